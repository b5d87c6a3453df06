"""Vocabularies, bins and rule thresholds.

Everything here is a default; every operator takes the value as a parameter.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# ---------------------------------------------------------------------------
# These must equal the behaviour being reproduced.
# ---------------------------------------------------------------------------

# Keyword groups in their configured order.  A later group that matches
# overrides an earlier one (last match wins); matching is substring search.
CATEGORY_KEYWORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Food & Dining", ("zomato", "swiggy", "restaurant", "food", "dining", "pizza", "dominos", "kfc")),
    ("Transportation", ("uber", "ola", "cab", "metro", "bus", "auto", "fuel", "petrol", "rapido")),
    ("Shopping", ("amazon", "flipkart", "myntra", "shopping", "mall", "ajio", "nykaa")),
    ("Entertainment", ("netflix", "prime", "hotstar", "spotify", "bookmyshow", "gaming")),
    ("Bills & Utilities", ("electricity", "airtel", "jio", "vi", "broadband", "recharge")),
    ("Groceries", ("bigbasket", "grofers", "dmart", "reliance", "grocery", "vegetables")),
    ("Transfer", ("transfer", "sent to", "received from", "wallet", "bank")),
    ("Others", ("atm", "cash", "miscellaneous")),
)
DEFAULT_CATEGORY = "Others"

# Merchant extraction: prefix words, stop words, generic names.
MERCHANT_PREFIXES = ("to", "from", "paid to", "sent to", "received from")
MERCHANT_STOPS = ("on", "for", "via")
MERCHANT_GENERIC = ("self", "bank", "account")
MERCHANT_UNKNOWN = "Unknown"

# Amount bins: right-closed edges and their labels.
AMOUNT_EDGES = (0, 100, 500, 1000, 5000, float("inf"))
AMOUNT_LABELS = ("Very Low", "Low", "Medium", "High", "Very High")

# Valid amount window after abs(): 0 < amount <= cap.
AMOUNT_CAP = 100000

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# App detection: the marker that stands first in the lower-cased text.
APP_MARKERS = (
    ("paytm", ("paytm",)),
    ("gpay", ("google pay", "gpay")),
    ("phonepe", ("phonepe", "phone pe")),
)
GENERIC_APP = "generic"

LINES_PER_CHUNK = 1000

# Recommendation rules.
HIGH_SPENDING_SHARE = 0.25
LOW_SAVINGS_RATE = 0.15
SMALL_TXN_AMOUNT = 200
SMALL_TXN_COUNT = 20
SUBSCRIPTION_MIN_COUNT = 3
RULE_EXCLUDED_CATEGORY = "Transfer"

# Insight thresholds.
LARGE_AVG_AMOUNT = 1000
FOOD_SHARE = 0.3
ENTERTAINMENT_SHARE = 0.2

# Validation.
REQUIRED_COLUMNS = ("date", "amount", "description", "transaction_type")
NULL_SHARE_WARN = 0.1

# Small-level grouping threshold, percent of rows.
SMALL_LEVEL_PCT = 5.0

# Date formats tried in order by parse_flexible_date (Spark patterns).
FLEXIBLE_DATE_FORMATS = ("d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "d MMM yyyy", "d MMMM yyyy", "M/d/yyyy")
