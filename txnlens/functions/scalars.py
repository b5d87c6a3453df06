"""Money, date and privacy Column functions (native expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema
from .text import S, collapse_blanks

_NUMERIC = rf"^{S}*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?{S}*$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_amount(col: Column | str) -> Column:
    """Strip the rupee sign, commas and spaces, then a number; anything else is 0.0.

    Declared difference: ``nan``, ``inf`` and ``1_000`` give 0.0 here.
    """
    stripped = F.regexp_replace(_c(col), "[₹, ]", "")
    return F.coalesce(
        F.when(stripped.rlike(_NUMERIC), F.trim(collapse_blanks(stripped)).try_cast("double")),
        F.lit(0.0),
    )


def parse_flexible_date(col: Column | str, formats: Sequence[str] = schema.FLEXIBLE_DATE_FORMATS) -> Column:
    """First format that parses wins (so 01/02/2024 is 1 February); none -> null."""
    s = collapse_blanks(col)
    return F.coalesce(*[F.try_to_date(s, f) for f in formats])


def date_range_label(start: Column | str, end: Column | str) -> Column:
    days = F.datediff(_c(end), _c(start))
    return (
        F.when(days <= 7, "This week")
        .when(days <= 31, "This month")
        .when(days <= 93, "Last 3 months")
        .when(days <= 186, "Last 6 months")
        .otherwise(F.concat(days.cast("string"), F.lit(" days")))
    )


def month_year_key(col: Column | str) -> Column:
    return F.date_format(_c(col), "yyyy-MM")


def day_name(col: Column | str) -> Column:
    return F.date_format(_c(col), "EEEE")


def hash_sensitive(col: Column | str) -> Column:
    """First 16 hex characters of SHA-256 over the UTF-8 text."""
    return F.substring(F.sha2(_c(col).cast("string"), 256), 1, 16)


def mask_account(col: Column | str) -> Column:
    c = _c(col).cast("string")
    n = F.length(c)
    return F.when(n <= 4, c).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(c, F.lit(4))))


def money(col: Column | str) -> Column:
    """Amount as exact decimal(18,2)."""
    return _c(col).cast(schema.MONEY)


def as_double(col: Column | str) -> Column:
    return _c(col).cast("double")
