"""DuckDB SQL oracles, one per SQL-expressible query key.

The SQL is written apart from the Spark code; only the Unicode character classes (lists of code
points, themselves checked against Python's ``re`` in ``tests/test_properties.py``) are shared.
Fixed values (descriptions, keyword groups, message texts, patterns) stand here a second time on
purpose, so that a slip in one copy shows.  Dedupe is a ``row_number`` window,
parsers are checked against a projection of the source rows, top-k and mode
are windows, zero-filled levels come from ``GROUP BY`` with ``CASE``.
Tables ``events lineitem part orders customer documents conversations`` are views.
"""

from __future__ import annotations

from txnlens.functions.text import S_CHARS, W_CHARS

S = f"[{S_CHARS}]"
NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------------------
# Building blocks
# ---------------------------------------------------------------------------

DESCS = (
    "Paid to Zomato on UPI", "Sent to Ola Cabs via wallet", "Received from Ravi Kumar",
    "Paid to Amazon Pay for order 24", "Netflix subscription", "ATM cash withdrawal",
    "Airtel recharge #99", "Paid to 7Eleven store", "BigBasket groceries", "Transfer to self",
    "Cola service centre", "Paid to Big Onion", "Uber ride -- auto", "to Dmart", "Spotify", "UPI",
)
DESC_CASE = "CASE CAST(event_id % 16 AS INTEGER) " + " ".join(
    f"WHEN {i} THEN {q(d)}" for i, d in enumerate(DESCS)) + " END"

TXN = f"""SELECT user_id AS statement_id, user_id AS account_id, event_id AS line_no, CAST(ts AS DATE) AS date,
  ts AS datetime, {DESC_CASE} AS description, CAST(value AS DECIMAL(18,2)) AS amount,
  CASE WHEN event_type IN ('purchase','view','click') THEN 'debit' ELSE 'credit' END AS transaction_type,
  CASE CAST(user_id % 3 AS INTEGER) WHEN 0 THEN 'paytm' WHEN 1 THEN 'gpay' ELSE 'phonepe' END AS app_source,
  CAST(month(ts) AS INTEGER) AS month, CAST(year(ts) AS INTEGER) AS year
FROM events"""

TXN_BIG = """SELECT l_suppkey AS statement_id, l_suppkey AS account_id, l_orderkey * 8 + l_linenumber AS line_no,
  CAST(l_shipdate AS DATE) AS date, l_shipdate AS datetime, p_name AS description,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
  CASE WHEN l_returnflag IN ('A','N') THEN 'debit' ELSE 'credit' END AS transaction_type,
  'paytm' AS app_source, CAST(month(l_shipdate) AS INTEGER) AS month, CAST(year(l_shipdate) AS INTEGER) AS year
FROM lineitem JOIN part ON l_partkey = p_partkey"""


TXN_DIRTY = f"""SELECT statement_id, account_id, line_no * 2 + copy AS line_no, date, datetime,
  CASE WHEN account_id % 4 = 1 AND line_no % 3 = 0 THEN NULL
       WHEN account_id % 5 = 2 AND line_no % 4 <> 1 THEN 'Swiggy dinner order'
       WHEN account_id % 6 = 3 AND line_no % 8 = 5 THEN 'Monthly SIP mutual fund' ELSE description END AS description,
  CASE WHEN line_no % 17 = 4 THEN NULL WHEN line_no % 11 = 3 THEN CAST(0 AS DECIMAL(18,2))
       WHEN line_no % 7 = 2 THEN -amount ELSE amount END AS amount,
  transaction_type, app_source, month, year
FROM (SELECT *, unnest(CASE WHEN line_no % 5 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM ({TXN}))"""


def clean_desc(x: str) -> str:
    inner = f"regexp_replace(lower({x}), '[^{W_CHARS}{S_CHARS}]', ' ', 'g')"
    return f"trim(regexp_replace({inner}, '{S}+', ' ', 'g'), ' ')"


def title(x: str) -> str:
    # RE2 has no lookahead: a match consumes the letter it marks before, so a
    # second pass marks the pairs the first one skipped (they never touch)
    once = "regexp_replace({}, '([^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}} ])(\\p{{L}})', '\\1' || chr(1) || ' \\2', 'g')"
    marked = once.format(once.format(x))
    words = f"list_transform(string_split({marked}, ' '), lambda w: upper(w[1]) || lower(w[2:]))"
    return f"replace(array_to_string({words}, ' '), chr(1) || ' ', '')"


MERCHANT_RE = (f"(?i)(?:to|from|paid to|sent to|received from){S}+([a-z{S_CHARS}&]+?)"
               f"(?:{S}+on|{S}+for|{S}+via|$)")


def merchant(x: str) -> str:
    found = f"trim(regexp_extract({x}, '{MERCHANT_RE}', 1), ' ')"
    words = f"string_split({x}, ' ')"
    return (f"CASE WHEN {x} IS NULL THEN 'Unknown' "
            f"WHEN regexp_matches({x}, '{MERCHANT_RE}') AND {found} NOT IN ('self','bank','account') "
            f"THEN {title(found)} "
            f"WHEN len({words}) > 1 AND {words}[1] IN ('to','from') THEN {title(words + '[2]')} "
            f"ELSE {title(f'array_to_string({words}[1:2], chr(32))')} END")


# The keyword groups, as alternations.
VOCAB = (
    ("Food & Dining", "zomato|swiggy|restaurant|food|dining|pizza|dominos|kfc"),
    ("Transportation", "uber|ola|cab|metro|bus|auto|fuel|petrol|rapido"),
    ("Shopping", "amazon|flipkart|myntra|shopping|mall|ajio|nykaa"),
    ("Entertainment", "netflix|prime|hotstar|spotify|bookmyshow|gaming"),
    ("Bills & Utilities", "electricity|airtel|jio|vi|broadband|recharge"),
    ("Groceries", "bigbasket|grofers|dmart|reliance|grocery|vegetables"),
    ("Transfer", "transfer|sent to|received from|wallet|bank"),
    ("Others", "atm|cash|miscellaneous"),
)


INVESTING = (("Investment", "sip|mutual fund"),)


def category(x: str, more: tuple = ()) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, '(?i)(?:{kw})') THEN {q(c)}" for c, kw in reversed(VOCAB + more))
    return f"CASE {whens} ELSE 'Others' END"


def amount_range(a: str) -> str:
    return (f"CASE WHEN {a} > 0 AND {a} <= 100 THEN 'Very Low' WHEN {a} > 100 AND {a} <= 500 THEN 'Low' "
            f"WHEN {a} > 500 AND {a} <= 1000 THEN 'Medium' WHEN {a} > 1000 AND {a} <= 5000 THEN 'High' "
            f"WHEN {a} > 5000 THEN 'Very High' END")


DEDUP_ORDER = ("line_no NULLS FIRST, statement_id NULLS FIRST, datetime NULLS FIRST, transaction_type NULLS FIRST, "
               "app_source NULLS FIRST, month NULLS FIRST, year NULLS FIRST")

def clean_ctes(more: tuple = ()) -> str:
    return f"""c_dedup AS (
  SELECT * EXCLUDE (_rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY account_id, date, amount, description ORDER BY {DEDUP_ORDER}) AS _rn
    FROM src) WHERE _rn = 1),
c_amt AS (SELECT * REPLACE (abs(amount) AS amount) FROM c_dedup WHERE abs(amount) > 0 AND abs(amount) <= 100000),
c_desc AS (SELECT *, {clean_desc('description')} AS description_clean FROM c_amt),
c_enr AS (SELECT *, {merchant('description_clean')} AS merchant, {category('description_clean', more)} AS category,
  CAST(hour(datetime) AS INTEGER) AS hour, CAST(day(datetime) AS INTEGER) AS day_of_month,
  isodow(datetime) >= 6 AS is_weekend, {amount_range('amount')} AS amount_range FROM c_desc),
clean AS (SELECT *, count(*) OVER (PARTITION BY account_id, merchant) AS merchant_frequency FROM c_enr)"""

CLEAN_CTES = clean_ctes()

CLEAN_COLS = ("statement_id, account_id, line_no, date, datetime, description, CAST(amount AS DOUBLE) AS amount, "
              "transaction_type, app_source, month, year, description_clean, merchant, category, hour, day_of_month, "
              "is_weekend, amount_range, merchant_frequency")


def on_clean(body: str) -> str:
    return f"WITH src AS ({TXN}),\n{CLEAN_CTES}\n{body}"


def on_clean_big(body: str) -> str:
    return f"WITH src AS ({TXN_BIG}),\n{CLEAN_CTES}\n{body}"


def on_txn(body: str) -> str:
    return f"WITH txn AS ({TXN})\n{body}"


def on_dirty(body: str) -> str:
    return f"WITH txn AS ({TXN_DIRTY})\n{body}"


def on_txn_big(body: str) -> str:
    return f"WITH txn AS ({TXN_BIG})\n{body}"


# Rendered statements (same layouts as the Spark fixture) and the expected parse.
AMT_TXT = "'₹' || CAST(amount AS VARCHAR)"
LINE = (f"CASE app_source WHEN 'paytm' THEN strftime(datetime, '%d/%m/%Y %H:%M:%S') || ' ' || description || ' ' || {AMT_TXT} "
        f"WHEN 'gpay' THEN (CASE WHEN transaction_type = 'debit' THEN 'Paid to ' ELSE 'Received from ' END) || description "
        f"|| {NL} || strftime(datetime, '%-d %b %Y, %-I:%M %p') || {NL} || {AMT_TXT} "
        f"ELSE strftime(datetime, '%d-%m-%Y %H:%M') || ' ' || description || ' ' || {AMT_TXT} END")

STATEMENT_CTES = f"""txn AS ({TXN}),
r AS (SELECT account_id * 1048576 + line_no // 65536 AS statement_id, CAST((line_no % 65536) // 4096 + 1 AS INTEGER)
  AS page_no, account_id, app_source, line_no, datetime, description, amount, transaction_type, {LINE} AS line FROM txn),
pages AS (
  SELECT statement_id, page_no, string_agg(line, {NL} ORDER BY datetime, line_no) AS text
  FROM r GROUP BY 1, 2
  UNION ALL
  SELECT DISTINCT statement_id, 0 AS page_no, CASE app_source WHEN 'paytm' THEN 'Paytm statement'
    WHEN 'gpay' THEN 'Google Pay statement' ELSE 'Phonepe statement' END AS text FROM r),
statements AS (SELECT statement_id, string_agg(text, {NL} ORDER BY page_no) AS text FROM pages GROUP BY 1),
rec AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY page_no, datetime, line_no) - 1 AS k FROM r),
expected AS (
  SELECT statement_id, account_id, k, app_source,
    CASE app_source WHEN 'paytm' THEN date_trunc('second', datetime) ELSE date_trunc('minute', datetime) END AS datetime,
    CASE app_source WHEN 'gpay' THEN (CASE WHEN transaction_type = 'debit' THEN 'Paid to ' ELSE 'Received from ' END)
      || description ELSE description END AS description,
    CASE app_source WHEN 'paytm' THEN abs(amount) ELSE amount END AS amount,
    CASE app_source WHEN 'paytm' THEN (CASE WHEN contains(lower(description), 'paid') THEN 'debit' ELSE 'credit' END)
      WHEN 'gpay' THEN transaction_type
      ELSE (CASE WHEN contains(lower(description), 'sent') THEN 'debit' ELSE 'credit' END) END AS transaction_type
  FROM rec)"""

PARSED_COLS = ("statement_id, CAST(k AS BIGINT) AS line_no, datetime, description, CAST(amount AS DOUBLE) AS amount, "
               "transaction_type, app_source")


def on_statements(body: str) -> str:
    return f"WITH {STATEMENT_CTES}\n{body}"


def detect(text: str) -> str:
    def at(*words: str) -> str:
        return "least(" + ", ".join(f"coalesce(nullif(strpos(lower({text}), {q(w)}), 0), 1e18)" for w in words) + ", 1e18)"

    p, g, o = at("paytm"), at("google pay", "gpay"), at("phonepe", "phone pe")
    return (f"CASE WHEN least({p}, {g}, {o}) = 1e18 THEN 'generic' WHEN {p} = least({p}, {g}, {o}) THEN 'paytm' "
            f"WHEN {g} = least({g}, {o}) THEN 'gpay' ELSE 'phonepe' END")


def top_n(src: str, part: str, order: str, n: int, cols: str = "*") -> str:
    return (f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS _rn "
            f"FROM {src}) WHERE _rn <= {n}")


DEBIT = "transaction_type = 'debit'"
CREDIT = "transaction_type = 'credit'"
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
WEEKDAY_VALUES = ", ".join(f"({i}, {q(d)})" for i, d in enumerate(WEEKDAYS))


def pct_txt(x: str) -> str:
    return f"CAST(CAST(({x}) * 100 AS DECIMAL(38,1)) AS VARCHAR) || '%'"


def money_txt(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(38,2)) AS VARCHAR)"


NUMERIC_RE = f"^{S}*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?{S}*$"
ACCOUNT_RE = "[0-9]{10,}"
PHONE_RE = f"[+]?[0-9{S_CHARS}\\-$]{{10,}}"
EMAIL_RE = "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b"

SQL: dict[str, str] = {}

# --- 2.1 / 2.2 statements and parsing ------------------------------------------

SQL["assemble_statement_text"] = on_statements("SELECT statement_id, text FROM statements")
SQL["detect_app_source"] = on_statements(f"SELECT statement_id, {detect('text')} AS app_source FROM statements")
SQL["split_statement_lines"] = on_statements("""SELECT statement_id, CAST(line_no AS INTEGER) AS line_no,
  CAST(line_no // 1000 AS INTEGER) AS chunk_no, line FROM (
  SELECT statement_id, generate_subscripts(arr, 1) - 1 AS line_no, unnest(arr) AS line
  FROM (SELECT statement_id, string_split(text, chr(10)) AS arr FROM statements))""")
for _app in ("paytm", "gpay", "phonepe"):
    SQL[f"parse_{_app}"] = on_statements(f"SELECT {PARSED_COLS} FROM expected WHERE app_source = '{_app}'")
SQL["parse_statements"] = on_statements(f"SELECT {PARSED_COLS} FROM expected")
SQL["union_parsed"] = SQL["parse_statements"]
SQL["parse_long_statements"] = SQL["parse_statements"]
SQL["parse_generic"] = on_statements(f"""SELECT statement_id, CAST(k AS BIGINT) AS line_no,
  TIMESTAMP '2024-02-01 00:00:00' AS datetime,
  CASE app_source WHEN 'gpay' THEN {AMT_TXT} ELSE {LINE} END AS description,
  CAST(amount AS DOUBLE) AS amount, 'debit' AS transaction_type, 'generic' AS app_source FROM rec""")
SQL["assemble_transactions"] = on_statements("""SELECT statement_id, account_id, CAST(k AS BIGINT) AS line_no,
  CAST(datetime AS DATE) AS date, datetime, description, CAST(amount AS DOUBLE) AS amount, transaction_type,
  app_source, CAST(month(datetime) AS INTEGER) AS month, CAST(year(datetime) AS INTEGER) AS year FROM expected""")
# Statement files: every seventh undecodable, every eleventh blank, every thirteenth without a transaction.
FILE_CTES = f"""{STATEMENT_CTES},
files AS (SELECT statement_id, 'statements/' || statement_id || '.pdf' AS path, statement_id % 1001 % 7 = 1 AS broken,
  CASE WHEN statement_id % 1001 % 11 = 3 THEN 'blank' WHEN statement_id % 1001 % 13 = 5 THEN 'none' ELSE 'full' END AS kind
  FROM statements)"""
SQL["read_statement_pages"] = f"""WITH {FILE_CTES}
SELECT path, 0 AS page_no, CAST(NULL AS VARCHAR) AS text, 'failed: UnicodeDecodeError' AS status FROM files WHERE broken
UNION ALL SELECT path, 0, CASE kind WHEN 'blank' THEN ' ' || chr(10) ELSE 'Paytm statement' || chr(10) || 'nothing here' END, 'ok'
  FROM files WHERE NOT broken AND kind <> 'full'
UNION ALL SELECT path, CAST(row_number() OVER (PARTITION BY statement_id ORDER BY page_no) - 1 AS INTEGER), text, 'ok'
  FROM files JOIN pages USING (statement_id) WHERE NOT broken AND kind = 'full'"""
# Amounts whose whole part ends in 9 were made unreadable: rejected, or no match at all in the layout that wants cents.
SQL["parse_status"] = f"""WITH {FILE_CTES}
SELECT path, CASE WHEN broken OR kind = 'blank' THEN 'failed: no text' WHEN yes = 0 THEN 'failed: no transactions' ELSE 'ok' END
  AS status, yes AS n_transactions, no AS n_rejected FROM (
  SELECT path, broken, kind,
    count(*) FILTER (WHERE NOT broken AND kind = 'full' AND floor(amount) % 10 <> 9) AS yes,
    count(*) FILTER (WHERE NOT broken AND kind = 'full' AND floor(amount) % 10 = 9 AND app_source <> 'gpay') AS no
  FROM files JOIN expected USING (statement_id) GROUP BY path, broken, kind)"""

MS = "date_trunc('milliseconds', datetime)"
SQL["load_table"] = on_txn(f"SELECT * REPLACE ({MS} AS datetime, CAST(amount AS DOUBLE) AS amount) FROM txn")
SQL["save_table"] = on_clean(f"SELECT * REPLACE ({MS} AS datetime) FROM (SELECT {CLEAN_COLS} FROM clean)")
SQL["export_clean_csv"] = SQL["save_table"]
SQL["load_json_array"] = """SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text,
  array_to_string(string_split(text, ' '), '|') AS words FROM conversations"""

# --- 2.3 projections (text rules over descriptions, whole documents and whole conversation turns)


def on_texts(body: str) -> str:
    return f"""WITH texts AS (
  SELECT 'txn' AS src, CAST(line_no AS VARCHAR) AS id, description FROM ({TXN_DIRTY})
  UNION ALL SELECT 'doc', CAST(doc_id AS VARCHAR), text FROM documents
  UNION ALL SELECT 'turn', conv_id || '-' || turn, text FROM conversations)
{body}"""


# -------------------------------------------------------------

SQL["abs_amount"] = on_dirty("SELECT account_id, line_no, CAST(abs(amount) AS DOUBLE) AS amount FROM txn")
SQL["clean_description"] = on_texts(f"SELECT src, id, {clean_desc('description')} AS description_clean FROM texts")
SQL["extract_merchant"] = on_texts(f"SELECT src, id, {merchant(clean_desc('description'))} AS merchant FROM texts")
SQL["categorize"] = on_texts(f"SELECT src, id, {category(clean_desc('description'))} AS category FROM texts")
SQL["derive_time_features"] = on_txn("""SELECT line_no, CAST(hour(datetime) AS INTEGER) AS hour,
  CAST(day(datetime) AS INTEGER) AS day_of_month, isodow(datetime) >= 6 AS is_weekend FROM txn""")
SQL["amount_range"] = on_txn_big(f"""SELECT account_id, line_no, CAST(abs(amount) AS DOUBLE) AS amount,
  {amount_range('abs(amount)')} AS amount_range FROM txn""")
SQL["month_year_key"] = on_txn_big("SELECT account_id, line_no, strftime(date, '%Y-%m') AS month_year FROM txn")
SQL["day_name"] = on_txn_big("SELECT account_id, line_no, dayname(date) AS day_name FROM txn")
SQL["typed_projection"] = on_clean_big(f"SELECT {CLEAN_COLS} FROM clean")
SQL["clean_transactions"] = on_clean(f"SELECT {CLEAN_COLS} FROM clean")

VOCABULARY = f"""SELECT DISTINCT keyword, length(keyword) % 7 AS priority, 'group ' || length(keyword) AS category FROM (
  SELECT unnest(string_split({clean_desc('text')}, ' ')) AS keyword FROM benchmark) WHERE length(keyword) >= 4
  UNION SELECT DISTINCT lower(p_name), length(p_name) % 7, 'group ' || length(p_name) FROM part"""
SQL["categorize_by_table"] = f"""WITH texts AS (
  SELECT 'txn' AS src, CAST(line_no AS VARCHAR) AS id, description FROM ({TXN_DIRTY})
  UNION ALL SELECT 'doc', CAST(doc_id AS VARCHAR), text FROM documents
  UNION ALL SELECT 'turn', conv_id || '-' || turn, text FROM conversations),
cleaned AS (SELECT src, id, {clean_desc('description')} AS d FROM texts),
found AS (SELECT d, arg_max(category, (priority, category)) AS category
  FROM (SELECT DISTINCT d FROM cleaned) JOIN ({VOCABULARY}) ON contains(d, keyword) GROUP BY d)
SELECT src, id, coalesce(category, 'Others') AS category FROM cleaned LEFT JOIN found USING (d)"""

# --- 2.4 filters ---------------------------------------------------------------------

SQL["filter_valid_amounts"] = on_txn_big("""SELECT account_id, line_no, CAST(abs(amount) AS DOUBLE) AS amount
  FROM txn WHERE abs(amount) > 0 AND abs(amount) <= 100000""")
SQL["filter_by_type"] = on_clean(f"SELECT account_id, line_no, CAST(amount AS DOUBLE) AS amount FROM clean WHERE {DEBIT}")
SQL["filter_by_categories"] = on_clean("""SELECT account_id, line_no, category, CAST(amount AS DOUBLE) AS amount
  FROM clean WHERE category IN ('Food & Dining', 'Groceries')""")
SQL["filter_by_date_range"] = on_clean_big("""SELECT account_id, line_no, date, CAST(amount AS DOUBLE) AS amount
  FROM clean WHERE date >= DATE '1996-01-01' AND date <= DATE '1997-06-30'""")
SQL["filter_by_amount_range"] = on_clean_big("""SELECT account_id, line_no, CAST(amount AS DOUBLE) AS amount
  FROM clean WHERE amount >= 1000 AND amount <= 5000""")
SQL["filter_by_merchants"] = on_clean("""SELECT account_id, line_no, merchant, CAST(amount AS DOUBLE) AS amount
  FROM clean WHERE merchant IN ('Zomato', 'Dmart', 'Big')""")
SQL["filter_small_debits"] = on_clean(f"""SELECT account_id, line_no, CAST(amount AS DOUBLE) AS amount
  FROM clean WHERE {DEBIT} AND amount < 200""")
SQL["filter_weekend"] = on_clean("SELECT account_id, line_no, CAST(amount AS DOUBLE) AS amount FROM clean WHERE is_weekend")
SQL["column_bounds"] = on_clean("""SELECT account_id, min(date) AS min_date, max(date) AS max_date,
  CAST(min(amount) AS DOUBLE) AS min_amount, CAST(max(amount) AS DOUBLE) AS max_amount FROM clean GROUP BY account_id""")
SQL["distinct_values"] = on_clean("SELECT DISTINCT account_id, merchant FROM clean")

# --- 2.5 joins -------------------------------------------------------------------------

SQL["merchant_frequency"] = on_clean("SELECT account_id, line_no, merchant, merchant_frequency FROM clean")
SQL["semi_join_top_merchants"] = on_clean_big(f"""SELECT account_id, line_no, merchant, CAST(amount AS DOUBLE) AS amount
  FROM clean WHERE (account_id, merchant) IN (
    {top_n('(SELECT account_id, merchant, sum(amount) AS t FROM clean GROUP BY 1, 2)', 'account_id',
           't DESC, merchant ASC', 5, 'account_id, merchant')})""")
SQL["reindex_weekdays"] = on_clean(f"""SELECT a.account_id, CAST(w.dow AS INTEGER) AS dow, w.day_name,
  CAST(s.amount AS DOUBLE) AS amount
  FROM (SELECT DISTINCT account_id FROM clean WHERE {DEBIT}) a
  CROSS JOIN (VALUES {WEEKDAY_VALUES}) w(dow, day_name)
  LEFT JOIN (SELECT account_id, dayname(datetime) AS day_name, sum(amount) AS amount FROM clean WHERE {DEBIT}
             GROUP BY 1, 2) s ON s.account_id = a.account_id AND s.day_name = w.day_name""")


def small_levels(col: str) -> str:
    return on_clean(f"""SELECT c.account_id, c.line_no,
  CASE WHEN s.{col} IS NOT NULL THEN 'Others' ELSE c.{col} END AS {col}
  FROM clean c LEFT JOIN (
    SELECT account_id, {col} FROM (
      SELECT account_id, {col}, count(*) AS n, sum(count(*)) OVER (PARTITION BY account_id) AS total
      FROM clean GROUP BY account_id, {col})
    WHERE {col} IS NOT NULL AND CAST(n AS DOUBLE) / CAST(total AS DOUBLE) * 100 < 5.0) s
  ON s.account_id = c.account_id AND s.{col} = c.{col}""")


SQL["replace_small_levels"] = on_clean("""SELECT account_id, line_no,
  CASE WHEN category IN (SELECT category FROM clean GROUP BY 1 HAVING count(*) * 100.0 / (SELECT count(*) FROM clean) < 5)
    THEN 'Others' ELSE category END AS category FROM clean""")
SQL["group_small_categories"] = small_levels("merchant")

# --- 2.6 aggregations ---------------------------------------------------------------------

SPENT = f"coalesce(sum(CASE WHEN {DEBIT} THEN amount END), 0)"
RECEIVED = f"coalesce(sum(CASE WHEN {CREDIT} THEN amount END), 0)"
AVG = "CAST(sum(amount) AS DOUBLE) / count(amount)"

SQL["overview_metrics"] = on_clean(f"""SELECT account_id, count(*) AS n_transactions,
  CAST({SPENT} AS DOUBLE) AS total_spent, CAST({RECEIVED} AS DOUBLE) AS total_received,
  CAST({RECEIVED} - {SPENT} AS DOUBLE) AS net_flow, {AVG} AS avg_amount,
  min(date) AS min_date, max(date) AS max_date FROM clean GROUP BY account_id""")

TOP_MERCH = top_n("(SELECT account_id, merchant, count(*) AS n FROM clean GROUP BY 1, 2)", "account_id",
                  "n DESC, merchant ASC", 5, "account_id, merchant, n")
SQL["summary_stats"] = on_clean(f"""
SELECT account_id, 'total_transactions' AS metric, CAST(NULL AS VARCHAR) AS level, CAST(count(*) AS DOUBLE) AS value
  FROM clean GROUP BY account_id
UNION ALL SELECT account_id, 'total_amount', NULL, CAST(sum(amount) AS DOUBLE) FROM clean GROUP BY account_id
UNION ALL SELECT account_id, 'avg_transaction', NULL, {AVG} FROM clean GROUP BY account_id
UNION ALL SELECT account_id, 'start_date', CAST(min(date) AS VARCHAR), NULL FROM clean GROUP BY account_id
UNION ALL SELECT account_id, 'end_date', CAST(max(date) AS VARCHAR), NULL FROM clean GROUP BY account_id
UNION ALL SELECT account_id, 'category_count', category, CAST(count(*) AS DOUBLE) FROM clean GROUP BY 1, 3
UNION ALL SELECT account_id, 'top_merchant', merchant, CAST(n AS DOUBLE) FROM ({TOP_MERCH})
UNION ALL SELECT account_id, 'type_count', transaction_type, CAST(count(*) AS DOUBLE) FROM clean GROUP BY 1, 3""")

def entries(name: str, n: str, src: str) -> str:
    return f"SELECT account_id, string_agg({name} || '=' || {n}, ';' ORDER BY {name}) AS e FROM ({src}) GROUP BY 1"


SQL["summary_maps"] = on_clean(f"""
SELECT account_id, total_transactions, total_amount, avg_transaction, start_date, end_date, c.e AS categories,
  t.e AS top_merchants, k.e AS transaction_types FROM (
  SELECT account_id, count(*) AS total_transactions, CAST(sum(amount) AS DOUBLE) AS total_amount, {AVG} AS avg_transaction,
    min(date) AS start_date, max(date) AS end_date FROM clean GROUP BY account_id)
JOIN ({entries('category', 'n', 'SELECT account_id, category, count(*) AS n FROM clean GROUP BY 1, 2')}) c USING (account_id)
JOIN ({entries('merchant', 'n', TOP_MERCH)}) t USING (account_id)
JOIN ({entries('transaction_type', 'n', 'SELECT account_id, transaction_type, count(*) AS n FROM clean GROUP BY 1, 2')}) k
  USING (account_id)""")

CAT_SPEND = f"SELECT account_id, category, {SPENT} AS amount FROM clean GROUP BY account_id, category"
SQL["category_spending"] = on_clean(f"SELECT account_id, category, CAST(amount AS DOUBLE) AS amount FROM ({CAT_SPEND})")
SQL["sort_by_metric"] = on_clean(f"""SELECT account_id, category, CAST(amount AS DOUBLE) AS amount,
  CAST(row_number() OVER (PARTITION BY account_id ORDER BY amount, category) AS INTEGER) AS place FROM ({CAT_SPEND})""")

_SEL = f"{DEBIT} AND category IN ('Food & Dining', 'Groceries', 'Transfer')"
SQL["category_stats"] = on_clean(f"""SELECT account_id, category,
  CAST(coalesce(sum(CASE WHEN {_SEL} THEN amount END), 0) AS DOUBLE) AS total_amount,
  CAST(sum(CASE WHEN {_SEL} THEN amount END) AS DOUBLE) / NULLIF(count(CASE WHEN {_SEL} THEN amount END), 0)
    AS average_amount,
  count(CASE WHEN {_SEL} THEN amount END) AS transaction_count,
  count(DISTINCT CASE WHEN {_SEL} THEN merchant END) AS unique_merchants
  FROM clean GROUP BY account_id, category""")
SQL["category_counts"] = on_clean("SELECT account_id, category, count(*) AS n FROM clean GROUP BY 1, 2")
SQL["transaction_type_counts"] = on_clean("""SELECT account_id, transaction_type,
  count(*) FILTER (WHERE amount >= 20 AND amount <= 200) AS n FROM clean GROUP BY 1, 2""")
SQL["daily_spending"] = on_clean(f"""SELECT account_id, date, CAST(sum(amount) AS DOUBLE) AS amount FROM clean
  WHERE {DEBIT} AND date >= DATE '2024-01-05' AND date <= DATE '2024-01-20' GROUP BY 1, 2""")
SQL["monthly_spending"] = on_clean_big(f"""SELECT account_id, strftime(datetime, '%Y-%m') AS month_year,
  CAST(sum(amount) AS DOUBLE) AS amount FROM clean WHERE {DEBIT} GROUP BY 1, 2""")
SQL["day_of_week_spending"] = on_clean(f"""SELECT a.account_id, CAST(w.dow AS INTEGER) AS dow, w.day_name,
  CAST(s.amount AS DOUBLE) AS amount
  FROM (SELECT DISTINCT account_id FROM clean) a CROSS JOIN (VALUES {WEEKDAY_VALUES}) w(dow, day_name)
  LEFT JOIN (SELECT account_id, isodow(datetime) - 1 AS dow, sum(amount) AS amount FROM clean WHERE {DEBIT}
             GROUP BY 1, 2) s ON s.account_id = a.account_id AND s.dow = w.dow""")
SQL["hourly_pattern"] = on_clean("""SELECT account_id, hour, CAST(sum(amount) AS DOUBLE) AS total_amount,
  count(*) AS n FROM clean GROUP BY 1, 2""")
SQL["amount_histogram"] = on_clean_big("""SELECT account_id, bin, mn + bin * ((mx - mn) / 30) AS lo,
  mn + (bin + 1) * ((mx - mn) / 30) AS hi, count(*) AS n FROM (
  SELECT account_id, mn, mx, CAST(CASE WHEN (mx - mn) / 30 = 0 THEN 0
    ELSE least(floor((a - mn) / ((mx - mn) / 30)), 29) END AS INTEGER) AS bin FROM (
    SELECT account_id, CAST(amount AS DOUBLE) AS a,
      min(CAST(amount AS DOUBLE)) OVER (PARTITION BY account_id) AS mn,
      max(CAST(amount AS DOUBLE)) OVER (PARTITION BY account_id) AS mx FROM clean))
GROUP BY account_id, bin, mn, mx""")
SQL["top_merchants_by_count"] = on_clean(top_n(
    "(SELECT account_id, merchant, count(*) AS n FROM clean GROUP BY 1, 2)", "account_id",
    "n DESC, merchant ASC", 10, "account_id, merchant, n"))
SQL["merchant_stats"] = on_clean_big(f"""SELECT account_id, merchant, CAST(total_amount AS DOUBLE) AS total_amount,
  average_amount, transaction_count, primary_category FROM (
  SELECT s.*, m.category AS primary_category,
    row_number() OVER (PARTITION BY s.account_id ORDER BY s.total_amount DESC, s.merchant ASC) AS _r FROM (
    SELECT account_id, merchant, sum(amount) AS total_amount, {AVG} AS average_amount, count(*) AS transaction_count
    FROM clean GROUP BY 1, 2) s
  JOIN ({top_n('(SELECT account_id, merchant, category, count(*) AS n FROM clean GROUP BY 1, 2, 3)',
               'account_id, merchant', 'n DESC, category ASC', 1, 'account_id, merchant, category')}) m
  ON m.account_id = s.account_id AND m.merchant = s.merchant)
WHERE _r <= 10""")
SQL["merchant_spending_trends"] = on_clean_big(f"""SELECT account_id, merchant, date,
  CAST(sum(amount) AS DOUBLE) AS amount FROM clean WHERE (account_id, merchant) IN (
    {top_n('(SELECT account_id, merchant, sum(amount) AS t FROM clean GROUP BY 1, 2)', 'account_id',
           't DESC, merchant ASC', 5, 'account_id, merchant')})
  GROUP BY 1, 2, 3""")
SQL["weekend_vs_weekday"] = on_clean("""SELECT account_id,
  CAST(coalesce(sum(CASE WHEN is_weekend THEN amount END), 0) AS DOUBLE) AS weekend_amount,
  CAST(coalesce(sum(CASE WHEN NOT is_weekend THEN amount END), 0) AS DOUBLE) AS weekday_amount
  FROM clean GROUP BY account_id""")
SQL["category_share"] = on_clean(f"""SELECT account_id, category, CAST(amount AS DOUBLE) AS amount,
  CAST(amount AS DOUBLE) / NULLIF(CAST(sum(amount) OVER (PARTITION BY account_id) AS DOUBLE), 0) AS share
  FROM ({CAT_SPEND})""")

TOP_MERCH_BIG = TOP_MERCH
SQL["spending_summary"] = on_clean_big(f"""
SELECT account_id, 'total_spent' AS metric, CAST(NULL AS VARCHAR) AS level, CAST({SPENT} AS DOUBLE) AS value
  FROM clean GROUP BY account_id
UNION ALL SELECT account_id, 'total_received', NULL, CAST({RECEIVED} AS DOUBLE) FROM clean GROUP BY account_id
UNION ALL SELECT account_id, 'transaction_count', NULL, CAST(count(*) AS DOUBLE) FROM clean GROUP BY account_id
UNION ALL SELECT account_id, 'avg_transaction', NULL, {AVG} FROM clean GROUP BY account_id
UNION ALL SELECT account_id, 'weekend', NULL, CAST(coalesce(sum(CASE WHEN is_weekend THEN amount END), 0) AS DOUBLE)
  FROM clean GROUP BY account_id
UNION ALL SELECT account_id, 'weekday', NULL,
  CAST(coalesce(sum(CASE WHEN NOT is_weekend THEN amount END), 0) AS DOUBLE) FROM clean GROUP BY account_id
UNION ALL SELECT account_id, 'n_months', NULL,
  CAST(count(DISTINCT CASE WHEN {DEBIT} THEN year * 100 + month END) AS DOUBLE) FROM clean GROUP BY account_id
UNION ALL SELECT account_id, 'category_spending', category, CAST(amount AS DOUBLE) FROM ({CAT_SPEND})
UNION ALL SELECT account_id, 'monthly_spending', printf('%04d-%02d', year, month), CAST(sum(amount) AS DOUBLE)
  FROM clean WHERE {DEBIT} GROUP BY account_id, year, month
UNION ALL SELECT account_id, 'top_merchant', merchant, CAST(n AS DOUBLE) FROM ({TOP_MERCH_BIG})""")

# --- 2.7 windows ------------------------------------------------------------------------------

SQL["dedupe_near"] = on_dirty(f"""SELECT account_id, line_no, date, CAST(amount AS DOUBLE) AS amount, description,
  transaction_type FROM (SELECT *, row_number() OVER (PARTITION BY account_id, date, amount, description
  ORDER BY {DEDUP_ORDER}) AS _rn FROM txn) WHERE _rn = 1""")
SQL["recurring_merchants"] = on_clean(f"""SELECT account_id, merchant, count(*) AS n FROM clean WHERE {DEBIT}
  GROUP BY 1, 2 HAVING count(*) >= 3""")
SQL["pct_change"] = on_clean_big(f"""SELECT account_id, category, month_year, CAST(amount AS DOUBLE) AS amount,
  CAST(prev AS DOUBLE) AS prev_amount,
  CASE WHEN prev IS NULL THEN NULL WHEN CAST(prev AS DOUBLE) = 0 THEN 0.0
    ELSE (CAST(amount AS DOUBLE) - CAST(prev AS DOUBLE)) / CAST(prev AS DOUBLE) * 100 END AS pct_change FROM (
  SELECT *, lag(amount) OVER (PARTITION BY account_id, category ORDER BY month_year) AS prev FROM (
    SELECT account_id, category, strftime(datetime, '%Y-%m') AS month_year, sum(amount) AS amount
    FROM clean WHERE {DEBIT} GROUP BY 1, 2, 3))""")

SQL["pct_change_calendar"] = on_clean_big(f""",
sums AS (SELECT account_id, category, date_trunc('month', datetime) AS month, sum(amount) AS amount
  FROM clean WHERE {DEBIT} GROUP BY 1, 2, 3),
bounds AS (SELECT account_id, category, min(month) AS lo, max(max(month)) OVER (PARTITION BY account_id) AS hi
  FROM sums GROUP BY 1, 2),
spine AS (SELECT account_id, category, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS month
  FROM bounds),
filled AS (SELECT account_id, category, strftime(s.month, '%Y-%m') AS month_year, coalesce(amount, 0) AS amount,
  lag(coalesce(amount, 0)) OVER (PARTITION BY account_id, category ORDER BY s.month) AS prev
  FROM spine s LEFT JOIN sums USING (account_id, category, month))
SELECT account_id, category, month_year, CAST(amount AS DOUBLE) AS amount, CAST(prev AS DOUBLE) AS prev_amount,
  CASE WHEN prev IS NULL THEN NULL WHEN CAST(prev AS DOUBLE) = 0 THEN 0.0
    ELSE (CAST(amount AS DOUBLE) - CAST(prev AS DOUBLE)) / CAST(prev AS DOUBLE) * 100 END AS pct_change FROM filled""")
SQL["dedupe_near_batches"] = SQL["dedupe_near"]

# --- 2.8 top-k ------------------------------------------------------------------------------------

SQL["top_k"] = on_clean_big("""SELECT account_id, merchant, CAST(sum(amount) AS DOUBLE) AS total_amount FROM clean
  GROUP BY 1, 2 ORDER BY sum(amount) DESC, account_id, merchant LIMIT 10""")
TOP_CAT = top_n(f"({CAT_SPEND})", "account_id", "amount DESC, category ASC", 1, "account_id, category, amount")
SQL["top_category"] = on_clean(f"SELECT account_id, category, CAST(amount AS DOUBLE) AS amount FROM ({TOP_CAT})")

# --- 2.9 set operations ------------------------------------------------------------------------------

SQL["distinct_rows"] = on_dirty("""SELECT account_id, date, datetime, description, CAST(amount AS DOUBLE) AS amount,
  transaction_type, app_source, month, year FROM (
  SELECT DISTINCT account_id, date, datetime, description, amount, transaction_type, app_source, month, year FROM txn)""")

# --- 2.10 scalars --------------------------------------------------------------------------------------

SQL["to_amount"] = f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, token,
  CASE WHEN regexp_matches(s, '{NUMERIC_RE}')
    THEN coalesce(TRY_CAST(trim(regexp_replace(s, '{S}+', ' ', 'g'), ' ') AS DOUBLE), 0.0) ELSE 0.0 END AS amount
FROM (SELECT doc_id, pos, token, regexp_replace(token, '[₹, ]', '', 'g') AS s FROM (
  SELECT doc_id, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token FROM (
    SELECT doc_id, regexp_extract_all(text, '₹?[0-9][0-9,.]*') AS toks FROM documents)))"""
SQL["extract_numbers"] = """SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(tok AS DOUBLE) AS number FROM (
  SELECT doc_id, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS tok FROM (
    SELECT doc_id, regexp_extract_all(text, '[0-9]+\\.?[0-9]*') AS toks FROM documents))"""
SQL["clean_text"] = f"""SELECT doc_id, trim(regexp_replace(trim(regexp_replace(text, '{S}+', ' ', 'g'), ' '),
  '[^{W_CHARS}{S_CHARS}\\-\\.,:]', ' ', 'g'), ' ') AS text_clean FROM documents"""
SQL["parse_flexible_date"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 AND day(o_orderdate) <= 12
  THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE CAST(o_orderdate AS DATE) END
  AS parsed_date FROM orders"""
SQL["date_range_label"] = on_clean_big("""SELECT account_id, min_date, max_date,
  CASE WHEN d <= 7 THEN 'This week' WHEN d <= 31 THEN 'This month' WHEN d <= 93 THEN 'Last 3 months'
    WHEN d <= 186 THEN 'Last 6 months' ELSE CAST(d AS VARCHAR) || ' days' END AS label FROM (
  SELECT account_id, min(date) AS min_date, max(date) AS max_date, datediff('day', min(date), max(date)) AS d
  FROM clean GROUP BY account_id)""")
SQL["hash_sensitive"] = "SELECT c_custkey, substr(sha256(c_name), 1, 16) AS name_hash FROM customer"


def mask(x: str) -> str:
    return f"CASE WHEN length({x}) <= 4 THEN {x} ELSE repeat('*', length({x}) - 4) || right({x}, 4) END"


SQL["mask_account"] = (f"SELECT c_custkey, {mask('CAST(c_custkey AS VARCHAR)')} AS key_masked, "
                       f"{mask('c_name')} AS name_masked FROM customer")
SQL["cut_text"] = "SELECT doc_id, substr(text, 1, 100) AS head100, substr(text, 1, 500) || '...' AS head500 FROM documents"

# --- 2.11 quality ---------------------------------------------------------------------------------------

REQ = ("date", "amount", "description", "transaction_type")
_NULLS = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in REQ)
_HIGH = ", ".join(f"CASE WHEN null_{c} > n_rows * 0.1 THEN '{c}' END" for c in REQ)
SQL["validate_transactions"] = on_dirty(f"""SELECT *, n_rows > 0 AS is_valid, '' AS missing_columns,
  concat_ws(',', {_HIGH}) AS high_null_columns FROM (
  SELECT account_id, count(*) AS n_rows, {_NULLS}, count(*) FILTER (WHERE amount < 0) AS n_negative,
    count(*) FILTER (WHERE amount = 0) AS n_zero, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_amount,
    min(date) AS start_date, max(date) AS end_date FROM txn GROUP BY account_id)""")
_SOME = [c for c in REQ if c != "description"]
SQL["validate_on_write"] = on_dirty(f"""SELECT *, FALSE AS is_valid, 'description' AS missing_columns,
  concat_ws(',', {", ".join(f"CASE WHEN null_{c} > n_rows * 0.1 THEN '{c}' END" for c in _SOME)}) AS high_null_columns FROM (
  SELECT count(*) AS n_rows, {", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in _SOME)},
    count(*) FILTER (WHERE amount < 0) AS n_negative, count(*) FILTER (WHERE amount = 0) AS n_zero,
    CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_amount, min(date) AS start_date, max(date) AS end_date FROM txn)""")
SQL["check_not_empty"] = on_dirty("""SELECT account_id, coalesce(n, 0) AS n_rows, coalesce(n, 0) > 0 AS not_empty
  FROM (SELECT DISTINCT c_custkey AS account_id FROM customer)
  LEFT JOIN (SELECT account_id, count(*) AS n FROM txn GROUP BY 1) USING (account_id)""")
SQL["check_null_share"] = on_dirty(" UNION ALL ".join(
    f"SELECT account_id, '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS n_null, "
    f"count(*) FILTER (WHERE {c} IS NULL) > count(*) * 0.1 AS warn FROM txn GROUP BY account_id" for c in REQ))
SQL["check_amount_signs"] = """SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal < 0) AS n_negative,
  count(*) FILTER (WHERE c_acctbal = 0) AS n_zero FROM customer GROUP BY 1"""
SQL["validation_statistics"] = on_txn_big("""SELECT account_id, count(*) AS total_rows, min(date) AS start_date,
  max(date) AS end_date, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_amount FROM txn GROUP BY 1""")
SQL["scan_sensitive"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS column, n_account_numbers, n_phone_numbers, n_email_addresses,
  n_account_numbers > 0 AS has_account_numbers, n_phone_numbers > 0 AS has_phone_numbers,
  n_email_addresses > 0 AS has_email_addresses FROM (
  SELECT count(*) FILTER (WHERE regexp_matches(lower({c}), '{ACCOUNT_RE}')) AS n_account_numbers,
    count(*) FILTER (WHERE regexp_matches(lower({c}), '{PHONE_RE}')) AS n_phone_numbers,
    count(*) FILTER (WHERE regexp_matches(lower({c}), '{EMAIL_RE}')) AS n_email_addresses FROM documents)"""
    for c in ("text", "lang", "source"))

# --- 2.12 rules and insights -----------------------------------------------------------------------------

SHARE = f"""SELECT account_id, category, CAST(amount AS DOUBLE) / NULLIF(CAST(sum(amount) OVER
  (PARTITION BY account_id) AS DOUBLE), 0) AS share FROM ({CAT_SPEND})"""
RULE1 = f"""SELECT account_id, 1 AS rule_no, category AS item, share AS metric_value, 'Budgeting' AS category,
  'Your spending on ' || category || ' is ' || {pct_txt('share')} ||
  ' of your total expenses. Consider setting a budget for this category.' AS recommendation, 'High' AS impact
  FROM ({SHARE}) WHERE category <> 'Transfer' AND share > 0.25"""
RULE2 = f"""SELECT account_id, 2 AS rule_no, CAST(NULL AS VARCHAR) AS item, rate AS metric_value, 'Savings' AS category,
  'Your savings rate is only ' || {pct_txt('rate')} ||
  '. Aim for at least 20% by reducing non-essential spending.' AS recommendation, 'High' AS impact FROM (
  SELECT account_id, (income - expense) / income AS rate FROM (
    SELECT account_id, CAST({SPENT} AS DOUBLE) AS expense, CAST({RECEIVED} AS DOUBLE) AS income
    FROM clean GROUP BY account_id) WHERE income > 0) WHERE rate < 0.15"""
RULE3 = f"""SELECT account_id, 3 AS rule_no, CAST(NULL AS VARCHAR) AS item, CAST(n AS DOUBLE) AS metric_value,
  'Spending Habits' AS category, 'You have ' || CAST(n AS VARCHAR) ||
  ' small transactions under ₹200. These can add up; try tracking them for a week.' AS recommendation,
  'Medium' AS impact FROM (SELECT account_id, count(*) FILTER (WHERE {DEBIT} AND amount < 200) AS n
  FROM clean GROUP BY account_id) WHERE n > 20"""
RULE4 = f"""SELECT account_id, 4 AS rule_no, merchant AS item, CAST(n AS DOUBLE) AS metric_value,
  'Subscriptions' AS category, 'You have recurring payments to ' || merchant ||
  '. Ensure you are actively using this subscription.' AS recommendation, 'Medium' AS impact FROM (
  SELECT account_id, merchant, count(*) AS n FROM clean WHERE {DEBIT} GROUP BY 1, 2)
  WHERE n >= 3 AND merchant <> 'Unknown'"""
SQL["rule_high_spending_category"] = on_clean(RULE1)
SQL["rule_low_savings_rate"] = on_clean(RULE2)
SQL["rule_small_transactions"] = on_clean(RULE3)
SQL["rule_subscriptions"] = on_clean(RULE4)
SQL["recommendations"] = on_clean(f"{RULE1}\nUNION ALL {RULE2}\nUNION ALL {RULE3}\nUNION ALL {RULE4}")


def _cat(name: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN {DEBIT} AND category = {q(name)} THEN amount END), 0) AS DOUBLE)"


BASE = f"""SELECT account_id, CAST({SPENT} AS DOUBLE) AS spent, CAST({RECEIVED} AS DOUBLE) AS received, {AVG} AS avg,
  count(DISTINCT CASE WHEN {DEBIT} THEN year * 100 + month END) AS n_months, {_cat('Food & Dining')} AS food,
  {_cat('Entertainment')} AS entertainment, {_cat('Investment')} AS investment FROM clean GROUP BY account_id"""


def ins(section: str, seq: int, rule_id: str, value: str, text: str, where: str = "TRUE", src: str = "base") -> str:
    return (f"SELECT account_id, {q(section)} AS section, {seq} AS seq, {q(rule_id)} AS rule_id, "
            f"CAST({value} AS DOUBLE) AS metric_value, {text} AS text FROM {src} WHERE {where}")


INSIGHTS = {
    "insight_overspend": ins("key_insights", 1, "overspend", "spent - received",
                             q("Your spending exceeds income - consider budgeting"), "spent > received"),
    "insight_top_category": ins("key_insights", 2, "top_category", "amount",
                                f"'Highest spending: ' || category || ' (₹' || {money_txt('amount')} || ')'",
                                src=f"({TOP_CAT})"),
    "insight_transaction_size": ins("key_insights", 3, "transaction_size", "avg",
                                    "CASE WHEN avg > 1000 THEN 'High average transaction amount - mostly large "
                                    "purchases' ELSE 'Moderate spending pattern with small frequent transactions' END"),
    "insight_food_share": ins("improvement_areas", 1, "food_share", "food",
                              q("Food spending is high - consider home cooking"), "food > spent * 0.3"),
    "insight_entertainment_share": ins("improvement_areas", 2, "entertainment_share", "entertainment",
                                       q("Entertainment expenses are significant"), "entertainment > spent * 0.2"),
    "insight_investing": ins("positive_habits", 1, "investing", "investment", q("Good job on investing!"),
                             "investment > 0"),
    "insight_monthly_average": (
        ins("budget_recommendations", 1, "monthly_average", "spent / greatest(n_months, 1)",
            f"'Monthly spending average: ₹' || {money_txt('spent / greatest(n_months, 1)')}")
        + " UNION ALL " + ins("budget_recommendations", 2, "save_share", "NULL", q("Try to save 20% of income"))),
}
ON_DIRTY = f"WITH src AS ({TXN_DIRTY}),\n{clean_ctes(INVESTING)},\nbase AS ({BASE})"
for _k, _v in INSIGHTS.items():
    SQL[_k] = f"{ON_DIRTY}\n{_v}"
ALL_INSIGHTS = "\nUNION ALL ".join(INSIGHTS.values())
SQL["rule_based_insights"] = f"{ON_DIRTY}\n{ALL_INSIGHTS}"

TIPS = (
    "💡 Track your daily expenses to identify spending patterns",
    "🎯 Set monthly budgets for each category",
    "💰 Consider automating savings (even small amounts help)",
    "📱 Use UPI transaction limits to control spending",
    "📊 Review your spending weekly to stay on track",
)
TIP_VALUES = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(TIPS))
SQL["format_advice"] = f"""{ON_DIRTY},
ins AS ({ALL_INSIGHTS})
SELECT a.account_id, CAST(t.seq AS INTEGER) AS seq, t.line FROM (SELECT DISTINCT account_id FROM ins) a
  CROSS JOIN (VALUES {TIP_VALUES}) t(seq, line)
UNION ALL
SELECT account_id, CAST(seq + 4 AS INTEGER) AS seq, text AS line FROM ins WHERE section = 'improvement_areas'"""

PROMPT_HEAD = "You review the payments of one account. The figures below cover the whole period."
PROMPT_TAIL = ("Answer with one JSON object and nothing else. Its fields: key_insights, improvement_areas, positive_habits and "
               "budget_recommendations are lists of short sentences; additional_notes is a single text. "
               "Refer to amounts where they matter, and suggest only what the figures support.")
SQL["build_insight_prompt"] = on_clean(f"""SELECT account_id, concat_ws({NL}, {q(PROMPT_HEAD)}, 'spent: ₹' || {money_txt('spent')},
  'received: ₹' || {money_txt('received')}, 'mean payment: ₹' || {money_txt('avg')}, 'payments: ' || n,
  'spent by category: ' || cats, 'payments at the busiest merchants: ' || tops, {q(PROMPT_TAIL)}) AS prompt FROM (
  SELECT account_id, CAST({SPENT} AS DOUBLE) AS spent, CAST({RECEIVED} AS DOUBLE) AS received, {AVG} AS avg, count(*) AS n
  FROM clean GROUP BY account_id)
JOIN (SELECT account_id, string_agg(category || ' = ' || {money_txt('CAST(amount AS DOUBLE)')}, '; ' ORDER BY category) AS cats
  FROM ({CAT_SPEND}) GROUP BY 1) USING (account_id)
JOIN (SELECT account_id, string_agg(merchant || ' = ' || n, '; ' ORDER BY merchant) AS tops FROM ({TOP_MERCH}) GROUP BY 1)
  USING (account_id)""")

# The fixed model answers by the prompt's number of payments: a failure, prose, or JSON with two of the prompt's lines.
REVIEWED = f"""SELECT account_id, string_split(prompt, {NL}) AS lines,
  CAST(regexp_extract(prompt, 'payments: ([0-9]+)', 1) AS BIGINT) AS n FROM (SELECT * FROM prompts)"""
_JSON = """'{"key_insights": ["' || lines[2] || '", "' || lines[3] || '"], "additional_notes": "' || n || ' payments"}'"""
SQL["score_prompts"] = f"""WITH prompts AS ({SQL["build_insight_prompt"]})
SELECT account_id, CASE n % 3 WHEN 1 THEN 'I looked at ' || n || ' payments' WHEN 2 THEN {_JSON} END AS response,
  CASE n % 3 WHEN 0 THEN 'ConnectionError' END AS model_error FROM ({REVIEWED})"""
SQL["model_insights"] = f"""WITH src AS ({TXN}),
{clean_ctes()},
base AS ({BASE}),
prompts AS ({SQL["build_insight_prompt"]}),
reviewed AS ({REVIEWED})
SELECT account_id, 'model_generated' AS source, 'key_insights' AS section, CAST(i AS INTEGER) AS seq, lines[i + 1] AS text
  FROM reviewed, (VALUES (1), (2)) v(i) WHERE n % 3 = 2
UNION ALL SELECT account_id, 'model_generated', 'additional_notes', 1, n || ' payments' FROM reviewed WHERE n % 3 = 2
UNION ALL SELECT account_id, 'fallback', 'llm_analysis', 1, 'I looked at ' || n || ' payments' FROM reviewed WHERE n % 3 = 1
UNION ALL SELECT account_id, 'rules', section, CAST(seq AS INTEGER), text FROM ({ALL_INSIGHTS})
  WHERE account_id IN (SELECT account_id FROM reviewed WHERE n % 3 = 0)"""

ANSWERS = """SELECT conv_id || '-' || turn AS answer_id, (conv_id + turn) % 5 AS kind, replace(replace(text, '{', ''), '}', '') AS prose,
  coalesce(trim(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')), '') AS said FROM conversations"""
RAW = """CASE kind WHEN 2 THEN '{"key_insights": ["' || said || '"' WHEN 3 THEN said WHEN 4 THEN prose END"""
SQL["parse_insight_response"] = f"""SELECT answer_id, CASE kind WHEN 0 THEN said || '|b' ELSE '' END AS key_insights,
  '' AS improvement_areas, CASE kind WHEN 0 THEN said ELSE '' END AS positive_habits,
  CASE kind WHEN 1 THEN '{{"n":1}}|' || said ELSE '' END AS budget_recommendations,
  CASE kind WHEN 0 THEN said ELSE '' END AS additional_notes, {RAW} AS llm_analysis,
  CASE WHEN kind < 2 THEN 'model_generated' ELSE 'fallback' END AS insights_type FROM ({ANSWERS})"""
ADVICE_ROWS = {
    0: [(0, q("🔍 Key Insights:")), (1, "'- ' || said"), (2, "'- b'"), (2000, f"{NL} || '👍 Positive Habits:'"), (2001, "'- ' || said")],
    1: [(3000, f"{NL} || '💰 Budget Recommendations:'"), (3001, """'- {"n":1}'"""), (3002, "'- ' || said")],
}
SQL["format_model_advice"] = " UNION ALL ".join(
    [f"SELECT answer_id, CAST({seq} AS INTEGER) AS seq, {line} AS line FROM ({ANSWERS}) WHERE kind = {kind}"
     for kind, rows in ADVICE_ROWS.items() for seq, line in rows]
    + [f"SELECT answer_id, 9000, {NL} || '📝 Additional Notes: ' || said FROM ({ANSWERS}) WHERE kind = 0 AND length(said) > 0",
       f"SELECT answer_id, 0, 'Based on AI analysis of your spending patterns:' FROM ({ANSWERS}) WHERE kind >= 2",
       f"SELECT answer_id, 1, substr({RAW}, 1, 500) || '...' FROM ({ANSWERS}) WHERE kind >= 2"])


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
