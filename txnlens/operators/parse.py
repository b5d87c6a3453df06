"""Statement text -> transaction rows, with native expressions only.

Each app layout is one regex.  ``regexp_extract_all(text, p, 0)`` returns the
whole matches in text order, ``posexplode`` numbers them, and one
``regexp_replace`` of each (short) match string yields all its groups.
Re-matching a match string gives the same groups, and the match spans the
whole string, because the patterns have no anchors or look-arounds.

Blanks inside a matched date (non-breaking or narrow spaces, line breaks) are
normalised to one space before parsing, as Python's ``strptime`` accepts them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.text import S, S_CHARS, W, collapse_blanks

D2 = "[0-9]{2}"
AMOUNT_RUN = "[0-9,]+\\.?[0-9]*"

# The layouts of the statements (Java syntax).  (?d): '.' stops at '\n' only.
PAYTM = f"(?d)({D2}/{D2}/[0-9]{{4}}){S}+({D2}:{D2}:{D2}){S}+(.*?){S}+(₹{S}*{AMOUNT_RUN})"
GPAY = (f"(?id)(Paid to|Received from){S}*(.*?){S}*"
        f"([0-9]{{1,2}}{S}{W}{{3}}{S}[0-9]{{4}},{S}[0-9]{{1,2}}:{D2}{S}[AP]M){S}*"
        f"₹{S}*([0-9,]+\\.[0-9]{{2}})")
PHONEPE = f"(?d)({D2}-{D2}-[0-9]{{4}}){S}+({D2}:{D2}){S}+(.*?){S}+(₹{S}*{AMOUNT_RUN})"
GENERIC_AMOUNT = f"₹{S}*({AMOUNT_RUN})"


def _strip(c: Column) -> Column:
    """Python ``str.strip()``: remove Unicode blanks at both ends."""
    return F.regexp_replace(c, f"^{S}+|{S}+$", "")


def _money(c: Column) -> Column:
    return F.regexp_replace(c, f"[₹,{S_CHARS}]", "").try_cast(schema.MONEY)


def _ts(s: Column, fmt: str) -> Column:
    """Wall-clock time: read as UTC and taken apart in UTC, whatever the session's time zone
    (a zoned parse would shift hours that a clock change skips)."""
    instant = F.try_to_timestamp(F.concat(collapse_blanks(s), F.lit(" Z")), F.lit(f"{fmt} X"))
    seconds = F.unix_seconds(instant).cast(T.DecimalType(18, 6))
    zero = F.lit(0)
    return F.lit("1970-01-01").cast(T.TimestampNTZType()) + F.make_dt_interval(zero, zero, zero, seconds)


# ---------------------------------------------------------------------------
# Statement assembly and app detection
# ---------------------------------------------------------------------------

def assemble_statement_text(pages: DataFrame, id_col: str = "statement_id", carry: Sequence[str] = (),
                            separator: str = "\n") -> DataFrame:
    """Page texts joined in page order, one row per statement, for pages that
    come as rows.  Files are joined without a shuffle (``files.decode_files``).

    A statement is one document (one source file), so its pages are gathered
    into one row; ``carry`` columns are constant per statement (e.g. ``path``).
    """
    return (
        pages.groupBy(id_col, *carry)
        .agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("_p"))
        .select(id_col, *carry, F.array_join(F.transform("_p", lambda p: p["text"]), separator).alias("text"))
    )


def detect_app(text: Column | str = "text", markers=schema.APP_MARKERS, generic: str = schema.GENERIC_APP) -> Column:
    """The app whose marker stands first in the whole lower-cased text."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    found = [F.struct(F.instr(low, w).alias("at"), F.lit(app).alias("app")) for app, words in markers for w in words]
    first = F.array_min(F.filter(F.array(*found), lambda x: x["at"] > 0))
    return F.coalesce(first["app"], F.lit(generic))


def detect_app_source(statements: DataFrame, id_col: str = "statement_id") -> DataFrame:
    return statements.select(id_col, detect_app("text").alias("app_source"))


def split_statement_lines(statements: DataFrame, id_col: str = "statement_id",
                          chunk_lines: int = schema.LINES_PER_CHUNK) -> DataFrame:
    """One row per line: ``(statement_id, line_no, chunk_no, line)``."""
    return (
        statements.select(id_col, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .select(id_col, "line_no", (F.col("line_no") / chunk_lines).cast("int").alias("chunk_no"), "line")
    )


# ---------------------------------------------------------------------------
# Layout parsers: match string -> fields
# ---------------------------------------------------------------------------

# All groups of a match in one regex pass: ``regexp_replace`` of the match
# string with its groups joined by SEP, then ``split``.  The free-text group
# (description / name) goes last and the split is limited, so a SEP inside it
# cannot shift the other fields (they are digits and blanks only).
SEP = "\u0001"
GROUP_ORDER = {"paytm": (1, 2, 4, 3), "gpay": (1, 3, 4, 2), "phonepe": (1, 2, 4, 3)}


def match_parts(m: Column, app: str) -> Column:
    order = GROUP_ORDER[app]
    joined = F.regexp_replace(m, PATTERNS[app], SEP.join(f"${g}" for g in order))
    return F.split(joined, SEP, len(order))


def _paytm_fields(p: Column) -> dict[str, Column]:
    date, time, amount, desc = (F.get(p, i) for i in range(4))
    dt = _ts(F.concat_ws(" ", date, time), "dd/MM/yyyy HH:mm:ss")
    return {
        "datetime": dt,
        "description": _strip(desc),
        "amount": F.abs(_money(amount)),
        "transaction_type": F.when(F.lower(desc).contains("paid"), "debit").otherwise("credit"),
    }


def _gpay_fields(p: Column) -> dict[str, Column]:
    marker, when, amount, name = (F.get(p, i) for i in range(4))
    return {
        "datetime": _ts(when, "d MMM yyyy, h:mm a"),
        "description": _strip(F.concat_ws(" ", marker, name)),
        "amount": _money(amount),
        # case-sensitive test on a case-insensitive match: "PAID TO" is a credit
        "transaction_type": F.when(marker.contains("Paid"), "debit").otherwise("credit"),
    }


def _phonepe_fields(p: Column) -> dict[str, Column]:
    date, time, amount, desc = (F.get(p, i) for i in range(4))
    dt = _ts(F.concat_ws(" ", date, time), "dd-MM-yyyy HH:mm")
    return {
        "datetime": dt,
        "description": _strip(desc),
        "amount": _money(amount),
        "transaction_type": F.when(F.lower(desc).contains("sent"), "debit").otherwise("credit"),
    }


def _generic_fields(m: Column, as_of: Column) -> dict[str, Column]:
    return {
        "datetime": as_of.cast(T.TimestampNTZType()),
        "description": _strip(m),
        "amount": _money(F.regexp_extract(m, GENERIC_AMOUNT, 1)),
        "transaction_type": F.lit("debit"),
    }


PATTERNS = {"paytm": PAYTM, "gpay": GPAY, "phonepe": PHONEPE}
PARSERS: dict[str, Callable[..., dict[str, Column]]] = {
    "paytm": _paytm_fields, "gpay": _gpay_fields, "phonepe": _phonepe_fields,
}


def statement_matches(text: Column, app: Column) -> Column:
    """Whole matches of the statement's layout, in text order."""
    generic_lines = F.filter(F.split(text, "\n", -1), lambda ln: ln.contains("₹"))
    expr = None
    for name, pat in PATTERNS.items():
        hit = F.regexp_extract_all(text, F.lit(pat), 0)
        expr = F.when(app == name, hit) if expr is None else expr.when(app == name, hit)
    return expr.otherwise(generic_lines)


def _parts(m: Column, app: Column) -> Column:
    """The match's groups for its layout (null for generic lines)."""
    expr = None
    for name in PARSERS:
        expr = F.when(app == name, match_parts(m, name)) if expr is None else expr.when(app == name, match_parts(m, name))
    return expr


def _fields(m: Column, app: Column, as_of: Column, parts: Column) -> dict[str, Column]:
    per_app = {name: fn(parts) for name, fn in PARSERS.items()}
    per_app["generic"] = _generic_fields(m, as_of)
    out = {}
    for field in ("datetime", "description", "amount", "transaction_type"):
        expr = None
        for name, cols in per_app.items():
            expr = F.when(app == name, cols[field]) if expr is None else expr.when(app == name, cols[field])
        out[field] = expr
    return out


def match_statements(statements: DataFrame, id_col: str = "statement_id", app: str | None = None,
                     as_of: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Every layout match of every statement, with ``accepted``: false where
    its amount, date or time does not parse.  ``line_no`` is the match number.

    ``app`` forces one layout for all statements; by default it is detected.
    ``as_of`` dates the rows of the generic layout (default: now).
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    app_col = F.lit(app) if app else detect_app("text")
    src = statements.select(id_col, *carry, "text", app_col.alias("app_source"), as_of.alias("_as_of"))
    found = src.select(id_col, *carry, "app_source", "_as_of", F.lit(0).cast("bigint").alias("_offset"),
                       statement_matches(F.col("text"), F.col("app_source")).alias("_matches"))
    return match_rows(found, id_col, carry)


def match_rows(found: DataFrame, id_col: str, carry: Sequence[str]) -> DataFrame:
    """Rows ``(id, carry..., app_source, _as_of, _offset, _matches)`` -> a row per match, numbered from ``_offset``."""
    exploded = found.select(id_col, *carry, "app_source", "_as_of", "_offset",
                            F.posexplode("_matches").alias("line_no", "_m"))
    # the groups are staged as a column: one regex pass per match, read by every field
    exploded = exploded.withColumn("_p", _parts(F.col("_m"), F.col("app_source")))
    f = _fields(F.col("_m"), F.col("app_source"), F.col("_as_of"), F.col("_p"))
    rows = exploded.select(
        id_col, *carry, (F.col("line_no") + F.col("_offset")).alias("line_no"),
        f["datetime"].alias("datetime"), f["description"].alias("description"),
        f["amount"].alias("amount"), f["transaction_type"].alias("transaction_type"), "app_source",
    )
    return rows.withColumn("accepted", F.col("datetime").isNotNull() & F.col("amount").isNotNull())


def parse_statements(statements: DataFrame, id_col: str = "statement_id", app: str | None = None,
                     as_of: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """``match_statements`` without the rows that do not parse: whole statements, no cap."""
    return match_statements(statements, id_col, app, as_of, carry).filter("accepted").drop("accepted")


def assemble_transactions(parsed: DataFrame) -> DataFrame:
    """Typed table with ``date``, ``datetime`` (date + parsed time), ``month``, ``year``."""
    keep = [c for c in parsed.columns if c not in ("datetime", "description", "amount",
                                                   "transaction_type", "app_source")]
    return parsed.select(
        *keep,
        F.col("datetime").cast("date").alias("date"),
        "datetime", "description", F.col("amount").cast(schema.MONEY).alias("amount"),
        "transaction_type", "app_source",
        F.month("datetime").alias("month"), F.year("datetime").alias("year"),
    )


def parse_status(statements: DataFrame, matches: DataFrame, id_col: str = "statement_id") -> DataFrame:
    """Per statement: ``failed: no text``, ``failed: no transactions`` or ``ok``,
    the accepted rows and the rejected ones (matched, but not parsed)."""
    counts = matches.groupBy(id_col).agg(F.count_if("accepted").alias("_ok"), F.count_if(~F.col("accepted")).alias("_no"))
    blank = F.col("text").isNull() | (F.length(_strip(F.col("text"))) == 0)
    j = statements.select(id_col, blank.alias("_blank")).join(counts, id_col, "left")
    n = F.coalesce(F.col("_ok"), F.lit(0)).cast("long")
    return j.select(
        id_col,
        F.when(F.col("_blank"), "failed: no text").when(n == 0, "failed: no transactions").otherwise("ok").alias("status"),
        n.alias("n_transactions"), F.coalesce(F.col("_no"), F.lit(0)).cast("long").alias("n_rejected"),
    )
