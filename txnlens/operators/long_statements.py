"""Long statements parsed in blocks of lines, over many tasks.

A statement is one row, and its layout's matches are found from left to right.  A match may run
over line ends, but only over blanks between its fields, so there are line ends that no match can
cross: both lines hold something, the left one doesn't end in a field after which a match may go on,
and the right one doesn't begin with a field before which it may have begun.  Cut there, the blocks'
matches are exactly the whole text's, in the same order.

The line after every ``block_lines`` lines is moved on to the next such line end.  Blocks of statements that
have several are dealt over the cluster before the regex runs; their matches are checkpointed once, and
numbered over the whole statement from the blocks' counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import S, W
from ..session import cut_lineage
from .parse import D2, detect_app, match_rows, statement_matches

# Fields at the end of a line after which a match of the layout may go on in the next line, and fields at the start of
# a line before which it may have begun.  The generic layout's matches are single lines.
OPEN_END = {
    "paytm": f"({D2}/{D2}/[0-9]{{4}}|{D2}:{D2}:{D2}|₹)$",
    "gpay": "(?i)(paid to|received from|₹)$",
    "phonepe": f"({D2}-{D2}-[0-9]{{4}}|{D2}:{D2}|₹)$",
}
OPEN_START = {
    "paytm": f"^(₹|{D2}:{D2}:{D2})",
    "gpay": f"(?i)^(₹|[0-9]|[ap]m|{W}{{3}}{S}[0-9]{{4}},)",
    "phonepe": f"^(₹|{D2}:{D2})",
}


def _may_cross(left: Column, right: Column, app: str) -> Column:
    left, right = F.regexp_replace(left, f"{S}+$", ""), F.regexp_replace(right, f"^{S}+", "")
    return (F.length(left) == 0) | (F.length(right) == 0) | left.rlike(OPEN_END[app]) | right.rlike(OPEN_START[app])


def statement_blocks(statements: DataFrame, id_col: str = "statement_id", block_lines: int = schema.LINES_PER_CHUNK,
                     app: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """``(id, carry..., app_source, n_blocks, block_no, text)``: whole lines, cut where no match crosses.

    The blocks of a statement joined by line ends are its text.  A null text has no block; an empty one has one.
    """
    app_col = F.lit(app) if app else detect_app("text")
    lines = statements.select(id_col, *carry, app_col.alias("app_source"), F.split("text", "\n", -1).alias("_lines"))

    def crosses(i: Column) -> Column:
        """A match may cross the end of line ``i`` (numbered from 1)."""
        left, right = F.element_at("_lines", i), F.element_at("_lines", i + 1)
        test = F.lit(False)
        for name in OPEN_END:
            test = F.when(F.col("app_source") == name, _may_cross(left, right, name)).otherwise(test)
        return test

    n, step = F.size("_lines"), F.lit(block_lines)

    def first_firm(k: Column) -> Column:
        """The first end of lines ``k * step`` to ``(k + 1) * step - 1`` that no match crosses; those behind it are not tested."""
        ends = F.sequence(k * step, F.least((k + 1) * step, n) - 1)
        return F.aggregate(ends, F.lit(None).cast("int"), lambda e, i: F.when(e.isNotNull(), e).when(~crosses(i), i))

    parts = F.sequence(F.lit(1), F.floor((n - 1) / step).cast("int"))
    firm = F.filter(F.transform(parts, first_firm), lambda e: e.isNotNull())
    cuts = F.concat(F.array(F.lit(0)), F.when(n > block_lines, firm).otherwise(F.array().cast("array<int>")), F.array(n))
    # the output of a generator: filters on it are not moved below and so can't bring it in many times
    lines = lines.select("*", F.explode(F.array(cuts)).alias("_cuts"))
    n_blocks = F.size("_cuts") - 1
    texts = F.transform(F.slice("_cuts", F.lit(1), n_blocks), lambda a, k: F.array_join(
        F.slice("_lines", a + 1, F.get("_cuts", k + 1) - a), "\n"))
    return lines.select(id_col, *carry, "app_source", n_blocks.alias("n_blocks"), F.posexplode(texts).alias("block_no", "text"))


def parse_long_statements(statements: DataFrame, id_col: str = "statement_id", app: str | None = None,
                          as_of: Column | None = None, carry: Sequence[str] = (),
                          block_lines: int = schema.LINES_PER_CHUNK) -> DataFrame:
    """``parse.parse_statements``, with long statements cut into blocks; equal rows, ``line_no`` included.

    Ids must be unique.  Statements of one block are parsed where they are.
    """
    dated = statements.withColumn("_as_of", F.current_timestamp() if as_of is None else as_of)
    blocks = statement_blocks(dated, id_col, block_lines, app, (*carry, "_as_of"))
    one = blocks.filter("n_blocks = 1").withColumn("_offset", F.lit(0).cast("bigint"))
    many = blocks.filter("n_blocks > 1").repartition(id_col, "block_no")
    found = cut_lineage(many.select(id_col, *carry, "app_source", "_as_of", "block_no",
                                    statement_matches(F.col("text"), F.col("app_source")).alias("_matches")))
    counts = found.select(id_col, "block_no", F.size("_matches").cast("bigint").alias("_n"))
    before = Window.partitionBy(id_col).orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(id_col, "block_no", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = found.join(offsets, [id_col, "block_no"])
    whole = one.select(id_col, *carry, "app_source", "_as_of", statement_matches(F.col("text"), F.col("app_source")).alias("_matches"), "_offset")
    rows = whole.unionByName(numbered.select(*whole.columns))
    return match_rows(rows, id_col, carry).filter("accepted").drop("accepted")
