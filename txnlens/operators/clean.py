"""Cleaning and row-wise enrichment of a transactions table.

Every operator is DataFrame -> DataFrame.  ``keys`` are tenant columns
(e.g. ``("account_id",)``); ``()`` treats the whole table as one statement.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import text as tx

NEAR_DUP_SUBSET = ("date", "amount", "description")


def distinct_rows(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows (hash aggregate with map-side combine)."""
    return df.dropDuplicates()


def dedupe_near(df: DataFrame, keys: Sequence[str] = (), subset: Sequence[str] = NEAR_DUP_SUBSET,
                order_by: Sequence[str] = ("line_no",), ties: Sequence[str] | None = None) -> DataFrame:
    """Keep the first row (lowest ``order_by``, ties broken by ``ties``, by default the remaining
    columns in order, nulls first) of each ``keys + subset`` group.

    ``row_number() == 1`` over the group: Spark plans it with a partial
    ``WindowGroupLimit`` before the shuffle, so every map task sends at most one
    row per group and a hot group of copies never lands whole in one task.
    Null group values compare equal.
    """
    group = [*keys, *[c for c in subset if c not in keys]]
    rest = [c for c in (df.columns if ties is None else ties) if c not in group and c not in order_by]
    w = Window.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_first() for c in (*order_by, *rest)])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def abs_amount(df: DataFrame, col: str = "amount") -> DataFrame:
    return df.withColumn(col, F.abs(F.col(col)))


def filter_valid_amounts(df: DataFrame, cap: float = schema.AMOUNT_CAP, col: str = "amount") -> DataFrame:
    """0 < amount <= cap; nulls dropped."""
    a = F.col(col)
    return df.filter((a > 0) & (a <= F.lit(cap)))


def rejected_amounts(df: DataFrame, keys: Sequence[str] = (), cap: float = schema.AMOUNT_CAP, col: str = "amount") -> DataFrame:
    """Per key, the rows that ``filter_valid_amounts`` drops after ``abs``: null, zero and above the cap."""
    a = F.abs(F.col(col))
    return df.groupBy(*keys).agg(F.count_if(a.isNull()).alias("n_null"), F.count_if(a == 0).alias("n_zero"),
                                 F.count_if(a > F.lit(cap)).alias("n_above_cap"))


def with_description_clean(df: DataFrame, src: str = "description", out: str = "description_clean") -> DataFrame:
    return df.withColumn(out, tx.clean_description(src))


def with_merchant(df: DataFrame, src: str = "description_clean", out: str = "merchant",
                  prefixes=schema.MERCHANT_PREFIXES, stops=schema.MERCHANT_STOPS,
                  generic=schema.MERCHANT_GENERIC, unknown: str = schema.MERCHANT_UNKNOWN) -> DataFrame:
    """Merchant column.  The prefix match and the word split are projected
    first: Catalyst keeps a costly expression that is read several times in
    its own projection (both fuse into one codegen stage), so each runs once."""
    first, words = tx.merchant_parts(src, prefixes, stops)
    staged = df.withColumns({"_m_first": first, "_m_words": words})
    merchant = tx.merchant_from_parts(F.col(src), F.col("_m_first"), F.col("_m_words"), generic, unknown)
    return staged.withColumn(out, merchant).drop("_m_first", "_m_words")


def with_category(df: DataFrame, src: str = "description_clean", out: str = "category",
                  vocabulary=schema.CATEGORY_KEYWORDS, default: str = schema.DEFAULT_CATEGORY) -> DataFrame:
    return df.withColumn(out, tx.categorize(src, vocabulary, default))


def amount_range(col: Column | str = "amount", edges: Sequence[float] = schema.AMOUNT_EDGES,
                 labels: Sequence[str] = schema.AMOUNT_LABELS) -> Column:
    """Right-closed bins; outside every bin -> null."""
    a = F.col(col) if isinstance(col, str) else col
    expr = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = a > F.lit(lo)
        if hi != float("inf"):
            cond = cond & (a <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def derive_time_features(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """hour, day_of_month, is_weekend (Saturday/Sunday)."""
    return df.withColumns({"hour": F.hour(ts), "day_of_month": F.dayofmonth(ts), "is_weekend": F.weekday(ts) >= 5})


def merchant_frequency(df: DataFrame, keys: Sequence[str] = (), merchant: str = "merchant",
                       out: str = "merchant_frequency") -> DataFrame:
    """Row count of each row's merchant, mapped back onto every row.

    An equi left join with the per-merchant counts, not a window over the
    merchant: a hot merchant would put all of its rows into one window task,
    while the join side is pre-aggregated and AQE may broadcast it (size
    checked at runtime) or split a skewed partition.

    The rows meet their counts on one struct key.  A struct is never null,
    so Catalyst infers no ``isnotnull`` filter for the count side (which it
    would push below the dedupe and so split the plan in two); both sides stay
    the same plan and the upstream shuffle is computed once and reused.  Null
    fields compare equal, as in the grouping.  The count side is grouped by
    exactly the join key, so a query that never reads the frequency drops
    the join altogether.
    """
    key = F.struct(*keys, merchant)
    counts = df.groupBy(key.alias("_mf_key")).agg(F.count(F.lit(1)).alias(out))
    return df.join(counts, key == counts["_mf_key"], "left").select(*[df[c] for c in df.columns], counts[out])


CLEAN_TYPES = {
    "amount": schema.MONEY,
    "transaction_type": T.StringType(),
    "app_source": T.StringType(),
    "category": T.StringType(),
    "amount_range": T.StringType(),
    "merchant_frequency": T.LongType(),
    "hour": T.IntegerType(),
    "day_of_month": T.IntegerType(),
    "month": T.IntegerType(),
    "year": T.IntegerType(),
}


def typed_projection(df: DataFrame, types: dict | None = None) -> DataFrame:
    """Final cast to the schema contract (dictionary encoding is Parquet's job)."""
    types = CLEAN_TYPES if types is None else types
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def clean_transactions(df: DataFrame, keys: Sequence[str] = (), order_by: Sequence[str] = ("line_no",),
                       cap: float = schema.AMOUNT_CAP, vocabulary=schema.CATEGORY_KEYWORDS) -> DataFrame:
    """description/merchant/category -> dedupe -> amounts -> features -> types.

    What depends on the description alone is computed below the dedupe shuffle:
    the description is one of its keys, and both sides of the frequency join
    read that shuffle, so the text rules run once per row.  Ties of the dedupe are
    broken by the source's columns only: what is derived from the description, a group
    key, can't break one, and as no sort key it is pruned where a query doesn't read it.  The dedupe runs
    before ``abs`` so -50 and 50 stay different rows.  ``rejected_amounts``
    counts what the amount window drops.
    """
    out = with_category(with_merchant(with_description_clean(df)), vocabulary=vocabulary)
    out = dedupe_near(out, keys, order_by=order_by, ties=df.columns)
    out = filter_valid_amounts(abs_amount(out), cap)
    out = derive_time_features(out).withColumn("amount_range", amount_range("amount"))
    out = merchant_frequency(out, keys)
    return typed_projection(out)
