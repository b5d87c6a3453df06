"""Spending metrics over a clean transactions table.

All are hash aggregations (partial + final, so hot keys collapse map-side).
Category levels with no debit row still appear (sum 0, count 0, mean null):
they come from *conditional* aggregation over the unfiltered table in the
same scan, never from a join against a table of levels.
Averages are ``cast(sum as double) / count`` (exact sum, one rounding).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.scalars import day_name, month_year_key


def _debit() -> Column:
    return F.col("transaction_type") == "debit"


def _credit() -> Column:
    return F.col("transaction_type") == "credit"


def _sum0(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0).cast(schema.MONEY))


def _mean(s: Column, n: Column) -> Column:
    return F.try_divide(s.cast("double"), n)


def _join_on_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join of a small aggregate with its per-key aggregate; with no keys
    ``b`` has exactly one row, met on a key that is 0 in every row (computed
    from the row, so that the plan stays an equi-join)."""
    if keys:
        return a.join(b, list(keys), how)

    def zero(df: DataFrame) -> Column:
        return F.pmod(F.xxhash64(*df.columns), F.lit(1))

    return a.withColumn("_g", zero(a)).join(b.withColumn("_g", zero(b)), "_g", how).drop("_g")


def _pb(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))


# ---------------------------------------------------------------------------
# Filters
# ---------------------------------------------------------------------------

def filter_by_type(df: DataFrame, kind: str = "debit") -> DataFrame:
    return df.filter(F.col("transaction_type") == kind)


def filter_by_categories(df: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    return df if categories is None else df.filter(F.col("category").isin(*categories))


def filter_by_merchants(df: DataFrame, merchants: Sequence[str] | DataFrame | None = None,
                        keys: Sequence[str] = ()) -> DataFrame:
    """``isin`` for a short list; a DataFrame selection becomes a left-semi join."""
    if merchants is None:
        return df
    if isinstance(merchants, DataFrame):
        return df.join(merchants, [*keys, "merchant"], "left_semi")
    return df.filter(F.col("merchant").isin(*merchants))


def filter_by_date_range(df: DataFrame, start: date | str | None = None, end: date | str | None = None,
                         col: str = "date") -> DataFrame:
    """start <= date <= end, both inclusive; a missing bound is open."""
    c = F.col(col)
    if start is not None:
        df = df.filter(c >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(c <= F.lit(end).cast("date"))
    return df


def amount_between(lo=None, hi=None, col: str = "amount") -> Column:
    c = F.col(col)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (c >= F.lit(lo))
    if hi is not None:
        cond = cond & (c <= F.lit(hi))
    return cond


def filter_by_amount_range(df: DataFrame, lo=None, hi=None, col: str = "amount") -> DataFrame:
    return df.filter(amount_between(lo, hi, col))


def filter_small_debits(df: DataFrame, below: float = schema.SMALL_TXN_AMOUNT) -> DataFrame:
    return df.filter(_debit() & (F.col("amount") < F.lit(below)))


def filter_weekend(df: DataFrame, weekend: bool = True) -> DataFrame:
    return df.filter(F.col("is_weekend") == F.lit(weekend))


def column_bounds(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """min/max of date and amount (the default filter ranges)."""
    return df.groupBy(*keys).agg(
        F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"),
    )


def distinct_values(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, col).distinct()


# ---------------------------------------------------------------------------
# Aggregates
# ---------------------------------------------------------------------------

def overview_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    spent = _sum0(F.when(_debit(), F.col("amount")))
    received = _sum0(F.when(_credit(), F.col("amount")))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_transactions"),
        spent.alias("total_spent"),
        received.alias("total_received"),
        (received - spent).alias("net_flow"),
        _mean(F.sum("amount"), F.count("amount")).alias("avg_amount"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    )


def category_spending(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Debit amount per category; every category level of the key appears."""
    return df.groupBy(*keys, "category").agg(_sum0(F.when(_debit(), F.col("amount"))).alias("amount"))


def category_stats(df: DataFrame, keys: Sequence[str] = (), categories: Sequence[str] | None = None) -> DataFrame:
    """Selected categories, debits: total, mean, count, distinct merchants.

    Unselected or debit-free levels stay with 0 / null, as the table's
    category levels survive the filter.
    """
    cond = _debit()
    if categories is not None:
        cond = cond & F.col("category").isin(*categories)
    amt = F.when(cond, F.col("amount"))
    return df.groupBy(*keys, "category").agg(
        _sum0(amt).alias("total_amount"),
        _mean(F.sum(amt), F.count(amt)).alias("average_amount"),
        F.count(amt).alias("transaction_count"),
        F.count_distinct(F.when(cond, F.col("merchant"))).alias("unique_merchants"),
    )


def category_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n"))


def transaction_type_counts(df: DataFrame, keys: Sequence[str] = (), lo=None, hi=None) -> DataFrame:
    """Rows in the amount range per type; a type with none shows 0."""
    return df.groupBy(*keys, "transaction_type").agg(F.count_if(amount_between(lo, hi)).alias("n"))


def daily_spending(df: DataFrame, keys: Sequence[str] = (), start=None, end=None) -> DataFrame:
    d = filter_by_date_range(filter_by_type(df, "debit"), start, end)
    return d.groupBy(*keys, "date").agg(F.sum("amount").alias("amount"))


def monthly_spending(df: DataFrame, keys: Sequence[str] = (), start=None, end=None) -> DataFrame:
    d = filter_by_date_range(filter_by_type(df, "debit"), start, end)
    return d.groupBy(*keys, month_year_key("datetime").alias("month_year")).agg(F.sum("amount").alias("amount"))


def monthly_spending_ym(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Summary variant: grouped by (year, month)."""
    return filter_by_type(df, "debit").groupBy(*keys, "year", "month").agg(F.sum("amount").alias("amount"))


def day_of_week_spending(df: DataFrame, keys: Sequence[str] = (), start=None, end=None) -> DataFrame:
    """Seven rows Monday..Sunday per key; null where a weekday has no debit.

    One conditional-aggregate row per key, unpivoted with ``stack``: no join
    against a weekday table and no cross product of keys and days.
    """
    d = filter_by_date_range(df, start, end)
    dow = F.weekday("datetime")
    sums = [F.sum(F.when(_debit() & (dow == i), F.col("amount"))).alias(f"d{i}") for i in range(7)]
    wide = d.groupBy(*keys).agg(*sums)
    pairs = ", ".join(f"{i}, '{name}', d{i}" for i, name in enumerate(schema.WEEKDAYS))
    return wide.select(*keys, F.expr(f"stack(7, {pairs}) as (dow, day_name, amount)"))


def hourly_pattern(df: DataFrame, keys: Sequence[str] = (), lo=None, hi=None) -> DataFrame:
    d = filter_by_amount_range(df, lo, hi)
    return d.groupBy(*keys, "hour").agg(F.sum("amount").alias("total_amount"), F.count(F.lit(1)).alias("n"))


def amount_histogram(df: DataFrame, keys: Sequence[str] = (), bins: int = 30, lo=None, hi=None) -> DataFrame:
    """Equal-width bins between the key's min and max, last bin closed.

    Rows are first counted per (key, amount), with map-side combine; bounds
    and bins come from those counts, never from a join of the rows.
    """
    d = filter_by_amount_range(df, lo, hi).select(*keys, F.col("amount").cast("double").alias("a"))
    counts = d.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("_n"))
    bounds = counts.groupBy(*keys).agg(F.min("a").alias("mn"), F.max("a").alias("mx"))
    j = _join_on_keys(counts, bounds, keys, "inner")
    width = (F.col("mx") - F.col("mn")) / F.lit(bins)
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("a") - F.col("mn")) / width), F.lit(bins - 1))).cast("int")
    out = j.groupBy(*keys, b.alias("bin"), "mn", "mx").agg(F.sum("_n").alias("n"))
    w = (F.col("mx") - F.col("mn")) / F.lit(bins)
    return out.select(*keys, "bin", (F.col("mn") + F.col("bin") * w).alias("lo"),
                      (F.col("mn") + (F.col("bin") + 1) * w).alias("hi"), "n")


def top_k(df: DataFrame, k: int, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Top k rows, globally (TakeOrderedAndProject) or per key
    (``row_number <= k``, which Spark plans as a partial WindowGroupLimit
    before the shuffle).  ``order`` must be a total order for stable ties."""
    if not keys:
        return df.orderBy(*order).limit(k)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")


def top_merchants_by_count(df: DataFrame, keys: Sequence[str] = (), k: int = 10) -> DataFrame:
    counts = df.groupBy(*keys, "merchant").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, k, [F.col("n").desc(), F.col("merchant").asc()], keys)


def merchant_stats(df: DataFrame, keys: Sequence[str] = (), k: int = 10,
                   merchants: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """All types: total, mean, count and the most frequent category (smallest
    on ties); the top k merchants by total."""
    # rows are counted per category first, with map-side combine
    d = filter_by_merchants(df, merchants, keys).groupBy(*keys, "merchant", "category").agg(
        F.sum("amount").alias("_sum"), F.count("amount").alias("_amounts"), F.count(F.lit(1)).alias("_rows"))
    most = F.min(F.when(F.col("category").isNotNull(), F.struct((-F.col("_rows")).alias("_rows"), "category")))
    stats = d.groupBy(*keys, "merchant").agg(
        F.sum("_sum").cast(d.schema["_sum"].dataType).alias("total_amount"),
        _mean(F.sum("_sum"), F.sum("_amounts")).alias("average_amount"),
        F.sum("_rows").alias("transaction_count"),
        most["category"].alias("primary_category"),
    )
    return top_k(stats, k, [F.col("total_amount").desc(), F.col("merchant").asc()], keys)


def merchant_totals(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, "merchant").agg(F.sum("amount").alias("total_amount"))


def semi_join_top_merchants(df: DataFrame, keys: Sequence[str] = (), k: int = 5) -> DataFrame:
    """Rows whose merchant is among the key's top k by total amount.

    The top-k side is at most k rows per key; AQE broadcasts it when small.
    """
    top = top_k(merchant_totals(df, keys), k, [F.col("total_amount").desc(), F.col("merchant").asc()], keys)
    return df.join(top.select(*keys, "merchant"), [*keys, "merchant"], "left_semi")


def merchant_spending_trends(df: DataFrame, keys: Sequence[str] = (), k: int = 5) -> DataFrame:
    """Daily totals of the key's top k merchants: rows are aggregated once, to
    (key, merchant, date); the totals and the top k come from those sums."""
    daily = df.groupBy(*keys, "merchant", "date").agg(F.sum("amount").alias("amount"))
    totals = daily.groupBy(*keys, "merchant").agg(F.sum("amount").alias("total_amount"))
    top = top_k(totals, k, [F.col("total_amount").desc(), F.col("merchant").asc()], keys)
    return daily.join(top.select(*keys, "merchant"), [*keys, "merchant"], "left_semi")


def weekend_vs_weekday(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        _sum0(F.when(F.col("is_weekend"), F.col("amount"))).alias("weekend_amount"),
        _sum0(F.when(~F.col("is_weekend"), F.col("amount"))).alias("weekday_amount"),
    )


def category_share(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Debit amount of each category over the key's total debit amount.

    The window runs over the small per-(key, category) aggregate only.
    """
    cs = category_spending(df, keys)
    total = F.sum("amount").over(_pb(keys))
    return cs.select(*keys, "category", "amount", F.try_divide(F.col("amount").cast("double"),
                                                               total.cast("double")).alias("share"))


def top_category(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Largest debit category per key; ties go to the alphabetically first."""
    return top_k(category_spending(df, keys), 1, [F.col("amount").desc(), F.col("category").asc()], keys)


def small_levels(df: DataFrame, col: str, keys: Sequence[str] = (),
                 min_percentage: float = schema.SMALL_LEVEL_PCT) -> DataFrame:
    """Levels (keys, ``col``) that hold less than ``min_percentage`` % of the
    key's rows.  Null rows count in the denominator and are no level."""
    levels = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    # per-key totals joined back on the keys (one row per key, broadcast by AQE
    # when small): a window over the key would hold all of a key's levels in one task
    totals = levels.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    return (_join_on_keys(levels, totals, keys, "inner")
            .filter(F.col(col).isNotNull() & (F.col("_n") / F.col("_total") * 100 < F.lit(min_percentage)))
            .select(*keys, col))


def replace_small_levels(df: DataFrame, col: str, small: DataFrame, keys: Sequence[str] = (),
                         other: str = "Others") -> DataFrame:
    """``df`` with the levels of the lookup table ``small`` (keys, ``col``) replaced by ``other``; nulls stay."""
    marked = small.select(*keys, col).distinct().withColumn("_small", F.lit(True))
    j = df.join(marked, [*keys, col], "left")
    return j.select(*[F.when(F.col("_small"), F.lit(other)).otherwise(F.col(c)).alias(c) if c == col else F.col(c)
                      for c in df.columns])


def group_small_categories(df: DataFrame, col: str, keys: Sequence[str] = (),
                           min_percentage: float = schema.SMALL_LEVEL_PCT, other: str = "Others") -> DataFrame:
    """Levels holding less than ``min_percentage`` % of the key's rows become ``other``."""
    return replace_small_levels(df, col, small_levels(df, col, keys, min_percentage), keys, other)


def recurring_merchants(df: DataFrame, keys: Sequence[str] = (), min_count: int = schema.SUBSCRIPTION_MIN_COUNT,
                        exclude: Sequence[str] = ()) -> DataFrame:
    """Merchants with at least ``min_count`` debits."""
    d = filter_by_type(df, "debit")
    out = d.groupBy(*keys, "merchant").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    return out.filter(~F.col("merchant").isin(*exclude)) if exclude else out


def pct_change(old: Column, new: Column) -> Column:
    """(new - old) / old * 100; 0 when old is 0."""
    o, n = old.cast("double"), new.cast("double")
    return F.when(o == 0, F.lit(0.0)).otherwise((n - o) / o * 100)


def calendar_category_change(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Month-over-month debit change per category, against the previous calendar month.

    A category's months run from its own first debit month to its key's last one, without gaps: a
    month without debits has amount 0, and the next month changes against that 0 (as ``pct_change``).
    The months of a (key, category) are a ``sequence`` of its bounds joined to the monthly sums on key,
    category and month; all of it works on the monthly aggregate.
    """
    group = [*keys, "category"]
    month = F.trunc("datetime", "month").alias("month")
    sums = filter_by_type(df, "debit").groupBy(*group, month).agg(F.sum("amount").alias("amount"))
    bounds = sums.groupBy(*group).agg(F.min("month").alias("first"), F.max("month").alias("own_last"))
    bounds = bounds.withColumn("last", F.max("own_last").over(_pb(keys)))
    spine = bounds.select(*[F.col(c).alias(f"_s_{c}") for c in group],
                          F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("_s_month"))
    same = F.lit(True)
    for c in (*group, "month"):
        same = same & F.col(f"_s_{c}").eqNullSafe(F.col(c))
    filled = spine.join(sums, same, "left").select(
        *[F.col(f"_s_{c}").alias(c) for c in (*group, "month")],
        F.coalesce("amount", F.lit(0).cast(schema.MONEY)).alias("amount"))
    prev = F.lag("amount").over(Window.partitionBy(*group).orderBy("month"))
    return filled.select(*group, month_year_key("month").alias("month_year"), "amount", prev.alias("prev_amount"),
                         pct_change(prev, F.col("amount")).alias("pct_change"))


def monthly_category_change(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Debit change per category from the last month with debits (window over the monthly aggregate);
    ``calendar_category_change`` compares with the previous calendar month."""
    m = (filter_by_type(df, "debit")
         .groupBy(*keys, "category", month_year_key("datetime").alias("month_year"))
         .agg(F.sum("amount").alias("amount")))
    prev = F.lag("amount").over(Window.partitionBy(*keys, "category").orderBy("month_year"))
    return m.select(*keys, "category", "month_year", "amount", prev.alias("prev_amount"),
                    pct_change(prev, F.col("amount")).alias("pct_change"))


def small_debit_count(df: DataFrame, keys: Sequence[str] = (), below: float = schema.SMALL_TXN_AMOUNT) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(_debit() & (F.col("amount") < F.lit(below))).alias("n_small"))


# ---------------------------------------------------------------------------
# One pass for several levels: summary, rules and insights
# ---------------------------------------------------------------------------

# Level name -> its grouping columns (besides the keys).
LEVEL_COLUMNS = {"category": ("category",), "month": ("year", "month"), "merchant": ("merchant",),
                 "type": ("transaction_type",)}
DEFAULT_LEVELS = ("category", "month", "merchant")


def level_totals(df: DataFrame, keys: Sequence[str] = (), small_below: float = schema.SMALL_TXN_AMOUNT,
                 levels: Sequence[str] = DEFAULT_LEVELS) -> DataFrame:
    """Per key, the measures of several levels in one aggregation (GROUPING SETS).

    ``level`` is ``all`` (one row per key) or one of ``levels``: ``category``,
    ``month`` (``year``, ``month``), ``merchant``, ``type``
    (``transaction_type``); the columns of the other levels are null.
    Spark expands every clean row once per level and aggregates all levels in
    one hash aggregate (partial + final around a single shuffle), so the clean
    table is scanned and computed once, however many levels a result needs.
    Sums are exact decimals; the ``*0`` sums are zero-filled.
    """
    debit, credit = _debit(), _credit()
    amt = F.col("amount")
    cols = [c for lv in levels for c in LEVEL_COLUMNS[lv]]
    sets = [list(keys)] + [[*keys, *LEVEL_COLUMNS[lv]] for lv in levels]
    level = F.lit("all")
    for lv in reversed(levels):
        level = F.when(F.grouping(LEVEL_COLUMNS[lv][0]) == 0, F.lit(lv)).otherwise(level)
    return df.groupingSets(sets, *keys, *cols).agg(
        level.alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(debit).alias("n_debit"),
        F.sum(amt).alias("amount"),
        F.count(amt).alias("n_amount"),
        F.sum(F.when(debit, amt)).alias("debit"),
        _sum0(F.when(debit, amt)).alias("debit0"),
        _sum0(F.when(credit, amt)).alias("credit0"),
        _sum0(F.when(F.col("is_weekend"), amt)).alias("weekend0"),
        _sum0(F.when(~F.col("is_weekend"), amt)).alias("weekday0"),
        F.count_if(debit & (amt < F.lit(small_below))).alias("n_small"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    )


def category_spending_from_levels(t: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``category_spending`` from a ``level_totals`` table."""
    return t.filter(F.col("level") == "category").select(*keys, "category", F.col("debit0").alias("amount"))


def overview_from_levels(t: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``overview_metrics`` from a ``level_totals`` table."""
    return t.filter(F.col("level") == "all").select(
        *keys, F.col("n").alias("n_transactions"), F.col("debit0").alias("total_spent"),
        F.col("credit0").alias("total_received"), (F.col("credit0") - F.col("debit0")).alias("net_flow"),
        _mean(F.col("amount"), F.col("n_amount")).alias("avg_amount"),
        F.col("min_date"), F.col("max_date"))


def key_window(keys: Sequence[str]):
    """A window over one key's ``all``, ``category`` and ``month`` rows of
    ``level_totals``; every merchant row is a partition of its own, so no task
    holds all merchants of a hot key."""
    return Window.partitionBy(*keys, F.when(F.col("level") == "merchant", F.col("merchant")))


def top_merchant_rows(totals: DataFrame, keys: Sequence[str], top: int, order: Sequence[Column] | None = None) -> DataFrame:
    """``level_totals`` with the merchant rows cut to the key's top ``top``
    (default: by count, then name); other rows pass.  The filter is a plain
    ``row_number <= top`` (other rows are single-row partitions), so Spark
    plans a partial WindowGroupLimit before the shuffle."""
    order = order or [F.col("n").desc(), F.col("merchant").asc()]
    rest = [c for lv, cs in LEVEL_COLUMNS.items() if lv != "merchant" for c in cs if c in totals.columns]
    other = F.when(F.col("level") != "merchant", F.struct("level", *rest))
    rn = F.row_number().over(Window.partitionBy(*keys, other).orderBy(*order))
    return totals.withColumn("_rn", rn).filter(F.col("_rn") <= top).drop("_rn")


def spending_summary(df: DataFrame, keys: Sequence[str] = (), top: int = 5) -> DataFrame:
    """The bundle behind insights and prompts, as long rows ``(keys, metric, level, value)``.

    Scalars (spent, received, n, avg, weekend/weekday, months with debits),
    category spending (all levels), spending per (year, month) and the top
    merchants by count: one ``level_totals`` pass, one top-k window, one
    window over each key's small rows, then every row is unpivoted.
    """
    t = top_merchant_rows(level_totals(df, keys), keys, top)
    lv = F.col("level")
    n_months = F.count_if((lv == "month") & (F.col("n_debit") > 0)).over(key_window(keys))
    t = t.withColumn("n_months", n_months)
    scalars = F.array(
        _long_row("total_spent", None, F.col("debit0")), _long_row("total_received", None, F.col("credit0")),
        _long_row("transaction_count", None, F.col("n")),
        _long_row("avg_transaction", None, _mean(F.col("amount"), F.col("n_amount"))),
        _long_row("weekend", None, F.col("weekend0")), _long_row("weekday", None, F.col("weekday0")),
        _long_row("n_months", None, F.col("n_months")),
    )
    rows = (F.when(lv == "all", scalars)
            .when(lv == "category", F.array(_long_row("category_spending", F.col("category"), F.col("debit0"))))
            .when((lv == "month") & (F.col("n_debit") > 0),
                  F.array(_long_row("monthly_spending", F.format_string("%04d-%02d", "year", "month"), F.col("debit"))))
            .when(lv == "merchant", F.array(_long_row("top_merchant", F.col("merchant"), F.col("n")))))
    return _explode_long(t, keys, rows)


def _long_row(metric: str, level: Column | None, value: Column | None) -> Column:
    """One ``(metric, level, value)`` entry of a long-form result."""
    return F.struct(F.lit(metric).alias("metric"),
                    (level if level is not None else F.lit(None)).cast("string").alias("level"),
                    (value if value is not None else F.lit(None)).cast("double").alias("value"))


def _explode_long(t: DataFrame, keys: Sequence[str], rows: Column) -> DataFrame:
    return t.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.metric", "_r.level", "_r.value")


SUMMARY_LEVELS = ("category", "merchant", "type")


def summary_stats(df: DataFrame, keys: Sequence[str] = (), top: int = 5) -> DataFrame:
    """Scalars plus maps (category counts, top merchants, type counts), one row per key.

    One ``level_totals`` pass and the top-merchant cut; the maps are then
    gathered from each key's few level rows (categories, ``top`` merchants,
    types), never from its transactions.
    """
    t = top_merchant_rows(level_totals(df, keys, levels=SUMMARY_LEVELS), keys, top)
    lv = F.col("level")

    def on_all(c: Column) -> Column:
        return F.max(F.when(lv == "all", c))

    def as_map(level: str, col: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(lv == level, F.struct(F.col(col), F.col("n")))))

    return t.groupBy(*keys).agg(
        on_all(F.col("n")).alias("total_transactions"),
        on_all(F.coalesce(F.col("amount"), F.lit(0).cast(schema.MONEY))).alias("total_amount"),
        on_all(_mean(F.col("amount"), F.col("n_amount"))).alias("avg_transaction"),
        on_all(F.col("min_date")).alias("start_date"), on_all(F.col("max_date")).alias("end_date"),
        as_map("category", "category").alias("categories"),
        as_map("merchant", "merchant").alias("top_merchants"),
        as_map("type", "transaction_type").alias("transaction_types"),
    )


def summary_long(df: DataFrame, keys: Sequence[str] = (), top: int = 5) -> DataFrame:
    """``summary_stats`` as rows ``(keys, metric, level, value)``; dates as ISO text levels.

    One ``level_totals`` pass, the top-merchant cut, then every level row is
    unpivoted: no per-level aggregate, no union of scans.
    """
    t = top_merchant_rows(level_totals(df, keys, levels=SUMMARY_LEVELS), keys, top)
    lv, n = F.col("level"), F.col("n")
    scalars = F.array(
        _long_row("total_transactions", None, n),
        _long_row("total_amount", None, F.coalesce(F.col("amount"), F.lit(0).cast(schema.MONEY))),
        _long_row("avg_transaction", None, _mean(F.col("amount"), F.col("n_amount"))),
        _long_row("start_date", F.col("min_date"), None), _long_row("end_date", F.col("max_date"), None),
    )
    rows = (F.when(lv == "all", scalars)
            .when(lv == "category", F.array(_long_row("category_count", F.col("category"), n)))
            .when(lv == "merchant", F.array(_long_row("top_merchant", F.col("merchant"), n)))
            .when(lv == "type", F.array(_long_row("type_count", F.col("transaction_type"), n))))
    return _explode_long(t, keys, rows)


def reindex_weekdays(agg: DataFrame, keys: Sequence[str] = (), day_col: str = "day_name",
                     value: str = "amount") -> DataFrame:
    """Re-index a per-weekday aggregate onto Monday..Sunday (missing -> null).

    Pivots the (at most 7) rows of each key into one row and unpivots with
    ``stack``; no cross join of keys and days.
    """
    cols = [F.max(F.when(F.col(day_col) == d, F.col(value))).alias(f"v{i}") for i, d in enumerate(schema.WEEKDAYS)]
    wide = agg.groupBy(*keys).agg(*cols)
    pairs = ", ".join(f"{i}, '{d}', v{i}" for i, d in enumerate(schema.WEEKDAYS))
    return wide.select(*keys, F.expr(f"stack(7, {pairs}) as (dow, {day_col}, {value})"))


def with_calendar_keys(df: DataFrame) -> DataFrame:
    """``month_year`` (yyyy-MM) and ``day_name`` columns."""
    return df.withColumn("month_year", month_year_key("datetime")).withColumn("day_name", day_name("datetime"))
