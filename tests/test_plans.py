"""Plan shape and one-pass equivalence: the properties the scale design rests on.

The one-pass bundles (``recommendations``, ``rule_based_insights``,
``spending_summary``) must equal the union of the single operators they
replace; plans must not carry work a result never reads.
"""

from pyspark.sql import functions as F

from conftest import SF_CHECK
from txnlens.operators import clean as cl
from txnlens.operators import metrics as m
from txnlens.operators import rules as r
from txnlens.sources import fixtures as fx

K = ("account_id",)


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(row[c] for c in cols) for row in df.collect()), key=repr)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_recommendations_equal_union_of_rules(spark):
    c = cl.clean_transactions(fx.txn(spark, SF_CHECK), K)
    union = (r.rule_high_spending_category(c, K).unionByName(r.rule_low_savings_rate(c, K))
             .unionByName(r.rule_small_transactions(c, K)).unionByName(r.rule_subscriptions(c, K)))
    bundle = r.recommendations(c, K)
    assert _rows(bundle) == _rows(union)
    assert {1, 3, 4} <= {row.rule_no for row in bundle.select("rule_no").distinct().collect()}


def test_insights_equal_union_of_insight_rules(spark):
    c = cl.clean_transactions(fx.txn_big(spark, SF_CHECK), K)
    parts = [r.insight_overspend(c, K), r.insight_top_category(c, K), r.insight_transaction_size(c, K),
             r.insight_food_share(c, K), r.insight_entertainment_share(c, K), r.insight_investing(c, K),
             r.insight_monthly_average(c, K)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    assert _rows(r.rule_based_insights(c, K)) == _rows(union)


def test_global_key_bundles(spark):
    """keys=() is one group: the bundles still run (window partitions on the level only)."""
    c = cl.clean_transactions(fx.txn(spark, SF_CHECK), ())
    s = {(row.metric, row.level): row.value for row in m.spending_summary(c, ()).collect()}
    assert s[("transaction_count", None)] == c.count()
    assert s[("n_months", None)] == 1.0
    assert sum(1 for (metric, _) in s if metric == "top_merchant") == 5


def test_summary_is_one_aggregate_pass(spark):
    c = cl.clean_transactions(fx.txn_big(spark, SF_CHECK), K)
    df = m.spending_summary(c, K)
    df.write.format("noop").mode("overwrite").save()
    plan = _plan(df)
    assert plan.count("Expand") == 1          # all levels in one grouping-sets aggregate
    assert "WindowGroupLimit" in plan          # top merchants cut before the shuffle


def test_unused_merchant_frequency_join_is_dropped(spark):
    c = cl.clean_transactions(fx.txn(spark, SF_CHECK), K)
    lean = c.select("account_id", "amount")
    assert "Join" not in lean._jdf.queryExecution().optimizedPlan().toString()
    full = c.select("account_id", "merchant_frequency")
    assert "Join" in full._jdf.queryExecution().optimizedPlan().toString()


def test_frequency_count_side_has_no_inferred_filter(spark):
    """No ``isnotnull`` filter is inferred for the count side, so both join
    sides share the plan below the aggregate (and the dedupe shuffle)."""
    c = cl.clean_transactions(fx.txn(spark, SF_CHECK), K)
    opt = c._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(user_id" not in opt and "isnotnull(CASE" not in opt


def test_merchant_frequency_null_keys_match(spark):
    df = spark.createDataFrame([(None, "A"), (None, "A"), (None, None), (1, "A")], "account_id long, merchant string")
    out = cl.merchant_frequency(df, K).orderBy("account_id", "merchant").collect()
    assert [(x.account_id, x.merchant, x.merchant_frequency) for x in out] == [
        (None, None, 1), (None, "A", 2), (None, "A", 2), (1, "A", 1)]


def test_fixture_statements_and_pages_are_bounded(spark):
    pages = fx.statement_pages(spark, SF_CHECK).filter(F.col("page_no") > 0)
    lines = pages.select("statement_id", "page_no", F.size(F.split("text", "\n")).alias("n"))
    worst = lines.agg(F.max("n").alias("page"), F.max("page_no").alias("pages")).first()
    # a GPay transaction renders as three lines
    assert worst.page <= 3 * fx.PAGE_SPAN
    assert worst.pages <= fx.STATEMENT_SPAN // fx.PAGE_SPAN
    per_stmt = fx.txn(spark, SF_CHECK).groupBy(
        F.expr(f"account_id * {fx.STATEMENTS_PER_ACCOUNT} + line_no div {fx.STATEMENT_SPAN}")).count()
    assert per_stmt.agg(F.max("count")).first()[0] <= fx.STATEMENT_SPAN


def test_summary_maps_equal_long_form(spark):
    c = cl.clean_transactions(fx.txn(spark, SF_CHECK), K)
    wide = {row.account_id: row for row in m.summary_stats(c, K).collect()}
    long = {}
    for row in m.summary_long(c, K).collect():
        long.setdefault(row.account_id, {})[(row.metric, row.level)] = row.value
    assert set(wide) == set(long)
    for acc, w in wide.items():
        lf = long[acc]
        assert lf[("total_transactions", None)] == w.total_transactions
        assert lf[("total_amount", None)] == float(w.total_amount)
        assert ("start_date", w.start_date.isoformat()) in lf
        assert {k: float(v) for k, v in w.categories.items()} == \
            {lv: v for (mt, lv), v in lf.items() if mt == "category_count"}
        assert {k: float(v) for k, v in w.top_merchants.items()} == \
            {lv: v for (mt, lv), v in lf.items() if mt == "top_merchant"}
        assert {k: float(v) for k, v in w.transaction_types.items()} == \
            {lv: v for (mt, lv), v in lf.items() if mt == "type_count"}


def test_text_rules_run_once_below_the_dedupe(spark):
    c = cl.clean_transactions(fx.txn_big(spark, SF_CHECK), K)
    df = cl.typed_projection(c)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(cl.typed_projection(cl.clean_transactions(fx.txn_big(spark, SF_CHECK), K)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert "ReusedExchange" in plan
    assert plan.count("paid to|sent to") <= 2          # one projection: the test and the extraction of one rule
    assert df.columns == c.columns


def test_insights_and_rules_build_only_the_levels_they_read(spark):
    c = cl.clean_transactions(fx.txn(spark, SF_CHECK), K)
    insights = r.rule_based_insights(c, K)._jdf.queryExecution().optimizedPlan().toString()
    assert "merchant" not in insights.split("Expand")[0]
    rules = r.recommendations(c, K)._jdf.queryExecution().optimizedPlan().toString()
    assert "month" not in rules.split("Expand")[0]


def test_histogram_joins_counts_not_rows(spark):
    c = cl.clean_transactions(fx.txn(spark, SF_CHECK), K)
    for keys in (K, ()):
        df = m.amount_histogram(c, keys)
        assert df.agg(F.sum("n")).first()[0] == c.count()
        plan = _plan(df)
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_dirty_rows_exercise_the_cleaning_rules(spark):
    t = fx.txn_dirty(spark, SF_CHECK)
    n = t.count()
    assert cl.dedupe_near(t, K).count() < n
    assert cl.distinct_rows(t.drop("line_no", "statement_id")).count() < n
    s = t.agg(*[F.count_if(F.expr(x)) for x in ("amount < 0", "amount = 0", "amount is null", "description is null")]).first()
    assert min(s) > 0
    rejected = cl.rejected_amounts(t, K).agg(F.sum("n_null"), F.sum("n_zero")).first()
    assert rejected[0] == s[2] and rejected[1] == s[1]
