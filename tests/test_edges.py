"""Hand-written edge tables for the semantic traps (expected values pinned)."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from txnlens.functions import scalars as sc
from txnlens.functions import text as tx
from txnlens.operators import clean as cl
from txnlens.operators import metrics as m
from txnlens.operators import parse as ps
from txnlens.operators import rules as r


def _one(spark, rows, schema, expr):
    return [x[0] for x in spark.createDataFrame(rows, schema).select(expr.alias("v")).collect()]


def _parse(spark, text, app=None):
    st = spark.createDataFrame([(1, text)], "statement_id long, text string")
    p = ps.parse_statements(st, app=app, as_of=F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return p.orderBy("line_no").collect()


@pytest.mark.parametrize("line,expected", [
    ("05/01/2024 10:15:00 Paid to Zomato ₹ 1,250.50", Decimal("1250.50")),
    ("05/01/2024\n10:15:00\nrefund\n₹99", Decimal("99.00")),
])
def test_paytm_parses(spark, line, expected):
    rows = _parse(spark, "Paytm statement\n" + line)
    assert len(rows) == 1 and rows[0]["amount"] == expected


@pytest.mark.parametrize("line", [
    "31/02/2024 10:15:00 Paid to X ₹10.00",
    "05/01/2024 25:15:00 refund ₹10.5",
    "05/01/2024 10:15:00 Paid to X ₹,",
    "05/01/2024 10:15:00 Paid to\nZomato ₹10",
    "05/01/2024 10:15:00 ₹10",
])
def test_paytm_skips(spark, line):
    assert _parse(spark, "Paytm statement\n" + line) == []


def test_paytm_type_and_abs(spark):
    rows = _parse(spark, "Paytm statement\n05/01/2024 10:15:00 PAID bill ₹12.5\n05/01/2024 10:15:00 bill ₹-1\n06/01/2024 11:00:00 refund ₹3")
    assert [(x["transaction_type"], x["amount"]) for x in rows] == [("debit", Decimal("12.50")),
                                                                     ("credit", Decimal("3.00"))]
    assert rows[0]["datetime"] == dt.datetime(2024, 1, 5, 10, 15, 0)


def test_gpay_case_sensitive_type_and_narrow_blank(spark):
    rows = _parse(spark, "Google Pay statement\nPAID TO Zomato 1 Jan 2023, 9:00 PM ₹10.00\n"
                         "Paid to Ola\n2 Jan 2023, 9:05 AM\n₹1,010.00")
    assert [(x["transaction_type"], x["amount"], x["datetime"]) for x in rows] == [
        ("credit", Decimal("10.00"), dt.datetime(2023, 1, 1, 21, 0)),
        ("debit", Decimal("1010.00"), dt.datetime(2023, 1, 2, 9, 5))]
    assert rows[1]["description"] == "Paid to Ola"


def test_phonepe_sent_is_debit_paid_is_credit(spark):
    rows = _parse(spark, "PhonePe statement\n05-01-2024 10:15 Paid to X ₹5\n05-01-2024 10:16 Sent to Y ₹6")
    assert [x["transaction_type"] for x in rows] == ["credit", "debit"]


def test_generic_lines(spark):
    rows = _parse(spark, "Bank\nCoffee ₹ 45.5 at 9\nno amount here\nbad ₹x\n  Tea ₹1,000  ")
    assert [(x["description"], x["amount"]) for x in rows] == [("Coffee ₹ 45.5 at 9", Decimal("45.50")),
                                                               ("Tea ₹1,000", Decimal("1000.00"))]
    assert all(x["app_source"] == "generic" and x["transaction_type"] == "debit" for x in rows)


def test_detect_app(spark):
    st = spark.createDataFrame([(1, "x" * 5000 + "paytm"), (2, "x"), (3, "Phone Pe"), (4, "GPAY"), (5, None),
                                (6, "Google Pay statement\nPaid to Paytm"), (7, "PhonePe and gpay and paytm")],
                               "statement_id long, text string")
    got = dict(ps.detect_app_source(st).collect())
    assert got == {1: "paytm", 2: "generic", 3: "phonepe", 4: "gpay", 5: "generic", 6: "gpay", 7: "phonepe"}


def test_late_marker_and_long_descriptions(spark):
    late = "terms and conditions " * 80 + "\nPaytm\n05/01/2024 10:15:00 Received from Ravi ₹10"
    assert [(x["app_source"], x["transaction_type"]) for x in _parse(spark, late)] == [("paytm", "credit")]
    same = "Paid to " + "a" * 120
    rows = _parse(spark, f"Paytm\n05/01/2024 10:15:00 {same}b ₹10\n05/01/2024 10:15:00 {same}c ₹10")
    assert [x["description"] for x in rows] == [same + "b", same + "c"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_hours_do_not_depend_on_the_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        paytm = _parse(spark, "Paytm\n10/03/2024 02:30:00 Paid to X ₹1\n03/11/2024 01:30:00 Paid to X ₹1")
        gpay = _parse(spark, "Google Pay\nPaid to X\n10 Mar 2024, 2:30 AM\n₹1.00")
        phonepe = _parse(spark, "PhonePe\n10-03-2024 02:30 Paid to X ₹1")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert [x["datetime"] for x in paytm] == [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 11, 3, 1, 30)]
    assert [x["datetime"] for x in gpay + phonepe] == [dt.datetime(2024, 3, 10, 2, 30)] * 2


def test_rejected_matches_are_counted(spark):
    rows = [(1, "Paytm\n05/01/2024 10:15:00 Paid to X ₹1\n31/02/2024 10:15:00 Paid to X ₹2\n05/01/2024 10:15:00 Paid to X ₹,"),
            (2, None), (3, " "), (4, "Paytm nothing")]
    st = spark.createDataFrame(rows, "statement_id long, text string")
    got = {x["statement_id"]: (x["status"], x["n_transactions"], x["n_rejected"])
           for x in ps.parse_status(st, ps.match_statements(st)).collect()}
    assert got == {1: ("ok", 1, 2), 2: ("failed: no text", 0, 0), 3: ("failed: no text", 0, 0), 4: ("failed: no transactions", 0, 0)}


@pytest.mark.parametrize("desc,merchant", [
    ("auto pay", "Pay"), ("paid to big onion", "Big"), ("transfer to self", "Transfer To"),
    ("to dmart", "Dmart"), ("7eleven store", "7Eleven Store"), ("x_ab 12cd", "X_Ab 12Cd"), ("", ""),
    ("received from ravi kumar via upi", "Ravi Kumar"), ("from bank", "Bank"),
])
def test_merchant_rules(spark, desc, merchant):
    assert _one(spark, [(desc,)], "d string", tx.extract_merchant("d")) == [merchant]


def test_merchant_null_is_unknown(spark):
    assert _one(spark, [(None,)], "d string", tx.extract_merchant("d")) == ["Unknown"]


def test_category_last_match_wins(spark):
    got = _one(spark, [("cola service centre",), ("uber to atm",), ("nothing",)], "d string", tx.categorize("d"))
    assert got == ["Bills & Utilities", "Others", "Others"]


def test_clean_description_unicode_blanks(spark):
    got = _one(spark, [("  Paid to\tZOMATO!!  #1 ",)], "d string", tx.clean_description("d"))
    assert got == ["paid to zomato 1"]


@pytest.mark.parametrize("s,expected", [
    ("05/01/2024", dt.date(2024, 1, 5)), ("5/1/2024", dt.date(2024, 1, 5)), ("31-12-2023", dt.date(2023, 12, 31)),
    ("2024-03-07", dt.date(2024, 3, 7)), ("1 Jan 2023", dt.date(2023, 1, 1)), ("1 january 2023", dt.date(2023, 1, 1)),
    ("12/31/2023", dt.date(2023, 12, 31)), ("31/31/2023", None), ("2023-02-30", None), ("junk", None), ("", None),
    (None, None),
])
def test_parse_flexible_date(spark, s, expected):
    assert _one(spark, [(s,)], "s string", sc.parse_flexible_date("s")) == [expected]


@pytest.mark.parametrize("s,expected", [
    ("₹1,250.50", 1250.5), ("₹ 99", 99.0), ("1e3", 1000.0), ("-5", -5.0), ("₹-5", -5.0), (".5", 0.5), ("5.", 5.0),
    ("abc", 0.0), ("", 0.0), ("1d", 0.0), ("0x1A", 0.0), (None, 0.0),
])
def test_to_amount(spark, s, expected):
    assert _one(spark, [(s,)], "s string", sc.to_amount("s")) == [expected]


@pytest.mark.parametrize("a,label", [("100", "Very Low"), ("100.01", "Low"), ("500", "Low"), ("5000", "High"),
                                     ("5000.01", "Very High"), ("0", None)])
def test_amount_bins(spark, a, label):
    assert _one(spark, [(Decimal(a),)], "a decimal(18,2)", cl.amount_range("a")) == [label]


def test_mask_and_hash(spark):
    got = spark.createDataFrame([("1234",), ("1234567890",)], "s string").select(
        sc.mask_account("s").alias("m"), sc.hash_sensitive("s").alias("h")).collect()
    assert [x["m"] for x in got] == ["1234", "******7890"]
    assert got[0]["h"] == "03ac674216f3e15c"


def test_date_range_label(spark):
    rows = [(dt.date(2024, 1, 1), dt.date(2024, 1, 8)), (dt.date(2024, 1, 1), dt.date(2024, 12, 31))]
    got = _one(spark, rows, "a date, b date", sc.date_range_label("a", "b"))
    assert got == ["This week", "365 days"]


TXN_SCHEMA = ("account_id long, line_no long, date date, datetime timestamp_ntz, description string, "
              "amount decimal(18,2), transaction_type string")


def _txn(spark, rows):
    return spark.createDataFrame(rows, TXN_SCHEMA)


def test_dedupe_first_and_sign(spark):
    d = dt.date(2024, 1, 1)
    ts = dt.datetime(2024, 1, 1, 9)
    rows = [(1, 3, d, ts, "x", Decimal("50"), "credit"), (1, 2, d, ts, "x", Decimal("50"), "debit"),
            (1, 1, d, ts, "x", Decimal("-50"), "debit"), (2, 9, d, ts, "x", Decimal("50"), "credit")]
    out = cl.dedupe_near(_txn(spark, rows), ("account_id",)).orderBy("account_id", "line_no").collect()
    assert [(x["account_id"], x["line_no"], x["transaction_type"]) for x in out] == [(1, 1, "debit"), (1, 2, "debit"),
                                                                                    (2, 9, "credit")]


def _clean_rows(spark):
    rows = []
    for i in range(61):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=i % 10)
        rows.append((i % 3, i, day, dt.datetime.combine(day, dt.time(i % 24)), ["Paid to Zomato", "Netflix", "to Dmart",
                     "Salary from Acme"][i % 4], Decimal(str(10 + i * 7.25)), "credit" if i % 4 == 3 else "debit"))
    df = _txn(spark, rows).withColumn("statement_id", F.col("account_id")).withColumn("app_source", F.lit("paytm")) \
        .withColumn("month", F.month("date")).withColumn("year", F.year("date"))
    return cl.clean_transactions(df, ("account_id",))


def test_shares_sum_to_one_and_histogram_counts(spark):
    c = _clean_rows(spark)
    shares = m.category_share(c, ("account_id",)).groupBy("account_id").agg(F.sum("share").alias("s")).collect()
    assert all(abs(x["s"] - 1) < 1e-9 for x in shares)
    h = m.amount_histogram(c, ("account_id",), 30).groupBy("account_id").agg(F.sum("n").alias("n"))
    n = c.groupBy("account_id").count()
    assert sorted(h.collect()) == sorted(n.collect())


def test_per_key_equals_global_on_that_key(spark):
    c = _clean_rows(spark)
    per_key = {x["category"]: x["amount"] for x in m.category_spending(c, ("account_id",)).filter("account_id = 1").collect()}
    glob = {x["category"]: x["amount"] for x in m.category_spending(c.filter("account_id = 1")).collect()}
    assert per_key == glob


def test_zero_filled_levels_and_weekdays(spark):
    c = _clean_rows(spark)
    stats = m.category_stats(c, ("account_id",), ["Entertainment"]).filter("account_id = 0").collect()
    food = [x for x in stats if x["category"] == "Food & Dining"][0]
    assert food["transaction_count"] == 0 and food["average_amount"] is None and food["total_amount"] == 0
    dow = m.day_of_week_spending(c, ("account_id",))
    assert dow.groupBy("account_id").count().filter("count != 7").count() == 0


def test_recommendation_rows(spark):
    c = _clean_rows(spark)
    rec = r.recommendations(c, ("account_id",)).collect()
    assert {x["rule_no"] for x in rec} <= {1, 2, 3, 4}
    assert all(x["recommendation"] for x in rec)


def test_parse_insight_response(spark):
    good = {"key_insights": ["a", {"b": 1}], "improvement_areas": "nope", "additional_notes": "n"}
    rows = [(1, "Sure! " + json.dumps(good) + " bye"), (2, "no json"), (3, '{"key_insights": ["x"'),
            (4, '{"positive_habits": ["p"]}')]
    df = spark.createDataFrame(rows, "account_id long, response string")
    got = {x["account_id"]: x for x in r.parse_insight_response(df, ("account_id",)).collect()}
    assert got[1]["key_insights"] == ["a", '{"b":1}'] and got[1]["improvement_areas"] == []
    assert got[1]["additional_notes"] == "n" and got[1]["insights_type"] == "model_generated"
    assert got[2]["insights_type"] == "fallback" and got[2]["llm_analysis"] == "no json"
    assert got[3]["insights_type"] == "fallback"
    assert got[4]["positive_habits"] == ["p"] and got[4]["key_insights"] == []


def test_model_failure_falls_back(spark):
    c = _clean_rows(spark)

    def flaky(prompt):
        if "payments: 20" in prompt:
            raise RuntimeError("down")
        return '{"key_insights": ["ok"]}'

    parsed, rule = r.model_insights(c, flaky, ("account_id",))
    assert parsed.count() + rule.select("account_id").distinct().count() == 3
    advice = r.format_model_advice(parsed, ("account_id",)).collect()
    assert any(x["line"] == "- ok" for x in advice)


def test_unsteady_model_is_called_once_a_key(spark):
    import random
    import tempfile

    calls = tempfile.mkdtemp(prefix="txnlens-calls-")

    def unsteady(prompt):
        tempfile.mkstemp(dir=calls)
        if random.random() < 0.5:
            raise RuntimeError("down")
        return "{}"

    import os
    parsed, rule = r.model_insights(_clean_rows(spark), unsteady, ("account_id",))
    a = {x["account_id"] for x in parsed.collect()}
    b = {x["account_id"] for x in rule.collect()}
    assert a | b == {0, 1, 2} and not a & b
    assert len(os.listdir(calls)) == 3


def test_raw_answer_length_is_a_parameter(spark):
    df = spark.createDataFrame([(1, "x" * 900)], "account_id long, response string")
    parsed = r.parse_insight_response(df, ("account_id",))
    lengths = [max(len(x["line"]) for x in r.format_model_advice(parsed, ("account_id",), n).collect()) for n in (500, 700, None)]
    assert lengths == [503, 703, 900]


def test_title_case_runs_of_uncased_letters(spark):
    """Every letter after an uncased character starts a word, also inside a
    run of uncased letters (Python ``str.title``)."""
    vals = ["0中A", "中中中中a", "7eleven store", "o'neil", "aBC dEF", "x_y", "1a2b3c", "éa1b"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, s string")
    got = [r[1] for r in sorted(df.select("i", tx.title_case("s")).collect())]
    assert got == [v.title() for v in vals]


def test_parse_separator_inside_description(spark):
    """The one-pass group split keeps the free-text group last: a separator
    character inside a description does not shift the other fields."""
    rows = _parse(spark, "Paytm statement\n05/01/2024 10:15:00 Paid to A\u0001B ₹12.50")
    assert len(rows) == 1
    assert rows[0]["description"] == "Paid to A\u0001B"
    assert float(rows[0]["amount"]) == 12.5
    assert rows[0]["transaction_type"] == "debit"
