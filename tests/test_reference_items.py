"""Model scoring, long statements, keyword tables, JSON arrays, page streams, safe saves, batch dedupe, calendar, checks on write."""

import json
import os
import random
import tempfile
import tracemalloc

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from txnlens.operators import clean as cl
from txnlens.operators import dedupe_index as di
from txnlens.operators import long_statements as ls
from txnlens.operators import metrics as m
from txnlens.operators import parse as ps
from txnlens.operators import quality as q
from txnlens.operators import rules as r
from txnlens.operators import vocabulary as vo
from txnlens.plans import catalog
from txnlens.sources import files as fl


def folder():
    return tempfile.mkdtemp(prefix="txnlens-items-")


# --- model ------------------------------------------------------------------------------

def test_every_key_is_asked_once_and_lies_in_one_result(spark):
    log = folder()

    def model(prompts):
        answers = []
        for p in prompts:
            with open(os.path.join(log, f"{os.getpid()}-{random.random()}"), "w") as f:
                f.write(p)
            n = int(p.split("payments: ")[1].split("\n")[0])
            answers.append(None if n % 3 == 0 else TimeoutError() if n % 3 == 1 else '{"key_insights": ["fine"]}')
        return answers

    clean = catalog.clean(spark, SF_SMALL)
    parsed, rule = r.model_insights(clean, model, ("account_id",), batch=4)
    good, bad = {x.account_id for x in parsed.collect()}, {x.account_id for x in rule.collect()}
    accounts = {x.account_id for x in clean.select("account_id").distinct().collect()}
    assert good | bad == accounts and not good & bad and good and bad
    rows = r.insight_rows(parsed, rule, ("account_id",)).collect()
    assert {x.account_id for x in rows} == accounts
    asked = sorted(open(os.path.join(log, f)).read() for f in os.listdir(log))
    assert asked == sorted(x.prompt for x in r.build_insight_prompt(clean, ("account_id",)).collect())


def test_a_failing_batch_leaves_the_others(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(10)] + [(None, None)], "k int, prompt string").coalesce(1)

    def model(some):
        if "p4" in some:
            raise KeyError
        return some[:-1] if "p6" in some else [x and x.upper() for x in some]

    got = {x.k: (x.response, x.model_error) for x in r.score_prompts(prompts, model, ("k",), batch=2).collect()}
    assert got == {0: ("P0", None), 1: ("P1", None), 2: ("P2", None), 3: ("P3", None), 4: (None, "KeyError"), 5: (None, "KeyError"),
                   6: (None, "ValueError"), 7: (None, "ValueError"), 8: ("P8", None), 9: ("P9", None), None: (None, "NoAnswer")}


# --- long statements -----------------------------------------------------------------------

LAYOUTS = {
    "paytm": ["Paytm statement", "05/01/2024", "10:15:00", "", "  Paid to Zomato", "₹", "1,250.50", "06/01/2024 11:00:00 Paid to Ola ₹ 75",
              "07/01/2024 09:00:00", "note without amount", "08/01/2024 10:00:00 Received", "₹9"],
    "gpay": ["Google Pay", "Paid to", "Big Bazaar", "5", "Jan 2024,", "3:07 PM", "₹", "12.50", "Received from Ravi", "6 Jan 2024, 9:00 AM", "₹7.00",
             "paid to nobody", "7 Jan", "2024, 1:00", "PM", "₹3.25"],
    "phonepe": ["PhonePe", "05-01-2024 10:15", "Sent to A", "₹5", "", "06-01-2024", "11:00 Sent to B ₹", "6.50", "07-01-2024 12:00 x ₹7"],
    "generic": ["bank", "coffee ₹ 20", "", "₹5 tea", "nothing"],
}


@pytest.mark.parametrize("app", LAYOUTS)
def test_blocks_of_any_size_parse_like_the_whole(spark, app):
    """Every split point: blocks of one line and more, over lines repeated so that matches meet each edge."""
    lines = LAYOUTS[app]
    texts = [(i, "\n".join(lines[:1] + (lines[1:] * 3)[i:])) for i in range(len(lines))] + [(98, ""), (99, None)]
    st = spark.createDataFrame(texts, "statement_id int, text string")
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    columns = ["statement_id", "line_no", "datetime", "description", "amount", "transaction_type", "app_source"]
    whole = sorted(map(tuple, ps.parse_statements(st, as_of=at).select(*columns).collect()))
    assert whole
    for size in (1, 2, 5, 1000):
        blocks = ls.statement_blocks(st, block_lines=size).collect()
        for i, text in texts[:-1]:
            assert "\n".join(b.text for b in sorted((b for b in blocks if b.statement_id == i), key=lambda b: b.block_no)) == text
        assert (max(b.n_blocks for b in blocks) > 1) == (size < 1000)
        assert sorted(map(tuple, ls.parse_long_statements(st, as_of=at, block_lines=size).select(*columns).collect())) == whole


def test_a_long_statement_is_parsed_by_many_tasks(spark):
    line = "05/01/2024 10:15:00 Paid to Zomato ₹10"
    st = spark.createDataFrame([(1, "Paytm\n" + "\n".join([line] * 20_000))], "statement_id int, text string")
    parsed = ls.parse_long_statements(st, block_lines=500)
    assert parsed.count() == 20_000
    assert parsed.agg(F.max("line_no"), F.count_distinct("line_no")).first() == (19_999, 20_000)
    parts = ls.statement_blocks(st, block_lines=500).repartition(8, "statement_id", "block_no")
    assert parts.select(F.spark_partition_id()).distinct().count() >= 6


def test_only_the_line_ends_near_a_cut_are_tested(spark):
    """The plan holds no list of all line ends that no match crosses; cuts are the first of each stretch."""
    st = spark.createDataFrame([(1, "\n".join(["Paytm"] + ["x"] * 9 + [""] * 7 + ["y"] * 3))], "statement_id int, text string")
    blocks = ls.statement_blocks(st, block_lines=4)
    assert "_firm" not in blocks._jdf.queryExecution().analyzed().toString()
    # ends 10 to 17 touch an empty line, so the stretches 8-11 and 16-19 begin at 8 and 18, and 12-15 has no cut
    assert [b.text.count("\n") + 1 for b in sorted(blocks.collect(), key=lambda b: b.block_no)] == [4, 4, 10, 2]


def test_the_most_frequent_category_is_found_by_counts(spark):
    from txnlens.operators import metrics as m

    rows = [("a", "x", "c2", 1), ("a", "x", "c1", 2), ("a", "x", None, 3), ("a", "x", None, 3), ("a", "x", None, None), ("a", "y", None, 4),
            ("a", None, "c3", 50), ("b", "x", "c1", 1), ("b", "x", "c9", 1), ("b", "x", "c9", 1)]
    t = spark.createDataFrame(rows, "k string, merchant string, category string, amount int").withColumn("amount", F.col("amount").cast("decimal(12,2)"))
    found = m.merchant_stats(t, ("k",), 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and found.schema["total_amount"].dataType.simpleString() == "decimal(22,2)"
    assert sorted((r.k, str(r.merchant), float(r.total_amount), r.average_amount, r.transaction_count, r.primary_category) for r in found.collect()) == [
        ("a", "None", 50.0, 50.0, 1, "c3"), ("a", "x", 9.0, 2.25, 5, "c1"), ("b", "x", 3.0, 1.0, 3, "c9")]


# --- keyword table ----------------------------------------------------------------------------

def test_keyword_table_equals_comparing_all(spark):
    rng = random.Random(3)
    letters = "abcde fgäß"
    words = [(rng.randint(0, 5), f"c{rng.randint(0, 9)}", "".join(rng.choices(letters, k=rng.randint(1, 8)))) for _ in range(400)]
    words += [(9, "none", ""), (9, "none", None), (3, "up", "ABC")]
    texts = [(i, "".join(rng.choices(letters, k=rng.randint(0, 40)))) for i in range(300)] + [(300, None), (301, ""), (302, "xx ABCDE")]
    got = {x.id: x.category for x in vo.categorize_by_table(
        spark.createDataFrame(texts, "id int, description_clean string"),
        spark.createDataFrame(words, "priority int, category string, keyword string")).collect()}
    for i, t in texts:
        hits = [(p, c) for p, c, k in words if k and t and k.lower() in t.lower()]
        assert got[i] == (max(hits)[1] if hits else "Others"), (i, t)


def test_keyword_table_of_the_literal_groups(spark):
    """The literal rule as a table: a later group has the higher priority."""
    from txnlens import schema
    from txnlens.functions import text as tx

    rows = [(i, c, k) for i, (c, words) in enumerate(schema.CATEGORY_KEYWORDS) for k in words]
    t = catalog._texts(spark, SF_SMALL).select("src", "id", tx.clean_description("description").alias("description_clean"))
    by_table = vo.categorize_by_table(t, spark.createDataFrame(rows, "priority int, category string, keyword string"))
    literal = t.select("src", "id", tx.categorize("description_clean").alias("category"))
    assert by_table.select("src", "id", "category").exceptAll(literal).count() == 0
    empty = spark.createDataFrame([], "priority int, category string, keyword string")
    assert vo.categorize_by_table(t, empty).filter("category != 'Others'").count() == 0


def test_many_keywords_meet_by_an_equi_join(spark):
    words = spark.range(50_000).select((F.col("id") % 11).alias("priority"), F.concat(F.lit("c"), F.col("id") % 11).alias("category"),
                                       F.concat(F.lit("key"), F.col("id")).alias("keyword"))
    texts = spark.createDataFrame([(1, "a key49999 b"), (2, "key12"), (3, "key x")], "id int, description_clean string")
    found = vo.categorize_by_table(texts, words)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # key49999 also holds key4 (4), key49 (5), key499 (4), key4999 (5), itself 49999 % 11 = 4
    assert {x.id: x.category for x in found.collect()} == {1: "c5", 2: "c1", 3: "Others"}


def test_keyword_table_carries_no_places_or_texts_and_any_bitmap_is_right(spark, monkeypatch):
    rng = random.Random(5)
    letters = "abcdé ß😀x"
    words = [(rng.randint(0, 5), f"c{rng.randint(0, 9)}", "".join(rng.choices(letters, k=rng.choice((1, 3, 4, 5, 8, 9, 17, 40))))) for _ in range(500)]
    texts = [(i, "".join(rng.choices(letters, k=rng.randint(0, 60)))) for i in range(200)] + [(200, None), (201, "")]
    texts += [(i, texts[i % 7][1]) for i in range(202, 230)] + [(230, "q" * 50_000 + words[0][2] + words[1][2].upper())]
    texts += [(231 + i, f"q{words[i][2]}q") for i in range(100)]
    w = spark.createDataFrame(words, "priority int, category string, keyword string")
    t = spark.createDataFrame(texts, "id int, description_clean string")
    for bits, broadcast in ((vo.MAX_BITS, vo.BROADCAST_BYTES), (1 << 11, 0)):
        monkeypatch.setattr(vo, "MAX_BITS", bits)
        monkeypatch.setattr(vo, "BROADCAST_BYTES", broadcast)
        found = vo.categorize_by_table(t, w)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and ("SortMergeJoin [keyword" in plan) == (not broadcast)
        got = {x.id: x.category for x in found.collect()}
        assert len(got) == len(texts)
        for i, x in texts:
            hits = [(p, c) for p, c, k in words if x and k.lower() in x.lower()]
            assert got[i] == (max(hits)[1] if hits else "Others"), (i, x)


# --- JSON arrays -------------------------------------------------------------------------------------

@pytest.mark.parametrize("indent", [None, 1])
def test_one_json_array_is_read_by_many_tasks(spark, indent):
    rng = random.Random(7)
    odd = ['plain', 'a "quoted" }, { word', 'back\\slash\\', '[{"not": "an object"}]', 'line\nend', '', 'ü}', '\\"}', None]
    rows = [{"id": i, "text": rng.choice(odd), "sub": {"a": [i, {"b": "}"}], "c": {}}, "list": [[], [{"x": 1}]]} for i in range(3000)]
    path = os.path.join(folder(), "table.json")
    os.mkdir(path)
    for name, part in (("a", rows[:2500]), ("b", rows[2500:]), ("c", [])):
        with open(os.path.join(path, f"{name}.txt"), "w", encoding="utf-8") as f:
            json.dump(part, f, indent=indent, ensure_ascii=name == "b")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "20000")
        table = fl.load_table(spark, path, "id bigint, text string, sub struct<c: string>", json_array=True)
        got = sorted((x.id, x.text) for x in table.collect())
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(x["id"], x["text"]) for x in rows]


# --- pages ---------------------------------------------------------------------------------------------

def test_pages_of_a_file_are_never_all_in_memory():
    page = "x" * 200_000

    def decode(_):
        for i in range(300):
            yield f"{i}{page}"
        raise EOFError

    tracemalloc.start()
    numbers, states = [], []
    for batch in fl._page_batches(iter([("f", b"", "valid"), ("g", None, "wrong extension")]), decode):
        assert batch.column("text").nbytes <= fl.DECODED + 1000
        numbers += batch.column("page_no").to_pylist()
        states += batch.column("status").to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert numbers == [*range(301), 0] and states == ["ok"] * 300 + ["failed: EOFError", "wrong extension"]
    assert peak < 10 * fl.DECODED                    # 60 MB of pages


@pytest.mark.parametrize("text", ["", "\f", "a\fb", "é" * 700_000 + "\f" + "漢" * 400_000, "a" * (fl.DECODED - 1) + "é\f"])
def test_default_decoder_in_parts(text):
    assert list(fl.decode_utf8_pages(text.encode())) == text.split("\f")
    with pytest.raises(UnicodeDecodeError):
        list(fl.decode_utf8_pages(text.encode() + b"\xc3"))


# --- saves -----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_a_failing_save_leaves_the_old_table(spark, fmt):
    path = os.path.join(folder(), f"t.{fmt}")
    assert fl.save_table(spark.range(5), path, fmt)
    boom = spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).cast("bigint").alias("id"))
    assert fl.save_table(boom, path, fmt) is False
    assert fl.load_table(spark, path, "id bigint").count() == 5
    assert fl.save_table(spark.range(7), path, fmt, mode="errorifexists") is False
    assert fl.save_table(spark.range(3), path, fmt) is True
    assert fl.load_table(spark, path, "id bigint").count() == 3
    assert fl.save_table(spark.range(3), path, "excel") is False
    assert os.listdir(os.path.dirname(path)) == [os.path.basename(path)] or sorted(
        f for f in os.listdir(os.path.dirname(path)) if not f.endswith(".crc")) == [os.path.basename(path)]


def test_a_save_that_loses_rows_is_no_save(spark, monkeypatch):
    path = os.path.join(folder(), "t.parquet")
    assert fl.save_table(spark.range(5), path, "parquet")
    monkeypatch.setattr(fl, "_rows_of", lambda *a: 4)
    assert fl.save_table(spark.range(6), path, "parquet") is False
    monkeypatch.undo()
    assert spark.read.parquet(path).count() == 5


# --- batches ----------------------------------------------------------------------------------------------

def batches():
    rng = random.Random(11)
    rows = [(1, i, rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), rng.choice([-1.0, 0.0, None])) for i in range(120)]
    return rows, "account_id int, line_no int, date int, description string, amount double"


def test_batches_equal_one_run_and_repeats_change_nothing(spark):
    rows, kinds = batches()
    whole = cl.dedupe_near(spark.createDataFrame(rows, kinds), ("account_id",))
    expected = sorted(map(tuple, whole.collect()), key=str)
    base = folder()
    path, kept = os.path.join(base, "index"), {}
    for number in (0, 1, 2, 1, 0, 3, 2):
        part = spark.createDataFrame(rows[number * 30:number * 30 + 30], kinds)
        fresh = sorted(map(tuple, di.dedupe_batch(part, path, number, ("account_id",), buckets=4).collect()), key=str)
        assert kept.setdefault(number, fresh) == fresh
    assert sorted((x for v in kept.values() for x in v), key=str) == expected
    # a batch given twice under one number is no batch of duplicates, one under a new number is
    again = spark.createDataFrame(rows[:30], kinds)
    assert di.dedupe_batch(again, path, 4, ("account_id",)).count() == 0
    # an index of another folder with the same last name is another index
    other = os.path.join(folder(), "index")
    assert di.dedupe_batch(again, other, 0, ("account_id",), buckets=4).count() == len(kept[0])


def test_an_index_is_found_again(spark):
    rows, kinds = batches()
    path = os.path.join(folder(), "index")
    di.dedupe_batch(spark.createDataFrame(rows[:60], kinds), path, 0, ("account_id",), buckets=4)
    name = di.index_table(spark, path)
    spark.sql(f"DROP TABLE {name}")                       # external: the files stay, as for another session
    assert di.dedupe_batch(spark.createDataFrame(rows[:60], kinds), path, 1, ("account_id",), buckets=4).count() == 0


def test_a_batch_meets_the_index_without_shuffling_it(spark):
    rows, kinds = batches()
    path = os.path.join(folder(), "index")
    di.dedupe_batch(spark.createDataFrame(rows[:60], kinds), path, 0, ("account_id",), buckets=8)
    fresh = di.dedupe_batch(spark.createDataFrame(rows[60:], kinds), path, 1, ("account_id",), buckets=8)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan, plan


# --- calendar, checks on write, plans ------------------------------------------------------------------------

def test_a_month_without_debits_counts_as_zero(spark):
    rows = [("k", "Food", "2024-01-05", 100), ("k", "Food", "2024-01-09", 20), ("k", "Food", "2024-03-01", 60), ("k", "Cab", "2024-03-02", 5),
            (None, "Food", "2024-02-01", 1), ("k", "Food", "2024-05-01", 7)]
    df = spark.createDataFrame(rows, "account_id string, category string, day string, amount int").select(
        "account_id", "category", F.col("day").cast("timestamp").alias("datetime"), F.col("amount").cast("decimal(18,2)"),
        F.when(F.col("day") == "2024-05-01", "credit").otherwise("debit").alias("transaction_type"))
    got = sorted(((x.account_id, x.category, x.month_year, float(x.amount), None if x.prev_amount is None else float(x.prev_amount), x.pct_change)
                  for x in m.calendar_category_change(df, ("account_id",)).collect()), key=str)
    assert got == sorted([("k", "Food", "2024-01", 120.0, None, None), ("k", "Food", "2024-02", 0.0, 120.0, -100.0),
                          ("k", "Food", "2024-03", 60.0, 0.0, 0.0),
                          ("k", "Cab", "2024-03", 5.0, None, None), (None, "Food", "2024-02", 1.0, None, None)], key=str)


@pytest.mark.parametrize("drop", [(), ("description",), ("amount", "date")])
def test_checks_on_write_equal_the_aggregate_with_one_scan(spark, drop):
    from txnlens.sources import fixtures as fx

    t = fx.txn_dirty(spark, SF_SMALL).drop(*drop)
    watched, seen = q.observed_validation(t)
    plan = watched._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan
    path = os.path.join(folder(), "t")
    watched.write.parquet(path)
    assert q.observed_result(spark, t, seen).collect() == q.validate_transactions(t).collect()
    assert q.validate_transactions(t).first().missing_columns == [c for c in ("date", "amount", "description", "transaction_type") if c in drop]


def test_a_histogram_runs_no_text_rules(spark):
    plan = catalog.QUERIES["amount_histogram"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract" not in plan and "Contains" not in plan and "regexp_replace" not in plan


def test_summary_maps_hold_all_entries(spark):
    clean = catalog.clean(spark, SF_SMALL)
    for row in m.summary_stats(clean, ("account_id",)).collect():
        assert sum(row.categories.values()) == sum(row.transaction_types.values()) == row.total_transactions
        assert len(row.top_merchants) <= 5
