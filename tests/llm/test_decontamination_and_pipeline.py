import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from txnlens.llm import decontaminate as dc
from txnlens.llm import text as tx
from txnlens.llm.queries import ORACLE_SQL, QUERIES


def brute_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (dc.MATCH if x == y else dc.MISMATCH), h[i][j + 1] + dc.GAP, h[i + 1][j] + dc.GAP)
    return max(map(max, h))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.lists(st.lists(st.integers(1, 5), max_size=15), min_size=1, max_size=4))
def test_alignment_equals_brute_force(item, passages):
    width = max(map(len, passages))
    padded = np.array([p + [0] * (width - len(p)) for p in passages], dtype=np.uint64).reshape(len(passages), width)
    best, _, _ = dc.smith_waterman(np.array(item, dtype=np.uint64), padded)
    assert best.tolist() == [brute_alignment(item, p) for p in passages]


def test_every_window_of_an_item_has_a_seed():
    items = dc.read_items([(1, " ".join(f"w{i}" for i in range(30))), (2, "two words"), (3, None), (4, "")])
    frequency = {size: (np.unique(v), np.arange(len(v))) for size, (v, _, _) in items.grams().items()}
    seeds = dc.seeds(items, frequency, window=4)
    place = np.sort(seeds[3][2])
    assert place[0] < 4 and (np.diff(place) <= 4).all() and place[-1] >= 24
    assert set(seeds) == {2, 3} and seeds[2][1].tolist() == [1]


def words(n, seed):
    r = random.Random(seed)
    return [f"v{r.randrange(10**6)}" for _ in range(n)]


@pytest.fixture(scope="module")
def cases():
    item = words(30, 1)
    edited = list(item)
    edited[4] = edited[15] = "changed"
    del edited[22]
    edited.insert(10, "added")
    items = [(1, " ".join(item)), (2, "Tiny one"), (3, None), (4, ""), (5, " ".join(words(25, 2))), (5, " ".join(words(25, 2)))]
    pad = words(300, 3)
    docs = [(1, " ".join(pad + item + pad)), (2, " ".join(pad + edited).upper()), (3, " ".join(pad)), (4, None), (5, ""),
            (6, " ".join(item[:8] + pad)), (7, "a TINY, one b"), (None, " ".join(item)), (1, " ".join(pad + item + pad)),
            (8, " ".join(words(25, 2) + pad + words(25, 2)))]
    return docs, items


def frames(spark, cases):
    docs, items = cases
    return (spark.createDataFrame([(i, t, 1.5, 9) for i, t in docs], "doc_id bigint, text string, score double, item_id int"),
            spark.createDataFrame(items, "item_id bigint, text string"))


def test_copies_and_edited_copies_are_found(spark, cases):
    docs, items = frames(spark, cases)
    rows = dc.contaminated(docs, items).collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in rows) == [("1", 1), ("1", 1), ("2", 1), ("7", 2), ("8", 5), ("8", 5), ("None", 1)]
    by = {(r["doc_id"], r["item_id"]): r for r in rows}
    whole = by[1, 1]
    assert (whole["score"], whole["start_word"], whole["end_word"], whole["item_start"], whole["item_end"]) == (1.0, 300, 330, 0, 30)
    assert whole["passage"] == cases[1][0][1] and 0.7 < by[2, 1]["score"] < 1


def test_blocks_give_the_same(spark, cases):
    docs, items = frames(spark, cases)
    key = lambda r: (str(r["doc_id"]), r["item_id"], r["score"], r["start_word"])
    assert sorted(map(key, dc.contaminated(docs, items, block_bytes=60).collect())) == sorted(map(key, dc.contaminated(docs, items).collect()))
    assert dc.remove_contaminated(docs, items, block_bytes=60).count() == dc.remove_contaminated(docs, items).count() == 4


def test_removal_keeps_rows_and_columns(spark, cases):
    docs, items = frames(spark, cases)
    kept = dc.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]


def test_empty_tables(spark, cases):
    docs, items = frames(spark, cases)
    assert dc.contaminated(docs.limit(0), items).count() == 0
    assert dc.contaminated(docs, items.limit(0)).count() == 0
    assert dc.remove_contaminated(docs, items.limit(0)).count() == docs.count()


def test_query_finds_what_brute_force_finds(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    split = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    exact = {(d, i) for d, t in docs for i, s in items if f" {split(s)} " in f" {split(t)} "}
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in QUERIES["op2_decontaminate"](spark, SF_SMALL).collect()}
    assert {k for k, s in got.items() if s == 1.0} == exact
    hashed = {i: tx.words(pa.array([t])).hash for i, t in items}
    for d, t in docs[:60]:
        h = tx.words(pa.array([t or ""])).hash.reshape(1, -1)
        for i, item in hashed.items():
            if h.size and dc.smith_waterman(item, h)[0][0] >= dc.THRESHOLD * dc.MATCH * len(item):
                assert (d, i) in got


@pytest.mark.parametrize("length", [4, 7, 15, 16, 20, 30, 60])
def test_edited_copies_at_every_rate_are_found(spark, length):
    """Every copy whose Smith-Waterman score reaches the threshold is found, however its changed or missing words are spread."""
    items, docs, r = [], [], random.Random(length)
    for k in range(60):
        item = words(length, 1000 * length + k)
        items.append((k, " ".join(item)))
        copy = list(item)
        step = 3 + k % 4
        if k % 3 == 0:
            copy = [f"x{r.random()}" if i % step == step - 1 else x for i, x in enumerate(copy)]
        elif k % 3 == 1:
            copy = [x for i, x in enumerate(copy) if i % step != step - 1]
        else:
            copy = [f"x{r.random()}" if r.random() < 1 / step else x for x in copy]
        docs.append((k, " ".join(words(50, 9 * k) + copy + words(50, 9 * k + 1)), 1.5, 9))
    want = set()
    for (k, item), (_, text, _, _) in zip(items, docs, strict=True):
        a, b = (tx.words(pa.array([t])).hash for t in (item, text))
        if dc.smith_waterman(a, b.reshape(1, -1))[0][0] >= dc.THRESHOLD * dc.MATCH * length:
            want.add((k, k))
    assert len(want) > 30
    rows = dc.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string, score double, item_id int"),
                           spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want


def test_items_of_other_id_types(spark, cases):
    docs, items = frames(spark, cases)
    for key in ("cast(item_id as smallint)", "cast(item_id as decimal(9,2))", "cast(item_id as double)",
                "date_add(date'2020-01-01', cast(item_id as int))"):
        assert dc.contaminated(docs, items.withColumn("item_id", F.expr(key))).count() == 7


# --- pipeline ---

def test_stages_are_in_order_and_keep_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.write(stage(spark, docs, SF_SMALL), "stage")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    left = {r["doc_id"] for r in docs.collect()}
    leaks = {r["doc_id"] for r in QUERIES["op2_decontaminate"](spark, SF_SMALL).collect()}
    assert not left & leaks
    packed = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {r["doc_id"] for r in packed} == left
    assert max(sum(r["length"] for r in packed if r["sequence_id"] == s) for s in {r["sequence_id"] for r in packed}) <= 2048


def test_stages_take_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    odd = [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "text " * 20_000, "en", "s", None), (2, "x", "en", "s", 1)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_SMALL)
            if name != "packing":
                assert out.columns == docs.columns
            assert out.count() <= max(len(rows), 1) + 25 * (name == "packing")


def test_every_operator_is_registered_once():
    numbers = sorted(int(k[2:].split("_")[0]) for k in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
