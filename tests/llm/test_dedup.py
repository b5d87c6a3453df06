import collections
import hashlib
import random
import re

import duckdb
import pyarrow as pa
import pytest

from conftest import SF_SMALL
from txnlens.llm import exact_dedup, near_dedup, scratch, suffix_dedup
from txnlens.llm import text as tx
from txnlens.llm.components import connected_components
from txnlens.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id bigint, text string, key string, id string, x_ int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "i", 1) for i, t in rows], SCHEMA)


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def bag(text):
    w = re.findall(r"\w+", (text or "").lower())
    if not w:
        return None
    return collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])


def jaccard(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def brute_classes(rows, threshold=0.8):
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] is not None and bags[j] is not None and jaccard(bags[i], bags[j]) >= threshold:
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted(sorted(g) for g in groups.values())


# --- components ---

def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(7, 7), (300, 301), (301, 300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 130)}, 300: 300, 301: 300}
    assert got == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_few_edges_take_few_tasks(spark):
    from txnlens.llm import components

    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(10 * i, 10 * i + k) for i in range(100) for k in range(1, 4)], "a bigint, b bigint")
        found = connected_components(edges)
        assert {r["node"]: r["component"] for r in found.collect()} == {10 * i + k: 10 * i for i in range(100) for k in range(4)}
        assert len(found.inputFiles()) <= components.FILES
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


# --- near duplicates ---

@pytest.fixture(scope="module")
def near_rows():
    rows, base = [], words(120, 1)
    rows.append((1, " ".join(base)))
    for k in range(2, 9):                                   # one word changed: similarity above 0.9
        w = list(base)
        w[10 * k] = f"other{k}"
        rows.append((k, " ".join(w)))
    w = list(base)
    for k in range(0, 120, 12):                             # far below 0.8
        w[k] = f"far{k}"
    rows += [(20, " ".join(w)), (21, " ".join(words(100, 2))), (22, "Short text, here."), (23, "short TEXT here"), (24, "short text there")]
    repeated = ["again"] * 60
    rows += [(30, " ".join(repeated)), (31, " ".join(repeated[:58])), (32, " ".join(repeated[:30]))]
    rows += [(40, None), (41, ""), (42, " .. "), (None, " ".join(base)), (1, " ".join(base))]
    return rows


def test_near_duplicates_equal_brute_force(spark, near_rows):
    out = near_dedup.near_duplicates(frame(spark, near_rows)).collect()
    assert len(out) == len(near_rows)
    groups = collections.defaultdict(list)
    for r in out:
        groups[r["class_id"] if r["class_size"] > 1 else ("alone", r["id"])].append(r["id"])
    got = sorted(sorted(g, key=str) for g in groups.values())
    want = [sorted(g, key=str) for g in _grouped(near_rows)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    by = {r["id"]: r for r in out}
    assert by[30]["class_id"] == by[31]["class_id"] != by[32]["class_id"]        # multiset overlap, not set overlap
    assert by[2]["n_links"] >= 1 and by[40]["class_size"] == 1 and by[40]["representative"]
    assert all(r["class_size"] == sum(x["class_id"] == r["class_id"] for x in out) for r in out if r["class_size"] > 1)


def _grouped(rows):
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    return [[rows[k][0] for k in g] for g in brute_classes(numbered)]


def test_keep_one_keeps_rows_and_columns(spark, near_rows):
    docs = frame(spark, near_rows)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([1, 20, 21, 22, 24, 30, 32, 40, 41, 42], key=str)


def test_near_duplicates_of_small_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = collections.defaultdict(list)
    for r in QUERIES["op9_near_dedup"](spark, SF_SMALL).collect():
        got[r["class_id"]].append(r["doc_id"])
    assert sorted(sorted(g) for g in got.values()) == brute_classes(rows)


def test_a_large_group_of_edited_copies_is_one_class(spark):
    base = words(200, 5)
    rows = [(0, " ".join(base))]
    for k in range(1, 120):
        r = random.Random(k)
        w = list(base)
        for _ in range(3):
            w[r.randrange(len(w))] = f"edit{k}x{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    out = near_dedup.near_duplicates(frame(spark, rows)).collect()
    near = {k for k, t in rows if jaccard(bag(t), bag(rows[0][1])) >= 0.8}
    assert near <= {r["id"] for r in out if r["class_id"] == 0}


def test_chained_edits_equal_brute_force(spark):
    """Copies of edited copies: links between members under 0.8 to their bucket's hub and members of the hub's class."""
    r = random.Random(0)
    family = [words(100, 1000)]
    for _ in range(249):
        w = list(family[0] if r.random() < 0.5 else r.choice(family))
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(100)] = f"e{r.randrange(10**6)}"
        family.append(w)
    rows = [(k, " ".join(w)) for k, w in enumerate(family)]
    got = collections.defaultdict(list)
    for x in near_dedup.near_duplicates(frame(spark, rows)).collect():
        got[x["class_id"]].append(x["id"])
    assert sorted(sorted(g) for g in got.values()) == brute_classes(rows)


def test_prefixes_of_linked_texts_meet(spark):
    """Every pair at the threshold or over it shares a token that is in the smaller one's post and the larger one's probe."""
    r = random.Random(4)
    base = words(90, 40) + ["again"] * 12
    texts = [" ".join(base)]
    for _ in range(60):
        w = list(base)
        for _ in range(r.randrange(1, 9)):
            k = r.randrange(len(w))
            w[k:k + r.randrange(2)] = [f"e{r.randrange(40)}"] * r.randrange(2)
        texts.append(" ".join(w))
    bags = [bag(t) for t in texts]
    sizes = [sum(b.values()) for b in bags]
    rows = [x for out in near_dedup.tokens(iter([pa.record_batch({"node": pa.array(range(len(texts)), pa.int64()), "text": texts})]))
            for x in zip(out.column("node").to_pylist(), out.column("token").to_pylist(), strict=True)]
    made = near_dedup.posts(spark.createDataFrame(rows, "node bigint, token bigint"),
                            spark.createDataFrame([(k, n, k) for k, n in enumerate(sizes)], "node bigint, size bigint, component bigint"))
    post, probe = collections.defaultdict(set), collections.defaultdict(set)
    for x in made.collect():
        (probe if x["probe"] else post)[x["node"]].add((x["token"], x["band"]))
    linked = apart = 0
    for i in range(len(texts)):
        for j in range(len(texts)):
            if i != j and sizes[i] <= sizes[j]:
                link = jaccard(bags[i], bags[j]) >= 0.8
                linked, apart = linked + link, apart + (not link and not post[i] & probe[j])
                assert not link or post[i] & probe[j]
    assert linked > 20 and apart > 20


def test_a_family_under_the_threshold_gives_candidates_in_proportion(spark, monkeypatch):
    """Copies of one text whose own edits keep them under 0.8 to it and to each other: no pairs of all with all."""
    base = words(150, 77)
    made = {}

    def counting(df, name):
        out = scratch.write(df, name)
        made[name] = made.get(name, 0) + (out.count() if name in ("candidates", "posts") else 0)
        return out

    monkeypatch.setattr(near_dedup, "write", counting)

    def run(n):
        made.clear()
        rows = [(0, " ".join(base))]
        for k in range(1, n):
            r, w = random.Random(k), list(base)
            for at in range(3, 150, 40 if k % 3 == 0 else 29):          # 4 or 6 edits of 5 shingles each
                w[min(149, at + r.randrange(20))] = f"e{k}x{at}"
            rows.append((k, " ".join(w)))
        out = near_dedup.near_duplicates(frame(spark, rows)).collect()
        near = [k for k, t in rows if jaccard(bag(t), bag(rows[0][1])) >= 0.8]
        assert sorted(x["id"] for x in out if x["class_id"] == 0) == near and len(near) < n
        return made["candidates"], made["posts"]

    few, many = run(500), run(2000)
    assert many[0] <= 6 * few[0] and many[1] <= 6 * few[1]              # four times the members; all pairs: 16 times


def test_near_duplicates_of_an_empty_table(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert near_dedup.keep_one(frame(spark, [])).count() == 0


# --- exact duplicates ---

EXACT = [(1, "a b"), (2, "ab "), (3, "a\tb\x0b"), (4, "A b"), (5, None), (6, ""), (7, " \n"), (8, "a\u00a0b"), (None, "a b   "),
         (1, "a b"), (9, "x"), (9, "x"), (9, "x")]


def test_exact_dedup_rules(spark):
    out = exact_dedup.dedup(frame(spark, EXACT)).collect()
    assert len(out) == len(EXACT)
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    assert by[None][0]["kept"] and by[None][0]["keep_id"] is None                # most code points
    assert {r["keep_id"] for r in by[1] + by[2] + by[3]} == {None} and by[1][0]["group_size"] == 5
    assert [by[i][0]["keep_id"] for i in (4, 5, 6, 7, 8)] == [4, 7, 7, 7, 8]      # a no-break space is not deleted
    assert sorted(r["kept"] for r in by[9]) == [False, False, True] and by[9][0]["group_size"] == 3
    assert by[2][0]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()
    assert by[5][0]["text_sha256"] == hashlib.sha256(b"").hexdigest()


def test_keep_first_keeps_rows_and_columns(spark):
    docs = frame(spark, EXACT)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [
        ("4", "A b"), ("7", " \n"), ("8", "a b"), ("9", "x"), ("None", "a b   ")]
    assert exact_dedup.keep_first(frame(spark, [])).count() == 0


def test_index_persists_and_is_joined_without_shuffling_it(spark):
    path = scratch.new_path(spark, "index")
    index = exact_dedup.DigestIndex(spark, path, "bigint", 4).open()
    first = exact_dedup.dedup_batch(frame(spark, [(1, "one"), (2, "two"), (3, "two")]), index, "b1").collect()
    assert {r["doc_id"]: r["kept"] for r in first} == {1: True, 2: True, 3: False}
    spark.sql(f"DROP TABLE {index.name}")                                        # the files of an external table stay
    again = exact_dedup.DigestIndex(spark, path, "bigint", 4).open()
    second = exact_dedup.dedup_batch(frame(spark, [(7, "t wo"), (8, "three"), (9, None)]), again, "b2").collect()
    assert {r["doc_id"]: (r["kept"], r["keep_id"]) for r in second} == {7: (False, 2), 8: (True, 8), 9: (True, 9)}
    assert sorted(r["batch"] for r in again.table().collect()) == ["b1", "b1", "b2", "b2"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = spark.createDataFrame([(b"x",)], "digest binary")
        plan = fresh.join(again.table(), "digest", "left_anti")._jdf.queryExecution().sparkPlan().toString()
        full = fresh.join(again.table(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and full.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_batch_that_comes_again_gets_the_same_answer(spark):
    index = exact_dedup.DigestIndex(spark, scratch.new_path(spark, "index"), "bigint", 4).open()
    exact_dedup.dedup_batch(frame(spark, [(1, "one"), (2, "two")]), index, "b1")
    batch = [(7, "t wo"), (8, "three"), (9, "thr ee"), (10, None)]
    first = sorted(map(tuple, exact_dedup.dedup_batch(frame(spark, batch), index, "b2").collect()), key=str)
    stored = sorted(map(tuple, index.table().collect()))
    again = sorted(map(tuple, exact_dedup.dedup_batch(frame(spark, batch), index, "b2").collect()), key=str)
    assert first == again and sorted(map(tuple, index.table().collect())) == stored
    # an append that was cut off: only a part of the batch is in the index
    part = exact_dedup.DigestIndex(spark, scratch.new_path(spark, "index"), "bigint", 4).open()
    part.append(index.table().filter("batch = 'b1' or keep_id = 10"))
    assert sorted(map(tuple, exact_dedup.dedup_batch(frame(spark, batch), part, "b2").collect()), key=str) == first
    assert sorted(map(tuple, part.table().collect())) == stored


def test_indexes_in_folders_of_one_name_are_apart(spark):
    a, b = (exact_dedup.DigestIndex(spark, scratch.new_path(spark, x) + "/index", "bigint", 4).open() for x in "ab")
    assert a.name != b.name
    exact_dedup.dedup_batch(frame(spark, [(1, "one")]), a, "b1")
    out = exact_dedup.dedup_batch(frame(spark, [(2, "one")]), b, "b1").collect()
    assert out[0]["kept"] and a.table().count() == b.table().count() == 1


def test_a_fresh_index_leaves_no_name_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.dedup(frame(spark, [(1, "one")])).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_exact_dedup_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({ORACLE_SQL['op6_exact_dedup']})").fetchall())
    got = sorted(tuple(r) for r in QUERIES["op6_exact_dedup"](spark, SF_SMALL).collect())
    assert got == want


# --- repeated passages ---

def brute_passages(rows, least):
    split = [re.findall(r"\w+", (t or "").lower()) for _, t in rows]
    seen = collections.defaultdict(set)
    for k, w in enumerate(split):
        for i in range(len(w) - least + 1):
            seen[tuple(w[i:i + least])].add((k, i))
    out = []
    for k, w in enumerate(split):
        spans = []
        for i in range(len(w) - least + 1):
            if len(seen[tuple(w[i:i + least])]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + least
                else:
                    spans.append([i, i + least])
        out += [(rows[k][0], a, b) for a, b in spans]
    return sorted(out, key=str)


def test_passages_equal_brute_force(spark):
    common = words(70, 3)
    rows = [(k, " ".join(words(60 + 7 * k, 100 + k) + common + words(40, 200 + k))) for k in range(6)]
    rows += [(10, " ".join(common[5:54])), (11, " ".join(common[5:56])), (12, " ".join(words(30, 9) + common + common[:60])),
             (20, None), (21, ""), (22, "few words"), (23, "few words"), (None, " ".join(words(90, 77)))]
    copy = " ".join(words(80, 8))
    rows += [(30, copy), (31, copy), (31, copy)]
    out = suffix_dedup.repeated_passages(frame(spark, rows)).collect()
    got = sorted(((r["doc_id"], r["start_word"], r["end_word"]) for r in out), key=str)
    assert got == brute_passages(rows, 50)
    assert all(r["n_words"] == r["end_word"] - r["start_word"] for r in out)
    row = next(r for r in out if r["doc_id"] == 11)
    assert suffix_dedup.cut_passage(dict(rows)[11], row["start_word"], row["end_word"]) == " ".join(common[5:56])


def test_passage_before_a_frequent_line_equals_brute_force(spark):
    """Two documents share 25 words and a line that many hold; no anchor lies in the 25 words, so the order hides the pair."""
    line = words(30, 13)
    rows = [(k, " ".join(words(40, 5000 + k) + line + words(30, 7000 + k))) for k in range(150)]

    def hidden(seed):
        own = words(25, 10_000 + seed)
        pair = [" ".join(words(40, 20_000 + 2 * seed + k) + own + line + words(30, 30_000 + 2 * seed + k)) for k in (0, 1)]
        found = [suffix_dedup.anchors(tx.words(pa.array([t])), suffix_dedup.GRAM, suffix_dedup.WINDOW)[1] for t in pair]
        return pair if not any(40 <= p < 65 for at in found for p in at.tolist()) else None

    pairs = [p for p in map(hidden, range(300)) if p][:5]
    assert pairs
    rows += [(1000 + k, t) for k, t in enumerate(t for p in pairs for t in p)]
    out = suffix_dedup.repeated_passages(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["start_word"], r["end_word"]) for r in out), key=str) == brute_passages(rows, 50)


@pytest.mark.parametrize("near", [1, 3])
def test_passages_of_mixed_rare_and_frequent_anchors_equal_brute_force(spark, near):
    """Passages made of lines that two to twenty documents hold, in all orders, some across a line's edge."""
    r = random.Random(near)
    lines = [words(r.randint(12, 60), 40_000 + k) for k in range(30)]
    rows = []
    for k in range(120):
        text = words(r.randint(0, 40), 50_000 + k)
        for _ in range(4):
            line = lines[min(int(r.expovariate(0.15)), 29)]
            cut = r.choice([0, 0, r.randrange(len(line))])
            text = text + line[cut:] + words(r.choice([0, 0, 5]), r.randrange(10**6))
        rows.append((k, " ".join(text)))
    out = suffix_dedup.repeated_passages(frame(spark, rows), near=near).collect()
    want = brute_passages(rows, 50)
    assert want and sorted(((r["doc_id"], r["start_word"], r["end_word"]) for r in out), key=str) == want


def test_passages_of_small_documents_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r["doc_id"], r["start_word"], r["end_word"]) for r in QUERIES["op8_repeated_passages"](spark, SF_SMALL).collect()), key=str)
    assert got == brute_passages(rows, 50)


def test_passages_of_an_empty_table_and_bad_window(spark):
    assert suffix_dedup.repeated_passages(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_passages(frame(spark, []), least=20, gram=8, window=32)
