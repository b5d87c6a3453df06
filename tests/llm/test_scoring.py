import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from txnlens.llm import calibrate, langid, quality, token_counts, toxicity
from txnlens.llm.packing import tokenizer_path
from txnlens.llm.queries import QUERIES


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1.0, 3) for i, t, lang in rows],
                                 "doc_id bigint, text string, lang string, score double, label int")


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


# --- calibration ---

@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=20))
def test_isotonic_rises_and_stays_within_0_and_1(pairs):
    w = np.array([a + b for a, b in pairs], dtype=float)
    p = np.array([b for _, b in pairs], dtype=float)
    steps = calibrate.isotonic(np.arange(len(pairs), dtype=float), w, p)
    y = steps(np.linspace(-1, 21, 100))
    assert (np.diff(y) >= -1e-12).all() and (y > 0).all() and (y < 1).all()


# --- toxicity ---

def brute_nearest(vectors, query, k, without):
    dense = {t: w for t, w in zip(*query, strict=True)}
    scores = [(sum(dense.get(t, 0.0) * w for t, w in zip(*v, strict=True)), i) for i, v in enumerate(vectors)]
    return sorted(((round(s, 9), i) for s, i in scores if s > 0 and i != without), key=lambda x: (-x[0], x[1]))[:k]


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 150), st.integers(1, 20), st.integers(1, 40))
def test_block_max_search_equals_brute_force(seed, n, k, block):
    rng = np.random.default_rng(seed)

    def vector():
        terms = np.sort(rng.choice(30, size=rng.integers(0, 6), replace=False))
        weight = rng.integers(1, 4, len(terms)).astype(float)
        return terms.astype(np.int64), weight / max(math.sqrt((weight ** 2).sum()), 1e-9)

    vectors = [vector() for _ in range(n)]
    index = toxicity.Index.build(vectors, 30, block)
    for without in (-1, 3):
        query = vector()
        who, near = index.nearest(*query, k, without)
        assert [(round(float(s), 6), int(i)) for s, i in zip(near, who, strict=True)] == [
            (round(s, 6), i) for s, i in brute_nearest(vectors, query, k, without)]


BAD, GOOD = ["scum", "vermin", "filth"], [f"word{i}" for i in range(60)]


def toxic_rows(n, seed=0):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = r.choices(GOOD, k=40)
        if bad:
            text[r.randrange(40)] = r.choice(BAD).upper() + "!"
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_and_shows_evidence(spark):
    rows, labels = toxic_rows(300)
    rows += [(1000, None, None), (1001, "", None), (1002, "such FILTH here", None), (None, "scum", None), (1003, "nothing known", None)]
    marks = spark.createDataFrame([*labels[:200], (None, 1), (5, None), (0, 0), (6, 7)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs(spark, rows), marks)
    out = {r["doc_id"]: r for r in toxicity.score(docs(spark, rows), model).collect()}
    assert all(out[i]["predicted"] == y for i, y in labels if i not in (0, 6))
    assert out[1002]["predicted"] == 1 == out[None]["predicted"]
    assert out[1000]["score"] == out[1001]["score"] == out[1003]["score"] < 0.5
    assert {e["label"] for e in out[1002]["evidence"]} == {1} and out[1002]["evidence"][0]["similarity"] > 0.5
    kept = toxicity.keep_clean(docs(spark, rows), model)
    assert kept.columns == docs(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if not r["predicted"]}


def test_toxicity_without_labels_or_documents(spark):
    rows, labels = toxic_rows(20)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.score(docs(spark, rows), toxicity.fit(docs(spark, rows), none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.score(docs(spark, rows), toxicity.fit(docs(spark, rows), one)).collect()} == {0.0}
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    assert toxicity.score(docs(spark, []), toxicity.fit(docs(spark, []), marks)).count() == 0


def test_toxicity_query(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    out = QUERIES["op10_toxicity"](spark, SF_CHECK).collect()
    assert len(out) == spark.read.parquet(f"{SF_CHECK}/documents.parquet").count()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.93
    clean = [p for p, y in held if not y]
    assert sum(clean) / len(clean) < 0.03


# --- quality ---

def brute_statistics(text):
    text = text or ""
    raw, w = text.encode(), re.findall(r"\w+", text.lower())
    lines = [x for x in text.split("\n") if x]
    fives = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    return {"log_bytes": math.log1p(len(raw)), "log_words": math.log1p(len(w)), "log_lines": math.log1p(len(lines)),
            "mean_word": np.mean([len(x.encode()) for x in w]) if w else 0,
            "upper": sum(65 <= c <= 90 for c in raw) / len(raw) if raw else 0,
            "bar": raw.count(b"|") / len(raw) if raw else 0,
            "top_word": max(map(w.count, w)) / len(w) if w else 0,
            "repeated_next": sum(a == b for a, b in zip(w, w[1:], strict=False)) / len(w) if w else 0,
            "repeated_fives": 1 - len(set(fives)) / len(fives) if fives else 0,
            "distinct_lines": len(set(lines)) / len(lines) if lines else 0,
            "ended_lines": sum(x[-1] in ".!?\"')" for x in lines) / len(lines) if lines else 0}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abAB |.é\n1", max_size=60)), max_size=6))
def test_statistics_equal_brute_force(texts):
    got = quality.statistics(pa.array(texts, pa.string()))
    assert got.shape == (len(texts), len(quality.STATISTICS)) and np.isfinite(got).all()
    for i, t in enumerate(texts):
        for name, value in brute_statistics(t).items():
            assert got[i, quality.STATISTICS.index(name)] == pytest.approx(value, abs=1e-5), name


def test_random_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, len(quality.STATISTICS)))
    k = quality.Kernel.draw(np.zeros(x.shape[1]), np.ones(x.shape[1]), 20_000)
    z = k(x)[:, :-1]
    exact = math.exp(-((x[0] - x[1]) ** 2).sum() / (2 * quality.WIDTH ** 2 * x.shape[1]))
    assert z[0] @ z[1] == pytest.approx(exact, abs=0.03)


def test_quality_query_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    out = QUERIES["op3_quality"](spark, SF_CHECK).collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.95


def test_quality_edges(spark):
    rows = [(1, None, None), (2, "", None), (None, "x", None), (3, "Some text. " * 50, "en"), (3, "Some text. " * 50, "en")]
    described = quality.describe(docs(spark, rows))
    for marks, want in (([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(None, 0), (1, 5), (3, None)], 0.5)):
        model = quality.fit(described, spark.createDataFrame(marks, "doc_id bigint, quality int"))
        out = quality.score(described, model).collect()
        assert len(out) == 5 and {r["score"] for r in out} == {want}
    model = quality.fit(described, spark.createDataFrame([(1, 0), (3, 1)], "doc_id bigint, quality int"))
    assert all(0 <= r["score"] <= 1 for r in quality.score(described, model).collect())
    assert quality.score(quality.describe(docs(spark, [])), model).count() == 0


# --- language ---

LANGS = {"aa": ["kala", "mona", "tiri", "sulu"], "bb": ["brax", "grunt", "zork", "klim"]}


def language_rows():
    r = random.Random(3)
    return [(i, " ".join(r.choices(LANGS[x], k=20)), x) for i, x in enumerate(["aa", "bb"] * 30)]


def test_language_by_words_then_grams(spark):
    model = langid.fit(docs(spark, [*language_rows(), (900, None, "aa"), (901, "kala", None)]))
    rows = [(1, "KALA, mona!", None), (2, "grunt", None), (3, "kalamona", None), (4, "zorkgrunt", None), (5, None, None),
            (6, "", None), (7, "12 .. _", None), (8, "ж", None), (None, "tiri", None), (2, "grunt", None)]
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(docs(spark, rows), model).collect()]
    assert sorted((str(i), x) for i, x, _ in out) == sorted([
        ("1", "aa"), ("2", "bb"), ("2", "bb"), ("3", "aa"), ("4", "bb"), ("5", "und"), ("6", "und"), ("7", "und"), ("8", "aa"), ("None", "aa")])
    assert all(0 <= s <= 1 for _, _, s in out) and {s for _, x, s in out if x == "und"} == {0.0}


def test_unseen_words_fall_back_order_by_order(spark):
    model = langid.fit(docs(spark, language_rows()))
    seen = model.word_row("kala")
    assert (seen == model.word_logs[model.words["kala"]]).all()
    known = [g for g in langid.grams("kalx", 3) if g in model.grams[3]]
    assert not [g for g in langid.grams("kalx", 5) + langid.grams("kalx", 4) if g in model.grams[5] or g in model.grams[4] and g != "<kal"] or known
    order = next(o for o in langid.ORDERS if any(g in model.grams[o] for g in langid.grams("kalx", o)))
    rows = [model.gram_logs[order][model.grams[order][g]] for g in langid.grams("kalx", order) if g in model.grams[order]]
    assert np.allclose(model.word_row("kalx"), np.mean(rows, axis=0))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_words_are_runs_of_letters(text):
    lower = text.lower()
    assert langid.words_of(text) == [x for x in "".join(c if c.isalpha() else " " for c in lower).split(" ") if x]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="aB \n\x1c_5\u00bdΣİé\u0301漢", max_size=30)), max_size=6))
def test_words_of_many_texts_at_once(texts):
    found, place, first = langid.split_words(texts)
    assert [[found[i] for i in place[a:b]] for a, b in zip(first[:-1], first[1:], strict=True)] == [langid.words_of(t) for t in texts]
    assert len(set(found)) == len(found)


def test_unseen_words_are_met_once_a_worker(spark, monkeypatch):
    model = langid.fit(docs(spark, language_rows()))
    texts = ["Kalax zork kalax", None, "KALAX", "ZORK kala ..", ""] * 20
    want = [langid.Scorer(model)(t) for t in texts]
    met, rows = [], langid.Model.word_rows
    monkeypatch.setattr(langid.Model, "word_rows", lambda self, words: met.extend(words) or rows(self, words))
    for _ in range(2):                  # two tasks of one worker
        assert langid.scorer(model).predict(texts) == want
    assert met == ["kalax"]


def test_numbers_are_no_letters(spark):
    model = langid.fit(docs(spark, language_rows()))
    rows = [(i, t, None) for i, t in enumerate(["\u00bd", "\u00b2 \u2460", "12 \u2167", "\u4e00", "a\u00b2"])]
    out = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs(spark, rows), model).collect()}
    assert out[0] == out[1] == out[2] == "und" and "und" not in (out[3], out[4])


def test_language_without_examples(spark):
    model = langid.fit(docs(spark, [(1, "x", None)]))
    assert [tuple(r) for r in langid.predict(docs(spark, [(1, "some text", None)]), model).collect()] == [(1, "und", 0.0)]
    assert langid.predict(docs(spark, []), model).count() == 0


def test_small_cache_gives_the_same(spark):
    model = langid.fit(docs(spark, language_rows()))
    big, small = langid.Scorer(model), langid.Scorer(model, cache=6)
    r = random.Random(5)
    for _ in range(40):
        text = " ".join(r.choices([*LANGS["aa"], *LANGS["bb"], "other", "kalazork"], k=30))
        a, b = big(text), small(text)
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-6)


def test_language_query_on_held_out_rows(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang").collect()}
    out = QUERIES["op5_language"](spark, SF_CHECK).collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) for r in out) and len(out) == len(truth)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in out if r["held_out"]]
    assert sum(held) / len(held) > 0.98


# --- token counts ---

@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.read_vocabulary(tokenizer_path(token_counts.VOCABULARY))


@pytest.fixture(scope="module")
def unigram(vocabulary):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.SPACE, prepend_scheme="always", split=True)
    return t


def test_counts_equal_the_library_on_documents(spark, unigram):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    out = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op4_token_counts"](spark, SF_SMALL).collect()}
    assert out == {i: len(unigram.encode(t or "").ids) for i, t in text.items()}


_counter = []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁aeinrst<>0x😀漢"), st.characters(blacklist_categories=["Cs"])), max_size=50))
def test_counts_equal_the_library(text):
    from tokenizers import Tokenizer, models, pre_tokenizers

    if not _counter:
        vocabulary = token_counts.read_vocabulary(tokenizer_path(token_counts.VOCABULARY))
        t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.SPACE, prepend_scheme="always", split=True)
        _counter.extend([token_counts.Counter(vocabulary, cache=100), t])
    assert _counter[0](text) == len(_counter[1].encode(text).ids)


def test_ties_go_to_the_piece_that_starts_first():
    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0), *[(f"<0x{i:02X}>", -9.0) for i in range(256)]]
    assert token_counts.Counter(pieces)("ab") == 2          # the longer piece starts first at the end of "ab"


def test_count_edges(spark):
    rows = [(1, None, None), (2, "", None), (3, " ", None), (None, "text", None), (4, "x" * 100_000, None), (2, "", None)]
    out = sorted((str(r["doc_id"]), r["n_tokens"] > 0, r["n_bytes"]) for r in token_counts.count_tokens(docs(spark, rows)).collect())
    assert out == [("1", False, 0), ("2", False, 0), ("2", False, 0), ("3", True, 1), ("4", True, 100_000), ("None", True, 4)]
    assert token_counts.count_tokens(docs(spark, [])).count() == 0
