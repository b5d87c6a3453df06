"""Set join, token alignment and periodic runs against brute force."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_CHECK, SF_SMALL
from pyspark.sql import functions as F

from txnlens.llm import jaccard_join, periodic_runs, queries, token_alignment
from txnlens.llm.blank_words import blank_words

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# --- set join ---------------------------------------------------------------------------------

def shingle_set(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def linked_by_brute_force(rows):
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, own in enumerate(sets):
        shared = Counter(j for g in own for j in holders[g])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                parent[find(k)] = find(j)
        for g in own:
            holders[g].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def families(seed=5):
    """Edited copies around the threshold, a chain of edits, a passage that many texts share, tiny texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=4)) for _ in range(3000)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    texts = []
    for n, edits, members in ((200, 2, 80), (200, 5, 80), (120, 4, 80), (60, 1, 50), (300, 8, 50)):
        base = words(n)
        for _ in range(members):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(n)] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    link = words(150)
    for _ in range(50):
        for _ in range(3):
            link[rng.randrange(150)] = rng.choice(vocabulary)
        texts.append(" ".join(link))
    passages = [words(30) for _ in range(3)]
    texts += [" ".join(words(rng.randint(1, 80)) + rng.choice(passages) + words(rng.randint(0, 20))) for _ in range(200)]
    texts += [" ".join(passages[0])] * 30 + [" ".join(words(rng.randint(0, 4))) for _ in range(40)]
    texts += [None, "", " \t", "A b\tC", "a B c", "ÄB ab", "äb ab"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("leaf", [4, 128])
def test_set_join_equals_brute_force(spark, leaf):
    rows = families()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted(tuple(r) for r in jaccard_join.linked_sets(docs, leaf=leaf).collect())
    assert got == linked_by_brute_force(rows)


def test_set_join_finds_links_to_members_of_the_hubs_class(spark):
    """The last row is linked to rows 10 to 12 (100 of 120 words), but not to the family's hubs (100 of 130), which these are linked to."""
    core, line, rest = ([f"{c}{i}" for i in range(n)] for c, n in (("h", 100), ("d", 20), ("f", 40)))
    sets = {i: core + [line[(i + k) % 20] for k in range(15)] for i in range(8)}
    sets |= {10 + i: core + [f"x{i}_{k}" for k in range(5)] for i in range(3)}
    sets |= {100 + i: line + [w for k, w in enumerate(rest) if k not in (i, i + 1)] for i in range(30)}
    sets[20] = core + [f"y{k}" for k in range(15)]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in sets.items()], "doc_id bigint, text string")
    got = {r.id: r.component_id for r in jaccard_join.linked_sets(docs, shingle=1, leaf=4).collect()}
    assert got == {i: 100 if i >= 100 else 0 for i in sets}


def test_set_join_of_the_given_documents(spark):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op11_jaccard_join(spark, SF_CHECK).collect())
    assert got == linked_by_brute_force(documents(spark, SF_CHECK))


def test_set_join_of_nulls_repeats_and_clashing_columns(spark):
    text = "one two three four five six seven"
    rows = [(None, text, 1, 2, "x"), (7, text, 1, 2, "x"), (7, text, 1, 2, "x"), (9, None, 0, 0, None), (None, None, 0, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, node int, n int, component_id string")
    got = sorted(map(tuple, jaccard_join.linked_sets(docs).collect()), key=str)
    assert got == sorted([(None, 3, 7), (7, 3, 7), (7, 3, 7), (9, 0, 9), (None, 0, None)], key=str)
    assert jaccard_join.linked_sets(docs.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_prefixes_are_long_enough(spark, percent):
    """Any two linked sets share a shingle in the smaller's index and the larger's probe prefix."""
    for n in range(1, 60):
        for m in range(n, 130):
            need = -(-percent * (n + m) // (100 + percent))
            if need <= n:
                assert n - need + 1 <= jaccard_join.index_length(n, percent)
                assert m - need + 1 <= jaccard_join.probe_length(m, percent)
    sql = [jaccard_join.index_length_sql("n", percent), jaccard_join.probe_length_sql("n", percent)]
    for n, i, p in spark.range(1, 60).withColumnRenamed("id", "n").select("n", *map(F.expr, sql)).collect():
        assert (i, p) == (jaccard_join.index_length(n, percent), jaccard_join.probe_length(n, percent))


def test_candidates_of_a_family_under_the_threshold_grow_in_proportion(spark, monkeypatch):
    """Members with three own words each (about 0.74 similar): no pair is even looked at."""
    def looked_at(members):
        rng = random.Random(1)
        base = [f"w{i}" for i in range(100)]
        rows = []
        for m in range(members):
            copy = list(base)
            for k in range(3):
                copy[10 + 30 * k + rng.randrange(20)] = f"own{m}_{k}"
            rows.append((m, " ".join(copy)))
        seen = []
        keep = jaccard_join._Join.within_bound
        monkeypatch.setattr(jaccard_join._Join, "within_bound", lambda self, p: seen.append(p.distinct().count()) or keep(self, p))
        result = jaccard_join.linked_sets(spark.createDataFrame(rows, "doc_id bigint, text string"), leaf=8).collect()
        monkeypatch.undo()
        assert all(r.component_id == r.id for r in result)
        return sum(seen)

    assert looked_at(200) <= 2 * max(looked_at(100), 50)


def test_pairs_are_stored_before_their_fine_points_are_joined(spark, monkeypatch):
    plans, write = {}, jaccard_join.write

    def noted(df, name, *more):
        plans.setdefault(name, df._jdf.queryExecution().analyzed().toString())
        return write(df, name, *more)

    monkeypatch.setattr(jaccard_join, "write", noted)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:50], f"x{i}"])) for i in range(4)] + [(9, " ".join(words[::-1])), (10, None)]
    got = {r.id: r.component_id for r in jaccard_join.linked_sets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9, 10: 10}
    assert "Repartition" in plans["pairs"] and "Repartition" not in plans["candidates"]


# --- token alignment --------------------------------------------------------------------------

def aligned_by_brute_force(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(public_tokenizers.path(token_alignment.TOKENIZER_A))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_alignment.TOKENIZER_B))
    byte = token_alignment._byte_of_character()
    info, held = [], Counter()
    for _, text in rows:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        bytes_a = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
                   for p in map(b_model.id_to_piece, b)]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            info.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        groups = [[[], []] for _ in both]
        for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
            for i, e in zip(ids, ends, strict=True):
                groups[np.searchsorted(both, e)][side].append(i)
        links, i, j = [], 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            step_a, step_b = ends_a[i] <= ends_b[j], ends_b[j] <= ends_a[i]
            i, j = i + step_a, j + step_b
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        info.append((len(a), len(b), len(groups), links, said))
        held.update(set(links))
    highest = Counter()
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    return [(k, 0, 0, 0, 0, 0, 0, "") if x is None else
            (k, x[0], x[1], x[2], len(x[3]), sum(held[p] == highest[p[0]] for p in x[3]), sum(held[p] for p in x[3]), x[4])
            for (k, _), x in zip(rows, info, strict=True)]


def test_alignment_of_the_given_documents(spark):
    rows = documents(spark, SF_SMALL)
    got = sorted(map(tuple, queries.op12_token_alignment(spark, SF_SMALL).collect()))
    digest = [r[:-1] + (hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "",) for r in aligned_by_brute_force(rows)]
    assert got == sorted(digest)


ODD = ["", None, "a", " ", "  two  blanks ", "<s> </s> <unk> <0x0A> <|endoftext|>", "▁x", "\x00a", "漢字かな交じり", "😀é\r\n\t",
       "x" * 5000, "the the the", "the the the", "ﬁ ① Ω", "1234567890 12 3.14", "nul﻿", "a b"]


@pytest.mark.parametrize("block", [1, 64, 1 << 21])
def test_alignment_of_odd_texts_in_any_blocks(spark, block):
    rows = list(enumerate(ODD))
    docs = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], "doc_id int, text string, block int, pairs string")
    got = sorted(map(tuple, token_alignment.link_statistics(docs, block=block).collect()))
    assert got == aligned_by_brute_force(rows)


def test_alignment_of_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id string, text string")
    got = token_alignment.link_statistics(docs, groups=None).collect()
    assert sorted((r.n_a, r.count_sum, r.groups) for r in got) == [(0, 0, None), (2, 4, None), (2, 4, None)]
    assert token_alignment.link_statistics(docs.limit(0)).count() == 0


def test_small_numbers_are_packed_in_a_byte():
    numbers = np.array([0, 1, 254, 255, 256, 1 << 40, 3])
    assert token_alignment._unpack(token_alignment._pack(numbers), len(numbers)).tolist() == numbers.tolist()


# --- periodic runs ----------------------------------------------------------------------------

def runs_by_brute_force(words, least=24, times=3):
    n, smallest = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and j > i:
                smallest.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in smallest.items())


def stutters(rng):
    out = []
    for _ in range(rng.randint(0, 6)):
        letters = "abcdefghijklmnopqrstuvwxyz"[:rng.choice([1, 2, 2, 3, 5, 26])]
        unit = [rng.choice(letters) for _ in range(rng.randint(1, 25))]
        out += unit * rng.randint(1, 9) + unit[:rng.randint(0, len(unit))]
    return out


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (40, 4)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least)
    found = 0
    for _ in range(120):
        docs = [stutters(rng) for _ in range(rng.randint(1, 6))]
        texts = [rng.choice([" ", "\n", " \t "]).join(d) if d else rng.choice([None, "", " "]) for d in docs]
        w = blank_words(pa.array(texts, pa.string()))
        got = [[] for _ in docs]
        for s, e, q in zip(*(x.tolist() for x in periodic_runs.word_runs(w, least, times)), strict=True):
            i = int(np.searchsorted(w.first, s, side="right")) - 1
            got[i].append((s - int(w.first[i]), e - s, q))
        assert got == [runs_by_brute_force(d, least, times) for d in docs]
        found += sum(map(len, got))
    assert found > 200


def test_runs_of_long_repeats_and_hash_twins():
    """A square-free-like word that fools sums of powers modulo 2^64, and long texts of one word or one line."""
    thue = [0]
    while len(thue) < 2048:
        thue += [1 - x for x in thue]
    texts = [" ".join(map(str, thue)), "a " * 30_000, "a b c d e f g\n" * 4_000, "x " + "ab " * 24]
    w = blank_words(pa.array(texts))
    got = list(zip(*(x.tolist() for x in periodic_runs.word_runs(w)), strict=True))
    at = w.first.tolist()
    assert [(s - at[1], e - s, q) for s, e, q in got if at[1] <= s < at[2]] == [(0, 30_000, 1)]
    assert [(s - at[2], e - s, q) for s, e, q in got if at[2] <= s < at[3]] == [(0, 28_000, 7)]
    assert [(s - at[3], e - s, q) for s, e, q in got if s >= at[3]] == [(1, 24, 1)]
    assert not [s for s, _, _ in got if s < at[1]]


def test_runs_of_the_given_documents(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF_CHECK).collect()}
    rows = documents(spark, SF_CHECK)
    assert len(got) == len(rows)
    repeating = 0
    for k, text in rows:
        words = re.findall(WORD, text or "")
        n, h = len(words), zlib.crc32(str(k).encode())
        g = h // 10
        if n > 2500:
            continue                                     # brute force is quadratic
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = runs_by_brute_force(words)
        repeating += bool(runs)
        dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
        said = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        assert got[k] == (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                          hashlib.sha256(said.encode()).hexdigest(),
                          hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())
    assert repeating > 50


def test_runs_of_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "ab " * 30, 1), (None, None, 2), (5, "", 3)], "doc_id int, text string, runs int")
    got = {(r.id, r.n_words, r.collapsed, tuple(map(tuple, r.runs))) for r in periodic_runs.periodic_runs(docs).collect()}
    assert got == {(None, 30, "ab", ((0, 30, 1),)), (None, 0, "", ()), (5, 0, "", ())}
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
