import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from txnlens.llm import bagminhash as bm
from txnlens.llm import text as tx


def said(w, i):
    return [w.data[w.start[j]:w.end[j]].tobytes().decode() for j in range(w.first[i], w.first[i + 1])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1_ é,.\n\tßЖ漢’ 　", max_size=40)), max_size=6))
def test_words_match_a_pattern(texts):
    w = tx.words(pa.array(texts, pa.string()))
    assert len(w.first) == len(texts) + 1
    for i, t in enumerate(texts):
        assert said(w, i) == re.findall(r"\w+", (t or "").lower())


def test_equal_words_have_equal_hashes_wherever_they_stand():
    w = tx.words(pa.array(["one two  ONE", "two-one", "x" * 3_000_000 + " one"]))
    one, two = w.hash[0], w.hash[1]
    assert w.hash.tolist()[:5] == [one, two, one, two, one] and w.hash[-1] == one
    assert len(set(w.hash.tolist())) == 3


def test_hashes_do_not_depend_on_the_block():
    texts = pa.array(["alpha beta gamma delta " * 200_000])
    w = tx.words(texts)
    assert len(set(w.hash.tolist())) == 4


def test_shingles_stay_within_a_text():
    w = tx.words(pa.array(["a b c", None, "", "d e", "c d e f"]))
    value, at = tx.shingles(w, 3)
    assert tx.text_of(w, at).tolist() == [0, 4, 4]
    assert len(set(value.tolist())) == 3


def test_slices_keep_all_rows_and_bound_the_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (10, 0, 700, 5, 5, 2000)] + [None], "k": list(range(7))})
    parts = list(tx.slices(iter([batch]), "text", 500))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(7))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 500 for p in parts)


@pytest.mark.parametrize("highest", [1, 3, 40])
def test_signatures_estimate_the_weighted_jaccard(highest):
    rng = np.random.default_rng(highest)
    a = rng.integers(0, highest + 1, 400)
    b = np.where(rng.random(400) < 0.7, a, rng.integers(0, highest + 1, 400))
    value = tx.mix(np.arange(400, dtype=np.uint64)) >> np.uint64(16)
    owner = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    m = 8000
    sig = bm.signatures(owner, np.concatenate([value[a > 0], value[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, m)
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - exact) < 4 * np.sqrt(exact * (1 - exact) / m)


def test_signature_depends_on_the_bag_alone():
    value = tx.mix(np.arange(50, dtype=np.uint64)) >> np.uint64(16)
    weight = np.arange(1, 51)
    alone = bm.signatures(np.zeros(50, int), value, weight, 1, 64)
    other = bm.signatures(np.repeat([0, 1], 50), np.tile(value, 2), np.concatenate([weight[::-1], weight]), 3, 64)
    assert (alone[0] == other[1]).all() and np.isinf(other[2]).all()


def test_overlap_is_the_multiset_jaccard():
    a = (np.array([1, 2, 5], np.uint64), np.array([2, 1, 4]))
    b = (np.array([2, 5, 9], np.uint64), np.array([3, 1, 1]))
    assert bm.overlap(a, b) == 2 / 10
    assert bm.overlap((a[0][:0], a[1][:0]), (a[0][:0], a[1][:0])) == 0.0


def test_slices_hold_no_more_texts_than_numbers():
    """70,000 short texts in one batch: bags of different texts stay apart."""
    from txnlens.llm.near_dedup import text_bags

    batch = pa.RecordBatch.from_arrays([pa.array([f"w{i}" for i in range(70_000)])], ["text"])
    parts = list(tx.slices(iter([batch]), "text"))
    assert [p.num_rows for p in parts] == [65_536, 70_000 - 65_536]
    for p in parts:
        owner, value, weight = text_bags(tx.words(p.column("text")), 5)
        assert len(np.unique(owner)) == len(np.unique(value)) == p.num_rows and (weight == 1).all()
