"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

1. Every word n-gram of the benchmark gets its document frequency over all documents.
2. Seeds.  Of every ``window`` neighbouring n-grams of an item the rarest: any stretch of
   ``n + window - 1`` unchanged words holds one, however common its words.  And the rarest word pairs
   of the item, all but as many as an alignment over the threshold must hold, less one: whichever
   words are changed or missing, one of these pairs is left as it was.  That holds for items of 4 words
   or more at a threshold of 0.5; words added between more than two thirds of an item's words can
   still hide it.
3. Documents are read once more; where a seed occurs and the passage around it has as many of the
   item's words as the threshold takes, the passage is aligned with the item.  The score is the Smith-Waterman score over that of the whole item matched exactly, so
   copies with changed, added or missing words score a little below 1.

The benchmark is taken in blocks of at most about ``block_bytes`` of text; only a block's seeds
are sent to the executors, whatever the size of the benchmark.  Documents are never shuffled.
Null or wordless documents and items match nothing.  Repeated items are items of their own;
repeated rows are reported once each.  Items shorter than ``n`` words are seeded as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import text as tx

N, WINDOW, THRESHOLD, BLOCK_BYTES = 3, 4, 0.5, 4 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
CELLS = 1 << 21          # alignment cells computed at a time
PAIR = 2


@dataclass
class Items:
    """One block of benchmark items: ids, texts and word hashes."""

    ids: list
    words: list[np.ndarray]
    n: int

    def sizes(self) -> np.ndarray:
        return np.array([min(self.n, len(w)) for w in self.words], dtype=np.int64)

    def grams(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By n-gram size: hash, item and position of every n-gram of items seeded at that size."""
        sizes, out = self.sizes(), {}
        for size in sorted(set(sizes.tolist()) - {0}):
            own = np.flatnonzero(sizes == size)
            first = np.concatenate(([0], np.cumsum([len(self.words[i]) for i in own])))
            w = tx.Words(np.concatenate([self.words[i] for i in own]), None, None, first, None)
            value, at = tx.shingles(w, size)
            item = tx.text_of(w, at)
            out[size] = (value, own[item], at - first[item])
        return out


def read_items(rows: list[tuple], n: int = N) -> Items:
    """Items of (id, text) rows."""
    w = tx.words(pa.array([t for _, t in rows], pa.large_string()))
    return Items([i for i, _ in rows], [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)], n)


def count_grams(batches: Iterator[pa.RecordBatch], grams: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(text) -> (size, gram, docs): how many of the task's texts hold each sorted benchmark n-gram."""
    total = {size: np.zeros(len(g), dtype=np.int64) for size, g in grams.items()}
    filters = {size: Known(g) for size, g in grams.items()}
    for batch in tx.slices(batches, "text"):
        w = tx.words(batch.column("text"))
        for size, known in filters.items():
            value, at = tx.shingles(w, size)
            hit, place = known.hits(value)
            n = len(total[size])
            pair = np.unique(tx.text_of(w, at[hit]) * n + place)
            total[size] += np.bincount(pair % n, minlength=n)
    for size, counts in total.items():
        seen = np.flatnonzero(counts)
        if len(seen):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), size, np.int32)), pa.array(seen), pa.array(counts[seen])],
                ["size", "gram", "docs"])


class Known:
    """Membership of hashes in a sorted array; a bitmap over leading bits turns most others away first."""

    def __init__(self, value: np.ndarray):
        self.value = value
        bits = max(16, int(len(value)).bit_length() + 5)
        self.shift = np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits, dtype=bool)
        self.bitmap[value >> self.shift] = True

    def hits(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the values that are in the array, and the place of the first equal entry."""
        maybe = np.flatnonzero(self.bitmap[value >> self.shift])
        if not len(maybe):
            return maybe, maybe
        place = np.minimum(np.searchsorted(self.value, value[maybe]), len(self.value) - 1)
        same = self.value[place] == value[maybe]
        return maybe[same], place[same]


def seeds(items: Items, frequency: dict[int, tuple[np.ndarray, np.ndarray]], window: int = WINDOW) -> dict:
    """By size: seed hashes with their items and positions; ``frequency`` has (n-gram, documents)."""
    out = {}
    for size, (value, item, at) in items.grams().items():
        known, docs = frequency[size]
        rank = docs[np.searchsorted(known, value)]
        take = np.zeros(len(value), dtype=bool)
        for lo, hi in _runs(item):
            span = min(window, hi - lo)
            views = np.lib.stride_tricks.sliding_window_view(rank[lo:hi], span)
            take[lo + np.arange(len(views)) + views.argmin(axis=1)] = True
        order = np.flatnonzero(take)[np.argsort(value[take], kind="stable")]
        out[size] = (Known(value[order]), item[order], at[order])
    return out


def intact_pairs(length: int, threshold: float) -> int:
    """Pairs of neighbouring words that an alignment over the threshold leaves intact at least, 1 or more.

    With m words matched and e changed or missing, 2 m - e >= 2 threshold * length and m + e <= length, and the
    matched words lie in e + 1 runs at most: m - e - 1 pairs, which is least where e is greatest.
    """
    return max(1, math.ceil((4 * threshold - 1) * length / 3 - 1 - 1e-9))


def pair_seeds(items: Items, frequency: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float) -> dict:
    """By size, as ``seeds``: of every item its rarest pairs, so many that ``intact_pairs`` of them can't all be others."""
    out = {}
    for size, (value, item, at) in items.grams().items():
        known, docs = frequency[size]
        rank = docs[np.searchsorted(known, value)]
        take = np.zeros(len(value), dtype=bool)
        for lo, hi in _runs(item):
            most = hi - lo - intact_pairs(len(items.words[item[lo]]), threshold) + 1
            take[lo + np.argsort(rank[lo:hi], kind="stable")[:max(most, 1)]] = True
        order = np.flatnonzero(take)[np.argsort(value[take], kind="stable")]
        out[size] = (Known(value[order]), item[order], at[order])
    return out


def both_seeds(one: dict, other: dict) -> dict:
    """Seeds of two kinds together."""
    out = dict(one)
    for size, (known, item, at) in other.items():
        if size in out:
            value = np.concatenate((out[size][0].value, known.value))
            item, at = np.concatenate((out[size][1], item)), np.concatenate((out[size][2], at))
            order = np.lexsort((at, item, value))
            value, item, at = value[order], item[order], at[order]
            new = np.concatenate(([True], (value[1:] != value[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1])))
            known, item, at = Known(value[new]), item[new], at[new]
        out[size] = (known, item, at)
    return out


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(x)) + 1
    edges = np.concatenate(([0], cut, [len(x)])).tolist() if len(x) else [0]
    return list(zip(edges[:-1], edges[1:], strict=True))


def smith_waterman(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of ``item`` with each row of ``passages`` (0 pads): score, its end in item and in passage."""
    rows, width = passages.shape
    slope = np.arange(width + 1, dtype=np.int32) * -GAP
    above = np.zeros((rows, width + 1), dtype=np.int32)
    best, end_i, end_j = (np.zeros(rows, dtype=np.int64) for _ in range(3))
    for i, word in enumerate(item):
        row = np.zeros_like(above)
        row[:, 1:] = np.maximum(above[:, :-1] + np.where(passages == word, MATCH, MISMATCH), above[:, 1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        at = row.argmax(axis=1)
        top = row[np.arange(rows), at]
        better = top > best
        best[better], end_i[better], end_j[better] = top[better], i + 1, at[better]
        above = row
    return best, end_i, end_j


def _regions(hits: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(text, item, position, item position) -> (item, first word, end word) of merged passages around seeds."""
    text, item, at, place = hits.T
    slack = lengths[item] // 4 + 2
    lo = np.maximum(at - place - slack, first[text])
    hi = np.minimum(at - place + lengths[item] + slack, first[text + 1])
    order = np.lexsort((lo, item, text))
    text, item, lo, hi = text[order], item[order], lo[order], hi[order]
    pair = text * (int(item.max()) + 1) + item
    base = pair * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(base + hi)
    new = np.concatenate(([True], (pair[1:] != pair[:-1]) | (lo[1:] + base[1:] > reach[:-1])))
    start = np.flatnonzero(new)
    return np.stack([text[start], item[start], lo[start], np.maximum.reduceat(hi, start)], axis=1)


def _item_words(items: Items) -> Known:
    """Every (item, word) as one hash."""
    size = [len(x) for x in items.words]
    return Known(np.unique(_in_item(np.repeat(np.arange(len(size)), size), np.concatenate([np.zeros(0, np.uint64), *items.words]))))


def _in_item(item: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tx.mix(word ^ tx.mix(item.astype(np.uint64) + np.uint64(1)))


def _promising(regions: np.ndarray, items: Items, vocabulary: Known, w: tx.Words, threshold: float) -> np.ndarray:
    """The regions that have enough words of their item: an alignment matches ``threshold`` of the item's words at least."""
    least = np.array([math.ceil(threshold * len(x) - 1e-9) for x in items.words])
    size, keep = regions[:, 3] - regions[:, 2], np.zeros(len(regions), dtype=bool)
    total = np.cumsum(size)
    i = 0
    while i < len(regions):
        j = max(i + 1, int(np.searchsorted(total, total[i] - size[i] + CELLS, side="right")))
        part = np.repeat(np.arange(i, j), size[i:j])
        word = w.hash[np.arange(len(part)) - np.repeat(total[i:j] - size[i:j] - (total[i] - size[i]), size[i:j]) + regions[part, 2]]
        hit, _ = vocabulary.hits(_in_item(regions[part, 1], word))
        keep[i:j] = np.bincount(part[hit] - i, minlength=j - i) >= least[regions[i:j, 1]]
        i = j
    return regions[keep]


@dataclass
class Matches:
    """Aligned passages: text and item index, score, word range in the batch and in the item."""

    text: np.ndarray
    item: np.ndarray
    score: np.ndarray
    start: np.ndarray
    end: np.ndarray
    item_start: np.ndarray
    item_end: np.ndarray


def align(w: tx.Words, items: Items, seeded: dict, vocabulary: Known, threshold: float = THRESHOLD) -> Matches:
    """The best passage of every (text, item) whose score reaches the threshold."""
    hits = []
    for size, (known, item, place) in seeded.items():
        gram, at = tx.shingles(w, size)
        hit, lo = known.hits(gram)
        if len(hit):
            n = np.searchsorted(known.value, gram[hit], side="right") - lo
            post = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            where = np.repeat(at[hit], n)
            hits.append(np.stack([tx.text_of(w, where), item[post], where, place[post]], axis=1))
    found = []
    if hits:
        lengths = np.array([len(x) for x in items.words])
        regions = _regions(np.concatenate(hits), lengths, w.first)
        regions = _promising(regions, items, vocabulary, w, threshold)
        regions = regions[np.lexsort((regions[:, 3] - regions[:, 2], regions[:, 1]))]
        for lo, hi in _runs(regions[:, 1]):
            word = items.words[regions[lo, 1]]
            widths = regions[lo:hi, 3] - regions[lo:hi, 2]
            i = lo
            while i < hi:
                j = i + 1
                while j < hi and (j - i + 1) * widths[j - lo] <= CELLS:
                    j += 1
                found.append(_align_rows(word, regions[i:j], w, threshold))
                i = j
    rows = np.concatenate(found) if found else np.zeros((0, 7))
    rows = rows[np.lexsort((rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):
        rows = rows[np.concatenate(([True], (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)))]
    return Matches(*(rows[:, k] if k == 2 else rows[:, k].astype(np.int64) for k in range(7)))


def _align_rows(item: np.ndarray, regions: np.ndarray, w: tx.Words, threshold: float) -> np.ndarray:
    text, number, lo, hi = regions.T
    width = int((hi - lo).max())
    index = lo[:, None] + np.arange(width)
    inside = index < hi[:, None]
    passages = np.where(inside, w.hash[np.minimum(index, len(w.hash) - 1)], np.uint64(0))
    best, end_i, end_j = smith_waterman(item, passages)
    score = best / (MATCH * len(item))
    out = []
    for r in np.flatnonzero(score >= threshold):
        back = smith_waterman(item[:end_i[r]][::-1], passages[r:r + 1, :end_j[r]][:, ::-1])
        out.append((text[r], number[r], score[r], lo[r] + end_j[r] - int(back[2][0]), lo[r] + end_j[r],
                    end_i[r] - int(back[1][0]), end_i[r]))
    return np.array(out, dtype=np.float64).reshape(-1, 7)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """(id, text) rows of the benchmark in blocks of about ``block_bytes``."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // block_bytes)
    for k in range(count):
        part = rows if count == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k)
        yield [tuple(r) for r in part.collect()]


def _prepare(docs: DataFrame, text_col: str, rows: list[tuple], n: int, window: int, threshold: float):
    """Items, seeds and words of one block as a broadcast; document frequencies are counted over all of ``docs``."""
    items = read_items(rows, n)
    pairs = Items(items.ids, items.words, PAIR)
    grams: dict[int, np.ndarray] = {}
    for kind in (items, pairs):
        for size, (value, _, _) in kind.grams().items():
            grams[size] = np.unique(np.concatenate((grams.get(size, value[:0]), value)))
    sent = docs.sparkSession.sparkContext.broadcast(grams)
    counts = (docs.select(F.col(text_col).cast("string").alias("text"))
              .mapInArrow(lambda it: count_grams(it, sent.value), "size int, gram bigint, docs bigint")
              .groupBy("size", "gram").agg(F.sum("docs").alias("docs")))
    frequency = {size: (g, np.zeros(len(g), dtype=np.int64)) for size, g in grams.items()}
    for size, gram, n_docs in counts.collect():      # as many rows as the block has n-grams at most
        frequency[size][1][gram] = n_docs
    seeded = both_seeds(seeds(items, frequency, window), pair_seeds(pairs, frequency, threshold))
    return docs.sparkSession.sparkContext.broadcast((items, seeded, _item_words(items)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", n: int = N, window: int = WINDOW,
                 threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row and item whose alignment reaches ``threshold``: doc_id, item_id, score,
    start_word and end_word of the passage, item_start and item_end, and the passage (lower case)."""
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = (f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {item_kind}, score double, start_word bigint, end_word bigint, "
              "item_start bigint, item_end bigint, passage string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col, block_bytes)):
        sent = _prepare(docs, text_col, block, n, window, threshold)

        def run(batches, sent=sent):
            items, seeded, vocabulary = sent.value
            for batch in tx.slices(batches, "text"):
                w = tx.words(batch.column("text"))
                m = align(w, items, seeded, vocabulary, threshold)
                if len(m.text):
                    first = w.first[m.text]
                    said = [w.data[w.start[a]:w.end[b - 1]].tobytes().decode() for a, b in zip(m.start, m.end, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(m.text)),
                         pa.array([items.ids[i] for i in m.item], item_type), pa.array(m.score),
                         pa.array(m.start - first), pa.array(m.end - first), pa.array(m.item_start), pa.array(m.item_end),
                         pa.array(said, pa.string())], [f.split()[0] for f in schema.split(", ")])

        part = rows.mapInArrow(run, schema)
        out = part if k == 0 else out.unionByName(part)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                        item_text_col: str = "text", n: int = N, window: int = WINDOW, threshold: float = THRESHOLD,
                        block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; columns and other rows as they were."""
    out = docs
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = _prepare(docs, text_col, block, n, window, threshold)

        def run(batches, sent=sent):
            items, seeded, vocabulary = sent.value
            for batch in tx.slices(batches, text_col):
                m = align(tx.words(batch.column(text_col)), items, seeded, vocabulary, threshold)
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[m.text] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
