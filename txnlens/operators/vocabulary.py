"""Categories from a keyword table, for vocabularies that are data rather than code.

A keyword row is ``(priority, category, keyword)``.  A description has the category of the highest
priority whose keyword it contains (case-insensitive, anywhere in the text, as in the literal rule
``functions.text.categorize``; there a later group has the higher priority).

A text's places are looked up where the text is: a bitmap of keyword hashes, of ``MAX_BITS`` bits at
most, tells for each place and keyword length whether the characters there may be a keyword.  Only those, each once
for a text, leave the task; they meet the keywords by an equi-join that Spark broadcasts or shuffles by
the table's measured size, so the bitmap never decides.  So no text is compared with every keyword, and rows carry a digest of
their text instead of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..session import cut_lineage

SLICE = 1 << 19                       # characters looked up at a time (one text at least)
HEAD = 4                              # places are first tried by this many characters
MAX_BITS, BLOCK_BITS = 1 << 27, 1 << 19
BROADCAST_BYTES = 8 << 20
_U = np.uint64


def keyword_index(vocabulary: DataFrame) -> DataFrame:
    """``(keyword, priority, category)`` of a keyword table, once per keyword: its highest priority.

    Keywords are lower-cased; null and empty ones match nothing.  Of equal priorities the greater category name stays.
    """
    word = F.lower("keyword")
    rows = vocabulary.filter(F.length("keyword") > 0).groupBy(word.alias("keyword")).agg(
        F.max(F.struct("priority", "category")).alias("_best"))
    return rows.select("keyword", "_best.priority", "_best.category")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _join(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    x = (left * _U(0x9E3779B97F4A7C15)) ^ (right + _U(salt))
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class _Windows:
    """Hashes of the runs of any length that begin at places of ``codes``: of two overlapping runs whose lengths are powers of two."""

    def __init__(self, codes: np.ndarray):
        self.powers = [_join(codes, codes, 1)]

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        k = length.bit_length() - 1
        while len(self.powers) <= k:
            last, step = self.powers[-1], 1 << len(self.powers) - 1
            self.powers.append(_join(last[:-step], last[step:], len(self.powers)))
        return _join(self.powers[k][places], self.powers[k][places + (length - (1 << k))], length << 8)


def _slots(value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (value & _U(bits - 1)).astype(np.int64), ((value >> _U(32)) & _U(bits - 1)).astype(np.int64)


def _hit(bitmap: np.ndarray, value: np.ndarray) -> np.ndarray:
    a, b = _slots(value, 8 * len(bitmap))
    return ((bitmap[a >> 3] >> (a & 7).astype(np.uint8)) & (bitmap[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def _set_bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(keyword) -> (block, part): this task's bitmap of the keywords and of their heads, in blocks that are not empty."""
    bitmap = np.zeros(bits // 8, np.uint8)
    for batch in batches:
        for word in batch.column(0).to_pylist():
            w = _Windows(_codes(word))
            for length in {min(HEAD, len(word)), len(word)}:
                for slot in _slots(w.at(np.zeros(1, np.int64), length), bits):
                    bitmap[slot >> 3] |= np.uint8(1) << (slot & 7).astype(np.uint8)
    parts = bitmap.reshape(-1, min(BLOCK_BITS, bits) // 8)
    some = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["block", "part"])


def _or_parts(key: tuple, table: pa.Table) -> pa.Table:
    parts = np.stack([np.frombuffer(x, np.uint8) for x in table.column("part").to_pylist()])
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())})


def keyword_bits(index: DataFrame, n: int) -> np.ndarray:
    """Bitmap of ``n`` keywords: 64 bits for each, up to ``MAX_BITS``."""
    bits = min(MAX_BITS, max(1 << 12, 1 << (64 * n - 1).bit_length()))
    made = (index.select("keyword").mapInArrow(lambda it: _set_bits(it, bits), "block bigint, part binary")
            .groupBy("block").applyInArrow(_or_parts, "block bigint, part binary"))
    out = np.zeros((max(1, bits // BLOCK_BITS), min(BLOCK_BITS, bits) // 8), np.uint8)
    for r in made.toLocalIterator():               # MAX_BITS at most
        out[r["block"]] = np.frombuffer(r["part"], np.uint8)
    return out.reshape(-1)


def _found(texts: list[str], bitmap: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, str]]:
    """(number of the text, what may be a keyword), each once for a text."""
    whole = "".join(texts)
    w, size = _Windows(_codes(whole)), np.array([len(t) for t in texts])
    end = np.cumsum(size)
    for head in sorted({min(HEAD, n) for n in lengths}):
        if head > len(whole):
            continue
        places = np.arange(len(whole) - head + 1)
        places = places[_hit(bitmap, w.at(places, head))]
        owner = np.searchsorted(end, places, side="right")
        left = end[owner] - places
        for n in lengths:
            if min(HEAD, n) != head:
                continue
            room = left >= n
            at, of = places[room], owner[room]
            if n > head and len(at):
                good = _hit(bitmap, w.at(at, n))
                at, of = at[good], of[good]
            yield from dict.fromkeys((i, whole[a:a + n]) for i, a in zip(of.tolist(), at.tolist(), strict=True))


def _look_up(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """(_key, _text) -> (_key, keyword) of what may be one; texts that are alike in a slice are looked up once."""
    for batch in batches:
        known = dict(zip(batch.column("_key").to_pylist(), batch.column("_text").to_pylist(), strict=True))
        keys, texts, total = [], [], 0
        for i, (key, text) in enumerate(known.items(), 1):
            keys.append(key)
            texts.append(text)
            total += len(text)
            if total >= SLICE or i == len(known):
                hits = list(_found(texts, bitmap, lengths))
                yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k, _ in hits], pa.binary()),
                                                  pa.array([x for _, x in hits], pa.string())], ["_key", "keyword"])
                keys, texts, total = [], [], 0


def categorize_by_table(df: DataFrame, vocabulary: DataFrame, src: str = "description_clean", out: str = "category",
                        default: str = schema.DEFAULT_CATEGORY) -> DataFrame:
    """``df`` with a category column from the keyword table; null and unmatched texts get ``default``.

    The result joins the rows on the text's digest.  An empty table gives ``default`` everywhere.
    """
    index = cut_lineage(keyword_index(vocabulary))
    # one small aggregate of the vocabulary: the lengths that occur, and its size
    known = index.agg(F.sort_array(F.collect_set(F.length("keyword"))).alias("lengths"), F.count("*").alias("n"),
                      F.sum(F.octet_length("keyword") + F.coalesce(F.octet_length("category"), F.lit(0)) + 48).alias("bytes")).first()
    if not known["n"]:
        return df.withColumn(out, F.lit(default))
    lengths = known["lengths"]
    sent = df.sparkSession.sparkContext.broadcast(keyword_bits(index, known["n"]))
    text = F.lower(F.col(f"`{src}`"))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    texts = df.select(digest.alias("_key"), text.alias("_text")).filter(F.length("_text") >= lengths[0])
    found = texts.mapInArrow(lambda it: _look_up(it, sent.value, lengths), "_key binary, keyword string")
    hits = found.join(F.broadcast(index) if known["bytes"] <= BROADCAST_BYTES else index.hint("merge"), "keyword")
    best = hits.groupBy("_key").agg(F.max(F.struct("priority", "category")).alias("_best"))
    best = best.select(F.col("_key").alias("_found"), F.col("_best.category").alias("_category"))
    joined = df.withColumn("_key", digest).join(best, F.col("_key") == F.col("_found"), "left")
    return joined.select(*[df[c] for c in df.columns if c != out], F.coalesce("_category", F.lit(default)).alias(out))
