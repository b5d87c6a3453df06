"""Repeated passages by a sparse suffix array.

1. Anchors: of every ``window`` neighbouring word k-grams of a text the one with the smallest hash
   (a minimiser).  Equal passages of at least ``window + gram - 1`` words choose the same anchors.
2. Suffixes start at anchors only.  Anchors whose k-gram occurs nowhere else are dropped.
3. A suffix carries the words from its anchor on, and those before it, up to ``least`` words either
   way, as 24-bit word hashes.  All suffixes are sorted by their words (range partitioning, so any
   number of equal suffixes is spread over tasks) and each is compared with its next neighbours.
4. The common prefix, extended to the left by the common words before the anchors, is a repeated
   passage if it has ``least`` words.  Passages of a text that overlap are joined, so a long one
   is found whole, anchor by anchor.
5. Partners that are no neighbours in that order: a k-gram in at most ``near + 1`` places has all its
   suffixes within ``near`` of each other, so the comparison is complete for it.  That leaves runs of
   ``least`` words whose every minimiser (of the windows that lie within the run, which are the same
   in each of its places) is of a k-gram in more places.  Those runs are hashed, and runs of a hash
   that occurs in more than one place are passages.

Equal texts are one suffix owner; each text with copies and ``least`` words is a passage as a whole.
Null and shorter texts have no passage.  Repeated rows are copies.  Null ids are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .scratch import drop, write

LEAST, GRAM, WINDOW, NEAR = 50, 8, 32, 8
WORD_BYTES = 3


def anchors(w: tx.Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """k-gram hash and word index of the minimisers of every text; the rightmost of equal ones."""
    value, at = tx.shingles(w, gram)
    if not len(value):
        return value, at
    owner = tx.text_of(w, at)
    count = np.bincount(owner, minlength=len(w.first) - 1)
    span = np.minimum(window, np.maximum(count, 1))
    begin = np.cumsum(count) - count
    # a window that runs over the end of its text is left out; a text of fewer k-grams is one window
    low = _sliding_argmin(value, window)
    index = np.arange(len(value))
    whole = index + window <= (begin + count)[owner]
    chosen = low[index[whole[index]]] if whole.any() else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < window))
    few = [begin[t] + int(np.argmin(value[begin[t]:begin[t] + span[t]])) for t in short.tolist()]
    keep = np.unique(np.concatenate((chosen, np.array(few, dtype=np.int64))))
    return value[keep], at[keep]


def _sliding_argmin(value: np.ndarray, window: int) -> np.ndarray:
    """Index of the smallest of the ``window`` values from each index on (fewer at the end), by doubling."""
    best = np.arange(len(value))
    step = 1
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        if step >= len(value):
            break
        ahead = best[step:]
        here = best[:-step]
        merged = best.copy()
        merged[:-step] = np.where(value[ahead] <= value[here], ahead, here)
        best = merged
        reach += step
    return best


def _find_anchors(batches: Iterator[pa.RecordBatch], gram: int, window: int) -> Iterator[pa.RecordBatch]:
    """(id, owner, text) -> (id, owner, n_words, grams, places)."""
    for batch in tx.slices(batches, "text"):
        w = tx.words(batch.column("text"))
        value, at = anchors(w, gram, window)
        first = np.searchsorted(at, w.first).astype(np.int32)
        place = (at - w.first[tx.text_of(w, at)]).astype(np.int32) if len(at) else at.astype(np.int32)
        offsets = pa.array(first)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("owner"), pa.array(w.count), pa.ListArray.from_arrays(offsets, pa.array(value.view(np.int64))),
             pa.ListArray.from_arrays(offsets, pa.array(place))], ["id", "owner", "n_words", "grams", "places"])


def _suffixes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(owner, text, places) -> (owner, place, after, before): word hashes from the anchor on, and backwards before it."""
    for batch in tx.slices(batches, "text"):
        w = tx.words(batch.column("text"))
        small = ((w.hash >> np.uint64(40)).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes())
        back = (w.hash[::-1] >> np.uint64(40)).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()
        n = len(w.hash)
        owner, place, after, before = [], [], [], []
        for i, (who, places) in enumerate(zip(batch.column("owner").to_pylist(), batch.column("places").to_pylist(), strict=True)):
            lo, hi = int(w.first[i]), int(w.first[i + 1])
            for p in places:
                at = lo + p
                if at >= hi:             # of another text with the same 64-bit key
                    continue
                owner.append(who)
                place.append(p)
                after.append(small[WORD_BYTES * at:WORD_BYTES * min(at + least, hi)])
                before.append(back[WORD_BYTES * (n - at):WORD_BYTES * (n - max(at - least, lo))])
        yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(place, pa.int32()), pa.array(after, pa.binary()),
                                          pa.array(before, pa.binary())], ["owner", "place", "after", "before"])


def _windows(batches: Iterator[pa.RecordBatch], least: int, gram: int, window: int) -> Iterator[pa.RecordBatch]:
    """(owner, text, frequent) -> (owner, start, window, ends): hashes of every run of ``least`` words whose minimisers
    all stand at frequent places: of its words, and of its first and last k-grams."""
    inner = least - gram + 2 - window        # windows of k-grams within a run
    for batch in tx.slices(batches, "text"):
        w = tx.words(batch.column("text"))
        grams, at = tx.shingles(w, gram)
        runs, start = tx.shingles(w, least)
        often = np.zeros(len(w.hash) + 1, dtype=bool)
        for i, places in enumerate(batch.column("frequent").to_pylist()):
            place = w.first[i] + np.array(places, dtype=np.int64)
            often[place[place < w.first[i + 1]]] = True      # else of another text with the same 64-bit key
        other = np.concatenate(([0], np.cumsum(~often[at[_sliding_argmin(grams, window)]]))) if len(grams) else np.zeros(1, np.int64)
        first = np.searchsorted(at, start)
        keep = other[np.minimum(first + inner, len(other) - 1)] == other[first]
        runs, start, first = runs[keep], start[keep], first[keep]
        text = tx.text_of(w, start)
        ends = tx.mix(grams[first]) ^ grams[first + least - gram]
        owner = batch.column("owner").to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(owner[text], pa.int64()), pa.array((start - w.first[text]).astype(np.int32)),
                                          pa.array(runs.view(np.int64)), pa.array(ends.view(np.int64))],
                                         ["owner", "start", "window", "ends"])


def _words_matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings of word hashes as rows of ``width`` words (padded), and their lengths in words."""
    column = column.cast(pa.large_binary())
    length = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width * WORD_BYTES), dtype=np.uint8)
    out[np.arange(width * WORD_BYTES) < length[:, None]] = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return out, length // WORD_BYTES


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Leading words that the rows of two matrices share, at most ``most``."""
    other = a != b
    first = np.where(other.any(axis=1), other.argmax(axis=1) // WORD_BYTES, a.shape[1] // WORD_BYTES)
    return np.minimum(first, most)


def _passages(rows: pa.Table, least: int, near: int, new_from: int = 0) -> np.ndarray:
    """(owner, start, end, other owner) from sorted suffixes and their next ``near`` followers.

    Followers before ``new_from`` were compared earlier.
    """
    owner, place = (rows.column(c).to_numpy().astype(np.int64) for c in ("owner", "place"))
    after, right = _words_matrix(rows.column("after").combine_chunks(), least)
    before, left = _words_matrix(rows.column("before").combine_chunks(), least)
    out = []
    for k in range(1, min(near, len(owner) - 1) + 1):
        i = np.arange(max(0, new_from - k), len(owner) - k)
        j = i + k
        r = _common(after[i], after[j], np.minimum(right[i], right[j]))
        some = r > 0
        i, j, r = i[some], j[some], r[some]
        both = _common(before[i], before[j], np.minimum(left[i], left[j]))
        good = (both + r >= least) & ((owner[i] != owner[j]) | (place[i] != place[j]))
        i, j, r, both = i[good], j[good], r[good], both[good]
        for x, y in ((i, j), (j, i)):
            out.append(np.stack([owner[x], place[x] - both, place[x] + r, owner[y]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


_FOUND = "owner bigint, start bigint, end bigint, other bigint, part int, edge int, place int, after binary, before binary"
_SUFFIX = ("owner", "place", "after", "before")


def _neighbours(batches: Iterator[pa.RecordBatch], least: int, near: int) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes -> passages, and the partition's first and last ``near`` suffixes (edge from 0 on, and before -1)."""
    part, head, tail = TaskContext.get().partitionId(), None, None
    for whole in batches:
        for at in range(0, whole.num_rows, 20_000):
            batch = pa.table(whole.slice(at, 20_000)).select(_SUFFIX)
            rows = batch if tail is None else pa.concat_tables([tail, batch])
            found = _passages(rows, least, near, 0 if tail is None else tail.num_rows)
            found = np.unique(found, axis=0)
            if len(found):
                yield _batch([pa.array(found[:, k]) for k in range(4)], len(found))
            head = rows.slice(0, near) if head is None or head.num_rows < near else head
            tail = rows.slice(max(0, rows.num_rows - near))
    if head is not None:
        for rows, first in ((head, 0), (tail, -tail.num_rows)):
            n = rows.num_rows
            yield _batch([rows.column("owner"), None, None, None, pa.array([part] * n, pa.int32()),
                          pa.array(range(first, first + n), pa.int32()), *(rows.column(c) for c in ("place", "after", "before"))], n)


def _batch(columns: list, n: int) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()] * 2
    columns = [*columns, *[None] * (len(kinds) - len(columns))]
    full = [pa.nulls(n, kind) if c is None else (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).cast(kind)
            for c, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(full, [f.split()[0] for f in _FOUND.split(", ")])


def _across(edges: list, least: int, near: int) -> list[tuple]:
    """Passages of neighbours that lie in different partitions."""
    parts: dict[int, dict[int, list]] = {}
    for r in edges:
        side = parts.setdefault(r["part"], {0: [], 1: []})
        side[r["edge"] < 0].append((r["edge"], {c: bytes(r[c]) if c in ("after", "before") else r[c] for c in _SUFFIX}))
    found, tail = set(), []
    for part in sorted(parts):
        head = [x for _, x in sorted(parts[part][0], key=lambda e: e[0])]
        if tail:
            rows = pa.Table.from_pylist(tail + head, schema=pa.schema(
                [("owner", pa.int64()), ("place", pa.int32()), ("after", pa.binary()), ("before", pa.binary())]))
            found.update(map(tuple, _passages(rows, least, near, len(tail)).tolist()))
        last = [x for _, x in sorted(parts[part][1], key=lambda e: e[0])]
        tail = (tail + last)[-near:] if len(last) < near else last
    return sorted(found)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM,
                      window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """Every maximal run of words of a row that lies in passages of ``least`` or more words that occur elsewhere.

    doc_id, start_word, end_word (words of ``text.words``, end excluded), n_words, other_id (a row that
    holds one of the run's passages, or the same row if it holds one twice).
    """
    if window + gram - 1 > least:
        raise ValueError("window + gram - 1 must not exceed least")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("owner"), text.alias("text"))
    found = write(rows.mapInArrow(lambda it: _find_anchors(it, gram, window),
                                  f"id {kind}, owner bigint, n_words bigint, grams array<bigint>, places array<int>"), "anchors")
    owners = write(found.groupBy("owner").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("best"),
                                              F.count("*").alias("copies"), F.max("n_words").alias("n_words"))
                   .select("owner", F.col("best.id").alias("first_id"), "copies", "n_words"), "owners")
    posts = found.filter(F.col("n_words") >= least).select("owner", F.explode(F.arrays_zip("grams", "places")).alias("at")) \
        .select("owner", F.col("at.grams").alias("gram"), F.col("at.places").alias("place"))
    spot = F.xxhash64("owner", "place")
    often = write(posts.groupBy("gram").agg(F.min(spot).alias("a"), F.max(spot).alias("b"), F.count("*").alias("n"))
                  .filter("a != b").select("gram", (F.col("n") > near + 1).alias("frequent")), "grams")
    places = (posts.join(often, "gram").select("owner", "place", "frequent").distinct()
              .groupBy("owner").agg(F.collect_list("place").alias("places"),
                                    F.collect_list(F.when(F.col("frequent"), F.col("place"))).alias("frequent")))
    places = write(places.join(owners, "owner").select(F.col("owner").alias("its"), "first_id", "places", "frequent", "copies"), "places")
    ids = write(found.select("id", "owner"), "ids")
    drop(found)
    own = rows.join(places, (rows["owner"] == places["its"]) & rows["id"].eqNullSafe(places["first_id"]))
    own = own.filter("copies = 1").unionByName(own.filter("copies > 1").dropDuplicates(["owner"]))    # an id may repeat
    suffixes = write(own.select("owner", "text", "places")
                     .mapInArrow(lambda it: _suffixes(it, least), "owner bigint, place int, after binary, before binary"), "suffixes")
    order = ["after", "before", "owner", "place"]
    compared = write(suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
                     .mapInArrow(lambda it: _neighbours(it, least, near), _FOUND), "compared")
    drop(suffixes)
    edges = compared.filter("edge is not null").select("part", "edge", *_SUFFIX).collect()    # 2 * near rows a partition
    across = _across(edges, least, near)
    spans = (compared.filter("edge is null").select("owner", "start", "end", "other")
             .unionByName(spark.createDataFrame(across, "owner bigint, start bigint, end bigint, other bigint")))
    windows = write(own.filter(F.size("frequent") > 0).select("owner", "text", "frequent")
                    .mapInArrow(lambda it: _windows(it, least, gram, window), "owner bigint, start int, window bigint, ends bigint"), "windows")
    at = F.xxhash64("owner", "start")
    again = write(windows.groupBy("window", "ends").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.min("owner").alias("low"),
                                                        F.max("owner").alias("high"))
                  .filter("a != b").select("window", "ends", "low", "high"), "repeated")
    equal = windows.join(again, ["window", "ends"]).select(
        "owner", F.col("start").cast("bigint").alias("start"), (F.col("start") + least).cast("bigint").alias("end"),
        F.when(F.col("owner") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other"))
    spans = spans.unionByName(equal)
    whole = (owners.filter((F.col("copies") > 1) & (F.col("n_words") >= least))
             .select("owner", F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("end"), F.col("owner").alias("other")))
    merged = write(_merge(spans.unionByName(whole)), "spans")
    drop(compared)
    drop(windows)
    partner = owners.select(F.col("owner").alias("other"), F.col("first_id").alias("other_id"))
    named = write(merged.join(partner, "other"), "named")
    return (ids.join(named, "owner")
            .select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"),
                    (F.col("end") - F.col("start")).alias("n_words"), "other_id"))


def _merge(spans: DataFrame) -> DataFrame:
    """Overlapping spans of an owner joined (an owner's spans grow with its anchors and words)."""
    spans = spans.groupBy("owner", "start", "end").agg(F.min("other").alias("other"))
    before = Window.partitionBy("owner").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("owner").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int")
    return (spans.withColumn("new", new).withColumn("run", F.sum("new").over(upto))
            .groupBy("owner", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other"))
            .drop("run"))


def cut_passage(text: str, start_word: int, end_word: int) -> str:
    """The words of a span, lower-cased, with what stands between them."""
    w = tx.words(pa.array([text]))
    return w.data[w.start[start_word]:w.end[end_word - 1]].tobytes().decode()
