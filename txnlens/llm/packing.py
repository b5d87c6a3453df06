"""Sequence packing: shortest-pack-first over the histogram of lengths.

``tokenize`` turns texts into pieces of at most ``max_length`` tokens, ``plan`` packs the histogram
of piece lengths (at most ``max_length`` numbers, whatever the corpus), and ``pack`` deals the
pieces of each length, by their rank, to the places the plan has for that length.

Null texts are empty texts: the end token alone.  Long texts are cut into full pieces and a rest.
Repeated rows are packed once each.  Ties in a rank are broken arbitrarily: the pieces are of the
same length, so any order packs as well.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from array import array
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blank_words import ranges
from .scratch import write
from .text import slices, utf8
from .word_bpe import WordBpe

MAX_LENGTH, TOKENIZER, END_ID = 2048, "word_bpe_49k.json", 1
CACHE = 500_000          # chunks of text whose ids a worker remembers
PIECES_PER_PART = 20_000
SLICE = 1 << 23          # bytes of text encoded at a time: the more, the fewer chunks are met again
MARK, GROUP = "\x02", 50  # a character that is no part of a word, and chunks that are encoded together


def tokenizer_path(name: str) -> str:
    """``name`` itself if it is a path, else the public tokenizer file of that name."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts: of chunks between ASCII blanks, as no token crosses a blank.

    That holds for tokenizers whose pre-tokenizer drops white space; other blanks lie within chunks and are left to it.
    Texts are cut and their different chunks found by Arrow, so each chunk is met once a batch.  Files of the form that
    ``WordBpe`` knows are run by it; chunks that it leaves out, and those of other files, go to the tokenizer, and
    their ids are remembered.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.words = WordBpe.of(file, self.tokenizer)
        self.special = [t["content"] for t in file.get("added_tokens") or []]    # taken from the text as it is written
        normal = self.tokenizer.normalizer       # where A-Z become a-z anyway, ASCII chunks are met in one case
        self.folds = normal is not None and normal.normalize_str(ascii_uppercase) == ascii_lowercase
        self.cache: dict[str, bytes] = {}        # chunks met lately
        self.old: dict[str, bytes] = {}          # those before; half of the limit each
        self.limit = cache // 2

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, encoded some at a time with a mark between them that is a token of its own."""
        mark = self._ids([MARK])[0]
        out = dict.fromkeys(chunks, b"")
        alone = len(mark) != 4
        odd = [c for c in chunks if alone or MARK in c]
        even = [] if alone else [c for c in chunks if MARK not in c]
        groups = [even[i:i + GROUP] for i in range(0, len(even), GROUP)]
        for group, ids in zip(groups, self._ids([f" {MARK} ".join(g) for g in groups]), strict=True):
            at = 4 * np.flatnonzero(np.frombuffer(ids, "<u4") == np.frombuffer(mark, "<u4"))
            out.update(zip(group, map(ids.__getitem__, map(slice, [0, *(at + 4)], [*at, len(ids)])), strict=True))
        out.update(zip(odd, self._ids(odd), strict=True))
        return [out[c] for c in chunks]

    def _learn(self, chunks: set[str]) -> None:
        if len(self.cache) + len(chunks) > self.limit:
            self.old, self.cache = self.cache, {}
        new = []
        for c in chunks:
            ids = self.old.get(c)
            if ids is None:
                new.append(c)
            else:
                self.cache[c] = ids
        self.cache.update(zip(new, self._encoded(new), strict=True))

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that the tokenizer encodes once, as long as they are remembered."""
        new = {c for c in chunks if c not in self.cache}
        if new:
            self._learn(set(chunks) if len(self.cache) + len(new) > self.limit else new)
        return list(map(self.cache.__getitem__, chunks))

    def _has_special(self, chunks: pa.Array) -> pa.Array:
        found = pa.array(np.zeros(len(chunks), bool))
        for content in self.special:
            found = pc.or_(found, pc.match_substring(chunks, content))
        return found

    def _chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks in any order, where each chunk's begin, and their number."""
        ids, size, left = np.zeros(0, np.uint32), np.zeros(len(chunks), np.int64), np.ones(len(chunks), bool)
        if self.words and chunks:
            special = self._has_special(pa.array(chunks, pa.large_string())).to_numpy(zero_copy_only=False)
            ids, size, left = self.words(chunks, special)
        begin = np.cumsum(size) - size
        odd = np.flatnonzero(left)
        rest = self._known([chunks[i] for i in odd.tolist()])
        size[odd] = np.fromiter(map(len, rest), np.int64, len(rest)) // 4
        begin[odd] = len(ids) + np.cumsum(size[odd]) - size[odd]
        return np.concatenate((ids, np.frombuffer(b"".join(rest), "<u4"))), begin, size

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        first = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)))
        coded = split.flatten().dictionary_encode()
        chunks, place = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        if self.folds:
            low = pc.if_else(pc.string_is_ascii(chunks), pc.ascii_lower(chunks), chunks)
            again = pc.if_else(self._has_special(low), chunks, low).dictionary_encode()
            chunks, place = again.dictionary, again.indices.to_numpy(zero_copy_only=False)[place]
        data, stops = utf8(chunks)
        # no chunk holds a newline; far faster than one by one
        ids, begin, size = self._chunk_ids(np.insert(data, stops[1:], 10).tobytes().decode().split("\n")[:-1])
        # a chunk's ids for each of its places, and where the texts end among them
        out = ids[ranges(begin[place], size[place])].astype("<u4").tobytes()
        at = (4 * np.concatenate(([0], np.cumsum(size[place])))[first]).tolist()
        return [out[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept from task to task with what it has met."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(ids: bytes, end_id: int, max_length: int) -> list[tuple[int, bytes]]:
    """(start, ids) of the pieces of one document, with its end token."""
    ids += int(end_id).to_bytes(4, "little")
    step = 4 * max_length
    return [(at // 4, ids[at:at + step]) for at in range(0, len(ids), step)]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, max_length: int, with_ids: bool):
    known = encoder(tokenizer_path(path))
    for batch in slices(batches, "text", SLICE):
        row, start, size, crc, total, ids = [], [], [], [], [], []
        for i, whole in enumerate(known.encode(batch.column("text"))):
            for at, piece in cut(whole, end_id, max_length):
                row.append(i)
                start.append(at)
                size.append(len(piece) // 4)
                crc.append(zlib.crc32(piece))
                total.append(len(whole) // 4 + 1)
                if with_ids:
                    ids.append(np.frombuffer(piece, dtype="<u4").astype(np.int32))
        columns = [batch.column("doc_id").take(pa.array(row, pa.int64())),
                   *(pa.array(x, pa.int64()) for x in (start, size, crc, total))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            columns.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
             end_id: int = END_ID, max_length: int = MAX_LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of every row: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _pieces(it, tokenizer, end_id, max_length, with_ids),
                           schema + ", ids array<int>" * with_ids)


def plan(histogram: dict[int, int], max_length: int = MAX_LENGTH) -> list[tuple[list[tuple[int, int]], int]]:
    """Packing patterns ([(length, copies), ...], packs of that pattern) by shortest pack first.

    Lengths are placed longest first, each piece in the shortest pack so far; where it does not fit
    there it opens a pack.  Packs of one pattern take their next piece together, so the work depends
    on the histogram's lengths, not on its counts.
    """
    packs: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    room: list[int] = []
    closed = []

    def put(pattern, count, free):
        if not count:
            return
        if not free:
            closed.append((pattern, count))
            return
        if free not in packs:
            packs[free] = []
            heapq.heappush(room, -free)
        packs[free].append((pattern, count))

    def grown(pattern, length):
        if pattern and pattern[-1][0] == length:
            return [*pattern[:-1], (length, pattern[-1][1] + 1)]
        return [*pattern, (length, 1)]

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            while room and not packs[-room[0]]:
                del packs[-heapq.heappop(room)]
            if room and -room[0] >= length:
                free = -room[0]
                pattern, count = packs[free].pop()
                take = min(count, n)
                put(pattern, count - take, free)
                put(grown(pattern, length), take, free - length)
                n -= take
            else:       # a new pack stays the only one with room for this length until it has none
                each = max_length // length
                put([(length, each)], n // each, max_length - each * length)
                put([(length, n % each)] if n % each else [], int(n % each > 0), max_length - n % each * length)
                n = 0
    return closed + [x for kept in packs.values() for x in kept]


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset), ordered by length and rank."""
    rows, rank, sequence = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for length, copies in pattern:
            at = rank.get(length, 0)
            rows.append((length, at, copies, sequence, offset))
            rank[length] = at + copies * count
            offset += length * copies
        sequence += count
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def _deal(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    starts = {int(x): (lo, hi) for x, lo, hi in _spans(table[:, 0])}
    for batch in batches:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        row = np.empty(len(length), dtype=np.int64)
        for x in np.unique(length):
            lo, hi = starts[int(x)]
            own = np.flatnonzero(length == x)
            row[own] = lo + np.searchsorted(table[lo:hi, 1], rank[own], side="right") - 1
        place = rank - table[row, 1]
        copies = table[row, 2]
        keep = [c for c in batch.schema.names if c != "rank"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(table[row, 3] + place // copies),
             pa.array(table[row, 4] + place % copies * length)], [*keep, "sequence_id", "offset"])


def _spans(x: np.ndarray) -> list[tuple[int, int, int]]:
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else []
    return [(x[a], a, b) for a, b in zip(first, [*first[1:], len(x)], strict=True)]


def pack(pieces: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """``pieces`` (doc_id, start, length, ...) with the sequence_id and offset of each.

    The rank of a piece among those of its length comes from counts for each (length, part), so no
    task orders all pieces of a length; parts hold about ``PIECES_PER_PART`` pieces.  The place in its
    stored file deals rows that are alike in everything else over the parts too.
    """
    stored = write(pieces, "pieces")
    spark = stored.sparkSession
    n = stored.count()
    parts = max(64, -(-n // PIECES_PER_PART))
    dealt = stored.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_metadata.row_index"), F.lit(parts)))
    counts = write(dealt.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}    # max_length rows at most
    sent = spark.sparkContext.broadcast(places(plan(histogram, max_length)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = write(counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "ranks")
    own = Window.partitionBy("length", "part").orderBy("doc_id", "start")
    ranked = (dealt.withColumn("own", F.row_number().over(own) - 1).join(first, ["length", "part"])
              .select(*stored.columns, (F.col("own") + F.col("first")).alias("rank")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    return ranked.mapInArrow(lambda it: _deal(it, sent.value), f"{fields}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """Token sequences (sequence_id, length, ids) from packed pieces with their ids; a sequence has max_length ids at most."""
    return (packed.groupBy("sequence_id")
            .agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
            .select("sequence_id", "length", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids")))
