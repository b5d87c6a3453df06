"""Alignment of two tokenizers' tokens on the bytes of a text, and how often linked ids meet in the corpus.

A is a byte-level BPE (its text gets a space in front), B a sentencepiece model, which adds that
space itself.  Both cut the same bytes.  Intervals of A and B are sorted together by start, the
running maximum of their ends is kept, and a group ends where a start reaches it: there both
tokenizers end a token.  Within a group every A token is linked with each B token it overlaps.

A link's count is the number of rows whose text holds its id pair linked.  Steps:

1. One map pass cuts texts into blocks of about ``BLOCK`` bytes (one text at least), aligns each block's texts and
   writes one row a block: figures of its texts, the block's distinct id pairs with the number of
   its texts that hold them, and which pair each text holds how often.
2. Pairs are counted corpus-wide from the blocks' pairs, and each A id's highest count is found.
   A block sends each pair once, so no key has more rows than there are blocks.
3. The counts go back to the blocks that hold the pair, and a second map over the blocks adds them
   up for each text.  A block bounds the rows that meet in a task.

Null and empty texts, and texts whose tokens' bytes aren't the text's (a piece of B stands for other
characters), have no tokens: zeros, and no groups.  Special tokens' strings are plain text.
Repeated rows count once each.  Null ids are kept.  No rows: no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blank_words import ranges
from .packing import tokenizer_path
from .scratch import write
from .text import slices, utf8

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK = 1 << 21          # bytes of text in a block
ENCODED = 1 << 20        # bytes of text encoded at a time
# The split pattern of byte-level BPE before merging (a fixed value of that tokenizer format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Bytes:
    """The bytes of every id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.at[ids], self.size[ids])]


def _byte_of_character() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the rest, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + i): b for i, b in enumerate(rest)}}


class ByteLevel:
    """Token ids of a byte-level BPE file of the ``tokenizers`` library.

    Where ids ascend in the order of the merges the same vocabulary runs in ``tiktoken``, which is
    several times faster and gives the same ids; other files are run by the library itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special = {t["content"] for t in file.get("added_tokens", [])}
        vocabulary = file["model"]["vocab"]
        byte = _byte_of_character()
        tokens: list[bytes] = [b""] * (max([*vocabulary.values(), *(t["id"] for t in file.get("added_tokens", []))]) + 1)
        for token, i in vocabulary.items():
            tokens[i] = token.encode() if token in special else bytes(byte[c] for c in token)
        self.bytes = Bytes(tokens)
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in file["model"]["merges"]]
        split = file["pre_tokenizer"] or {}
        plain = (file["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                 and not split.get("add_prefix_space") and not file["model"].get("ignore_merges"))
        self.fast = self.slow = None
        if plain and merged == sorted(merged):
            import tiktoken

            self.fast = tiktoken.Encoding("byte level", pat_str=PATTERN, special_tokens={}, mergeable_ranks={
                tokens[i]: i for t, i in vocabulary.items() if t not in special})
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)
            self.slow.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast:
            return [self.fast.encode_to_numpy(t, disallowed_special=()) for t in texts]
        return [np.array(x.ids, np.uint32) for x in self.slow.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Token ids of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = Bytes([bytes([int(self.model.id_to_piece(i)[3:-1], 16)]) if self.model.is_byte(i)
                            else self.model.id_to_piece(i).replace("▁", " ").encode()
                            for i in range(self.model.get_piece_size())])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.model.encode(texts, num_threads=1)]


_byte_level, _pieces = cache(ByteLevel), cache(Pieces)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def _tokens(coder, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and the offsets of the texts in them."""
    ids = coder.encode(texts)
    return (np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)), _offsets(np.array([len(x) for x in ids], np.int64))


def _faithful(coder, ids: np.ndarray, first: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True for texts whose tokens' bytes are the bytes ``data[at[i]:at[i + 1]]``."""
    size = _offsets(coder.bytes.size[ids])[first]
    good = np.diff(size) == np.diff(at)
    own = ranges(first[:-1][good], np.diff(first)[good])
    want = data[ranges(at[:-1][good], np.diff(at)[good])]
    wrong = np.flatnonzero(coder.bytes.of(ids[own]) != want)
    if len(wrong):
        kept = np.flatnonzero(good)
        good[kept[np.searchsorted(_offsets(np.diff(at)[good]), wrong, side="right") - 1]] = False
    return good


class Alignment:
    """Groups and links of the A and B tokens of texts that lie one after another.

    ``of_a`` and ``of_b``: each token's text; ``start``/``end`` of tokens on the joined bytes.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
        self.a, self.b = a, b
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        start_a, start_b = end_a - size_a, end_b - size_b
        start, end = np.concatenate((start_a, start_b)), np.concatenate((end_a, end_b))
        order = np.lexsort((np.arange(len(start)) >= len(a), start))
        reach = np.maximum.accumulate(end[order])
        breaks = np.concatenate(([True], start[order][1:] >= reach[:-1])) if len(order) else np.zeros(0, bool)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(breaks) - 1
        self.group_a, self.group_b = group[:len(a)], group[len(a):]
        self.n_groups = int(breaks.sum())
        first = np.searchsorted(end_b, start_a, side="right")
        count = np.searchsorted(start_b, end_a, side="left") - first
        self.link_a, self.link_b = np.repeat(np.arange(len(a)), count), ranges(first, count)

    def written(self, first_a: np.ndarray, first_b: np.ndarray) -> list[memoryview]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``: ids in order, by group."""
        groups = np.arange(self.n_groups + 1)
        before_a, before_b = np.searchsorted(self.group_a, groups), np.searchsorted(self.group_b, groups)
        place = np.concatenate((np.arange(len(self.a)) + before_b[self.group_a],
                                np.arange(len(self.b)) + before_a[self.group_b + 1]))
        ids, mark = np.empty(len(place), np.int64), np.full(len(place), ord(","), np.uint8)
        ids[place] = np.concatenate((self.a, self.b))
        ends = before_a[1:] + before_b[:-1] - 1                   # the group's last A token
        mark[ends] = ord("|")
        mark[before_a[1:] + before_b[1:] - 1] = ord(";")
        digits, size = _decimals(int(ids.max(initial=0)))
        letters = digits[ids]
        rows = np.arange(len(ids))
        letters[rows, size[ids]] = mark
        used = np.arange(letters.shape[1]) <= size[ids][:, None]
        flat = memoryview(letters[used].tobytes())
        at = _offsets(size[ids] + 1)[first_a + first_b]
        return [flat[i:max(i, j - 1)] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@cache
def _decimal_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    width = len(str(n)) + 1
    text = np.arange(n + 1).astype(f"S{width}")
    return text.view(np.uint8).reshape(n + 1, width), np.char.str_len(text).astype(np.int64)


def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """ASCII digits of the numbers up to ``most``, a byte of room after them, and their count."""
    return _decimal_table((1 << max(16, most.bit_length())) - 1)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers of 0 and more, a byte each; those of 255 and more follow as 64-bit numbers at the end, in order."""
    large = numbers >= 255
    return np.where(large, 255, numbers).astype(np.uint8).tobytes() + numbers[large].astype("<i8").tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    numbers = np.frombuffer(data, np.uint8, n).astype(np.int64)
    numbers[numbers == 255] = np.frombuffer(data, "<i8", offset=n)
    return numbers


def align_block(texts: pa.Array, path_a: str, path_b: str, groups: str | None) -> dict:
    """Figures of a block's texts, its distinct id pairs, and which pairs each text holds."""
    coder_a, coder_b = _byte_level(path_a), _pieces(path_b)
    n = len(texts)
    parts = []
    row = 0
    for part in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", ENCODED):
        text = part.column("text")
        some = np.flatnonzero(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
        spoken = text.take(pa.array(some)).to_pylist()
        spaced = [" " + t for t in spoken]
        data, at = utf8(pa.array(spaced, pa.large_string()))
        a, first_a = _tokens(coder_a, spaced)
        b, first_b = _tokens(coder_b, spoken)
        good = _faithful(coder_a, a, first_a, data, at) & _faithful(coder_b, b, first_b, data, at)
        count_a, count_b = np.diff(first_a)[good], np.diff(first_b)[good]
        parts.append((some[good] + row, a[ranges(first_a[:-1][good], count_a)], count_a,
                      b[ranges(first_b[:-1][good], count_b)], count_b))
        row += part.num_rows
    own, a, count_a, b, count_b = (np.concatenate(x) for x in zip(*parts, strict=True))
    first_a, first_b = _offsets(count_a), _offsets(count_b)
    al = Alignment(a, b, coder_a.bytes.size[a], coder_b.bytes.size[b])
    of_a = np.repeat(np.arange(len(own)), count_a)
    code = a[al.link_a] * len(coder_b.bytes.size) + b[al.link_b]
    pairs, inverse = np.unique(code, return_inverse=True)
    links = np.bincount(of_a[al.link_a], minlength=len(own))
    held, often = np.unique(of_a[al.link_a] * max(len(pairs), 1) + inverse, return_counts=True)
    pair = held % max(len(pairs), 1)
    holder = held // max(len(pairs), 1)
    holds = np.searchsorted(holder, np.arange(len(own) + 1))
    step = np.diff(pair, prepend=0)
    step[holds[:-1][holds[:-1] < len(step)]] = pair[holds[:-1][holds[:-1] < len(step)]]

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[own] = values
        return out

    said: list = [None] * n
    if groups:
        for i, x in zip(own.tolist(), al.written(first_a, first_b), strict=True):
            said[i] = hashlib.sha256(x).hexdigest() if groups == "sha256" else bytes(x).decode()
        said = ["" if x is None else x for x in said]
    group_of = np.concatenate((al.group_a, [al.n_groups]))
    return {"n_a": spread(count_a), "n_b": spread(count_b), "n_groups": spread(np.diff(group_of[first_a])),
            "n_links": spread(links), "groups": said, "pairs": pairs, "texts": np.bincount(pair, minlength=len(pairs)),
            "held": spread(np.diff(holds)), "pair_steps": _pack(step), "often": _pack(often)}


_FIGURES = ("n_a", "n_b", "n_groups", "n_links", "held")
_BLOCK_TYPES = ("".join(f", {c} array<bigint>" for c in _FIGURES)
                + ", groups array<string>, pairs array<bigint>, texts array<bigint>, pair_steps binary, often binary")


def _blocks(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, groups: str | None, block: int):
    def joined() -> Iterator[pa.RecordBatch]:
        held, size = [], 0                               # Arrow batches are joined up to a block
        for batch in batches:
            for part in slices(iter([batch]), "text", block):
                bytes_ = int(pc.sum(pc.binary_length(part.column("text"))).as_py() or 0)
                if held and size + bytes_ > block:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, size = [], 0
                held.append(part)
                size += bytes_
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for part in joined():
        x = align_block(part.column("text"), path_a, path_b, groups)
        kinds = {"pairs": pa.int64(), "texts": pa.int64(), "groups": pa.string(), **dict.fromkeys(_FIGURES, pa.int64())}
        columns = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))]
        names = ["ids"]
        for c in (*_FIGURES, "groups", "pairs", "texts"):
            values = pa.array(x[c], kinds[c])
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
            names.append(c)
        columns += [pa.array([x[c]], pa.binary()) for c in ("pair_steps", "often")]
        yield pa.RecordBatch.from_arrays(columns, names + ["pair_steps", "often"])


def _add_up(block: pa.Table, counts: pa.Table) -> pa.Table:
    """Rows of one block's texts, with the corpus-wide counts of the pairs that each text holds."""
    row = {c: block.column(c)[0] for c in block.column_names}
    held = row["held"].values.to_numpy(zero_copy_only=False)
    total = int(held.sum())
    first = _offsets(held)
    n, best = np.zeros(len(row["pairs"].values), np.int64), np.zeros(len(row["pairs"].values), np.int64)
    at = counts.column("at").to_numpy()
    n[at] = counts.column("n").to_numpy()
    best[at] = counts.column("best").to_numpy().astype(np.int64)
    step, often = _unpack(row["pair_steps"].as_py(), total), _unpack(row["often"].as_py(), total)
    run = np.cumsum(step)
    base = np.concatenate(([0], run))[first[:-1]]
    pair = run - np.repeat(base, held)

    def added(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(values * often)))[first])

    columns = {"id": row["ids"].values, **{c: row[c].values for c in _FIGURES if c != "held"},
               "n_best": pa.array(added(best[pair])), "count_sum": pa.array(added(n[pair])), "groups": row["groups"].values}
    return pa.table(columns)


def link_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_a: str = TOKENIZER_A,
                    tokenizer_b: str = TOKENIZER_B, groups: str | None = "text", block: int = BLOCK) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups``.

    n_best: links whose count is the highest of their A id, ties included; count_sum: counts added
    over links.  ``groups``: "text" writes the groups out, "sha256" gives that text's digest (lower
    case hex; '' without tokens), None leaves them null.
    """
    path_a, path_b = tokenizer_path(tokenizer_a), tokenizer_path(tokenizer_b)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = rows.mapInArrow(lambda it: _blocks(it, path_a, path_b, groups, block), f"ids array<{kind}>{_BLOCK_TYPES}")
    blocks = write(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    pieces = len(_pieces(path_b).bytes.size)
    counts = write(blocks.select(F.explode(F.arrays_zip("pairs", "texts")).alias("x"))
                   .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.texts").alias("n")), "counts")
    a = F.expr(f"pair div {pieces}").alias("a")
    highest = counts.groupBy(a).agg(F.max("n").alias("highest"))
    judged = (counts.select("pair", "n", a).join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")))
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    told = asked.join(judged, "pair").select(F.col("block").alias("of"), "at", "n", "best")
    figures = blocks.drop("texts")
    return (figures.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(
        _add_up, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
        "groups string"))
