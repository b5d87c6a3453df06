"""Word and word-shingle hashes of whole text batches, computed with numpy on Arrow buffers.

A word is a maximal run of ASCII letters, digits and underscores and of non-ASCII characters,
lower-cased; non-ASCII spaces and general punctuation separate words as ASCII ones do.
Null and empty texts have no words.  Work is done in blocks that end between words, so memory
beyond the text itself is 24 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19          # bytes hashed at a time
SLICE = 1 << 21          # bytes of text handed to an operator at a time
ROWS = 1 << 16           # and texts at most: operators keep a text's number in 16 bits
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_IS_WORD = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (95, 96), (97, 123), (128, 256)):
    _IS_WORD[_lo:_hi] = True
_INVERSE = pow(int(_BASE), -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, BLOCK + 1)
        _tables["up"], _tables["down"] = _powers(int(_BASE), size), _powers(_INVERSE, size)
    return _tables["up"], _tables["down"]


@dataclass
class Words:
    """Words of a batch: ``hash``, byte ``start``/``end`` in ``data`` and, per text, ``first`` (n + 1 word offsets)."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def _word_bytes(data: np.ndarray) -> np.ndarray:
    """True where a byte belongs to a word."""
    inside = _IS_WORD[data]
    lead = np.flatnonzero((data == 0xE2) | (data == 0xC2) | (data == 0xE3) | (data == 0xEF))
    lead = lead[lead + 1 < len(data)]
    if len(lead):
        kind, second = data[lead], data[lead + 1]
        # U+0080-00A9, U+00AB-00B4, U+00B6-00B9, U+00BB-00BF: controls, spaces and signs
        two = lead[(kind == 0xC2) & ~np.isin(second, (0xAA, 0xB5, 0xBA))]
        third = data[np.minimum(lead + 2, len(data) - 1)]
        general = (kind == 0xE2) & ((second == 0x80) | ((second == 0x81) & (third < 0xB0)))   # U+2000-206F
        wide = (kind == 0xE3) & (second == 0x80)                                              # U+3000-303F
        mark = (kind == 0xEF) & (second == 0xBB) & (third == 0xBF)                            # U+FEFF
        three = lead[general | wide | mark]
        for at, width in ((two, 2), (three, 3)):
            for k in range(width):
                inside[np.minimum(at + k, len(data) - 1)] = False
    return inside


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; ranges ascend and don't overlap."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, side="right")))
        lo, hi = start[i], end[j - 1]
        up, down = _power_tables(int(hi - lo) + 1)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[data[lo:hi]] * up[:hi - lo], out=total[1:])
        out[i:j] = (total[end[i:j] - lo] - total[start[i:j] - lo]) * down[start[i:j] - lo]
        i = j
    return mix(out + (end - start).astype(np.uint64))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null: empty) and the n + 1 offsets of the texts in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n, buffers = len(texts), texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=n + 1 + texts.offset)[texts.offset:] if n else np.zeros(1, np.int64)
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array) -> Words:
    """Words of every text of an Arrow string array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data, offsets = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(none.astype(np.uint64), none, none, offsets, data)
    inside = _word_bytes(data)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1]
    cut = cut[cut < len(data)]
    begins[cut] = inside[cut]
    ends = np.zeros(len(data) + 1, dtype=bool)
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:]
    inner = offsets[1:]
    inner = inner[inner > 0]
    ends[inner] = inside[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return Words(hash_ranges(data, start, end), start, end,
                 np.searchsorted(start, offsets).astype(np.int64), data)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first-word index of every run of ``size`` words that lies in one text."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, dtype=np.uint64)
    factor = 1
    for k in range(size):
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)
        value += w.hash[k:k + n] * _U(factor)
    text = np.repeat(np.arange(len(w.first) - 1), w.count)
    at = np.flatnonzero(text[:n] == text[size - 1:])
    return mix(value[at]), at


def text_of(w: Words, at: np.ndarray) -> np.ndarray:
    """Index of the text that holds each word index."""
    return np.searchsorted(w.first, at, side="right") - 1


def sequence_hash(w: Words) -> np.ndarray:
    """Two 64-bit hashes of each text's whole word sequence: an (n, 2) array."""
    n = len(w.first) - 1
    out = np.zeros((n, 2), dtype=np.uint64)
    if len(w.hash):
        place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.count)
        full = np.flatnonzero(w.count)
        for k, salt in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
            part = mix(w.hash ^ mix(place.astype(np.uint64) * _U(salt) + _U(salt)))
            out[full, k] = np.add.reduceat(part, w.first[:-1][full])
    out[:, 0] = mix(out[:, 0] + w.count.astype(np.uint64))
    out[:, 1] = mix(out[:, 1] ^ w.count.astype(np.uint64))
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about ``limit`` text bytes (one text at least) and at most ``ROWS`` texts."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        i = 0
        while i < batch.num_rows:
            before = size[i - 1] if i else 0
            j = min(i + ROWS, max(i + 1, int(np.searchsorted(size, before + limit, side="right"))))
            yield batch.slice(i, j - i)
            i = j
