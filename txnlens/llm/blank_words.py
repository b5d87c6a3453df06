"""Words between blanks: maximal runs of characters other than U+0020 and U+0009-U+000D, of whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .text import Words, hash_ranges, utf8

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def blank_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of every text (null: none); ``lower`` turns A-Z, and nothing else, to lower case first.

    Blanks are single bytes in UTF-8 and never part of a longer character, so bytes are enough.
    """
    data, offsets = utf8(texts)
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64), data)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 1, dtype=bool)
    np.logical_not(_BLANK[data], out=inside[:-1])
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    begins[edge] = inside[edge]
    ends = inside[:-1] & ~inside[1:]                     # the word's last byte
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(hash_ranges(data, start, end), start, end, np.searchsorted(start, offsets).astype(np.int64), data)


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` (``count[i]`` numbers) for every i, in one array."""
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(first - before, count)


def joined(w: Words, at: np.ndarray, first: np.ndarray) -> pa.Array:
    """Texts of the words ``w[at]`` with one space between; text i has the words ``first[i]`` up to ``first[i + 1]``."""
    size = w.end[at] - w.start[at]
    total = np.concatenate(([0], np.cumsum(size + 1)))
    begin = total[first[:-1]]
    length = np.maximum(total[first[1:]] - begin - 1, 0)
    out = np.full(int(total[-1]), 0x20, dtype=np.uint8)
    out[ranges(total[:-1], size)] = w.data[ranges(w.start[at], size)]
    buffer = out.tobytes()
    return pa.array([buffer[b:b + n] for b, n in zip(begin.tolist(), length.tolist(), strict=True)],
                    pa.large_binary()).cast(pa.large_string())
