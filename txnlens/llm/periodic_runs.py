"""Periodic runs of words, found on a grammar of the words.

A run is a stretch of words with smallest period q (words q apart are identical) of at least
``max(least, times * q)`` words that no neighbouring word extends with the same period.

1. Word ids of a batch of texts are compressed by Re-Pair: the most frequent pair of neighbouring
   symbols gets a new symbol, until no pair occurs twice.  A round replaces many pairs, the most
   frequent first, as long as their places don't overlap.  What is left of a text is joined in
   pairs to a balanced tree.
2. Every symbol stands for two parts side by side.  Runs over their boundary are computed once per
   symbol: a run of three periods holds the two words at the boundary again one period on or
   before, so the places of that word pair within the symbol are the candidate periods, and
   longest common extensions of both sides (prefix hashes and binary search, then compared word by
   word) give the run.
3. The runs of a symbol hold at each of its places.  Stretches of one period that overlap by a
   period are one run; of equal stretches the smallest period stays.  The lowest symbol that
   holds a run as a whole has it over its boundary, so no run is missed.

Words that lie in no run can be left out before step 1: a run of at least 24 words and 3 periods
holds ``least - least // times`` words and more that stand again one period on.  Only stretches whose word runs of
that length occur twice in their text get a grammar.

Null and empty texts have no words and no runs.  Repeated rows are worked on like any others.
One map pass over the rows; the memory is some 100 bytes a word of a slice of texts (one at least).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blank_words import blank_words, joined, ranges
from .text import Words, mix, shingles, slices

LEAST, TIMES = 24, 3
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_BASE = 0x9E3779B97F4A7C15 | 1


@dataclass
class Symbols:
    """Occurrences of grammar symbols: ``name``, and places ``lo``, ``mid`` and ``hi`` of its two parts."""

    name: np.ndarray
    lo: np.ndarray
    mid: np.ndarray
    hi: np.ndarray


def _pair_ids(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the distinct pairs of numbers."""
    code = left.astype(np.int64) * (int(right.max(initial=0)) + 1) + right
    return pd.factorize(code)[0]


def _choose(sym: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i whose pair (i, i + 1) is replaced in this round, and each such pair's number.

    Pairs that occur twice are taken by falling frequency, equal ones in a mixed order; a place
    goes to the first pair that takes it.
    """
    at = np.flatnonzero(part[1:] == part[:-1])
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(at):
        return none
    pair = _pair_ids(sym[at], sym[at + 1])
    # of overlapping pairs x x in a row of equal symbols, every second one counts
    again = np.zeros(len(at), dtype=bool)
    again[1:] = (pair[1:] == pair[:-1]) & (at[1:] == at[:-1] + 1)
    begin = np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))
    odd = (np.arange(len(at)) - begin) % 2 == 1
    count = np.bincount(pair[~odd], minlength=int(pair.max()) + 1)
    order = np.lexsort((mix(np.arange(len(count), dtype=np.uint64)), count))
    rank = np.empty(len(count), np.int64)
    rank[order] = np.arange(1, len(count) + 1)
    rank[count < 2] = 0
    free = np.zeros(len(sym) + 2, np.int64)              # free[i + 1]: rank of the pair at place i
    free[at[~odd] + 1] = rank[pair[~odd]]
    live = np.flatnonzero(free[1:-1])
    taken = []
    while len(live):
        here = free[live + 1]
        won = live[(here > free[live]) & (here > free[live + 2])]
        taken.append(won)
        free[won] = free[won + 1] = free[won + 2] = 0
        live = live[free[live + 1] > 0]
    if not taken:
        return none
    taken = np.sort(np.concatenate(taken))
    return taken, pair[np.searchsorted(at, taken)]


def repair(word: np.ndarray, part: np.ndarray, least: int) -> Symbols:
    """Re-Pair of the word ids; pairs don't cross from one part to the next.  Symbols of ``least`` words and more."""
    sym, lo, hi = word.astype(np.int64), np.arange(len(word)), np.arange(1, len(word) + 1)
    fresh = int(sym.max(initial=0)) + 1
    found: list[tuple[np.ndarray, ...]] = []

    def replace(at: np.ndarray, name: np.ndarray):
        nonlocal sym, lo, hi, part, fresh
        mid, end = lo[at + 1], hi[at + 1]
        long = end - lo[at] >= least
        found.append((name[long], lo[at][long], mid[long], end[long]))
        sym[at], hi[at] = name, end
        stay = np.ones(len(sym), dtype=bool)
        stay[at + 1] = False
        sym, lo, hi, part = sym[stay], lo[stay], hi[stay], part[stay]
        fresh = int(name.max()) + 1

    while True:
        at, pair = _choose(sym, part)
        if not len(at):
            break
        replace(at, fresh + pd.factorize(pair)[0])
    while True:                                          # what is left of a part becomes a balanced tree
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
        place = np.arange(len(part)) - np.repeat(first, np.diff(np.append(first, len(part))))
        at = np.flatnonzero((place[:-1] % 2 == 0) & (part[1:] == part[:-1])) if len(part) else first
        if not len(at):
            break
        replace(at, fresh + np.arange(len(at)))
    if not found:
        return Symbols(*(np.zeros(0, np.int64) for _ in range(4)))
    return Symbols(*(np.concatenate(x) for x in zip(*found, strict=True)))


class Extensions:
    """Longest common extensions of two places in one sequence."""

    def __init__(self, word: np.ndarray):
        n = len(word)
        self.power = np.full(n + 1, _BASE, dtype=np.uint64)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.sum = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(word.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=self.sum[1:])

    def _search(self, limit: np.ndarray, same) -> np.ndarray:
        least, most = np.zeros_like(limit), limit.copy()
        open_ = np.flatnonzero(least < most)
        step = 1                                         # gallop, then halve
        while len(open_):
            size = np.minimum(np.where(most[open_] > least[open_] + 2 * step, least[open_] + step,
                                       (least[open_] + most[open_] + 1) // 2), most[open_])
            ok = same(open_, size)
            least[open_] = np.where(ok, size, least[open_])
            most[open_] = np.where(ok, most[open_], size - 1)
            open_ = open_[least[open_] < most[open_]]
            step *= 2
        return least

    def forward(self, a: np.ndarray, q: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Words from ``a`` on that equal those from ``a + q`` on, at most ``limit``."""
        return self._search(limit, lambda i, n: (self.sum[a[i] + n] - self.sum[a[i]]) * self.power[q[i]]
                            == self.sum[a[i] + q[i] + n] - self.sum[a[i] + q[i]])

    def backward(self, a: np.ndarray, q: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Words before ``a`` that equal those before ``a + q``, at most ``limit``."""
        return self._search(limit, lambda i, n: (self.sum[a[i]] - self.sum[a[i] - n]) * self.power[q[i]]
                            == self.sum[a[i] + q[i]] - self.sum[a[i] + q[i] - n])


def _boundary_runs(word: np.ndarray, one: Symbols, least: int, times: int) -> tuple[np.ndarray, ...]:
    """(symbol's index, start, end, period) of runs over the boundary of each symbol's first place."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not len(one.lo):
        return none
    pair = np.append(_pair_ids(word[:-1], word[1:]), 0)
    n = len(word)
    key = np.sort(pair[:-1].astype(np.int64) * n + np.arange(n - 1))
    near = (one.hi - one.lo) // times
    base = pair[one.mid - 1].astype(np.int64) * n
    begin = np.searchsorted(key, base + np.maximum(one.lo, one.mid - 1 - near))
    stop = np.searchsorted(key, base + np.minimum(one.hi - 1, one.mid + near))
    of = np.repeat(np.arange(len(one.lo)), stop - begin)
    place = key[ranges(begin, stop - begin)] - base[of]
    mid, lo, hi = one.mid[of], one.lo[of], one.hi[of]
    other = np.flatnonzero(place != mid - 1)
    of, place, mid, lo, hi = of[other], place[other], mid[other], lo[other], hi[other]
    period = np.abs(place - (mid - 1))
    at = np.minimum(place, mid - 1) + 1                  # words at - 1 and at equal those one period on
    ext = Extensions(word)
    after = ext.forward(at, period, hi - at - period)
    before = ext.backward(at, period, at - lo)
    long = np.flatnonzero(after + before + period >= np.maximum(least, times * period))
    of, at, period, after, before, lo, hi = (x[long] for x in (of, at, period, after, before, lo, hi))
    start, end = at - before, at + period + after
    # multiples of a period give its stretch again; few runs with a period of their own lie over one place
    order = np.lexsort((period, end, start, of))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = ((of[order[1:]] == of[order[:-1]]) & (start[order[1:]] == start[order[:-1]])
                 & (end[order[1:]] == end[order[:-1]]))
    kept = order[~again]
    size = end[kept] - start[kept] - period[kept]
    unequal = word[ranges(start[kept], size)] != word[ranges(start[kept] + period[kept], size)]
    wrong = np.isin(of, of[kept[np.repeat(np.arange(len(kept)), size)[unequal]]])
    for i in np.flatnonzero(wrong).tolist():             # hashes of unequal stretches met: look word by word
        q, b, f = int(period[i]), int(at[i]), int(at[i])
        while f + q < hi[i] and word[f] == word[f + q]:
            f += 1
        while b > lo[i] and word[b - 1] == word[b - 1 + q]:
            b -= 1
        start[i], end[i] = b, f + q
    kept = np.union1d(kept, np.flatnonzero(wrong))
    good = kept[end[kept] - start[kept] >= np.maximum(least, times * period[kept])]
    return of[good], start[good], end[good], period[good]


def sequence_runs(word: np.ndarray, part: np.ndarray, least: int = LEAST,
                  times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run of the id sequences; ``part`` (ascending) numbers the sequences."""
    symbols = repair(word, part, least)
    name, first, inverse = np.unique(symbols.name, return_index=True, return_inverse=True)
    one = Symbols(name, symbols.lo[first], symbols.mid[first], symbols.hi[first])
    of, start, end, period = _boundary_runs(word, one, least, times)
    # every place of the symbol has its runs
    order = np.argsort(inverse, kind="stable")
    count = np.bincount(inverse, minlength=len(name))
    begin = np.cumsum(count) - count
    many = count[of]
    place = symbols.lo[order[ranges(begin[of], many)]] - np.repeat(one.lo[of], many)
    start, end, period = (np.repeat(start, many) + place, np.repeat(end, many) + place, np.repeat(period, many))
    # stretches of a period that overlap by a period are one run
    owner = part[start] if len(start) else start
    order = np.lexsort((end, start, period, owner))
    owner, start, end, period = owner[order], start[order], end[order], period[order]
    if not len(start):
        return start, end, period
    group = np.concatenate(([0], np.cumsum((owner[1:] != owner[:-1]) | (period[1:] != period[:-1]))))
    reach = np.maximum.accumulate(end + group * (len(word) + 1)) - group * (len(word) + 1)
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (start[1:] > reach[:-1] - period[1:])))
    head = np.flatnonzero(new)
    start, period = start[head], period[head]
    end = reach[np.append(head[1:], len(new)) - 1]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least_ = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))
    return start[least_], end[least_], period[least_]


def _word_ids(w: Words, at: np.ndarray) -> np.ndarray:
    """Numbers of the words ``w[at]``: equal exactly where the words' bytes are."""
    ids, seen = pd.factorize(w.hash[at])
    one = np.zeros(len(seen), np.int64)
    one[ids[::-1]] = at[::-1]
    size = w.end[at] - w.start[at]
    if (size == (w.end - w.start)[one[ids]]).all():
        if (w.data[ranges(w.start[at], size)] == w.data[ranges(w.start[one[ids]], size)]).all():
            return ids
    data = w.data.tobytes()                              # two words of one hash
    return pd.factorize(np.array([data[s:e] for s, e in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)], object))[0]


def word_runs(w: Words, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run of every text, as word indexes of ``w``, by start and period."""
    none = tuple(np.zeros(0, np.int64) for _ in range(3))
    size = least - least // times
    value, at = shingles(w, size)
    if not len(at):
        return none
    text = np.repeat(np.arange(len(w.first) - 1), w.count)
    key = mix(value ^ mix(text[at].astype(np.uint64)))
    order = np.argsort(key)
    equal = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    step = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + size, -1)
    held = np.flatnonzero(np.cumsum(step[:-1]))
    if not len(held):
        return none
    part = np.concatenate(([0], np.cumsum((held[1:] != held[:-1] + 1) | (text[held[1:]] != text[held[:-1]]))))
    start, end, period = sequence_runs(_word_ids(w, held), part, least, times)
    start, end = held[start], held[end - 1] + 1
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _rows(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        w = blank_words(batch.column("text"))
        start, end, period = word_runs(w, least, times)
        owner = np.searchsorted(w.first, start, side="right") - 1
        drop = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(drop, start + period, 1)
        np.add.at(drop, end, -1)
        kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
        offsets = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
        runs = pa.StructArray.from_arrays(
            [pa.array(start - w.first[owner]), pa.array(end - start), pa.array(period.astype(np.int64))], ["start", "length", "period"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(w.count.astype(np.int64)), pa.ListArray.from_arrays(offsets, runs),
             joined(w, kept, np.searchsorted(kept, w.first)).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                  times: int = TIMES) -> DataFrame:
    """Per row: id, n_words, runs (array of start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` is the text's words with one space between, without words that a run contains
    after its first period.  ``times`` is at least 3: a run over a boundary must hold a period and a
    word more on one side of it.
    """
    if times < 3 or least < 2:
        raise ValueError("periodic_runs: at least 3 periods and 2 words")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _rows(it, least, times), f"id {kind}, n_words bigint, runs {RUNS}, collapsed string")
