"""BagMinHash signatures: unbiased weighted-Jaccard sketches from hierarchical Poisson processes.

Each element owns a Poisson process over (x, weight, component).  The weight axis is cut into
dyadic levels [0, 1), [1, 2), [2, 4), ...; every level is a process of its own whose rate is the
number of components times the level's width.  An element of weight w takes all points of the
levels below w and, in the level that holds w, the points that lie below w.  Component k of the
signature is the smallest x of the points dealt to it, so two signatures agree in a component
with probability sum(min) / sum(max).  Points are generated in ascending x and only as far as
the text's signature still needs them.
"""

from __future__ import annotations

import numpy as np

from .text import mix

_U = np.uint64
STEPS = (1, 2, 2, 4, 8, 16)   # points generated at a time, while a process is still needed


def bags(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, 48-bit value) with its count, ordered by owner: owner, value, weight. Owners stay below 65,536."""
    key = np.sort((owner.astype(np.uint64) << _U(48)) | (value >> _U(16)))
    if not len(key):
        return owner[:0].astype(np.int64), key, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    weight = np.diff(np.concatenate((new, [len(key)])))
    key = key[new]
    return (key >> _U(48)).astype(np.int64), key & _U((1 << 48) - 1), weight


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0 ** -53


def _levels(owner, value, weight):
    """One process per element and level: owner, seed, level start, width, weight."""
    out = []
    level, low, high = 0, 0, 1
    while len(owner):
        seed = mix(value * _U(0x9FB21C651E98DF25) + mix(np.full(len(value), level + 1, np.uint64)))
        out.append((owner, seed, np.full(len(owner), low, np.float64), np.full(len(owner), high - low, np.float64),
                    weight.astype(np.float64)))
        level, low, high = level + 1, high, high * 2
        more = weight > low
        owner, value, weight = owner[more], value[more], weight[more]
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else None


def signatures(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, components: int) -> np.ndarray:
    """(n, components) float64 signature matrix; rows of owners without elements stay infinite.

    ``owner`` ascends; ``weight`` holds positive integers.
    """
    sig = np.full((n, components), np.inf)
    process = _levels(owner, value, weight)
    if process is None:
        return sig
    total = np.bincount(owner, weights=weight, minlength=n)
    reach = np.zeros(n)
    np.divide(np.log(components) + 2.0, total, out=reach, where=total > 0)
    open_ = total > 0
    flat = sig.ravel()
    while True:
        use = open_[process[0]]
        own, seed, low, width, most = (x[use] for x in process)
        rate = components * width
        x = np.zeros(len(own))
        done = turn = 0
        while len(own):
            step = STEPS[min(turn, len(STEPS) - 1)]
            number = np.arange(done, done + step, dtype=np.uint64)[None, :]
            word = mix(seed[:, None] + (number + _U(1)) * _U(0x9E3779B97F4A7C15))
            points = x[:, None] + np.cumsum(-np.log(_unit(word)) / rate[:, None], axis=1)
            draw = mix(word ^ _U(0x5851F42D4C957F2D))
            part = (draw % _U(components)).astype(np.int64)
            place = low[:, None] + _unit(mix(draw + _U(0x14057B7EF767814F))) * width[:, None]
            good = (points < reach[own][:, None]) & (place <= most[:, None])
            np.minimum.at(flat, (own[:, None] * components + part)[good], points[good])
            done, turn, x = done + step, turn + 1, points[:, -1]
            go = x < reach[own]
            own, seed, low, width, most, rate, x = (v[go] for v in (own, seed, low, width, most, rate, x))
        open_ = open_ & np.isinf(sig).any(axis=1)
        if not open_.any():
            return sig
        reach[open_] *= 1.5


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) int64 keys, different for different bands; equal where all rows of a band agree."""
    bits = mix(np.ascontiguousarray(sig[:, :bands * rows]).view(np.uint64)).reshape(len(sig), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
    for k in range(rows):
        key = mix(key * _U(0xD1342543DE82EF95) + bits[:, :, k])
    return key.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard of two bags, each (ascending distinct values, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum() + b[1].sum()) - common
    return common / whole if whole else 0.0
