"""Isotonic calibration from binned sums."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Steps:
    """A rising step function: ``value[i]`` from ``start[i]`` on, linear between block means if ``smooth``."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.value) if len(self.at) else np.full(len(x), 0.5)


def isotonic(x: np.ndarray, weight: np.ndarray, positive: np.ndarray, prior: float = 1.0) -> Steps:
    """Pool adjacent violators over bins of ascending ``x``.

    Each pooled block's value is its positive share, pulled to the overall share by ``prior`` units
    of weight, so it is never exactly 0 or 1.  Between blocks the function is linear.
    """
    total, ones = weight.sum(), positive.sum()
    share = (ones + 0.5) / (total + 1.0)
    blocks: list[list[float]] = []
    for a, w, p in zip(x, weight, positive, strict=True):
        blocks.append([a, a, w, p])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, hi, w2, p2 = blocks.pop()
            blocks[-1][1] = hi
            blocks[-1][2] += w2
            blocks[-1][3] += p2
    at, value = [], []
    for lo, hi, w, p in blocks:
        v = (p + prior * share) / (w + prior)
        for edge in (lo, hi) if hi > lo else (lo,):
            at.append(edge)
            value.append(v)
    return Steps(np.array(at, dtype=float), np.maximum.accumulate(np.array(value, dtype=float)) if value else np.zeros(0))


def binned(scored: DataFrame, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean x, weight and positive weight of ``bins`` equal bins of x in 0 to 1; columns x, label, weight."""
    rows = (scored.groupBy(F.least(F.floor(F.col("x") * bins), F.lit(bins - 1)).alias("bin"))
            .agg(F.sum(F.col("x") * F.col("weight")).alias("x"), F.sum("weight").alias("w"),
                 F.sum(F.col("weight") * F.col("label")).alias("p")).orderBy("bin").collect())    # ``bins`` rows at most
    w = np.array([r["w"] for r in rows], dtype=float)
    return np.array([r["x"] for r in rows], dtype=float) / np.maximum(w, 1e-12), w, np.array([r["p"] for r in rows], dtype=float)
