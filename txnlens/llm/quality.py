"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

1. One pass over the texts gives every row a vector of document statistics.
2. Labelled rows: statistics are standardised by their mean and deviation and cut at +-4, random
   Fourier features approximate a Gaussian kernel over them.  Each partition adds up its normal
   equations, by fold; the sums are added up row by row of the matrix in Spark.
3. The driver solves the ridge systems (features x features, whatever the number of rows): one
   without each fold, for scores of labelled rows that the row itself didn't shape, and one of all.
4. Isotonic regression on the left-out scores turns a ridge score into the probability of label 1.

All labelled rows are used.  Null texts count as empty; empty texts have statistics and get a score
like any other.  Labels other than 0 and 1 and null ids are left out; of several labels for an id the
largest holds.  Without labels of both classes every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calibrate, text as tx
from .scratch import write

FEATURES, FOLDS, RIDGE, SEED, BINS = 256, 4, 1.0, 17, 400
WIDTH = 1.0              # kernel width, in units of the square root of the number of statistics
ROWS_PER_TASK = 50_000

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "mean_word", "deviation_word", "upper", "lower", "digit", "blank",
    "sentence_mark", "comma", "bar", "rare_sign", "exclaim", "beyond_ascii", "distinct_words", "top_word",
    "repeated_next", "repeated_pairs", "repeated_fives", "distinct_lines", "mean_line", "ended_lines", "short_words",
    "long_words", "signs_per_word", "caps_per_word", "marks_per_word", "compressed", "short_lines")

_CLASSES = {name: np.isin(np.arange(256), list(chars)) for name, chars in {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": b" \t\n\x0b\x0c\r",
    "sentence_mark": b".!?;:", "comma": b",", "bar": b"|", "rare_sign": b"#$%&*+/<=>@[\\]^_`{}~", "exclaim": b"!",
    "beyond_ascii": range(128, 256)}.items()}


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[first]).astype(float)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


def _groups(value: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner the number of distinct values, and how often the most frequent one occurs."""
    key = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16)))
    if not len(key):
        return np.zeros(n), np.zeros(n)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    own = (key[new] >> np.uint64(48)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, own, np.diff(np.concatenate((new, [len(key)]))))
    return np.bincount(own, minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """(n, statistics) float32 matrix of a batch of texts."""
    data, first = tx.utf8(texts)
    w = tx.words(texts)
    n = len(first) - 1
    size, words = np.diff(first).astype(float), w.count.astype(float)
    kind = {name: _sums(table[data], first) for name, table in _CLASSES.items()}
    length = (w.end - w.start).astype(float)
    mean = _share(_sums(length, w.first), words)
    spread = np.sqrt(np.maximum(_share(_sums(length * length, w.first), words) - mean ** 2, 0))
    owner = np.repeat(np.arange(n), w.count)
    distinct, top = _groups(w.hash, owner, n)
    same = np.zeros(len(w.hash), dtype=np.int64)
    if len(same):
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
    repeated = {}
    for k in (2, 5):
        value, at = tx.shingles(w, k)
        runs = np.maximum(words - k + 1, 0)
        repeated[k] = _share(runs - _groups(value, tx.text_of(w, at), n)[0], runs)
    start, end, line_of = _lines(data, first)
    filled = end > start
    start, end, line_of = start[filled], end[filled], line_of[filled]
    lines = np.bincount(line_of, minlength=n).astype(float)
    line_kinds, _ = _groups(tx.hash_ranges(data, start, end), line_of, n)
    closed = np.isin(data[end - 1], list(b".!?\"')")) if len(end) else np.zeros(0, bool)
    offsets = np.concatenate(([0], np.cumsum(lines))).astype(np.int64)
    raw = data.tobytes()
    packed = np.array([len(zlib.compress(raw[a:b], 1)) for a, b in zip(first[:-1], first[1:], strict=True)], dtype=float)
    columns = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(words), "log_lines": np.log1p(lines), "mean_word": mean,
        "deviation_word": spread, **{k: _share(v, size) for k, v in kind.items()},
        "distinct_words": _share(distinct, np.maximum(words, 1) ** 0.9), "top_word": _share(top, words),
        "repeated_next": _share(_sums(same, w.first), words), "repeated_pairs": repeated[2], "repeated_fives": repeated[5],
        "distinct_lines": _share(line_kinds, lines), "mean_line": np.log1p(_share(size, lines)),
        "ended_lines": _share(_sums(closed.astype(np.int64), offsets), lines),
        "short_words": _share(_sums((length <= 3).astype(np.int64), w.first), words),
        "long_words": _share(_sums((length >= 15).astype(np.int64), w.first), words),
        "signs_per_word": np.minimum(_share(kind["rare_sign"], words), 5), "caps_per_word": np.minimum(_share(kind["upper"], words), 10),
        "marks_per_word": np.minimum(_share(kind["sentence_mark"] + kind["comma"], words), 5),
        "compressed": _share(packed, size + 20), "short_lines": _share(_sums(((end - start) < 30).astype(np.int64), offsets), lines)}
    return np.stack([columns[s] for s in STATISTICS], axis=1).astype(np.float32)


def _lines(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every line; lines end at line feeds and at the end of a text."""
    feeds = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate((feeds, first[1:])))
    starts = np.sort(np.concatenate((feeds + 1, first[:-1])))
    return starts, ends, np.searchsorted(first[1:], ends, side="left")


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.slices(batches, "text"):
        values = statistics(batch.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * values.shape[1]),
                                         pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the document statistics, of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_statistics_of, f"doc_id {docs.schema[id_col].dataType.simpleString()}, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(float)


@dataclass
class Kernel:
    """Standardisation and random Fourier features; the last feature is constant."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray

    @classmethod
    def draw(cls, mean: np.ndarray, scale: np.ndarray, features: int, seed: int = SEED) -> Kernel:
        random = np.random.default_rng(seed)
        width = WIDTH * math.sqrt(len(mean))
        return cls(mean, scale, random.normal(size=(len(mean), features)) / width, random.uniform(0, 2 * math.pi, features))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        wave = math.sqrt(2 / len(self.phase)) * np.cos(z @ self.frequency + self.phase)
        return np.concatenate([wave, np.ones((len(x), 1))], axis=1)


@dataclass
class Model:
    kernel: Kernel | None = None
    weights: np.ndarray | None = None        # a column without each fold, and one of all rows
    steps: calibrate.Steps | None = None
    prior: float = 0.5

    def ridge(self, x: np.ndarray, fold: np.ndarray | int = -1) -> np.ndarray:
        """Ridge scores, moved into 0 to 1 as calibration wants them."""
        z = self.kernel(x)
        raw = z @ self.weights[:, -1] if isinstance(fold, int) else (z * self.weights[:, fold].T).sum(axis=1)
        return np.clip((raw + 1) / 3, 0, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.prior) if self.steps is None else np.clip(self.steps(self.ridge(x)), 0, 1)


def _equations(batches: Iterator[pa.RecordBatch], kernel: Kernel, folds: int) -> Iterator[pa.RecordBatch]:
    """(x, label, fold) -> rows (fold, row, values) of the partition's sums of z z' with z'y as last column."""
    size = len(kernel.phase) + 1
    sums = np.zeros((folds, size, size + 1))
    for batch in batches:
        z = kernel(_matrix(batch.column("x")))
        y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold"))
        for f in range(folds):
            own = z[fold == f]
            sums[f, :, :-1] += own.T @ own
            sums[f, :, -1] += own.T @ y[fold == f]
    for f in range(folds):
        if sums[f, -1, -2]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, f, np.int32)), pa.array(np.arange(size, dtype=np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * (size + 1)), pa.array(sums[f].ravel()))],
                ["fold", "row", "values"])


def _add(table: pa.Table) -> pa.Table:
    """One matrix row, added up over the partitions."""
    values = np.array(table.column("values").to_pylist()).sum(axis=0)
    return pa.table({"fold": table.column("fold")[:1], "row": table.column("row")[:1],
                     "values": pa.array([values.tolist()], pa.list_(pa.float64()))})


def fit(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", features: int = FEATURES,
        folds: int = FOLDS, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """A model from rows of ``describe`` and ``labels`` (``id_col``, 0 or 1 in ``label_col``)."""
    spark = described.sparkSession
    marked = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
              .filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).cast("int")
    rows = write(described.select("doc_id", "x").join(marked, "doc_id").select("x", "label", fold.alias("fold")), "labelled")
    sums = [f(F.col("x")[i]) for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]
    first = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0)), *sums).first()
    n, ones = first[0], first[1]
    if not 0 < ones < n:
        return Model(prior=ones / n if n else 0.5)
    mean, scale = np.array(first[2::2], dtype=float), np.array(first[3::2], dtype=float)
    kernel = Kernel.draw(mean, np.where(scale > 1e-9, scale, 1.0), features, seed)
    spread = rows.repartition(max(1, -(-n // ROWS_PER_TASK)))
    added = (spread.mapInArrow(lambda it: _equations(it, kernel, folds), "fold int, row int, values array<double>")
             .groupBy("fold", "row").applyInArrow(_add, "fold int, row int, values array<double>"))
    size = features + 1
    total = np.zeros((folds, size, size + 1))
    for r in added.collect():                # folds * (features + 1) rows
        total[r["fold"], r["row"]] = r["values"]
    whole = total.sum(axis=0)
    penalty = ridge * np.eye(size)
    penalty[-1, -1] = 1e-6
    weights = np.stack([np.linalg.solve(m[:, :-1] + penalty, m[:, -1]) for m in (*(whole - t for t in total), whole)], axis=1)
    model = Model(kernel, weights, None, ones / n)
    sent = spark.sparkContext.broadcast(model)

    def left_out(batches):
        for batch in batches:
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.ridge(_matrix(batch.column("x")), fold)), batch.column("label"),
                                              pa.array(np.ones(batch.num_rows))], ["x", "label", "weight"])

    model.steps = calibrate.isotonic(*calibrate.binned(rows.mapInArrow(left_out, "x double, label int, weight double"), BINS))
    return model


def score(described: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row of ``describe``."""
    sent = described.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            value = sent.value.score(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value),
                                              pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = described.schema["doc_id"].dataType.simpleString()
    return described.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
