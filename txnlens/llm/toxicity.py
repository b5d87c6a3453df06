"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, with a block-max index.

Fitting
1. Labelled examples: all of them up to ``positives`` and ``negatives`` rows, beyond that a hash
   sample of about that size (the documented bound of what is learned from labels).
2. Terms: words and character n-grams inside words whose presence in an example depends on the
   label (likelihood-ratio statistic above a bound that grows with the number of terms tried, and
   odds far from the overall odds).  Equal texts count once there, so copies prove nothing.
3. Document frequencies of the terms are counted over all documents, labelled or not.
4. Examples become unit TF-IDF vectors.  The index keeps them in blocks, and for each term its
   postings by block and the largest weight in each block.
5. Each example is scored with itself left out; isotonic regression on these votes, weighted back
   to the class shares, gives the calibration.

Scoring: the block maxima bound every block's best cosine; blocks are opened by falling bound until
no block can hold a nearer example, so the neighbours are exact (ties: smaller example number).  The
vote is the similarity-weighted share of toxic neighbours, with ``SHRINK`` units of similarity
against, so 0 without any.  Evidence: the nearest
examples with their similarity and label.

Null, empty and termless texts have no neighbours and get the score of that case.  Examples with
null label or id are left out; of several labels for an id the largest holds.  Without any label of
either class all scores are the prior share (0.5 if there are no labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calibrate
from .scratch import write
from .text import slices

POSITIVES, NEGATIVES, TERMS, NEIGHBOURS, BLOCK = 4000, 8000, 4000, 15, 32
GRAMS = (4, 5, 6)
ODDS = 10.0
SHRINK = 1.0             # similarity that counts against the vote: a few far neighbours decide little
BINS = 200
EVIDENCE = 3
_BREAK = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower-case words, each between single blanks."""
    return " " + _BREAK.sub(" ", (text or "").lower()).strip() + " "


def all_terms(text: str | None) -> set[str]:
    """Whole words (between blanks) and n-grams of blank-started words."""
    out = set()
    for word in set(normal(text).split()):
        out.add(f" {word} ")
        marked = f" {word}"
        for n in GRAMS:
            out.update(marked[i:i + n] for i in range(len(marked) - n + 1))
    return out


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) -> (term, positive, negative) of the task's examples."""
    counts = (Counter(), Counter())
    for batch in slices(batches, "text"):
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            counts[label].update(all_terms(text))
    names = list(counts[0].keys() | counts[1].keys())
    for i in range(0, len(names), 100_000):
        part = names[i:i + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.string()), pa.array([counts[1][t] for t in part], pa.int64()),
             pa.array([counts[0][t] for t in part], pa.int64())], ["term", "positive", "negative"])


class Matcher:
    """Counts of the chosen terms in a text, found in one sweep by an Aho-Corasick automaton."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton() if terms else None
        for i, term in enumerate(terms):
            self.automaton.add_word(term, i)
        if terms:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> Counter:
        if not text or self.automaton is None:
            return Counter()
        return Counter(i for _, i in self.automaton.iter(normal(text)))


@dataclass
class Index:
    """Block-max inverted index of unit vectors.

    Postings of term t in block b are ``example[at[t, b]:at[t, b + 1]]`` with their weights.
    """

    size: int
    at: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    most: np.ndarray

    @classmethod
    def build(cls, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK) -> Index:
        blocks = -(-len(vectors) // block)
        term = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        example = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
        order = np.lexsort((example, term))
        term, weight, example = term[order], weight[order], example[order]
        cell = term * blocks + example // block
        at = np.searchsorted(cell, np.arange(terms * blocks + 1))
        most = np.zeros(terms * blocks)
        np.maximum.at(most, cell, weight)
        edges = np.stack([at[:-1], at[1:]], axis=1).reshape(terms, blocks, 2) if blocks else np.zeros((terms, 0, 2), int)
        return cls(len(vectors), edges, example, weight, most.reshape(terms, blocks))

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` most similar examples of positive cosine and their cosines, exactly; ties go to the smaller number."""
        if not len(term) or not self.size:
            return np.zeros(0, np.int64), np.zeros(0)
        bound = weight @ self.most[term]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        if not len(order):
            return np.zeros(0, np.int64), np.zeros(0)
        found, score, floor, i, step = [], [], 0.0, 0, 4
        while i < len(order) and bound[order[i]] >= floor - 1e-9:
            opened = order[i:i + step]
            edges = self.at[term][:, opened].reshape(-1, 2)
            n = edges[:, 1] - edges[:, 0]
            post = np.repeat(edges[:, 0] - np.cumsum(n) + n, n) + np.arange(n.sum())
            part = self.weight[post] * np.repeat(np.repeat(weight, len(opened)), n)
            who, inverse = np.unique(self.example[post], return_inverse=True)
            found.append(who)
            score.append(np.bincount(inverse, weights=part))
            i, step = i + step, step * 2
            total = np.concatenate(score)
            if len(total) > k:
                floor = np.partition(total, len(total) - k - 1)[len(total) - k - 1]    # one more than k, for ``without``
        who, total = np.concatenate(found), np.concatenate(score)
        other = who != without
        who, total = who[other], total[other]
        best = np.lexsort((who, -np.round(total, 9)))[:k]
        return who[best], total[best]


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: list = field(default_factory=list)
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    index: Index | None = None
    steps: calibrate.Steps | None = None
    prior: float = 0.5
    neighbours: int = NEIGHBOURS

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector: ascending terms and weights."""
        if not counts:
            return np.zeros(0, np.int64), np.zeros(0)
        term = np.array(sorted(counts), dtype=np.int64)
        weight = (1.0 + np.log([counts[t] for t in term.tolist()])) * self.idf[term]
        return term, weight / math.sqrt(float(weight @ weight))

    def vote(self, counts: dict[int, int], without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        who, near = self.index.nearest(*self.vector(counts), self.neighbours, without)
        return float(near @ self.labels[who] / (near.sum() + SHRINK)), who, near

    def score(self, text: str | None, matcher: Matcher, memo: dict) -> tuple[float, list[tuple]]:
        if self.steps is None:
            return self.prior, []
        counts = matcher(text)
        key = tuple(sorted(counts.items()))
        if key not in memo:
            if len(memo) >= 50_000:
                memo.clear()
            vote, who, near = self.vote(counts)
            memo[key] = (float(self.steps(np.array([vote]))[0]),
                         [(self.ids[i], float(s), int(self.labels[i])) for i, s in zip(who[:EVIDENCE].tolist(), near, strict=False)])
        return memo[key]


def select_terms(counts: DataFrame, positive: int, negative: int, most: int) -> list[str]:
    """Terms that depend on the label: G statistic above 24 + 2 ln(terms) and odds that differ ``ODDS``-fold from
    the overall odds, at most ``most``; if under 50 pass, the best 50 by G."""
    counts = write(counts, "terms")
    tried = counts.count()
    if not tried or not positive or not negative:
        return []

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    a, b = F.col("positive").cast("double"), F.col("negative").cast("double")
    share = F.lit(positive / (positive + negative))
    n, rest = a + b, F.lit(float(positive + negative)) - a - b
    g = 2 * (part(a, n * share) + part(b, n * (1 - share))
             + part(positive - a, rest * share) + part(negative - b, rest * (1 - share)))
    odds = F.abs(F.log((a + 0.5) / (b + 0.5)) - math.log(positive / negative))
    scored = counts.select("term", g.alias("g"), odds.alias("odds"))

    def best(rows: DataFrame, n: int) -> list[str]:
        return [r["term"] for r in rows.orderBy(F.desc("g"), "term").limit(n).collect()]

    good = best(scored.filter((F.col("g") > 24 + 2 * math.log(tried)) & (F.col("odds") > math.log(ODDS))), most)
    return good if len(good) >= 50 else best(scored.filter("g > 0"), 50)


def _frequencies(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    """(text) -> (term, docs) of the task, with the number of its rows at term -1."""
    matcher, total, rows = Matcher(terms), Counter(), 0
    for batch in slices(batches, "text"):
        rows += batch.num_rows
        for text in batch.column("text").to_pylist():
            total.update(matcher(text).keys())
    total[-1] = rows
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())],
                                     ["term", "docs"])


def _vectors(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) -> (id, label, terms, counts)."""
    matcher = Matcher(terms)
    for batch in slices(batches, "text"):
        counts = [matcher(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"),
             pa.array([sorted(c) for c in counts], pa.list_(pa.int64())),
             pa.array([[c[t] for t in sorted(c)] for c in counts], pa.list_(pa.int64()))], ["id", "label", "terms", "counts"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        positives: int = POSITIVES, negatives: int = NEGATIVES, terms: int = TERMS, neighbours: int = NEIGHBOURS,
        block: int = BLOCK) -> Model:
    """A model from ``labels`` (rows with ``id_col`` and 0 or 1 in ``label_col``) and the texts of ``docs``."""
    spark = docs.sparkSession
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
              .filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label")))
    total = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return Model(prior=float(next(iter(total), 0.5)))
    keep = F.lit(False)
    for label, most in ((0, negatives), (1, positives)):
        share = min(1.0, most / total[label])
        keep = keep | ((F.col("label") == label) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))))
    sample = F.broadcast(marked.filter(keep))     # about positives + negatives rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    examples = rows.join(sample, "id")
    once = examples.select("text", "label").withColumn("hash", F.xxhash64("text")).dropDuplicates(["hash", "label"])
    counts = (once.select("text", "label").mapInArrow(_count_terms, "term string, positive bigint, negative bigint")
              .groupBy("term").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
              .filter("positive + negative > 2"))
    size = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return Model(prior=total[1] / (total[0] + total[1]))
    chosen = select_terms(counts, size[1], size[0], terms)
    size = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    seen = dict(rows.select("text").mapInArrow(lambda it: _frequencies(it, chosen), "term bigint, docs bigint")
                .groupBy("term").agg(F.sum("docs").alias("docs")).collect())           # one row per chosen term
    n_docs = seen.get(-1, 0)
    idf = np.array([math.log((1 + n_docs) / (1 + seen.get(i, 0))) + 1 for i in range(len(chosen))])
    found = (examples.select("id", "label", "text")
             .mapInArrow(lambda it: _vectors(it, chosen), f"id {rows.schema['id'].dataType.simpleString()}, label int, "
                         "terms array<bigint>, counts array<bigint>").collect())       # the bounded sample
    found.sort(key=lambda r: (str(r["id"]), r["terms"], r["counts"]))
    model = Model(chosen, idf, [], np.zeros(0, np.int64), None, None, total[1] / (total[0] + total[1]), neighbours)
    vectors = [model.vector(dict(zip(r["terms"], r["counts"], strict=True))) for r in found]
    model.ids, model.labels = [r["id"] for r in found], np.array([r["label"] for r in found], dtype=np.int64)
    order = _by_likeness(vectors)
    model.ids, model.labels = [model.ids[i] for i in order], model.labels[order]
    model.index = Index.build([vectors[i] for i in order], len(chosen), block)
    weight = [total[c] / size[c] for c in (0, 1)]
    numbers = spark.createDataFrame([(i, int(found[j]["label"]), found[j]["terms"], found[j]["counts"])
                                     for i, j in enumerate(order)], "example int, label int, terms array<bigint>, counts array<bigint>")
    sent = spark.sparkContext.broadcast(model)

    def left_out(batches):
        for batch in batches:
            r = batch.to_pydict()
            votes = [sent.value.vote(dict(zip(t, c, strict=True)), e)[0]
                     for e, t, c in zip(r["example"], r["terms"], r["counts"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column("label"),
                                              pa.array([weight[x] for x in r["label"]])], ["x", "label", "weight"])

    votes = numbers.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(left_out, "x double, label int, weight double")
    model.steps = calibrate.isotonic(*calibrate.binned(votes, BINS))
    return model


def _by_likeness(vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """Order in which examples with the same heaviest terms are neighbours, so that block maxima are tight."""
    def heaviest(v):
        return tuple(v[0][np.argsort(-v[1], kind="stable")[:4]].tolist())

    return sorted(range(len(vectors)), key=lambda i: (heaviest(vectors[i]), i))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted and evidence (nearest examples) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        matcher, memo = Matcher(sent.value.terms), {}
        for batch in slices(batches, "text"):
            both = [sent.value.score(t, matcher, memo) for t in batch.column("text").to_pylist()]
            value = np.array([b[0] for b in both])
            evidence = [[{"example": e, "similarity": s, "label": y} for e, s, y in b[1]] for b in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32)),
                 pa.array(evidence, pa.list_(pa.struct([("example", batch.schema.field("doc_id").type),
                                                        ("similarity", pa.float64()), ("label", pa.int32())])))],
                ["doc_id", "score", "predicted", "evidence"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int, "
                                f"evidence array<struct<example:{kind},similarity:double,label:int>>")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        matcher, memo = Matcher(sent.value.terms), {}
        for batch in slices(batches, text_col):
            keep = [sent.value.score(t, matcher, memo)[0] < 0.5 for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
