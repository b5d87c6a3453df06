"""Language identification: known words first, then ever shorter character n-grams.

Fitting counts words by language over a hash sample of about ``docs_per_language`` labelled
documents of each language (the documented bound of what is learned).  The model keeps, of each
language, its most frequent words and, from the same counts, its most frequent character n-grams
of each order, words being marked at both ends.

Scoring: a known word adds its smoothed log frequency in every language.  An unseen word adds the
mean over its n-grams of the longest order of which any is known; the order falls until one is.
A word without any known n-gram adds nothing.  The score is the softmax, over languages, of the
text's sum divided by the square root of its words, so longer texts are surer.

Null texts and texts without a letter are ``und`` with score 0; so is everything if nothing was
learned.  A text of unknown letters only gets the most frequent language and its share.  Ties go to
the language that is first by name.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import write
from .text import slices

DOCS_PER_LANGUAGE, WORDS, GRAMS, ORDERS = 2000, 30_000, 15_000, (5, 4, 3, 2, 1)
UNKNOWN = "und"
CACHE = 200_000
PART = 1 << 14           # unseen words whose n-grams are looked up together
ALPHA = 0.5
# word characters that are numbers but no letters, such as fractions, superscripts and circled digits
_NUMBERS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha())
_WORD = re.compile(rf"[^\W\d_{_NUMBERS}]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return _WORD.findall(text.lower()) if text else []


_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """By code point, whether ``_WORD`` takes it."""
    if not _letters:
        table = np.zeros(sys.maxunicode + 1, dtype=bool)
        for found in _WORD.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
            table[slice(*found.span())] = True
        _letters.append(table)
    return _letters[0]


def split_words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words of all texts, the number of each word's own among them, and the n + 1 offsets of the texts; ``words_of`` at once."""
    low = [t.lower() if t else "" for t in texts]
    edge = np.concatenate(([0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)))
    code = np.frombuffer((" ".join(low) + " ").encode("utf-32-le"), "<u4")[:edge[-1]].copy()
    inside = _is_letter()[code]
    code[~inside] = 0x20
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = np.searchsorted(np.flatnonzero(begins), edge)
    if not first[-1]:
        return [], np.zeros(0, np.int64), first
    line = code.tobytes().decode("utf-32-le").strip(" ")
    coded = pc.ascii_split_whitespace(pa.array([line], pa.large_string())).flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), first


def grams(word: str, order: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i:i + order] for i in range(len(marked) - order + 1)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in slices(batches, "text"):
        names = batch.column("lang").to_pylist()
        known = sorted(set(names))
        found, place, first = split_words(batch.column("text").to_pylist())
        own = np.repeat(np.searchsorted(known, names), np.diff(first))
        pairs, times = np.unique(own * max(1, len(found)) + place, return_counts=True)
        for i, n in zip(pairs.tolist(), times.tolist(), strict=True):
            counts.setdefault(known[i // len(found)], Counter())[found[i % len(found)]] += n
    for lang, c in counts.items():
        names = list(c)
        for i in range(0, len(names), 100_000):
            part = names[i:i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()), pa.array([c[w] for w in part], pa.int64())],
                ["lang", "word", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch], orders: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) -> (lang, size, gram, n), summed within the task."""
    counts: dict[tuple[str, int], Counter] = {}
    for batch in batches:
        r = batch.to_pydict()
        for lang, word, n in zip(r["lang"], r["word"], r["n"], strict=True):
            for order in orders:
                c = counts.setdefault((lang, order), Counter())
                for g in grams(word, order):
                    c[g] += n
    for (lang, order), c in counts.items():
        names = list(c)
        for i in range(0, len(names), 100_000):
            part = names[i:i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part), pa.string()), pa.array([order] * len(part), pa.int32()),
                 pa.array(part, pa.string()), pa.array([c[g] for g in part], pa.int64())], ["lang", "size", "gram", "n"])


@dataclass
class Model:
    """Log frequencies by language (one column each): of words, and of n-grams by order."""

    languages: list[str]
    shares: np.ndarray
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[int, dict[str, int]]
    gram_logs: dict[int, np.ndarray]

    def word_row(self, word: str) -> np.ndarray:
        return self.word_rows([word])[0]

    def word_rows(self, words: list[str]) -> np.ndarray:
        """A row for every word; unseen ones take the means of their n-grams, one order after the other for all that are left."""
        out = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        left = []
        for i, word in enumerate(words):
            at = self.words.get(word)
            if at is None:
                left.append((i, f"<{word}>"))
            else:
                out[i] = self.word_logs[at]
        for order, known in self.grams.items():
            hit, rows, size, rest, get = [], [], [], [], known.get
            for i, marked in left:
                found = [at for k in range(len(marked) - order + 1) if (at := get(marked[k:k + order])) is not None]
                if found:
                    hit.append(i)
                    rows += found
                    size.append(len(found))
                else:
                    rest.append((i, marked))
            if hit:
                rows, count = np.array(rows), np.array(size)
                begin, sums = np.cumsum(count) - count, np.zeros((len(hit), len(self.languages)), dtype=np.float32)
                for k in range(int(count.max())):           # added one by one, as a mean over a word's rows does
                    more = np.flatnonzero(count > k)
                    sums[more] += self.gram_logs[order][rows[begin[more] + k]]
                out[hit] = sums / count.astype(np.float32)[:, None]
            left = rest
        return out


class Scorer:
    """Predicts with a model; rows of unseen words met lately are kept beside the model's, up to a bound."""

    def __init__(self, model: Model, cache: int = CACHE):
        self.model, self.limit, n = model, cache, len(model.words)
        self.rows = np.zeros((n + cache, len(model.languages)), dtype=np.float32)
        self.rows[:n] = model.word_logs
        self.at = dict(model.words)

    def _learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > len(self.rows):
            self.at = dict(self.model.words)
            new = [w for w in words if w not in self.at]
        n = len(self.at)
        for i in range(0, len(new), PART):
            part = new[i:i + PART]
            self.rows[n + i:n + i + len(part)] = self.model.word_rows(part)
        self.at.update(zip(new, range(n, n + len(new)), strict=True))

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.predict([text])[0]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; the different words of all are looked up once, ``limit`` at a time."""
        model = self.model
        if not model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        found, place, first = split_words(texts)
        total = np.zeros((len(texts), len(model.languages)))
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        for i in range(0, len(found), self.limit):
            part = found[i:i + self.limit]
            self._learn(part)
            own = np.fromiter(map(self.at.__getitem__, part), np.int64, len(part))
            here = slice(None) if len(part) == len(found) else (place >= i) & (place < i + len(part))
            rows, of = own[place[here] - i], text[here]
            for k in range(total.shape[1]):
                total[:, k] += np.bincount(of, weights=self.rows[:, k][rows], minlength=len(texts))
        out = []
        for sums, n in zip(total, np.diff(first).tolist(), strict=True):
            if not n:
                out.append((UNKNOWN, 0.0))
            elif not sums.any():
                best = int(model.shares.argmax())
                out.append((model.languages[best], float(model.shares[best])))
            else:
                value = sums / np.sqrt(n)
                share = np.exp(value - value.max())
                best = int(value.argmax())
                out.append((model.languages[best], float(share[best] / share.sum())))
        return out


_scorer: list[Scorer] = []


def scorer(model: Model) -> Scorer:
    """The worker's scorer of its latest model, kept from task to task with the rows of words it has met."""
    if not _scorer or _scorer[0].model is not model:
        _scorer[:] = [Scorer(model)]
    return _scorer[0]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE,
        words: int = WORDS, n_grams: int = GRAMS, orders: tuple[int, ...] = ORDERS, alpha: float = ALPHA) -> Model:
    """A model from the rows of ``docs`` with a language and a text."""
    rows = (docs.select(F.xxhash64(id_col).alias("draw"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
            .filter("lang is not null and text is not null"))
    size = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}     # a row per language
    languages = sorted(size)
    shares = np.array([size[x] for x in languages], dtype=float)
    if not languages:
        return Model([], shares, {}, np.zeros((0, 0)), {}, {})
    part = F.lit(1.0)
    for lang, n in size.items():
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, docs_per_language / n))).otherwise(part)
    sample = rows.filter(F.pmod("draw", F.lit(1 << 20)) < part * (1 << 20)).drop("draw")
    counts = write(sample.mapInArrow(_count_words, "lang string, word string, n bigint")
                   .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    gram = (counts.mapInArrow(lambda it: _count_grams(it, orders), "lang string, size int, gram string, n bigint")
            .groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")))
    sums = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    total = np.array([sums.get(x, 0) for x in languages], dtype=float)
    known, logs = _table(counts.filter("n > 1").withColumn("size", F.lit(0)).withColumnRenamed("word", "gram"),
                         words, languages, {0: total}, alpha)
    gram = write(gram, "grams")
    by_size: dict[int, np.ndarray] = {}
    for r in gram.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect():
        by_size.setdefault(r["size"], np.zeros(len(languages)))[languages.index(r["lang"])] = r["n"]
    gram_known, gram_logs = _table(gram, n_grams, languages, by_size, alpha)
    empty = np.zeros((0, len(languages)), dtype=np.float32)
    return Model(languages, shares / shares.sum(), known.get(0, {}), logs.get(0, empty),
                 {o: gram_known[o] for o in orders if o in gram_known}, gram_logs)


def _table(counts: DataFrame, most: int, languages: list[str], total: dict[int, np.ndarray], alpha: float):
    """Log frequencies, in every language, of the most frequent entries of each language and size.

    Entries of one frequency are taken together, as long as no more than ``most`` are taken (of the highest frequency, all).
    """
    often = counts.groupBy("lang", "size", "n").agg(F.count("*").alias("entries"))
    least: dict[tuple[str, int], int] = {}
    room: dict[tuple[str, int], int] = {}
    for r in often.orderBy(F.desc("n")).collect():      # a row per frequency that occurs in the sample
        key = (r["lang"], r["size"])
        room[key] = room.get(key, most) - r["entries"]
        if room[key] >= 0 or key not in least:
            least[key] = r["n"]
    floors = counts.sparkSession.createDataFrame([(*k, n) for k, n in least.items()], "lang string, size int, least bigint")
    top = counts.join(F.broadcast(floors), ["lang", "size"]).filter("n >= least").select("size", "gram").distinct()
    rows = counts.join(F.broadcast(top), ["size", "gram"]).select("size", "gram", "lang", "n").collect()    # languages * most entries at most
    known: dict[int, dict[str, int]] = {}
    number = {x: i for i, x in enumerate(languages)}
    for r in sorted(rows, key=lambda r: (r["size"], r["gram"])):
        known.setdefault(r["size"], {}).setdefault(r["gram"], len(known[r["size"]]))
    seen = {size: np.zeros((len(k), len(languages))) for size, k in known.items()}
    for r in rows:
        seen[r["size"]][known[r["size"]][r["gram"]], number[r["lang"]]] = r["n"]
    logs = {size: np.log((c + alpha) / (total[size] + alpha * (len(c) + 1))).astype(np.float32) for size, c in seen.items()}
    return known, logs


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = scorer(sent.value)
        for batch in slices(batches, "text"):
            both = known.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([b[0] for b in both], pa.string()),
                                              pa.array([b[1] for b in both], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
