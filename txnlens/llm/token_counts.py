"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton yields all vocabulary pieces that end at each character; dynamic
programming keeps the best score and the number of pieces up to there, never the pieces.

The rules are those of the unigram model of the ``tokenizers`` library with a Metaspace
pre-tokenizer and byte fallback, so the counts are exactly its counts:
- a blank becomes U+2581, a text that doesn't start with one gets one, and a piece never crosses
  from one word into the next;
- scores add up in double precision; of equal scores the piece that starts first wins;
- a character that is no piece by itself may also be unknown, at the lowest score less 10, and
  then counts as many tokens as it has UTF-8 bytes.

Null and empty texts have no tokens.  Counts of words are remembered up to a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import tokenizer_path
from .text import slices

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 800_000
LONGEST_KEPT = 64        # characters of a word that is remembered


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of every id of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts tokens of whole texts with one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]], cache: int = CACHE):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        pieces = {p for p, _ in vocabulary}
        held = set("".join(pieces))
        # a control character that no piece holds is unknown wherever it is: words can be cut there
        self.cuts = [c for c in "\n\t\r" if c not in held]
        self.cache: dict[str, int] = {}          # words met lately
        self.old: dict[str, int] = {}            # those before; half of the limit each
        self.limit = cache // 2

    def viterbi(self, word: str) -> int:
        """Tokens of one word, its U+2581 included."""
        ending: list[list[tuple[int, float]]] = [[] for _ in word]
        for end, match in self.automaton.iter(word):
            ending[end].append(match)
        best, tokens = [0.0], [0]
        for at, matches in enumerate(ending):
            top, count, longest = float("-inf"), 0, 0
            single = False
            for length, score in matches:
                value = best[at + 1 - length] + score
                if value > top or (value == top and length > longest):
                    top, count, longest = value, tokens[at + 1 - length] + 1, length
                if length == 1:
                    single = True
            if not single and best[at] + self.unknown > top:
                top, count = best[at] + self.unknown, tokens[at] + len(word[at].encode("utf-8", "surrogatepass"))
            best.append(top)
            tokens.append(count)
        return tokens[-1]

    def word(self, word: str) -> int:
        """Tokens of ``word`` after its U+2581; remembered if short."""
        known = self.old.get(word)
        if known is None:
            parts, extra = [SPACE + word], 0
            for c in self.cuts:
                if c in word:
                    extra += word.count(c)
                    parts = [p for x in parts for p in x.split(c)]
            known = extra + sum(self.viterbi(p) for p in parts if p)
        if len(word) <= LONGEST_KEPT:
            if len(self.cache) >= self.limit:
                self.old, self.cache = self.cache, {}
            self.cache[word] = known
        return known

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(" ", SPACE).split(SPACE)
        if not words[0]:
            words = words[1:]
        total = 0
        for w in words:
            n = self.cache.get(w)
            total += self.word(w) if n is None else n
        return total


_counters: dict[str, Counter] = {}


def counter(vocabulary: str) -> Counter:
    """The worker's counter, kept from task to task with the words it has met."""
    if vocabulary not in _counters:
        _counters[vocabulary] = Counter(read_vocabulary(tokenizer_path(vocabulary)))
    return _counters[vocabulary]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and n_bytes (UTF-8) of every row."""
    def run(batches: Iterator[pa.RecordBatch]):
        count = counter(vocabulary)
        for batch in slices(batches, "text"):
            counts = [count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(counts, dtype=np.int64)),
                                              batch.column("n_bytes")], ["doc_id", "n_tokens", "n_bytes"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, n_bytes bigint")
