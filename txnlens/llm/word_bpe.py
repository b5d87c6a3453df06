"""Ids of an end-of-word BPE file of the ``tokenizers`` library: numpy cuts the words, ``tiktoken`` merges them.

Only for files of one form: NFC, blanks to spaces and lower case; words by ``PATTERN``, byte by byte; merges with
an end-of-word suffix.  A newline behind each word stands for the suffix: joining it to the word's last byte comes
before all merges.  ``tiktoken`` joins neighbours by their joined bytes, the file by their pair.  Both are the same where
each token comes of one merge, its parts come of earlier ones, and its own symbols merge to it: up to a token's rank
what lies between its ends merges as it does alone, so only the token's own pair can stand there.

Chunks with other characters or long words are left to the library.
"""

from __future__ import annotations

import unicodedata

import numpy as np

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS = [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
         {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
# Latin, Greek, Cyrillic and general punctuation without marks: no two such characters compose
KNOWN = [*range(0x530), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]
LIMIT = 0x2060
LONGEST = 100            # characters of a word merged here: the work grows with their square
ODD, LETTER, DIGIT, SIGN, END = range(5)


def _bytes_of_symbols() -> dict[str, int]:
    """The character that stands for each byte in the file, and its byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def merges_agree(merges: list[tuple[str, str]], suffix: str) -> bool:
    """Whether merging by joined tokens is merging by pairs."""
    rank, pairs = {a + b: i for i, (a, b) in enumerate(merges)}, {m: i for i, m in enumerate(merges)}
    if len(rank) < len(merges) or any(max(rank.get(a, -1), rank.get(b, -1)) >= i for i, (a, b) in enumerate(merges)):
        return False
    none = len(merges)
    for token in rank:
        body = token.removesuffix(suffix)
        symbols = [*body] if body == token else [*body[:-1], body[-1:] + suffix]
        while len(symbols) > 1:
            ranks = [pairs.get(x, none) for x in zip(symbols, symbols[1:])]
            least = min(ranks)
            if least == none:
                return False
            i = ranks.index(least)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
    return True


class WordBpe:
    """Ids of chunks of text that hold no blank."""

    @classmethod
    def of(cls, file: dict, tokenizer) -> WordBpe | None:
        """For a file's content and its tokenizer, if the file is of the form."""
        model, split = file["model"], file["pre_tokenizer"] or {}
        normal = file["normalizer"] or {}
        if (model.get("type") != "BPE" or not model.get("end_of_word_suffix") or model.get("continuing_subword_prefix")
                or model.get("dropout") or model.get("ignore_merges")
                or normal.get("normalizers") != NORMAL or split.get("pretokenizers") != WORDS):
            return None
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        suffix, vocabulary, byte = model["end_of_word_suffix"], model["vocab"], _bytes_of_symbols()
        if not all(c in vocabulary and c + suffix in vocabulary for c in byte) or not merges_agree(merges, suffix):
            return None
        return cls(merges, vocabulary, suffix, tokenizer)

    def __init__(self, merges: list[tuple[str, str]], vocabulary: dict[str, int], suffix: str, tokenizer):
        import tiktoken

        byte = _bytes_of_symbols()
        ranks, ids = {}, np.zeros(512 + len(merges), np.uint32)
        self.ends = np.zeros(len(ids), bool)
        tokens = [*(c + suffix for c in byte), *byte, *(a + b for a, b in merges)]
        for i, token in enumerate(tokens):           # the bytes at a word's end come first, so that they are made first
            body = token.removesuffix(suffix)
            joined = bytes(byte[c] for c in body)
            if b"\n" not in joined:                  # no word holds one
                self.ends[i] = body != token
                ranks[joined + b"\n" * (body != token)] = i
                ids[i] = vocabulary[token]
        self.ids = ids
        self.core = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={"\n\n": len(ids)})
        self.lower, self.kind = np.zeros(LIMIT + 1, np.uint32), np.full(LIMIT + 1, ODD, np.uint8)
        for c in KNOWN:
            self._learn(chr(c), tokenizer)
        self.lower[10], self.kind[10] = 10, END

    def _learn(self, c: str, tokenizer) -> None:
        """How the tokenizer takes a character: its lower case and its part in words."""
        low = tokenizer.normalizer.normalize_str(c)
        if len(low) != 1 or ord(low) >= LIMIT or low == " " or unicodedata.category(c)[0] == "M":
            return
        words = [len(tokenizer.pre_tokenizer.pre_tokenize_str(x)) for x in ("a" + low, "!" + low, low + low)]
        kind = {(1, 2, 1): LETTER, (2, 2, 2): DIGIT, (2, 1, 1): SIGN}.get(tuple(words))
        if kind is not None:
            self.lower[ord(c)], self.kind[ord(c)] = ord(low), kind

    def _cuts(self, low: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """True where a word begins within a chunk."""
        cut = np.zeros(len(low), bool)
        cut[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) & (kind[1:] != END) & (kind[:-1] != END)
        # 's, 't, 'm, 'd, 're, 've and 'll, unless the sign is in a run of signs; every chunk has its end behind it
        at = np.flatnonzero(low == ord("'"))
        at = at[(at == 0) | (kind[at - 1] != SIGN)]
        x, y = low[at + 1], low[np.minimum(at + 2, len(low) - 1)]
        size = np.isin(x, [ord(c) for c in "stmd"]).astype(np.int64)
        for a, b in ("re", "ve", "ll"):
            size[(x == ord(a)) & (y == ord(b))] = 2
        at, size = at[size > 0], size[size > 0]
        cut[at + 1] = False
        cut[at + 1 + size] = kind[at + 1 + size] != END
        return cut

    def __call__(self, chunks: list[str], skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, their number for each, and the chunks left out: odd ones and those in ``skip``."""
        code = np.frombuffer("\n".join([*chunks, ""]).encode("utf-32-le"), "<u4")
        known = np.minimum(code, LIMIT)
        low, kind = self.lower[known], self.kind[known]
        stop = np.flatnonzero(kind == END)
        cut = self._cuts(low, kind)
        first = np.sort(np.concatenate((np.flatnonzero(cut), [0], stop[:-1] + 1)))       # of each word
        long = np.diff(np.append(first, len(low))) > LONGEST
        out = skip | (np.diff(stop, prepend=-1) == 1)                                   # empty chunks are left out too
        out[np.searchsorted(stop, np.concatenate((np.flatnonzero(kind == ODD), first[long])))] = True
        size = np.zeros(len(chunks), np.int64)
        if out.all():
            return np.zeros(0, np.uint32), size, out
        held = np.repeat(~out, np.diff(stop, prepend=-1))
        low, cut = low[held], cut[held]
        text = np.full(len(low) + int(cut.sum()), 10, "<u4")
        text[np.arange(len(low)) + np.cumsum(cut)] = low
        found = self.core.encode_to_numpy(text.tobytes().decode("utf-32-le"), disallowed_special=())
        # a chunk's last id is that of its last word's end
        words = 1 + np.add.reduceat(cut, np.flatnonzero(np.concatenate(([True], low[:-1] == 10))), dtype=np.int64)
        size[~out] = np.diff(np.flatnonzero(self.ends[found])[np.cumsum(words) - 1], prepend=-1)
        return self.ids[found], size, out
