"""Text Column functions, all native Spark expressions (no Python UDF).

Java regex ``\\w``/``\\s``/``\\d`` are ASCII-only, so the Unicode classes are
spelled out: ``W`` is a word character, ``S`` a blank (the same set Python's
``str`` regex treats as ``\\s``).  The same spellings run in RE2.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema

# Regex character classes (Java syntax; also valid RE2).
W_CHARS = r"\p{L}\p{N}_"
S_CHARS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}"
W = f"[{W_CHARS}]"
S = f"[{S_CHARS}]"

_TITLE_MARK = "\u0001 "


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def regex_quote(word: str) -> str:
    """Escape regex metacharacters so a keyword matches literally (Java and RE2)."""
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", word)


def collapse_blanks(col: Column | str) -> Column:
    """Every run of blanks (Unicode) becomes one ASCII space."""
    return F.regexp_replace(_c(col), f"{S}+", " ")


def strip_blanks(col: Column | str) -> Column:
    """Python ``str.strip()``: Unicode blanks removed at both ends (``trim`` only removes spaces)."""
    return F.regexp_replace(_c(col), f"^{S}+|{S}+$", "")


def title_case(col: Column | str) -> Column:
    """Python ``str.title()``: a letter is upper-cased when the character before
    it is not a cased letter ("7eleven" -> "7Eleven", "o'neil" -> "O'Neil").
    ``initcap`` only starts words after a space, so a marker space is put
    after every other non-cased character that precedes a letter, and removed."""
    marked = F.regexp_replace(_c(col), r"([^\p{Lu}\p{Ll}\p{Lt} ])(?=\p{L})", "$1" + _TITLE_MARK)
    return F.replace(F.initcap(marked), F.lit(_TITLE_MARK), F.lit(""))


def clean_description(col: Column | str = "description") -> Column:
    """lower -> non word/blank chars to blank -> blank runs to one -> trim.

    Both replacement steps fold into one: every run of non-word characters
    (blanks and punctuation alike) becomes a single space.
    """
    return F.trim(F.regexp_replace(F.lower(_c(col)), f"[^{W_CHARS}]+", " "))


def merchant_pattern(prefixes: Sequence[str] = schema.MERCHANT_PREFIXES,
                     stops: Sequence[str] = schema.MERCHANT_STOPS) -> str:
    alt = "|".join(regex_quote(p) for p in prefixes)
    stop = "|".join(f"{S}+{regex_quote(s)}" for s in stops)
    return f"(?id)(?:{alt}){S}+([a-z{S_CHARS}&]+?)(?:{stop}|$)"


def merchant_parts(col: Column | str = "description_clean",
                   prefixes: Sequence[str] = schema.MERCHANT_PREFIXES,
                   stops: Sequence[str] = schema.MERCHANT_STOPS) -> tuple[Column, Column]:
    """The two costly pieces of the merchant rule, each evaluated once per row:
    the group of the leftmost prefix match ("" when none: the group is never
    empty in a match) and the description's words (``str.split()``)."""
    d = _c(col)
    first = F.regexp_extract(d, merchant_pattern(prefixes, stops), 1)
    words = F.split(collapse_blanks(strip_blanks(d)), " ")  # str.split(): runs of any blank
    return first, words


def merchant_from_parts(d: Column, first: Column, words: Column,
                        generic: Sequence[str] = schema.MERCHANT_GENERIC,
                        unknown: str = schema.MERCHANT_UNKNOWN) -> Column:
    found = strip_blanks(first)
    # pick the text first, title-case once (one copy of the title-case code)
    pick = (F.when((first != "") & ~found.isin(*generic), found)
            .when((F.size(words) > 1) & F.get(words, 0).isin("to", "from"), F.get(words, 1))
            .otherwise(F.array_join(F.slice(words, 1, 2), " ")))
    rule = F.when(d.isNull(), F.lit(unknown)).otherwise(title_case(pick))
    # never null by contract; saying so lets Catalyst drop inferred
    # ``isnotnull(merchant)`` filters on joins (which would re-run the rule)
    return F.coalesce(rule, F.lit(unknown))


def extract_merchant(col: Column | str = "description_clean",
                     prefixes: Sequence[str] = schema.MERCHANT_PREFIXES,
                     stops: Sequence[str] = schema.MERCHANT_STOPS,
                     generic: Sequence[str] = schema.MERCHANT_GENERIC,
                     unknown: str = schema.MERCHANT_UNKNOWN) -> Column:
    """Merchant from a cleaned description.

    Leftmost ``<prefix> <letters and blanks>`` ending before a stop word or the
    end, title-cased unless generic; else the word after a leading to/from;
    else the first two words.  Substring semantics (no word boundaries) are kept.
    As one expression; ``clean.with_merchant`` stages the parts as columns so
    each regex runs once per row.
    """
    d = _c(col)
    first, words = merchant_parts(d, prefixes, stops)
    return merchant_from_parts(d, first, words, generic, unknown)


def categorize(col: Column | str = "description_clean",
               vocabulary: Sequence[tuple[str, Sequence[str]]] = schema.CATEGORY_KEYWORDS,
               default: str = schema.DEFAULT_CATEGORY) -> Column:
    """Keyword category; the *last* matching group wins (so the CASE is reversed).

    Keywords are literals matched case-insensitively as substrings: plain
    ``contains`` on the lower-cased text, no regex engine per row.
    """
    d = F.lower(_c(col))
    expr = None
    for category, keywords in reversed(list(vocabulary)):
        cond = None
        for k in keywords:
            c = d.contains(k.lower())
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(category)) if expr is None else expr.when(cond, F.lit(category))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def clean_text(col: Column | str) -> Column:
    """Collapse blanks and trim; anything but word, blank, ``- . , :`` to blank; trim."""
    collapsed = F.trim(collapse_blanks(col))
    return F.trim(F.regexp_replace(collapsed, f"[^{W_CHARS}{S_CHARS}\\-\\.,:]", " "))


NUMBER_PATTERN = r"[0-9]+\.?[0-9]*"


def extract_numbers(col: Column | str) -> Column:
    """All ``digits[.digits]`` runs as an array of doubles."""
    return F.transform(F.regexp_extract_all(_c(col), F.lit(NUMBER_PATTERN), 0), lambda x: x.cast("double"))


def cut_text(col: Column | str, n: int, ellipsis: str = "") -> Column:
    out = F.substring(_c(col), 1, n)
    return F.concat(out, F.lit(ellipsis)) if ellipsis else out
