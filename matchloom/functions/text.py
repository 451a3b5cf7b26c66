"""Text as column expressions: documentation to tokens, delimited lists, ids."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.lexicon import NOUN_RULES, STOP_WORDS

TOKEN = r"[\p{L}\p{N}_]+"


def doc_text(columns: Iterable[str | Column], null_token: str = "nan") -> Column:
    """Documentation columns joined by a space; a null becomes `null_token` ('nan' for parity, '' for clean text)."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit(null_token)) for c in cols])


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def ascii_only(tokens: Column) -> Column:
    """Tokens without any non-ASCII character; others are dropped whole."""
    return F.filter(tokens, lambda t: F.octet_length(t) == F.length(t))


def drop_stop_words(tokens: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Tokens that are no stop words, repeats kept; all tokens if nothing else would be left."""
    words = list(stop_words)
    kept = F.filter(tokens, lambda t: ~t.isin(words))  # a hash set in the JVM
    return F.when(F.size(kept) == 0, tokens).otherwise(kept)


def clean_tokens(text: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    return drop_stop_words(ascii_only(tokenize(text)), stop_words)


def lemma_candidates(word: Column) -> Column:
    """What the noun rules can make of a word, in rule order, the word itself last; repeats are possible."""
    forms = [F.when(word.endswith(end), F.concat(F.substring(word, F.lit(1), F.length(word) - F.lit(len(end))), F.lit(new))) for end, new in NOUN_RULES]
    return F.filter(F.array(*forms, word), lambda x: x.isNotNull() & (x != ""))


def listed(list_text: Column, item: Column, sep: str = "; ") -> Column:
    """Whether a delimited list holds an item, compared exactly."""
    return F.array_contains(F.split(list_text, sep), item)


def exploded(list_text: Column, sep: str = "; ") -> Column:
    return F.explode(F.split(list_text, sep))


def char_overlap(a: Column, b: Column) -> Column:
    """Number of distinct characters that two texts share."""
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    return F.size(F.array_intersect(chars(a), chars(b)))


def id_concat(*parts: str | Column, null: str | None = None, sep: str = ".") -> Column:
    """Id from parts. A null part gives null, or with `null` that text in its place."""
    cols = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    if null is not None:
        cols = [F.coalesce(c, F.lit(null)) for c in cols]
    joined = [x for c in cols for x in (F.lit(sep), c)][1:]
    return F.concat(*joined)


def replaced(text: Column, pattern: str, by: str) -> Column:
    """Every match of a pattern replaced; `$1` in `by` is its first group."""
    return F.regexp_replace(text, pattern, by)


def extracted(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match of a pattern; null without a match."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def pattern_renamed(names: Iterable[str], pattern: str, by: str) -> list[str]:
    """Names with every match of a pattern replaced (`\\1`: its first group); equal results are an error."""
    out = [re.sub(pattern, by, n) for n in names]
    if len(set(out)) < len(out):
        raise ValueError(f"names are not distinct any more: {out}")
    return out


def suffix_renamed(names: Iterable[str], old: str = "_1", new: str = "_2") -> list[str]:
    """Names with an ending replaced; names without it stay."""
    return [n[: -len(old)] + new if n.endswith(old) else n for n in names]
