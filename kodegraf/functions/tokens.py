"""Tokens of identifiers and queries, as column expressions and for literals on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query, and words that make it a question. Words that are code terms too (get, set, has, all, if, ...) are none of them.
STOP_WORDS = (
    "a an the of to in on at by for with from as is are was were be do does did how what where when why who which "
    "i my me it its this that and or can could would should will shall there"
).split()
QUESTION_WORDS = "how what where when why who which".split()
FIELD = r"[\p{L}\p{Nd}_]+"
#: Between lower case or digit and upper case, before the last capital of an acronym, between letters and digits, and at separators.
BOUNDARY = r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{Nd})(?=\p{L})|(?<=\p{L})(?=\p{Nd})|[^\p{L}\p{Nd}]+"


def fields(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.transform(F.regexp_extract_all(text, F.lit(FIELD), F.lit(0)), F.lower)


def split_identifier(text: Column) -> Column:
    """Lower-case parts of identifiers: parseHTML5 gives parse, html, 5."""
    return F.filter(F.transform(F.split(text, BOUNDARY), F.lower), lambda t: t != "")


def without_stop_words(tokens: Column) -> Column:
    """Tokens that are no stop words, repeats kept; all tokens if nothing else is left."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    kept = F.filter(tokens, lambda t: ~F.array_contains(stop, t))
    return F.when(F.size(kept) == 0, tokens).otherwise(kept)


def whole_word(term: Column) -> Column:
    """Short ASCII terms match whole words only; others match as prefixes."""
    return (F.length(term) < 4) & ~term.rlike(r"[^\x00-\x7F]")


def term_matches(token: Column, term: Column) -> Column:
    return F.when(whole_word(term), token == term).otherwise(F.startswith(token, term))


# --- the same for a query on the driver ---------------------------------------------

_FIELD = re.compile(r"[^\W]+")
_SPLIT = re.compile(r"(?<=[a-zß-öø-ÿ0-9])(?=[A-ZÀ-ÖØ-Þ])|(?<=[A-ZÀ-ÖØ-Þ])(?=[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])|(?<=\d)(?=[^\W\d_])|(?<=[^\W\d_])(?=\d)|[\W_]+")


def query_fields(text: str) -> list[str]:
    return [t.lower() for t in _FIELD.findall(text)]


def query_parts(text: str) -> list[str]:
    return [t.lower() for t in _SPLIT.split(text) if t]


def query_terms(text: str) -> list[str]:
    """Meaningful terms of a query, in order, once each."""
    tokens = query_fields(text)
    kept = [t for t in tokens if t not in STOP_WORDS] or tokens
    return list(dict.fromkeys(kept))


def query_words(text: str) -> list[str]:
    """Whole tokens of a query, as segments of a path are cut: underscores part them."""
    return [t.lower() for t in re.findall(r"[^\W_]+", text)]


def is_question(text: str) -> bool:
    """A natural question: a question word and two meaningful terms, or more than three meaningful terms."""
    tokens = query_fields(text)
    n = len([t for t in tokens if t not in STOP_WORDS] or tokens)
    return n > 3 or (n >= 2 and any(t in QUESTION_WORDS for t in tokens))


def matches_by_prefix(term: str) -> bool:
    return len(term) >= 4 or not term.isascii()


def fetch_limit(limit: int, offset: int = 0) -> tuple[int, int]:
    """(rows of the pool, rows of a block): a pool of whole blocks that covers the page, at most 500 rows."""
    block = min(max(5 * limit, 50), 500)
    want = max(1, -(-(offset + limit) // block)) * block
    return min(want, max(block, 500 // block * block)), block
