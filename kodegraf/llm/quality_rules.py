"""Quality rules as a short-circuit cascade.

Each rule is a cheap test of one text; the two base rules (too few words, too
many repeated ones) are rules like the others. On a bounded sample the cascade
is put in order step by step: of the rules left, the one with the most
rejections per second comes next, both taken over the texts that all rules
before let pass and priced at what the rule costs on top of the measurements
already made for these texts. Rules then run in this order and stop at the
first that rejects. The verdict is the conjunction of all rules, so it does not
depend on the order: only the time does.

accepted() filters by the whole cascade, and a text that an early rule rejects
is not measured further. The report of quality_rules() states the base
measurements of every text: there these are paid for beforehand, the order
counts them as free, and only what is left is saved.

Edge cases: null and empty texts have no words, fail the base rule and are not
kept. Texts of any length are read whole. Repeated rows get a row each. An empty
table gives no rows; the order of rules is then the listed one.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from copy import copy
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kodegraf.llm.common import U, map_texts, mix64, sampled, texts_of

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows on which cost and selectivity are estimated; they decide the order of rules only.
SAMPLE_ROWS = 256
SAMPLE_CHARS = 65_536


def covered_words(ids: np.ndarray, k: int = WINDOW) -> int:
    """Words inside windows of k words that occur twice or more, the first included."""
    n = len(ids)
    if n <= k:
        return 0
    key = mix64(ids.astype(U) + U(0x9E3779B97F4A7C15))
    h = np.zeros(n - k + 1, U)
    for j in range(k):
        h = h * U(0x100000001B3) + key[j : j + n - k + 1]
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice))
    rows = np.lib.stride_tricks.sliding_window_view(ids, k)[at]
    _, group, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    at = at[count[group.reshape(-1)] > 1]
    edge = np.zeros(n + 1, np.int32)
    edge[at] += 1
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


class Text:
    """One text with measurements that are made when first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.raw = text.encode("utf-8", "surrogatepass")
        self.words = self.raw.split()  # bytes.split() cuts at exactly these six characters

    @cached_property
    def n_words(self):
        return len(self.words)

    @cached_property
    def word_chars(self):
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self):
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self):
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self):
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def ids(self):
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(w, len(seen)) for w in self.words], np.int64)

    @cached_property
    def n_repeat_words(self):
        return covered_words(self.ids)

    @cached_property
    def n_upper(self):
        return len(self.raw) - len(self.raw.translate(None, bytes(range(65, 91))))

    @cached_property
    def n_lower(self):
        return len(self.raw) - len(self.raw.translate(None, bytes(range(97, 123))))

    @cached_property
    def n_letters(self):
        """ASCII letters and all characters beyond ASCII."""
        ascii_bytes = len(self.raw) - len(self.raw.translate(None, bytes(range(128))))
        return self.n_upper + self.n_lower + len(self.text) - ascii_bytes

    @cached_property
    def top_word(self):
        return int(np.bincount(self.ids).max()) if self.words else 0

    @cached_property
    def n_same_as_last(self):
        return int((self.ids[1:] == self.ids[:-1]).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: Measurements that the report states of every text, and the base rules over them.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 20),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
)
RULES = (
    Rule("symbols", lambda t: 100 * t.n_symbols > 20 * t.n_words),
    Rule("short_words", lambda t: t.word_chars < 2 * t.n_words),
    Rule("long_words", lambda t: t.word_chars > 15 * t.n_words),
    Rule("few_letters", lambda t: 100 * t.n_letters < 60 * t.word_chars),
    Rule("shouting", lambda t: 100 * t.n_upper > 50 * (t.n_upper + t.n_lower)),
    Rule("dup_lines", lambda t: 100 * t.n_dup_lines > 30 * len(t.lines)),
    Rule("top_word", lambda t: 100 * t.top_word > 30 * t.n_words),
    Rule("stutter", lambda t: 100 * t.n_same_as_last > 30 * t.n_words),
)


def base_failed(t: Text) -> bool:
    return any(r.rejects(t) for r in BASE_RULES)


def cascade_order(texts: list[str], rules: tuple[Rule, ...] = RULES, paid: tuple[str, ...] = ()) -> list[str]:
    """Names of the rules, next always the one with the most rejections per second among the texts that are left."""
    alive, left, order = [Text(x) for x in texts], list(rules), []
    for t in alive:
        for name in paid:
            getattr(t, name)
    while left:
        rated = []
        for i, rule in enumerate(left):
            fresh = [copy(t) for t in alive]  # with the measurements made so far
            began = time.perf_counter()
            rejected = sum(map(rule.rejects, fresh))
            cost = (time.perf_counter() - began) / max(1, len(fresh)) + 1e-9
            rated.append((-(rejected + 0.5) / (len(fresh) + 1) / cost if fresh else 0.0, i))
        best = left.pop(min(rated)[1])
        order.append(best.name)
        alive = [t for t in alive if not best.rejects(t)]
    return order


def first_rejection(t: Text, ordered: list[Rule]) -> str | None:
    return next((r.name for r in ordered if r.rejects(t)), None)


def _sampled(docs: DataFrame) -> list[str]:
    fair = docs.where(F.length("text") <= SAMPLE_CHARS)
    return [r.text for r in sampled(fair, SAMPLE_ROWS, ["text"]).collect()]


def _sorted(rules: tuple[Rule, ...], order: list[str]) -> list[Rule]:
    return sorted(rules, key=lambda r: order.index(r.name))


def quality_rules(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    order = order or cascade_order(_sampled(docs), RULES, MEASURES)

    def make():
        ordered = _sorted(RULES, order)

        def run(batch):
            out: dict[str, list] = {k: [] for k in (*MEASURES, "base_failed", "kept")}
            for text in texts_of(batch):
                t = Text(text)
                bad = base_failed(t)
                for k in MEASURES:
                    out[k].append(getattr(t, k))
                out["base_failed"].append(bad)
                out["kept"].append(not bad and first_rejection(t, ordered) is None)
            return out | {"doc_id": batch.column("doc_id")}

        return run

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return map_texts(docs, make, schema, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")])


def accepted(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows of docs that no rule rejects, all columns as they were; texts are measured only as far as the cascade asks."""
    rules = BASE_RULES + RULES
    order = order or cascade_order(_sampled(docs), rules)

    @F.pandas_udf("boolean")
    def good(texts):
        ordered = _sorted(BASE_RULES + RULES, order)
        return pd.Series([first_rejection(Text(t or ""), ordered) is None for t in texts], dtype=bool)

    return docs.where(good(F.col("text").cast("string")))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), win AS (
  SELECT r, i, array_to_string(ws[i:i+7], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 9)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY r
), ln AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), top AS (
  SELECT r, max(c) AS top_word FROM (SELECT r, x, count(*) AS c FROM (SELECT r, unnest(ws) AS x FROM w) GROUP BY r, x) GROUP BY r
), st AS (
  SELECT r, count(*) AS n_same FROM (SELECT r, ws, unnest(range(2, len(ws) + 1)) AS i FROM w) WHERE ws[i] = ws[i-1] GROUP BY r
), f AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower,
    length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS n_beyond,
    coalesce(n_lines, 0) AS n_lines, coalesce(top_word, 0) AS top_word, coalesce(n_same, 0) AS n_same
  FROM w LEFT JOIN cov USING (r) LEFT JOIN ln USING (r) LEFT JOIN top USING (r) LEFT JOIN st USING (r)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (
    100 * n_symbols > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * (n_upper + n_lower + n_beyond) < 60 * word_chars
    OR 100 * n_upper > 50 * (n_upper + n_lower)
    OR 100 * n_dup_lines > 30 * n_lines OR 100 * top_word > 30 * n_words OR 100 * n_same > 30 * n_words) AS kept
FROM b
"""
