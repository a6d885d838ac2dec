"""Retrieval: postings, boolean prefix match, BM25, rerank, evidence, paging."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kodegraf.functions import tokens as tk
from kodegraf.schema import IDENTITY

K1, B = 1.2, 0.75
HITS_OF_A_PAGE = 50


# What people call the languages of file extensions.
LANGUAGE_NAMES = {"py": "python", "ts": "typescript", "rb": "ruby", "js": "javascript", "rs": "rust", "kt": "kotlin", "luau": "lua"}


def said(tags: DataFrame) -> DataFrame:
    """node_id, said: summary, context and the values of the tags of a node, in order, from (node_id, summary, context, kind, value, position)."""
    texts = F.array_sort(F.collect_list(F.struct("position", "value")))
    parts = F.concat(F.array(F.first("summary"), F.first("context")), F.transform(texts, lambda t: t["value"]))
    return tags.groupBy("node_id").agg(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ").alias("said"))


def document_text(nodes: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """namespace, node_id, content: name, qualified name, kind, their distinct parts, parts of the file's name with its language, and what annotations (node_id, said) say."""
    base = F.lower(F.regexp_extract("file_path", r"([^/]*)$", 1))
    parts = F.array_distinct(F.concat(tk.split_identifier(F.col("name")), tk.split_identifier(F.col("qualified_name"))))
    cut = F.split(base, "[.]")
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    alias = F.when(F.size(cut) > 1, F.try_element_at(names, F.element_at(cut, -1)))
    file = F.concat_ws(" ", F.filter(cut, lambda x: x != ""), alias)
    text = [F.col("name"), F.col("qualified_name"), F.col("kind"), F.array_join(parts, " "), file]
    rows = nodes
    if annotations is not None:
        rows = nodes.join(annotations.select("node_id", "said"), "node_id", "left")
        text.append(F.coalesce("said", F.lit("")))
    return rows.select("namespace", "node_id", F.trim(F.concat_ws(" ", *text)).alias("content"))


def reason_rows(tags: DataFrame) -> DataFrame:
    """namespace, node_id, content: the first intent and every domain rule of a node, trimmed; blank ones drop, though a blank first intent uses up its place."""
    first = Window.partitionBy("namespace", "node_id", "kind").orderBy("ordinal")
    rows = tags.where(F.col("kind").isin("intent", "domainRule")).withColumn("rn", F.row_number().over(first)).where((F.col("kind") == "domainRule") | (F.col("rn") == 1))
    return rows.select("namespace", "node_id", F.trim("value").alias("content")).where("content <> ''")


def postings(docs: DataFrame, doc_key: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """namespace, doc_key, token, tf, len: how often a document holds a token, and its number of tokens. One pass over the documents."""
    toks = docs.select("namespace", *doc_key, tk.fields(F.col("content")).alias("t"))
    each = toks.select("namespace", *doc_key, F.size("t").cast("long").alias("len"), F.explode("t").alias("token"))
    return each.groupBy("namespace", *doc_key, "token", "len").agg(F.count("*").alias("tf"))


def corpus(docs: DataFrame) -> DataFrame:
    """namespace, corpus: the number of documents."""
    return docs.groupBy("namespace").agg(F.count("*").alias("corpus"))


def _begins(column: str, prefixes: list[str]) -> Column:
    """Whether the column begins with one of the prefixes: comparisons that a scan can prune by."""
    return reduce(Column.__or__, (F.startswith(F.col(column), F.lit(p)) for p in prefixes))


def strict_match(index: DataFrame, query: str) -> DataFrame:
    """namespace, node_id of the documents that every term of the query matches, from postings.

    A term matches if a token begins with it, or if its parts each begin a
    token. A query without a term matches nothing.
    """
    groups = [(t.lower(), tk.query_parts(t)) for t in query.split() if tk.query_fields(t)]
    groups = [(f, p) for t, p in groups for f in ([t] if tk.query_fields(t) == [t] else tk.query_fields(t))]
    if not groups:
        return index.select("namespace", "node_id").limit(0)
    prefixes = list(dict.fromkeys(x for t, p in groups for x in (t, *p)))
    held = index.where(_begins("token", prefixes)).groupBy("namespace", "node_id").agg(*[F.bool_or(F.startswith("token", F.lit(x))).alias(f"__{i}") for i, x in enumerate(prefixes)])
    has = lambda x: F.col(f"__{prefixes.index(x)}")
    group = lambda t, p: has(t) | reduce(Column.__and__, map(has, p)) if p else has(t)
    return held.where(reduce(Column.__and__, (group(t, p) for t, p in groups))).select("namespace", "node_id")


def _term_hits(index: DataFrame, terms: list[str]) -> DataFrame:
    """The postings of tokens that match a term, with the term, a row for each."""
    want = F.array(*[F.when(F.startswith("token", F.lit(t)) if tk.matches_by_prefix(t) else F.col("token") == t, F.lit(t)) for t in terms])
    near = reduce(Column.__or__, (F.startswith("token", F.lit(t)) if tk.matches_by_prefix(t) else F.col("token") == t for t in terms))
    return index.where(near).withColumn("term", F.explode(F.array_compact(want)))


def bm25(index: DataFrame, terms: list[str], sizes: DataFrame, doc_key: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """namespace, node_id, score, n_terms of nodes that match any term, from postings and corpus sizes.

    Average length and document frequencies are those of the matched documents;
    the corpus size is that of all documents of the namespace. A node's credit
    for a term is the largest over its documents. Only the postings of the
    terms are read.
    """
    if not terms:
        return index.select("namespace", "node_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_terms")).limit(0)
    keys = list(dict.fromkeys(["namespace", *doc_key, "node_id"]))
    one = _term_hits(index, terms).groupBy(*keys, "term").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))
    df = one.groupBy("namespace", "term").agg(F.count("*").alias("df"))
    matched = one.groupBy(*keys).agg(F.first("len").alias("len")).groupBy("namespace").agg(F.avg("len").alias("avg_len"), F.count("*").alias("n_matched"))
    full = one.join(df, ["namespace", "term"]).join(matched, "namespace").join(sizes, "namespace").withColumn("N", F.greatest("corpus", "n_matched"))
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    best = full.groupBy("namespace", "node_id", "term").agg(F.max(weight).alias("w"))
    return best.groupBy("namespace", "node_id").agg(F.sum("w").alias("score"), F.count("*").alias("n_terms")).where("score > 0")


def ranked(scored: DataFrame, limit: int, order: tuple[str, ...] = ("namespace", "node_id"), digits: int = 9) -> DataFrame:
    """The best rows of each namespace with their rank. Scores are compared to `digits` digits, so that sums in another order tie."""
    w = Window.partitionBy("namespace").orderBy(F.round("score", digits).desc(), *order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def answerable(index: DataFrame, terms: list[str], sizes: DataFrame) -> DataFrame:
    """namespace, n_terms_found, can_answer: whether half of the terms occur in some reason; none of no terms."""
    if not terms:
        return sizes.select("namespace", F.lit(0).cast("long").alias("n_terms_found"), F.lit(False).alias("can_answer"))
    found = _term_hits(index, terms).groupBy("namespace").agg(F.countDistinct("term").alias("n"))
    out = sizes.join(found, "namespace", "left").select("namespace", F.coalesce("n", F.lit(0)).cast("long").alias("n_terms_found"))
    return out.withColumn("can_answer", 2 * F.col("n_terms_found") >= len(terms))


# --- structural order ----------------------------------------------------------------


def path_score(query: str) -> Column:
    """Share of the query's whole tokens that are segments of the path."""
    whole = tk.query_words(query)
    segments = F.split(F.lower("file_path"), "[/._-]")
    return (reduce(Column.__add__, [F.array_contains(segments, t).cast("int") for t in whole]) / F.lit(float(len(whole)))) if whole else F.lit(0.0)


# What a matched character earns at the start of a name, at the start of a word in it, behind the last match and elsewhere; what a skipped one costs; the penalty of a longer name.
NAME_START, WORD_START, CONSECUTIVE, SCATTERED = 1.0, 0.8, 0.7, 0.3
GAP, TAIL = 0.2, 0.06
#: A method may be found by its type, at this share of the score.
RECEIVER = 0.5


def word_starts(name: str) -> np.ndarray:
    """What a match earns at each character of a name by its place alone; 0 inside of words."""
    out = np.zeros(len(name))
    for i, c in enumerate(name):
        if i == 0:
            out[i] = NAME_START
        elif name[i - 1] in "._-" or c.isupper() and (not name[i - 1].isupper() or name[i + 1 : i + 2].islower()):
            out[i] = WORD_START
    return out


def subsequence_score(query: str, name: str) -> float:
    """The best alignment of the characters of a query, in order, inside a name.

    best[j] is the best alignment so far whose last character stands at j. The
    next one follows it, or stands behind a gap: for that the running maximum of
    best, with the gaps' cost taken out, gives all earlier ends at once.
    Characters before the first match cost nothing.
    """
    n, m = len(query), len(name)
    if not n or n > m:
        return 0.0
    low = np.array([c.lower()[:1] for c in name])
    place, at = word_starts(name), np.arange(m)
    alone, behind = np.where(place > 0, place, SCATTERED), np.where(place > 0, place, CONSECUTIVE)
    best = None
    for c in query.lower():
        if best is None:
            score = alone
        else:
            next_to, far = np.full(m, -np.inf), np.full(m, -np.inf)
            next_to[1:] = best[:-1] + behind[1:]
            far[2:] = np.maximum.accumulate(best + GAP * at)[:-2] - GAP * (at[2:] - 1) + alone[2:]
            score = np.maximum(next_to, far)
        best = np.where(low == c, score, -np.inf)
    top = float(best.max())
    return max(0.0, top) / n / (1 + TAIL * (m - n)) if top > -np.inf else 0.0


def name_likeness(query: str):
    """A function of a name and a qualified name: the best likeness to the name, the last part of the qualified name and, at a discount, its receiver."""
    parts, joined = tk.query_parts(query), "".join(tk.query_parts(query))
    single = all(len(p) == 1 for p in parts)

    def like(target: str) -> float:
        if not parts or not target:
            return 0.0
        each = [subsequence_score(p, target) for p in parts]
        # A single character is no evidence beside longer parts.
        told = any(x > 0 and (single or len(p) > 1) for p, x in zip(parts, each))
        return max(sum(each) / len(each) if told else 0.0, subsequence_score(joined, target) if len(parts) > 1 else 0.0)

    def score(name: str | None, qualified: str | None) -> float:
        segments = (qualified or "").split(".")
        return max(like(name or ""), like(segments[-1]), RECEIVER * like(segments[-2]) if len(segments) > 2 else 0.0)

    return score


def name_scores(pool: DataFrame, query: str) -> DataFrame:
    """Adds name_score. For pools, not for whole tables."""
    import pandas as pd

    @F.pandas_udf("double")
    def score(name, qualified):
        one = name_likeness(query)
        return pd.Series([one(n, q) for n, q in zip(name, qualified)], dtype=float)

    return pool.withColumn("name_score", score("name", "qualified_name"))


def rerank(pool: DataFrame, block: int | None = None) -> DataFrame:
    """Adds position: by name score, path score, identity, then retrieval rank; inside blocks of the pool, so that pages never reshuffle."""
    order = [F.round("name_score", 9).desc(), F.round("path_score", 9).desc(), *IDENTITY, "rank"]
    if block:
        order = [F.floor((F.col("rank") - 1) / block), *order]
    return pool.withColumn("position", F.row_number().over(Window.partitionBy("namespace").orderBy(*order)))


def absorb_reasons(ranked_nodes: DataFrame, reason_hits: DataFrame) -> DataFrame:
    """namespace, node_id, has_intent, position: reason hits mark rows that are there and follow them in rank order otherwise."""
    a = ranked_nodes.select("namespace", "node_id", F.col("position").alias("p"))
    b = reason_hits.select("namespace", "node_id", F.col("rank").alias("r"))
    both = a.join(b, ["namespace", "node_id"], "full")
    w = Window.partitionBy("namespace").orderBy(F.col("p").isNull(), "p", "r")
    return both.select("namespace", "node_id", F.col("r").isNotNull().alias("has_intent"), F.row_number().over(w).alias("position"))


def evidence(rows: DataFrame, include_weak: bool = False) -> DataFrame:
    """Adds matched (name, path, intent); rows without any are weak: dropped, or kept behind the others."""
    marks = F.array_compact(F.array(F.when(F.col("name_score") > 0, "name"), F.when(F.col("path_score") > 0, "path"), F.when(F.col("has_intent"), "intent")))
    out = rows.withColumn("matched", marks)
    if not include_weak:
        return out.where(F.size("matched") > 0)
    w = Window.partitionBy("namespace").orderBy(F.size("matched") == 0, "position")
    return out.withColumn("position", F.row_number().over(w))


def by_file(rows: DataFrame) -> DataFrame:
    """Adds file_no (from 1, in order of first hits) and file_hits."""
    f = Window.partitionBy("namespace", "file_path")
    first = rows.withColumn("__first", F.min("position").over(f)).withColumn("file_hits", F.count("*").over(f))
    return first.withColumn("file_no", F.dense_rank().over(Window.partitionBy("namespace").orderBy("__first"))).drop("__first")


def file_pages(rows: DataFrame, limit: int, offset: int = 0, budget: int = HITS_OF_A_PAGE) -> DataFrame:
    """Rows of at most `limit` files after `offset` files, until the page exceeds the hit budget; a first file always stays whole."""
    here = rows.where(F.col("file_no") > offset)
    upto = Window.partitionBy("namespace").orderBy("file_no").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = here.withColumn("__hits", F.count("*").over(upto))
    return taken.where((F.col("file_no") <= offset + limit) & ((F.col("__hits") <= budget) | (F.col("file_no") == offset + 1))).drop("__hits")


def federated_pages(rows: DataFrame, limit: int, offset: int = 0, budget: int = HITS_OF_A_PAGE) -> DataFrame:
    """A page of each namespace, all cut to the shortest page that has more behind it, so that one offset continues all."""
    own = file_pages(rows, limit, offset, budget)
    last = rows.groupBy("namespace").agg(F.max("file_no").alias("last"))
    shown = own.groupBy("namespace").agg(F.max("file_no").alias("shown"))
    step = last.join(shown, "namespace").where("shown < last").agg(F.min("shown").alias("step"))
    return own.join(step, F.lit(True), "left").where(F.col("step").isNull() | (F.col("file_no") <= F.col("step"))).drop("step")


def merged(rows: DataFrame, natural: bool, most: int = 500) -> DataFrame:
    """One order over the pools of namespaces: question answers take turns by rank, others follow their scores; ties by identity.

    The first `most` rows, which are sorted in parts and only then numbered.
    """
    order = ["rank", *IDENTITY] if natural else [F.round("score", 9).desc(), *IDENTITY]
    return rows.orderBy(*order).limit(most).withColumn("merged", F.row_number().over(Window.orderBy(*order)))


def promote_exact(rows: DataFrame, query: str) -> DataFrame:
    """For a single token: the first node of exactly that name, else of that name in any case, moves to the front."""
    if len(query.split()) != 1:
        return rows
    grade = F.when(F.col("name") == query, 0).when(F.lower("name") == query.lower(), 1).otherwise(2)
    w = Window.partitionBy("namespace").orderBy(grade, "position")
    lead = (F.row_number().over(w) == 1) & (grade < 2)
    return rows.withColumn("__lead", lead).withColumn("position", F.row_number().over(Window.partitionBy("namespace").orderBy(~F.col("__lead"), "position"))).drop("__lead")


def note(answered: int, retrieved: int, n_reasons: int, offset: int) -> str | None:
    """Why an answer is empty; nothing for one that is not."""
    if answered == 0 and retrieved == 0:
        return "nothing was retrieved" if n_reasons else "nothing was retrieved, and no reasons are recorded"
    if offset >= answered > 0:
        return "the page lies past the end"
    return "all matches are weak" if answered == 0 else None
