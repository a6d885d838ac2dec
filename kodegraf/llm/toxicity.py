"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows (P) and unlabelled texts (U) train linear classifiers over
word rates (words and their beginnings). With the class prior pi the risk is

    pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)),

and where the corrected part falls below zero the step goes the other way, as
the non-negative estimator asks. Words enter if they are frequent enough and
their share of texts in P is twice that in U and a few standard errors above. Three
classifiers on different halves of U are averaged. The sampled texts are counted
on the executors; the driver sees the words that are chosen and their rates.

Only labels outside the held-out fold are read, and of these the toxic rows plus
the class prior; lang, source, n_chars and doc_id are no inputs of a score.

Edge cases: null and empty texts hold no word and get the score of the bare
offset; without any toxic label the score is the prior (0 by default) for every
row. Repeated rows get a row each. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kodegraf.llm.common import batches, crc_fold, map_texts, sampled, saved, texts_of
from kodegraf.llm.quality_classifier import SAMPLE_TASKS, labelled_sample

#: Bounds of the samples on which the classifiers are fitted.
POSITIVE_ROWS = 2000
UNLABELLED_ROWS = 4000
MOST_FEATURES = 2000
LEAST_DOCS = 4
LEAST_Z = 5.0
LEAST_LIFT = 2.0
MOST_RATE = 3.0
#: Lengths of the beginnings of words that are features beside the words.
PREFIXES = (4, 5, 6, 7)
CUT = 0.5
WORD = re.compile(r"\w+")


@dataclass
class Model:
    words: dict[str, int]  # to columns
    heads: dict[str, int]  # beginnings of longer words, to columns
    weights: np.ndarray  # classifiers x columns
    offsets: np.ndarray
    constant: float | None = None

    def __post_init__(self):
        #: First characters of all features: other words are passed over at once.
        self.starts = frozenset(f[: PREFIXES[0]] for f in (*self.words, *self.heads))

    def columns(self, word: str) -> list[int]:
        own = [self.words[word]] if word in self.words else []
        return own + [self.heads[h] for n in PREFIXES if n < len(word) and (h := word[:n]) in self.heads]

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z, k, starts = np.full(len(texts), self.offsets.mean()), PREFIXES[0], self.starts
        weight = self.weights.mean(axis=0)
        for i, text in enumerate(texts):
            words = WORD.findall(text.lower())
            hits = [w for w in words if w[:k] in starts]
            if hits:
                count = Counter(c for w in hits for c in self.columns(w))
                at = sorted(count)
                z[i] += float(weight[at] @ rate(np.array([count[c] for c in at], float), len(words)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(word: str) -> list[str]:
    """A word and its beginnings, told apart by a sign."""
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if n < len(word))]


def rate(count: np.ndarray, n_words: int) -> np.ndarray:
    """Occurrences in a hundred words, at most MOST_RATE."""
    return np.minimum(MOST_RATE, 100.0 * count / max(1, n_words))


def counts_of(text: str) -> tuple[Counter, int]:
    """How often each feature occurs in a text, and the number of its words."""
    words, out = Counter(WORD.findall(text.lower())), Counter()
    for w, n in words.items():
        for f in features(w):
            out[f] += n
    return out, words.total()


def _texts_with(it):
    """Of each batch the number of positive texts and of all that hold a feature."""
    for b in batches(it):
        own, every = Counter(), Counter()
        for positive, text in zip(b.column("p").to_pylist(), texts_of(b)):
            found = {f for w in set(WORD.findall(text.lower())) for f in features(w)}
            every.update(found)
            if positive:
                own.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array([own[f] for f in every], pa.int64()), pa.array(list(every.values()), pa.int64())], names=["f", "in_p", "n"])


def chosen_features(rows: DataFrame, n: int, k: int) -> list[str]:
    """At most MOST_FEATURES, the clearest: far more often in the n positive texts than in the k unlabelled ones."""
    held = rows.select("p", "text").mapInArrow(_texts_with, "f string, in_p long, n long").groupBy("f").agg(F.sum("in_p").alias("in_p"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
    share, p, u = (F.col("n") + 1) / F.lit(n + k + 2.0), F.col("in_p") / F.lit(float(n)), (F.col("n") - F.col("in_p")) / F.lit(float(k))
    z = (p - u) / F.sqrt(share * (1 - share) * F.lit(1 / n + 1 / k))
    top = held.where(p >= LEAST_LIFT * u).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.col("z").desc(), "f").limit(MOST_FEATURES)
    return sorted(r.f for r in top.collect())


def matrices(rows: DataFrame, chosen: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rates of the chosen features in the positive and in the unlabelled texts."""
    at = {f: i for i, f in enumerate(chosen)}

    def make():
        def run(batch):
            cols, rates = [], []
            for text in texts_of(batch):
                count, words = counts_of(text)
                on = sorted(at[f] for f in count if f in at)
                cols.append(on)
                rates.append(rate(np.array([count[chosen[c]] for c in on], float), words).tolist())
            return {"p": batch.column("p"), "h": batch.column("h"), "cols": pa.array(cols, pa.list_(pa.int32())), "rates": pa.array(rates, pa.list_(pa.float64()))}

        return run

    got = map_texts(rows, make, "p boolean, h long, cols array<int>, rates array<double>", ["p", "h", "text"]).collect()
    got.sort(key=lambda r: (r.h, r.cols))
    out = []
    for positive in (True, False):
        own = [r for r in got if r.p == positive]
        x = np.zeros((len(own), len(chosen)), np.float32)
        for i, r in enumerate(own):
            x[i, r.cols] = r.rates
        out.append(x)
    return out[0], out[1]


def risk_gradient(w: np.ndarray, b: float, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[bool, np.ndarray]:
    """Whether the corrected part of the risk is below zero, and the gradient (by w and b) of the risk, or of that part turned round."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    zp, zu = p @ w + b, u @ w + b
    below = bool(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() < 0)
    plus, minus, all_u = prior * (sig(zp) - 1) / len(zp), prior * sig(zp) / len(zp), sig(zu) / len(zu)
    dp, du = (minus, -all_u) if below else (plus - minus, all_u)
    return below, np.append(p.T @ dp + u.T @ du, dp.sum() + du.sum())


def nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 400, decay: float = 3e-4, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and offset that minimise the non-negative risk with the logistic loss."""
    w, b = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        g = risk_gradient(w, b, p, u, prior)[1] + decay * np.append(w, 0.0)
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(positive: DataFrame, unlabelled: DataFrame, prior: float, models: int = 3) -> Model:
    """From the texts of confirmed toxic and of unlabelled rows."""
    h = F.xxhash64("text").alias("h")
    rows = saved(positive.select(F.lit(True).alias("p"), h, "text").unionByName(unlabelled.select(F.lit(False).alias("p"), h, "text")).repartition(SAMPLE_TASKS), "sampled")
    sizes = {r.p: r.n for r in rows.groupBy("p").agg(F.count("*").alias("n")).collect()}
    n, k = sizes.get(True, 0), sizes.get(False, 0)
    if not n or not k or not 0 < prior < 1:
        return Model({}, {}, np.zeros((1, 0)), np.zeros(1), float(min(max(prior, 0.0), 1.0)))
    chosen = chosen_features(rows, n, k)
    p, u = matrices(rows, chosen)
    rng = np.random.default_rng(5)
    fits = [nnpu(p, u[rng.permutation(k)[: max(1, (k + 1) // 2)]], prior) for _ in range(models)]
    words = {f[1:]: i for i, f in enumerate(chosen) if f[0] == "="}
    heads = {f[1:]: i for i, f in enumerate(chosen) if f[0] == "^"}
    return Model(words, heads, np.stack([w for w, _ in fits]), np.array([b for _, b in fits]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5). prior: share of toxic texts; by default that of the labels read."""
    positive = labelled_sample(docs, labels, "toxic", POSITIVE_ROWS, F.col("__y") == 1).select("text")
    unlabelled = sampled(docs, UNLABELLED_ROWS, [F.col("text").cast("string").alias("text")], seed=31)
    if prior is None:
        shown = labels.where(crc_fold("doc_id") != 0).agg(F.avg(F.col("toxic").cast("double")).alias("p")).first().p
        prior = float(shown or 0.0)
    model = docs.sparkSession.sparkContext.broadcast(fit(positive, unlabelled, prior))

    def make():
        def run(batch):
            s = model.value.scores(texts_of(batch))
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": (s >= CUT).astype(np.int32)}

        return run

    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_fold("doc_id") == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")]
    return map_texts(docs, make, "doc_id long, held_out boolean, score double, predicted int", cols)
