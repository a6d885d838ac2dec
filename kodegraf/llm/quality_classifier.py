"""Quality classifier: random-indexing vectors, pooled, under a two-layer network.

A bounded sample of labelled rows trains everything; its texts are tokenised and
counted on the executors, and only counts and vectors of bounded size are
collected. Each token has a sparse
ternary index vector made from its hash; a token's context vector is the sum of
the index vectors around its occurrences (random indexing). A token vector is
its unit context vector plus its own index vector. The same is done for token
shapes (capitals, runs of a symbol, a token that repeats the last one), so that
words never seen still count. A document is the mean of its word vectors beside
the mean of its shape vectors, over its whole text. A network with one hidden
layer scores it, and a temperature fitted on rows kept out of the training makes
the scores probabilities.

Only labels outside the held-out fold are read; lang, source, n_chars and
doc_id are no inputs of a score.

Edge cases: null and empty texts have the zero vectors and get the score of
these; null labels are ignored; without any usable label, or with labels of one
class only, every score is the class share (0.5 without labels). Repeated rows
get a row each. An empty table gives no rows.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kodegraf.llm.common import batches, crc_fold, map_texts, saved, texts_of

#: The classifier is fitted on at most so many labelled rows, those of the smallest hash of doc_id.
TRAIN_ROWS = 4000
#: Tasks that count the sample.
SAMPLE_TASKS = 4
DIM = 64
NONZERO = 6
REACH = 2
VOCABULARY = 16_384
LEAST_COUNT = 3
HIDDEN = 32
CUT = 0.3
TOKEN = re.compile(r"\w+|[^\w\s]+")
SAME = "shape same"
_CACHE_MAX = 400_000


def shape(token: str) -> str:
    c = token[0]
    if c.isalnum() or c == "_":
        if token.isdigit():
            return "shape digits"
        if len(token) > 1 and token.isupper():
            return "shape CAPS"
        return "shape Capital" if c.isupper() else "shape lower"
    return f"shape {c if c.isascii() else 'other'}{min(len(token), 3)}"


def index_vector(token: str, dim: int = DIM) -> np.ndarray:
    """The sparse ternary vector of a token."""
    seed = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 7)
    rng = np.random.Generator(np.random.PCG64(seed))
    v = np.zeros(dim, np.float32)
    v[rng.choice(dim, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO) / np.sqrt(NONZERO)
    return v


@dataclass
class Model:
    words: dict[str, int]
    shapes: dict[str, int]
    word_vectors: np.ndarray
    shape_vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 2 * DIM), np.float32)
        if self.constant is not None:
            return out
        cache: dict[str, tuple[int, int]] = {}
        blank = len(self.words)
        for row, text in enumerate(texts):
            tokens = TOKEN.findall(text)
            if not tokens:
                continue
            counts = Counter(tokens)
            if len(cache) > _CACHE_MAX:
                cache.clear()
            try:
                at = [cache[t] for t in counts]
            except KeyError:
                for t in counts:
                    if t not in cache:
                        cache[t] = self.words.get(t.lower(), blank), self.shapes.get(shape(t), len(self.shapes))
                at = [cache[t] for t in counts]
            at = np.array(at, np.int64)
            n = np.fromiter(counts.values(), np.float32, len(counts))
            known = at[:, 0] < blank
            out[row, :DIM] = n[known] @ self.word_vectors[at[known, 0]] / len(tokens)
            of_shape = np.bincount(at[:, 1], weights=n, minlength=len(self.shape_vectors))
            of_shape[self.shapes[SAME]] = sum(map(operator.eq, tokens[1:], tokens))
            out[row, DIM:] = of_shape.astype(np.float32) @ self.shape_vectors / len(tokens)
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1)
        return (h @ self.w2 + self.b2).astype(np.float64)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.features(texts)) / self.temperature, -30, 30)))


def context_sums(token_lists: Iterable[list[str]], words: dict[str, int], shapes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word and shape the sum of the index vectors around it, as whole numbers: in units of an entry of an index vector."""
    unit = np.sqrt(NONZERO)
    ternary = lambda names: np.rint(np.stack([index_vector(t) for t in names]) * unit).astype(np.int32) if names else np.zeros((0, DIM), np.int32)
    base_w, base_s = np.vstack([ternary(words), np.zeros((1, DIM), np.int32)]), ternary(shapes)
    ctx_w, ctx_s = np.zeros((len(words) + 1, DIM), np.int64), np.zeros((len(shapes), DIM), np.int64)
    of_shape: dict[str, int] = {}
    for tokens in token_lists:
        if not tokens:
            continue
        w = np.array([words.get(t.lower(), len(words)) for t in tokens])
        s = np.array([of_shape.setdefault(t, shapes[shape(t)]) for t in tokens])
        here = base_w[w] + base_s[s]
        around = np.zeros_like(here)
        for o in range(1, REACH + 1):
            around[o:] += here[:-o]
            around[:-o] += here[o:]
        np.add.at(ctx_w, w, around)
        np.add.at(ctx_s, s, around)
        same = [i for i in range(1, len(tokens)) if tokens[i] == tokens[i - 1]]
        ctx_s[shapes[SAME]] += around[same].sum(axis=0)
    return ctx_w[:-1], ctx_s


def token_vectors(words: dict[str, int], shapes: dict[str, int], ctx_w: np.ndarray, ctx_s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit context vectors plus own index vectors; a row of zeros for shapes not known follows."""
    own = lambda names: np.stack([index_vector(t) for t in names]) if names else np.zeros((0, DIM), np.float32)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    return (unit(ctx_w) + own(words)).astype(np.float32), np.vstack([unit(ctx_s) + own(shapes), np.zeros((1, DIM))]).astype(np.float32)


def _counted(it):
    """Counts of words (w) and shapes (s) of each batch."""
    for b in batches(it):
        words, shapes = Counter(), set()
        for text in texts_of(b):
            tokens = Counter(TOKEN.findall(text))
            for t, n in tokens.items():
                words[t.lower()] += n
            shapes |= {shape(t) for t in tokens}
        names = [*words, *sorted(shapes)]
        yield pa.RecordBatch.from_arrays([pa.array(["w"] * len(words) + ["s"] * len(shapes)), pa.array(names, pa.string()), pa.array([*words.values(), *[1] * len(shapes)], pa.int64())], names=["kind", "name", "n"])


def token_model(rows: DataFrame) -> Model:
    """The vectors of tokens from the texts of rows, without a network."""
    counts = saved(rows.select("text").mapInArrow(_counted, "kind string, name string, n long").groupBy("kind", "name").agg(F.sum("n").alias("n")), "tokens")
    top = counts.where((F.col("kind") == "w") & (F.col("n") >= LEAST_COUNT)).orderBy(F.col("n").desc(), "name").limit(VOCABULARY).collect()
    words = {r.name: i for i, r in enumerate(top)}
    # Shapes are few: a character of ASCII and a length up to three, and some more.
    shapes = {x: i for i, x in enumerate(sorted({r.name for r in counts.where("kind = 's'").collect()} | {SAME}))}

    def sums(it):
        w, s = np.zeros((len(words), DIM), np.int64), np.zeros((len(shapes), DIM), np.int64)
        for b in batches(it):
            x, y = context_sums((TOKEN.findall(t) for t in texts_of(b)), words, shapes)
            w += x
            s += y
        both = np.vstack([w, s])
        on = np.flatnonzero(both.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array([x.tobytes() for x in both[on].astype("<i8")], pa.binary())], names=["at", "v"])

    # From each of SAMPLE_TASKS tasks a row a word.
    both = np.zeros((len(words) + len(shapes), DIM), np.int64)
    for r in rows.select("text").coalesce(SAMPLE_TASKS).mapInArrow(sums, "at long, v binary").collect():
        both[r["at"]] += np.frombuffer(r.v, "<i8")
    wv, sv = token_vectors(words, shapes, both[: len(words)], both[len(words) :])
    return Model(words, shapes, wv, sv, np.zeros(0), np.ones(0), np.zeros(0), np.zeros(0), np.zeros(0), 0.0, 1.0)


def network_gradient(p: list[np.ndarray], z: np.ndarray, y: np.ndarray, decay: float = 1e-4) -> list[np.ndarray]:
    """Of the mean logistic loss, with half the decay times the squared weights, by w1, b1, w2 and b2."""
    h = np.tanh(z @ p[0] + p[1])
    d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y) / len(y)
    dh = np.outer(d, p[2]) * (1 - h * h)
    return [z.T @ dh + decay * p[0], dh.sum(axis=0), h.T @ d + decay * p[2], d.sum(keepdims=True)]


def fit_network(model: Model, x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 3) -> Model:
    """model with the network and temperature fitted on features x and labels y."""
    y = y.astype(np.float32)
    if len(y) < 2 or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = max(1, len(y) * 4 // 5)
    train, tune = order[:cut], order[cut:]
    model.centre, model.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    z = (x - model.centre) / model.scale
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32), np.zeros(1, np.float32)]
    m1, m2, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        walk = rng.permutation(train)
        for i in range(0, cut, 128):
            at = walk[i : i + 128]
            step += 1
            for a, g, u, v in zip(p, network_gradient(p, z[at], y[at]), m1, m2):
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                a -= 0.003 * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p[0], p[1], p[2], float(p[3][0])
    tuned = tune if len(tune) else train
    logit = model.logits(x[tuned])

    def loss(t):
        s = np.clip(logit / t, -30, 30)
        return float(np.mean(np.logaddexp(0, s) - y[tuned] * s))

    model.temperature = min((float(t) for t in np.geomspace(0.5, 8, 60)), key=loss)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier, from at most TRAIN_ROWS labelled rows."""
    rows = saved(labelled_sample(docs, labels, "quality", TRAIN_ROWS).repartition(SAMPLE_TASKS), "labelled")
    model = token_model(rows)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(batch):
            return {"id": batch.column("__id"), "y": batch.column("y"), "x": pa.array(list(held.value.features(texts_of(batch))), pa.list_(pa.float32()))}

        return run

    got = map_texts(rows, make, "id long, y int, x array<float>", ["__id", "y", "text"]).collect()
    got.sort(key=lambda r: (r.id, r.y, r.x))
    return fit_network(model, np.array([r.x for r in got], np.float32).reshape(-1, 2 * DIM), np.array([r.y for r in got]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, where=None) -> DataFrame:
    """text and label of at most so many labelled documents outside the held-out fold."""
    lab = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("__y")).where(F.col("__y").isNotNull() & (crc_fold("__id") != 0))
    lab = lab if where is None else lab.where(where)
    some = lab.dropDuplicates(["__id", "__y"]).orderBy(F.xxhash64("__id", F.lit(29)), "__id", "__y").limit(rows)
    # At most `rows` pairs of numbers: small enough to broadcast whatever the input.
    return docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "__id").select("text", F.col("__y").alias("y"), "__id").orderBy(F.xxhash64("__id", F.lit(29)), "__id", "text").limit(rows)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.3)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def make():
        def run(batch):
            s = model.value.scores(texts_of(batch))
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": (s >= CUT).astype(np.int32)}

        return run

    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_fold("doc_id") == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")]
    return map_texts(docs, make, "doc_id long, held_out boolean, score double, predicted int", cols)


def accepted(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs that score at least `cut`, all columns as they were."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("boolean")
    def good(texts):
        return pd.Series(model.value.scores(texts.fillna("").tolist()) >= cut)

    return docs.where(good(F.col("text").cast("string")))
