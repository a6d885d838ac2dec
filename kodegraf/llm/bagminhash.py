"""Near-duplicates by BagMinHash signatures, banding and verified multiset overlap.

A text is the multiset of its windows of five words (words are the runs free of
ASCII white space; a text of one to four words is one window). Two texts are
linked if their weighted Jaccard similarity is at least 0.8; classes are the
connected components of the links.

BagMinHash draws, for every window and every dyadic block of its discretised
weight, a Poisson process whose points each carry a register and a level inside
the block; a point counts if its level is at most the window's multiplicity.
The smallest point of a register then agrees between two multisets with a
probability of exactly their weighted Jaccard similarity. Processes are only
followed up to a limit that all registers of a text reach.

The plan, none of which gathers a group in one task or the driver:

1. one pass over the texts makes digests and band keys;
2. texts of equal words collapse to one node, by a map-side combined aggregate;
3. every node is paired with the leaders of its buckets (the nodes with most
   company in theirs), in two further rounds with the next leader of its largest
   bucket; each pair is verified on whole texts and joins its classes;
4. then the nodes of buckets that hold several classes are compared block by
   block, where a block holds a bounded number of nodes. A comparison is an
   upper bound of the overlap: windows are counted in cells by their hash, and
   no overlap exceeds the sum of the smaller counts of each cell. Only pairs
   whose bound reaches the similarity leave the block and are verified on whole
   texts, so no link that a band proposes is lost and no group emits its pairs;
5. classes are merged by distributed minimum-label rounds; up to FEW_LINKS
   links, two numbers each, are merged at once in the driver instead.

Edge cases: null and empty texts, and such of white space only, have no window
and form classes of their own, one per row. Rows that share a doc_id are one
document: all its texts are compared, and all belong to one class (but for
empty ones). Rows without a doc_id are documents of their own that take part
with their texts; a class without any doc_id has a null class_id. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kodegraf.llm.common import U, clearing, map_texts, mix64, saved, texts_of

SHINGLE = 5
#: A pair at the similarity of 0.8 shares a band with a probability of 0.99997.
BANDS = 20
ROWS = 4
REGISTERS = BANDS * ROWS
#: similarity of 4/5, kept as a fraction so that the test is exact
NUM, DEN = 4, 5
LEADER_ROUNDS = 3
#: Nodes of a block of a bucket, on average: a task compares two blocks at a time.
BLOCK_NODES = 512
#: Links that are merged in the driver: of more, none is collected.
FEW_LINKS = 1 << 16
#: Cells of the counts of windows, by the weight that a text has at least.
CELLS = ((0, 256), (1024, 1024), (8192, 4096))
#: Bytes of text hashed at a time.
BLOCK = 1 << 20

_P = 0x9E3779B97F4A7C15
_BYTE = mix64(np.arange(1, 257, dtype=U) * U(_P))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n, at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        both = []
        for x in (_P, pow(_P, -1, 1 << 64)):
            a = np.full(size, U(x), U)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers[:] = both
    return _powers[0], _powers[1]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each run free of white space, and where each begins."""
    b = np.frombuffer(raw, np.uint8)
    space = np.concatenate([[True], _IS_SPACE[b], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers_to(len(b) + 1)
    total = np.zeros(len(b) + 1, U)
    np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
    return mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(U) * U(0xA24BAED4963EE407)), start


def _windows(h: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    if not len(h):
        return np.zeros(0, U), np.zeros(0, np.int64)
    k = min(k, len(h))
    x = np.full(len(h) - k + 1, U(k), U)
    for j in range(k):
        x = x * U(_P) + h[j : j + len(x)]
    x = np.sort(mix64(x))
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], np.diff(first, append=len(x))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the windows of a text, and their multiplicities."""
    return _windows(word_hashes(text.encode("utf-8", "surrogatepass"))[0])


def bags_of(raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bags of many texts, hashed together in blocks."""
    out, i = [], 0
    while i < len(raws):
        j, size = i, 0
        while j < len(raws) and (j == i or size + len(raws[j]) < BLOCK):
            size += len(raws[j]) + 1
            j += 1
        h, start = word_hashes(b"\n".join(raws[i:j]))
        ends = np.cumsum([len(r) + 1 for r in raws[i:j]])
        out += [_windows(x) for x in np.split(h, np.searchsorted(start, ends[:-1]))]
        i = j
    return out


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Size of the multiset intersection and union."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both, int(a[1].sum() + b[1].sum()) - both


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """BagMinHash registers (uint64) of each multiset; empty multisets get zeros."""
    out = np.zeros((len(bags), m), U)
    todo = [i for i, (h, _) in enumerate(bags) if len(h)]
    slack = 3.0
    while todo:
        got, full = _up_to([bags[i] for i in todo], m, slack)
        out[np.array(todo)[full]] = got[full]
        todo = [i for i, ok in zip(todo, full) if not ok]
        slack *= 2
    return out


def _up_to(bags: list, m: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Registers from all points below a limit per multiset, and whether each got all its registers."""
    weight = np.array([int(c.sum()) for _, c in bags], np.float64)
    limit = m / weight * (math.log(m) + slack)
    docs = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    hashes, counts = np.concatenate([h for h, _ in bags]), np.concatenate([c for _, c in bags])
    best, owner = np.full(len(bags) * m, np.inf), np.zeros(len(bags) * m, U)
    block = 0
    while True:  # dyadic blocks of levels: {1}, {2}, {3, 4}, {5..8}, ...
        low = 0 if block == 0 else 1 << (block - 1)
        size = max(1, low)
        at = np.flatnonzero(counts > low) if block else slice(None)
        doc, seed, count = docs[at], mix64(hashes[at] ^ U(block * 0xA24BAED4963EE407 & (1 << 64) - 1)), counts[at]
        if not len(doc):
            break
        t, most, i = np.zeros(len(doc)), limit[doc], 0
        while len(doc):
            i += 1
            r = mix64(seed + U(i * 0xD1B54A32D192ED03 & (1 << 64) - 1))
            t = t - np.log(((r >> U(24)).astype(np.float64) + 0.5) * 2.0**-40) / size
            on = np.flatnonzero(t <= most)
            doc, seed, t, r, most = doc[on], seed[on], t[on], r[on], most[on]
            reg = doc * m + (((r & U(0xFFFFFF)) * U(m)) >> U(24)).astype(np.int64)
            at, when, who = reg, t, r
            if size > 1:  # where in the block the point lies decides whether it counts
                count = count[on]
                ok = np.flatnonzero(low + 1 + (mix64(r ^ U(0x5851F42D4C957F2D)) % U(size)).astype(np.int64) <= count)
                at, when, who = reg[ok], t[ok], r[ok]
            np.minimum.at(best, at, when)
            won = np.flatnonzero(best[at] == when)
            owner[at[won]] = who[won]
        block += 1
    shape = (len(bags), m)
    return owner.reshape(shape), np.isfinite(best).reshape(shape).all(axis=1)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.shape[1] // bands
    x = np.tile(np.arange(1, bands + 1, dtype=U), (len(sig), 1)) * U(0x9E3779B97F4A7C15)
    for j in range(rows):
        x = mix64(x + sig[:, j::rows])
    return x.astype(np.int64)


def _sketch():
    def run(batch):
        raws = [text.encode("utf-8", "surrogatepass") for text in texts_of(batch)]
        digests = [hashlib.blake2b(b" ".join(raw.split()), digest_size=16).digest() for raw in raws]
        d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        bags = bags_of(raws)
        keys = np.concatenate([band_keys(signatures(bags[i : i + 256])) for i in range(0, len(bags), 256)])
        w = np.array([int(c.sum()) for _, c in bags], np.int64)
        offsets = np.arange(len(bags) + 1, dtype=np.int32) * BANDS
        same = {k: batch.column(k) for k in ("doc_id", "k1", "k2")}
        return same | {"d1": d[:, 0], "d2": d[:, 1], "w": w, "bands": pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))}

    return run


#: What tells rows apart: the doc_id, 0 for none, and a hash of 128 bits of the text.
ROW = ["doc", "k1", "k2"]


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """The text, the columns of ROW and the given ones."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(*columns, doc_id.alias("__doc_id"), text.alias("__text"), F.coalesce(doc_id, F.lit(0)).alias("doc"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text (k1, k2), digest of its words (d1, d2), number of windows w, band keys."""
    rows = keyed(docs).select(F.col("__doc_id").alias("doc_id"), "k1", "k2", F.col("__text").alias("text"))
    return map_texts(rows, _sketch, "doc_id long, k1 long, k2 long, d1 long, d2 long, w long, bands array<long>", rows.columns)


def _verify():
    last: list = [None, None]

    def run(batch):
        both, union = [], []
        for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("text").to_pylist(), batch.column("tb").to_pylist()):
            if last[0] != a:
                last[:] = [a, bag(ta or "")]
            x, y = overlap(last[1], bag(tb or ""))
            both.append(x)
            union.append(y)
        return {"a": batch.column("a"), "b": batch.column("b"), "both": both, "all": union}

    return run


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes whose whole texts reach the similarity. Merge joins at every size: texts are never broadcast."""
    two = pairs.join(texts.withColumnsRenamed({"id": "b", "text": "tb"}).hint("merge"), "b").join(texts.withColumnRenamed("id", "a").hint("merge"), "a").select("a", "text", "b", "tb")
    return map_texts(two, _verify, "a long, b long, both long, all long", ["a", "text", "b", "tb"]).where(DEN * F.col("both") >= NUM * F.col("all")).select("a", "b")


def cells_of(weight: int) -> int:
    return next(n for least, n in reversed(CELLS) if weight >= least)


def cell_counts(one: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Windows of a text by cell, in 16 bits; large weights are counted in coarser units, rounded up."""
    h, c = one
    weight = int(c.sum())
    n, shift = cells_of(weight), max(0, weight.bit_length() - 16)
    counts = np.bincount((h % U(n)).astype(np.int64), weights=c, minlength=n).astype(np.int64)
    return (-(-counts >> shift)).astype("<u2").tobytes()


def _cells():
    def run(batch):
        raws = [text.encode("utf-8", "surrogatepass") for text in texts_of(batch)]
        return {"id": batch.column("id"), "cells": pa.array([cell_counts(x) for x in bags_of(raws)], pa.binary())}

    return run


def most_overlap(weights: np.ndarray, cells: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """An upper bound of the overlap of the multisets i[k] and j[k]: the smaller counts of each cell, summed."""
    kinds = np.array([cells_of(int(w)) for w in weights])
    out = np.zeros(len(i), np.int64)
    at_kind = np.minimum(kinds[i], kinds[j])
    for n in np.unique(at_kind):
        # Counts of more cells are folded: cells are hashes modulo powers of two.
        own = np.zeros((len(weights), n), np.int32)
        for x in np.flatnonzero(kinds >= n):
            shift = max(0, int(weights[x]).bit_length() - 16)
            own[x] = (np.frombuffer(cells[x], "<u2").astype(np.int32) << shift).reshape(-1, n).sum(axis=0)
        on = np.flatnonzero(at_kind == n)
        step = max(1, (1 << 22) // n)
        for k in range(0, len(on), step):
            o = on[k : k + step]
            out[o] = np.minimum(own[i[o]], own[j[o]]).sum(axis=1)
    return out


def _near_pairs(key: tuple, rows: pa.Table) -> pa.Table:
    """Pairs of two blocks of a bucket, in different classes, whose bound reaches the similarity; each in its first common band."""
    band, _, x, y = (k.as_py() for k in key)
    ids, label, w, block = (rows.column(k).to_numpy() for k in ("id", "label", "w", "block"))
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    fits = (label[left][:, None] != label[right]) & (DEN * np.minimum(w[left][:, None], w[right]) >= NUM * np.maximum(w[left][:, None], w[right]))
    i, j = np.nonzero(np.triu(fits, 1) if x == y else fits)
    i, j = left[i], right[j]
    if len(i):
        most = most_overlap(w, rows.column("cells").to_pylist(), i, j)
        on = (NUM + DEN) * most >= NUM * (w[i] + w[j])
        i, j = i[on], j[on]
    if len(i):
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[:, :band]
        on = ~np.concatenate([(bands[i[k : k + 65536]] == bands[j[k : k + 65536]]).any(axis=1) for k in range(0, len(i), 65536)])
        i, j = i[on], j[on]
    return pa.table({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def near_pairs(at: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of different classes that a bucket holds and whose overlap may reach the similarity; at: band, key, n, id, w, label."""
    cells = map_texts(texts.join(at.select("id").distinct().hint("merge"), "id", "left_semi"), _cells, "id long, cells binary", ["id", "text"])
    n = F.ceil(F.col("n") / F.lit(BLOCK_NODES)).cast("int")
    side = at.withColumn("block", F.pmod(F.xxhash64("id"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    side = side.join(cells.join(nodes.select("id", "bands"), "id").hint("merge"), "id").select("band", "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "label", "w", "block", "cells", "bands")
    return side.groupBy("band", "key", "x", "y").applyInArrow(_near_pairs, "a long, b long")


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of links (a, b), sorted, and the smallest id of the component of each."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while (root[x] != root[y]).any():
        p, q = root[x], root[y]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root != root[root]).any():
            root = root[root]
    return ids, ids[root]


@clearing
def components(edges: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(id, label): the smallest id of each component.

    More than `few` links are merged by minimum labels over neighbours and label
    jumps: each round is some jobs of many tasks, whose records the driver keeps.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    if edges.count() <= few:
        links = edges.toArrow()
        ids, label = merged(*(links.column(k).to_numpy() for k in ("a", "b")))
        return saved(edges.sparkSession.createDataFrame(pa.table({"id": ids.astype(np.int64), "label": label.astype(np.int64)})), "labels")
    e = saved(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "edges")
    labels = saved(e.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumnRenamed("x", "id"), "labels")
    while True:
        near = e.join(labels, e.y == labels.id).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.x, "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("far"))
        new = saved(step.join(jump, "to", "left").select("id", "label", F.least("to", F.coalesce("far", "to")).alias("to")), "labels")
        labels = new.select("id", F.col("to").alias("label"))
        if new.where("to < label").isEmpty():
            return labels


@clearing
def node_classes(sk: DataFrame, docs: DataFrame) -> DataFrame:
    """d1, d2, rep (missing, doc_id, k1, k2 of the first row), n_rows and label of each node; label is one id of the class."""
    words = sk.where("w > 0")
    rep = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "k1", "k2")
    nodes = words.groupBy("d1", "d2").agg(F.min(F.struct(rep.alias("rep"), "w", "bands")).alias("m"), F.count("*").alias("n_rows"))
    # Ids are fixed by writing them; results do not depend on them.
    nodes = saved(nodes.select(F.monotonically_increasing_id().alias("id"), "d1", "d2", "m.*", "n_rows"), "nodes")
    bucket = nodes.select("id", "w", F.posexplode("bands").alias("band", "key"))
    # Written before they are joined, here and below, so that the join of a crowded bucket can be split.
    crowd = saved(bucket.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "crowds")
    company = bucket.join(crowd, ["band", "key"]).select("band", "key", "n", "id", "w")
    rank = company.groupBy("id").agg(F.sum("n").alias("company"))
    company = saved(company.join(rank, "id").select("band", "key", "n", "id", "w", "company"), "company")
    # The only pass over all texts but the first; a merge join at every size.
    first = nodes.join(rank, "id", "left_semi").select("id", F.coalesce("rep.doc_id", F.lit(0)).alias("doc"), "rep.k1", "rep.k2")
    texts = saved(keyed(docs).join(first.hint("merge"), ROW).groupBy(*ROW).agg(F.first("id").alias("id"), F.first("__text").alias("text")).select("id", "text"), "near-texts")

    at = company.withColumn("label", F.col("id"))
    # Texts of one document are of one class.
    several = words.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("a"), F.max(F.struct("d1", "d2")).alias("z")).where("a <> z")
    one = words.join(several, "doc_id").select("d1", "d2", "a").distinct().where("a <> struct(d1, d2)")
    ids = nodes.select("d1", "d2", "id")
    same = one.join(ids, ["d1", "d2"]).select(F.col("id").alias("b"), F.col("a.d1").alias("d1"), F.col("a.d2").alias("d2")).join(ids, ["d1", "d2"]).select(F.col("id").alias("a"), "b")
    labels, links, used = None, [saved(same, "links")], None
    for turn in range(LEADER_ROUNDS + 1):
        if turn:
            at = company.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
            mixed = at.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band", "key")
            mixed = saved(mixed, "mixed")
            at = saved(at.join(mixed, ["band", "key"], "left_semi"), "open")
        if turn < LEADER_ROUNDS:
            free = at if used is None else at.join(used, ["band", "key", "id"], "left_anti")
            lead = free.groupBy("band", "key").agg(F.max(F.struct("company", "id", "w", "label")).alias("l")).select("band", "key", F.col("l.id").alias("a"), F.col("l.w").alias("wa"), F.col("l.label").alias("la"))
            lead = saved(lead, "leaders")
            mine = lead.select("band", "key", F.col("a").alias("id"))
            used = mine if used is None else used.unionByName(mine)
            # First a node meets the leaders of all its buckets, later that of its largest one.
            side = at if turn == 0 else at.groupBy("id").agg(F.max(F.struct("n", "band", "key", "w", "label")).alias("m")).select("id", "m.*")
            possible = DEN * F.least("wa", "w") >= NUM * F.greatest("wa", "w")
            pairs = lead.join(side, ["band", "key"]).where((F.col("label") != F.col("la")) & (F.col("id") != F.col("a")) & possible).select("a", F.col("id").alias("b")).distinct()
        else:
            pairs = near_pairs(at, nodes, texts)
        pairs = saved(pairs, "pairs")
        if labels is not None and pairs.isEmpty():
            continue  # nothing new to verify or to merge
        new = saved(verified(pairs, texts), "links")
        if labels is None or not new.isEmpty():
            links.append(new)
            labels = components(reduce(DataFrame.unionByName, links))
    return saved(nodes.join(labels, "id", "left").select("d1", "d2", "rep", "n_rows", F.coalesce("label", "id").alias("label")), "classed")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size (rows), kept (the document of the smallest doc_id).

    The table of sketches, verified links and labels go to the shared folder.
    """
    sk = saved(sketches(docs), "sketches")
    nodes = node_classes(sk, docs)
    classes = saved(nodes.groupBy("label").agg(F.min("rep.doc_id").alias("class_id"), F.sum("n_rows").alias("class_size")), "classes")
    classed = saved(nodes.join(classes, "label").select("d1", "d2", "class_id", "class_size"), "classed")
    full = sk.where("w > 0").select("doc_id", "d1", "d2").join(classed, ["d1", "d2"]).select("doc_id", "class_id", "class_size")
    bare = sk.where("w = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return full.unionByName(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of docs of each class, that of the smallest doc_id (rows without one come last), all columns as they were; rows without words all stay."""
    sk = saved(sketches(docs), "sketches")
    best = node_classes(sk, docs).groupBy("label").agg(F.min("rep").alias("r")).select(F.coalesce("r.doc_id", F.lit(0)).alias("doc"), "r.k1", "r.k2")
    best = saved(best, "kept")
    row = sk.withColumn("doc", F.coalesce("doc_id", F.lit(0)))
    repeated = row.where("w > 0").groupBy(*ROW).agg(F.count("*").alias("n")).where("n > 1").select(*ROW)
    twice = saved(best.join(repeated, ROW, "left_semi"), "repeated")
    once = best.join(twice, ROW, "left_anti").unionByName(row.where("w = 0").select(*ROW))
    own = [f"`{c}`" for c in docs.columns]
    rows = keyed(docs, *own)
    out = rows.join(once, ROW, "left_semi").select(*own)
    if twice.isEmpty():
        return out
    return out.unionByName(rows.join(twice, ROW, "left_semi").dropDuplicates(ROW).select(*own))
