"""Pattern packing by non-negative least squares.

Texts are tokenised, closed by id 0 and cut into pieces of at most `capacity`
tokens. The histogram of piece lengths (at most `capacity` numbers) is all the
driver sees. On it

1. patterns of up to four lengths, rounded up to a grid, that fill a sequence
   are enumerated, and non-negative least squares fits how often each repeats;
2. the rounded-down repeats are filled with exact lengths, the last of each by
   the length left that fits best;
3. what remains is packed best-fit by descending length, into the gaps that
   patterns left and into new sequences, again by counts of lengths only.

The plan is a list of (lengths, repeats). Pieces get their place by a rank
within their length: ranks are counted in hash buckets first, so that a length
of which there are very many is not ranked in one task.

Edge cases: null and empty texts are pieces of one token, the closing id;
repeated rows get pieces of their own; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kodegraf.llm.common import map_texts, saved, texts_of

CAPACITY = 2048
GRID = 16
MOST_IN_PATTERN = 4
RANK_BUCKETS = 1024
#: Words whose ids are kept, in each of two generations: the older one goes when the newer is full, but for words met again.
_CACHE_MAX = 350_000
#: Texts of these characters only are normalised by lower case alone, so that words can be looked up.
_PLAIN = regex.compile("[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u012f\\u0131-\\u017f]*")
_PLAIN_CHARS = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x180))]
_CLASS = {k: re.escape("".join(c for c in _PLAIN_CHARS if unicodedata.category(c)[0] == k and c == c.lower())) for k in "LN"}
#: The tokenizer's own pattern (fixed value), with letters and numbers spelled out, as it need only hold for such texts in lower case.
_WORD = re.compile(rf"[{_CLASS['L']}]+|'(?:s|t|re|ve|m|ll|d)|[{_CLASS['N']}]|[^\s{_CLASS['L']}{_CLASS['N']}]+")


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a text, as packed little-endian unsigned 32-bit numbers closed by id 0."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.fullmatch(text):
            return self._ids(text) + b"\0\0\0\0"
        if len(self.known) > _CACHE_MAX:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        words = _WORD.findall(text.lower())
        found = list(map(known.get, words))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    w = words[i]
                    if w not in known:
                        known[w] = older.get(w) or self._ids(w)
                    found[i] = known[w]
        found.append(b"\0\0\0\0")
        return b"".join(found)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of each piece."""
    path = path or public_path()

    def make():
        encode = encoder(path)

        def run(batch):
            out = defaultdict(list)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                raw = encode(text)
                for k, i in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[i : i + 4 * capacity]
                    for name, x in (("doc_id", doc_id), ("piece", k), ("start", i // 4), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part))):
                        out[name].append(x)
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            return out

        return run

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return map_texts(docs, make, schema, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")])


def patterns(bins: int, most: int) -> np.ndarray:
    """All descending tuples of 1..bins with the sum bins and at most `most` parts, padded by zeros."""
    rows = np.array([[a, *[0] * (most - 1), bins - a] for a in range(1, bins + 1)])
    done = [rows[rows[:, -1] == 0][:, :most]]
    open_ = rows[rows[:, -1] > 0]
    for k in range(1, most):
        last, rest = open_[:, k - 1], open_[:, -1]
        reps = np.minimum(last, rest)
        if k == most - 1:  # the last part takes all that is left
            keep = rest <= last
            closed = open_[keep].copy()
            closed[:, k], closed[:, -1] = rest[keep], 0
            done.append(closed[:, :most])
            break
        grown = np.repeat(open_, reps, axis=0)
        part = np.concatenate([np.arange(1, r + 1) for r in reps]) if len(reps) else np.zeros(0, int)
        grown[:, k] = part
        grown[:, -1] -= part
        done.append(grown[grown[:, -1] == 0][:, :most])
        open_ = grown[grown[:, -1] > 0]
    return np.concatenate(done)


def nonnegative_least_squares(a: np.ndarray, y: np.ndarray, steps: int = 200) -> np.ndarray:
    """x >= 0 that nearly minimises |a x - y|, by accelerated projected gradients."""
    lip = float(np.linalg.norm(a, 2)) ** 2
    x = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, z - a.T @ (a @ z - y) / lip)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = GRID) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that together hold the histogram exactly."""
    left = {n: c for n, c in histogram.items() if c > 0}
    ready = [((capacity,), left.pop(capacity))] if capacity in left else []
    gaps: dict[int, list[list]] = defaultdict(list)  # free tokens -> [repeats, lengths]
    bins = capacity // grid
    by_bin: dict[int, list[int]] = defaultdict(list)
    for n in sorted(left):
        by_bin[-(-n // grid)].append(n)
    y = np.array([sum(left[n] for n in by_bin[b]) for b in range(1, bins + 1)], float)
    lengths_up = sorted(left)
    if y.sum():
        rows = patterns(bins, MOST_IN_PATTERN)
        rows = rows[[all(b == 0 or y[b - 1] for b in r) for r in rows.tolist()]]
        a = np.zeros((bins, len(rows)))
        for k in range(rows.shape[1]):
            on = rows[:, k] > 0
            np.add.at(a, (rows[on, k] - 1, np.flatnonzero(on)), 1)
        repeats = np.floor(nonnegative_least_squares(a, y) if len(rows) else np.zeros(0)).astype(int)
        for p in np.argsort(-repeats, kind="stable"):
            todo = int(repeats[p])
            while todo > 0:
                used: dict[int, int] = defaultdict(int)
                parts = [b for b in rows[p] if b]
                for b in parts[:-1]:
                    n = next((n for n in reversed(by_bin[b]) if left[n] > used.get(n, 0)), None)
                    if n is None:
                        break
                    used[n] += 1
                else:  # the last part is the length left that fills the sequence best
                    free = capacity - sum(n * c for n, c in used.items())
                    n = next((n for n in reversed(lengths_up[: bisect_right(lengths_up, free)]) if left[n] > used.get(n, 0)), None)
                    if n is None:
                        break
                    used[n] += 1
                    times = min(todo, *(left[n] // c for n, c in used.items()))
                    if times == 0:
                        break
                    for n, c in used.items():
                        left[n] -= c * times
                    lengths = tuple(n for n, c in sorted(used.items(), reverse=True) for _ in range(c))
                    gaps[capacity - sum(lengths)].append([times, lengths])
                    todo -= times
                    lengths_up = [n for n in lengths_up if left[n]] if any(not left[n] for n in used) else lengths_up
                    continue
                break
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            free = min((g for g in gaps if g >= n and gaps[g]), default=None)
            if free is None:
                times, lengths, free = c, (), capacity
            else:
                times, lengths = gaps[free].pop()
            fit = free // n
            full = min(times, c // fit)
            if full:
                gaps[free - fit * n].append([full, lengths + (n,) * fit])
                c -= full * fit
            if full < times and c and c < fit:
                gaps[free - c * n].append([1, lengths + (n,) * c])
                c, full = 0, full + 1
            if full < times and lengths:
                gaps[free].append([times - full, lengths])
    return ready + [(tuple(lengths), times) for g in sorted(gaps) for times, lengths in gaps[g]]


def _slots(made: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Of each run of ranks of a length: its first key (length << 44 | rank), first sequence and offset."""
    at: dict[int, int] = defaultdict(int)
    keys, first, offset, base = [], [], [], 0
    for lengths, times in made:
        o = 0
        for n in lengths:
            keys.append(n << 44 | at[n])
            first.append(base)
            offset.append(o)
            at[n] += times
            o += n
        base += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (keys, first, offset))


def ranked(cut: DataFrame, buckets: int = RANK_BUCKETS) -> DataFrame:
    """Adds rank: a number from 0 within rows of the same length, gapless."""
    # The checksum spreads pieces without a doc_id.
    rows = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    return rows.withColumn("inside", inside).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("inside") - 1).drop("bucket", "base", "inside")


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that are already written out (they are read twice)."""
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # Runs of ranks: their number follows the number of lengths, not of rows.
    slots = cut.sparkSession.sparkContext.broadcast(_slots(plan(histogram, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        keys, first, offset = slots.value
        want = length.to_numpy() << 44 | rank.to_numpy()
        i = np.searchsorted(keys, want, side="right") - 1
        return pd.DataFrame({"sequence_id": first[i] + want - keys[i], "offset": offset[i]} if len(want) else {"sequence_id": [], "offset": []}).astype("int64")

    # Only two numbers of a piece go through Python; its ids stay where they are.
    return ranked(cut).withColumn("place", place("length", "rank")).select(*cut.columns, "place.sequence_id", "place.offset")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids: the tokens of each piece."""
    return placed(saved(pieces(docs, path, capacity, with_ids), "pieces"), capacity)
