"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, document after document, are packed into blocks of a
fixed number of words. Each output shard draws multinomial counts of sources,
slot by slot, with the targets as probabilities. A slot's number within its
source goes through a pseudorandom permutation of the source's block numbers
(a new one for each pass over the source), and blocks join slots by number.

Plain multinomial counts would miss the targets by their sampling error. So
slots drawn beyond a source's quota of blocks are handed to the sources drawn
too seldom: counts of a shard stay random, totals are exact. A source at its cap
of twice its size is read exactly twice.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and
share 150 % of all words; a source stops at twice its size and what it can't
take is shared again by weight among the others.

All numbers come from hashes of numbers, so that reruns agree. Equal rows are
laid out as one run of copies, others through hash buckets of their content
with summed offsets, and slots in pieces of a bounded number, dealt evenly: no
source, and no doc_id (or none), is handled in one task. Only the list of
sources, a row each, is sorted in one task.

Edge cases: null texts and texts without words have size 0 and nothing is taken
of them; a null source is a source of its own; repeated rows, and rows
without a doc_id, are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kodegraf.llm.common import saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
#: Words in a block.
BLOCK = 64
#: Slots of an output shard.
SHARD = 16_384
BUCKETS = 1024
CELLS = 1024
#: Slots that are made from one row, and slots of a task.
PIECE = 2048
TASK_SLOTS = 1 << 18
#: Shards whose counts are summed together before offsets.
SPAN = 1024
ROUNDS = 12
SEED = 2024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Adds weight, target and sid (number in code-point order, null last) to (source, source_size).

    With x = target / weight the capped sources are those of the smallest
    cap / weight; a running sum over this order finds the common level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("sid", F.row_number().over(by_name) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(MOST_PASSES)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, after, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(every) * F.lit(SHARE) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The level rises while the sources before are rightly capped, and falls after.
    fair = F.max("level").over(every)
    return w.withColumn("target", F.least(F.col("cap"), fair * F.col("weight"))).drop("cap", "level")


def permuted(x: Column, n: Column, key: Column) -> Column:
    """x in [0, n) under a permutation chosen by key: rounds of swap-or-not."""

    def turn(acc: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r, F.lit(SEED)), n) - acc, n)
        return F.when(F.xxhash64(F.greatest(acc, other), key, r) < 0, other).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x, turn)


def located(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, total: Column) -> DataFrame:
    """points joined to the interval [low, high) of [0, total) that holds `at`: an equi-join on cells."""
    cell = lambda v: F.floor(v * F.lit(CELLS) / total)
    cut = intervals.where(F.col(low) < F.col(high)).withColumn("cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high) - 1))))
    return points.withColumn("cell", cell(F.col(at))).join(cut, "cell").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("cell")


def layout(rows: DataFrame) -> DataFrame:
    """Adds start, the words before the copies in their source, to rows (k1, k2, size, copies, sid, ...)."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("k1", "k2", F.lit(SEED)), F.lit(BUCKETS))).withColumn("extent", F.col("size") * F.col("copies"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("sid", "bucket").agg(F.sum("extent").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("sid", "bucket").orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum("extent").over(inside), F.lit(0))).join(base, ["sid", "bucket"]).withColumn("start", F.col("base") + F.col("inside")).drop("bucket", "base", "inside", "extent")


def slots(plan: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """shard, sid, block, pass: the blocks that the mix holds, from (sid, source_size, target)."""
    n = F.ceil(F.col("source_size") / F.lit(block))
    p = plan.where("source_size > 0").select("sid", n.alias("n"), F.least(F.lit(MOST_PASSES) * n, F.when(F.col("target") >= MOST_PASSES * F.col("source_size"), F.lit(MOST_PASSES) * n).otherwise(F.round(F.col("target") / block))).cast("long").alias("quota"))
    upto, every = Window.orderBy("sid"), Window.partitionBy()
    p = saved(p.withColumn("high", F.sum("quota").over(upto)).withColumn("low", F.col("high") - F.col("quota")).withColumn("total", F.sum("quota").over(every)), "quotas")
    total = p.agg(F.max("total").alias("total"))
    spark = plan.sparkSession
    n_slots = int(total.first().total or 0)
    # One draw a slot: the counts of a shard are multinomial.
    drawn = spark.range(n_slots).select((F.col("id") / shard).cast("long").alias("shard"), F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(max(1, n_slots))).alias("u"))
    counts = located(drawn, "u", p.select("sid", "low", "high"), "low", "high", F.lit(max(1, n_slots))).groupBy("shard", "sid").agg(F.count("*").alias("c"))
    counts = saved(counts.withColumn("span", F.floor(F.col("shard") / SPAN)), "draws")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.groupBy("sid", "span").agg(F.sum("c").alias("c")).select("sid", "span", F.coalesce(F.sum("c").over(before("sid", "span")), F.lit(0)).alias("base"))
    counts = counts.withColumn("inside", F.coalesce(F.sum("c").over(before("sid", "span", "shard")), F.lit(0))).join(spans, ["sid", "span"]).withColumn("first", F.col("base") + F.col("inside"))
    got = p.join(counts.groupBy("sid").agg(F.sum("c").alias("got")), "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    got = got.withColumn("lack", F.greatest(F.col("quota") - F.col("got"), F.lit(0))).withColumn("over", F.greatest(F.col("got") - F.col("quota"), F.lit(0)))
    got = got.withColumn("lack_high", F.sum("lack").over(upto)).withColumn("lack_low", F.col("lack_high") - F.col("lack")).withColumn("over_low", F.sum("over").over(upto) - F.col("over"))
    got = saved(got, "quotas")
    piece = counts.join(got, "sid").select("shard", "sid", "n", "quota", "over_low", "first", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(PIECE).cast("long"))).alias("at"))
    # As many tasks as the slots ask for: their number is not to be read off the few bytes of the pieces.
    piece = piece.repartition(max(spark.sparkContext.defaultParallelism, -(-n_slots // TASK_SLOTS)), "sid", "shard", "at")
    one = piece.select("shard", "sid", "n", "quota", "over_low", F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.least(F.col("c"), F.col("at") + PIECE) - 1)).alias("k"))
    kept = one.where("k < quota").select("shard", "sid", "n", "k")
    lacking = got.agg(F.sum("lack").alias("x")).first().x or 0
    moved = located(one.where("k >= quota").select("shard", (F.col("over_low") + F.col("k") - F.col("quota")).alias("o")), "o", got.select("sid", "n", "got", "lack_low", "lack_high"), "lack_low", "lack_high", F.lit(max(1, int(lacking))))
    moved = moved.select("shard", "sid", "n", (F.col("got") + F.col("o") - F.col("lack_low")).alias("k"))
    every_slot = kept.unionByName(moved).withColumn("pass", F.floor(F.col("k") / F.col("n"))).withColumn("x", F.col("k") % F.col("n"))
    return every_slot.select("shard", "sid", "pass", permuted(F.col("x"), F.col("n"), F.xxhash64("sid", "pass")).alias("block"))


#: What tells rows apart: a hash of 128 bits of doc_id, source and text.
ROW = ["k1", "k2"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the columns of ROW beside its own."""
    told = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")]
    return docs.select(*[f"`{c}`" for c in docs.columns], F.xxhash64(*told).alias("__k1"), F.xxhash64(F.lit(1), *told).alias("__k2"))


def mixed(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(rows, parts): rows doc_id, source, size, k1, k2, copies, source_size, target, sid, start; parts sid, start, shard, pass, first, n.

    Rows has a row for each row of docs; equal ones have the same key (k1, k2)
    and their number in copies. A part is a run of n words of a document, from
    its word number `first` on, that the mix holds in a shard.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2"))
    base = saved(base.groupBy("doc_id", "source", "size", *ROW).agg(F.count("*").alias("copies")), "sizes")
    plan = saved(targets(base.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))), "targets")
    placed = base.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "weight")
    rows = saved(layout(placed).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("copy"), "layout")
    b = rows.where("size > 0").select("sid", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    low, high = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    b = b.select("sid", "start", "block", (low - F.col("start")).alias("first"), (high - low).alias("n"))
    return rows, b.join(slots(plan, block, shard), ["sid", "block"]).select("sid", "start", "shard", "pass", "first", "n")


def mix_report(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of docs."""
    rows, parts = mixed(keyed(docs.select("doc_id", "source", "text")), block, shard)
    taken = parts.groupBy("sid", "start").agg(F.sum("n").alias("taken"))
    some = rows.where("size > 0").join(taken, ["sid", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return some.unionByName(rows.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix as documents with the columns of docs: a row for each row of docs and pass with its taken words.

    Rows of equal doc_id, source and text share their other columns, those of
    one of them. A document of which a pass takes all words keeps its text as it is; of
    others the taken words, in order, are joined by spaces. n_chars, if there,
    follows the text.
    """
    own, names = docs.columns, [f"__{i}" for i in range(len(docs.columns))]
    held = keyed(docs)
    rows, parts = mixed(held, block, shard)
    runs = parts.groupBy("sid", "start", "pass").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("runs"), F.sum("n").alias("taken"))
    got = saved(rows.where("size > 0").join(runs, ["sid", "start"]).select(*ROW, "copies", "runs", (F.col("taken") == F.col("size")).alias("whole")), "runs")
    held = held.toDF(*names, *ROW)
    # The words of a text are split once, not once a run: as the item of an array they are a variable of the lambda.
    text = F.col(names[own.index("text")]).cast("string")
    words = F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    cut = F.transform(words, lambda w: F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(w, (r["first"] + 1).cast("int"), r["n"].cast("int")))), " "))[0]

    def read(h: DataFrame, r: DataFrame) -> DataFrame:
        out = h.join(r, ROW).withColumn("__text", F.when(F.col("whole"), text).otherwise(cut))
        made = {"text": F.col("__text"), "n_chars": F.length("__text").cast(docs.schema["n_chars"].dataType) if "n_chars" in own else None}
        return out.select(*[made.get(c, F.col(x)).alias(c) for c, x in zip(own, names)])

    out, twice = read(held, got.where("copies = 1")), got.where("copies > 1")
    if twice.isEmpty():
        return out
    hashed = [F.col(x) for x, f in zip(names, docs.schema) if "map<" not in f.dataType.simpleString()]
    one = held.join(twice.select(*ROW).distinct(), ROW, "left_semi").groupBy(*ROW).agg(F.min_by(F.struct(*names), F.xxhash64(*hashed)).alias("row"))
    return out.unionByName(read(one.select(*ROW, "row.*"), twice))
