"""Bounded traversal as a loop of joins, one level a turn.

The state is a table of (source, node_id, depth, ordinal): one loop serves any
number of sources. Each level is written to the shared folder, so that lineage
stays short and lost executors cost a level at most. The loop ends at an empty
frontier, which is its only action besides the writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kodegraf.operators.scans import first_of
from kodegraf.schema import CALL_KINDS
from kodegraf.sources.work import saved


def _levels(starts: DataFrame, step, max_depth: int | None, order: list[str], max_nodes: int | None = None) -> DataFrame:
    """source, node_id, depth, ordinal (from 0, in visit order of each source).

    step(frontier) gives (source, node_id, *order) of all neighbours. A node is
    placed by its first discovery in `order`. With max_nodes a source stops
    when it has more than that.
    """
    level = saved(starts.select("source", "node_id").distinct().select("source", "node_id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ordinal")), "level")
    seen, depth = level, 0
    while (max_depth is None or depth < max_depth) and not level.isEmpty():
        depth += 1
        found = step(level)
        new = first_of(found.join(seen.select("source", "node_id"), ["source", "node_id"], "left_anti"), ["source", "node_id"], order)
        # Ordinals rise from level to level: the last one holds the largest so far.
        base = level.groupBy("source").agg(F.max("ordinal").alias("base"))
        rank = F.row_number().over(Window.partitionBy("source").orderBy(*order, "node_id"))
        ranked = new.withColumn("rank", rank)
        if max_nodes is not None:
            base = base.where(F.col("base") <= max_nodes)
            ranked = ranked.where(F.col("rank") <= max_nodes + 1)  # a constant limit applies before the shuffle
        level = saved(ranked.join(base, "source").select("source", "node_id", F.lit(depth).alias("depth"), (F.col("base") + F.col("rank")).alias("ordinal")), "level")
        seen = seen.unionByName(level)
    return seen


def impact(edges: DataFrame, starts: DataFrame, depth: int, max_depth: int = 3, max_nodes: int = 200) -> DataFrame:
    """source, node_id, depth, ordinal, truncated: undirected reach over all edge kinds.

    In a level outgoing edges come first, then incoming ones, each by place of
    the edge. Members are the first max_nodes in visit order, the start included.
    """
    e = edges.select("from_node_id", "to_node_id", "file_path", "line", "fingerprint")
    order = ["side", "file_path", "line", "fingerprint"]

    def step(level: DataFrame) -> DataFrame:
        at = level.select("source", F.col("node_id").alias("at"))
        out = at.join(e, at["at"] == e.from_node_id).select("source", F.col("to_node_id").alias("node_id"), F.lit(0).alias("side"), *order[1:])
        into = at.join(e, at["at"] == e.to_node_id).select("source", F.col("from_node_id").alias("node_id"), F.lit(1).alias("side"), *order[1:])
        return out.unionByName(into)

    return capped(_levels(starts, step, min(depth, max_depth), order, max_nodes), max_nodes)


def flows(edges: DataFrame, starts: DataFrame, kinds: tuple[str, ...] = CALL_KINDS, max_nodes: int | None = 200, max_depth: int | None = None) -> DataFrame:
    """source, node_id, depth, ordinal, truncated: directed reach over calls.

    A level follows its frontier in order, and the edges of each node by place.
    """
    e = edges.where(F.col("kind").isin(*kinds)).select("from_node_id", "to_node_id", "file_path", "line", "fingerprint")
    order = ["parent", "file_path", "line", "fingerprint"]

    def step(level: DataFrame) -> DataFrame:
        at = level.select("source", F.col("node_id").alias("at"), F.col("ordinal").alias("parent"))
        return at.join(e, at["at"] == e.from_node_id).select("source", F.col("to_node_id").alias("node_id"), *order)

    return capped(_levels(starts, step, max_depth, order, max_nodes), max_nodes)


def reach(edges: DataFrame, starts: DataFrame, kinds: tuple[str, ...] = CALL_KINDS, within: DataFrame | None = None) -> DataFrame:
    """source, node_id, depth of all that calls lead to from the starts: flows() without an order or a limit.

    For the sources of a whole graph. Where called nodes are no more than the
    starts, the reach of each called node is found once, and a start joins
    those of the nodes that it calls; else levels are followed from the starts.
    within (node_id) keeps only these members. The edges are read several
    times, so they should be stored ones.
    """
    pairs = edges.where(F.col("kind").isin(*kinds)).select(F.col("from_node_id").alias("source"), F.col("to_node_id").alias("node_id"))
    starts = starts.select("source", "node_id").distinct()
    if _called(pairs).count() > starts.count():
        found = _levels_of_pairs(pairs, starts)
        return found if within is None else found.join(within.select("node_id").distinct(), "node_id", "left_semi").select("source", "node_id", "depth")
    below, own = _closure(pairs).withColumn("depth", F.col("depth") + 1), starts.withColumn("depth", F.lit(0))
    if within is not None:
        within = saved(within.select("node_id").distinct(), "within")
        below, own = (t.join(within, "node_id", "left_semi").select("source", "node_id", "depth") for t in (below, own))
    below = saved(below, "below")
    of_each = below.groupBy("source").agg(F.count("*").alias("n"))
    mean, most = of_each.agg(F.avg("n"), F.max("n")).first()
    # Sets of a called node travel as arrays, in pieces of about 4096 nodes.
    pieces = -(-(most or 1) // 4096)
    piece = F.pmod(F.xxhash64("node_id"), F.lit(pieces)).cast("int").alias("piece")
    sets = below.groupBy(F.col("source").alias("called"), piece).agg(F.collect_list(F.struct("node_id", "depth")).alias("set"))
    sets = saved(sets.select("called", "piece", F.col("set.node_id").alias("nodes"), F.col("set.depth").alias("depths")), "sets")
    calls = starts.join(pairs.select(F.col("source").alias("node_id"), F.col("node_id").alias("called")), "node_id").select("source", "called")
    rows = calls.join(sets, "called").select("source", "piece", "nodes", "depths")
    rows = rows.unionByName(own.select("source", piece, F.array("node_id").alias("nodes"), F.array("depth").alias("depths")))
    if not pairs.where("node_id is null").isEmpty() and within is None:
        none = calls.where("called is null").select("source", F.lit(None).cast("long").alias("node_id"), F.lit(1).alias("depth"))
        rows = rows.unionByName(none.select("source", piece, F.array("node_id").alias("nodes"), F.array("depth").alias("depths")))
    # Pieces of a source meet in one of many small partitions, whose groups fit a hash table.
    parts = int(pairs.count() * (mean or 1)) // 1_500_000 + edges.sparkSession.sparkContext.defaultParallelism
    by = ["source", "piece"] if pieces > 1 else ["source"]
    one = rows.repartition(min(parts, 20_000), *by).select(*by, "depths", F.posexplode("nodes").alias("at", "node_id"))
    return one.groupBy(*by, "node_id").agg(F.min(F.col("depths")[F.col("at")]).alias("depth")).select("source", "node_id", "depth")


def _called(pairs: DataFrame) -> DataFrame:
    return pairs.where("node_id is not null").select("node_id").distinct()


def _unseen(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs that are not in seen; a missing node is one node."""
    s = seen.select(F.col("source").alias("s"), F.col("node_id").alias("n"))
    return found.join(s, (F.col("source") == F.col("s")) & F.col("node_id").eqNullSafe(F.col("n")), "left_anti")


def _levels_of_pairs(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    level = saved(starts.withColumn("depth", F.lit(0)), "level")
    seen, depth, step = level, 0, pairs.select(F.col("source").alias("at"), F.col("node_id").alias("to"))
    while not level.isEmpty():
        depth += 1
        found = level.join(step, F.col("node_id") == F.col("at")).select("source", F.col("to").alias("node_id")).distinct()
        level = saved(_unseen(found, seen).withColumn("depth", F.lit(depth)), "level")
        seen = seen.unionByName(level)
    return seen


def _closure(pairs: DataFrame) -> DataFrame:
    """source, node_id, depth of all called nodes, themselves included.

    Pairs known up to a depth extend those of exactly that depth, which doubles
    it a turn. Where that would form many more rows than it finds, a turn goes
    on by one level.
    """
    called = saved(_called(pairs), "called")
    own = called.select(F.col("node_id").alias("source"), "node_id", F.lit(0).alias("depth"))
    inner = pairs.join(called.withColumnRenamed("node_id", "source"), "source", "left_semi").where(~F.col("source").eqNullSafe(F.col("node_id")))
    known = last = saved(inner.distinct().withColumn("depth", F.lit(1)), "closure")
    depth = 1
    while True:
        far = last.where(F.col("depth") == depth)
        fan = known.groupBy(F.col("source").alias("node_id")).agg(F.count("*").alias("all"), F.count_if(F.col("depth") == 1).alias("near"))
        far_n = far.groupBy("node_id").agg(F.count("*").alias("n"))
        doubled, single = far_n.join(fan, "node_id").agg(F.sum(F.col("n") * F.col("all")), F.sum(F.col("n") * F.col("near"))).first()
        if not single:
            return own.unionByName(known)
        more = depth if doubled <= 4 * (known.count() + single) else 1
        step = known.where(F.col("depth") <= more).select(F.col("source").alias("at"), F.col("node_id").alias("to"), F.col("depth").alias("further"))
        found = far.join(step, F.col("node_id") == F.col("at")).groupBy("source", F.col("to").alias("node_id")).agg((F.min("further") + depth).alias("depth"))
        last = saved(_unseen(found.where(~F.col("source").eqNullSafe(F.col("node_id"))), known), "closure")
        known, depth = known.unionByName(last), depth + more


def capped(seen: DataFrame, max_nodes: int | None) -> DataFrame:
    """The first max_nodes of each source; truncated says that there were more."""
    if max_nodes is None:
        return seen.withColumn("truncated", F.lit(False))
    most = seen.groupBy("source").agg((F.max("ordinal") >= max_nodes).alias("truncated"))
    return seen.where(F.col("ordinal") < max_nodes).join(most, "source")


def flow_tables(nodes: DataFrame, reach: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flows, members) of a reach: one flow a source, members with the namespace of their own node."""
    head = reach.where("ordinal = 0").select(F.col("source").alias("flow_id"))
    made = head.join(nodes.select(F.col("node_id").alias("flow_id"), "name", "namespace"), "flow_id")
    members = reach.select(F.col("source").alias("flow_id"), "node_id", "ordinal").join(nodes.select("node_id", "namespace"), "node_id")
    return made, members
