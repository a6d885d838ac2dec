"""Scans of the graph tables: a filter, a projection and a total order each.

Filters are plain comparisons on columns, so that they reach the Parquet scan;
sets of keys come as DataFrames and become semi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kodegraf.schema import CROSS_REF_KIND, IDENTITY, PLACE
from kodegraf.sources.work import saved


def in_namespaces(df: DataFrame, namespaces: list[str] | None) -> DataFrame:
    return df if namespaces is None else df.where(F.col("namespace").isin(*namespaces))


def node_by_qualified_name(nodes: DataFrame, namespace: str, name: str) -> DataFrame:
    """The node of that name with the lowest id."""
    return nodes.where((F.col("namespace") == namespace) & (F.col("qualified_name") == name)).orderBy("node_id").limit(1)


def nodes_by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("node_id"), "node_id", "left_semi")


def nodes_by_qualified_names(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """qualified_name and all its node ids, ascending."""
    return nodes.join(names.select("qualified_name").distinct(), "qualified_name").groupBy("qualified_name").agg(F.array_sort(F.collect_list("node_id")).alias("node_ids"))


def nodes_by_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    return nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").orderBy(*PLACE)


def file_state(nodes: DataFrame) -> DataFrame:
    """Id, path and hash of everything but packages."""
    return nodes.where(F.col("kind") != "package").select("node_id", "file_path", "hash")


def nodes_of_kinds(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    return nodes.where(F.col("kind").isin(*kinds)).orderBy(*PLACE)


def has_path_prefix(path: Column, prefix: str) -> Column:
    """Segment-aware prefix; the empty one and "." match all."""
    p = prefix.strip("/")
    return F.lit(True) if p in ("", ".") else (path == p) | path.startswith(p + "/")


def subtree(nodes: DataFrame, folder: str, kinds: list[str] | None = None) -> DataFrame:
    found = nodes.where(F.col("file_path").startswith(folder.rstrip("/") + "/"))
    return (found if kinds is None else found.where(F.col("kind").isin(*kinds))).orderBy(*PLACE)


def longest_suffix(nodes: DataFrame, suffix: str) -> DataFrame:
    """File nodes whose directory is the path, else those that share its longest trailing run of segments."""
    parts = [p for p in suffix.split("/") if p]
    tails = ["/".join(parts[i:]) for i in range(len(parts))]
    folder = F.regexp_replace("file_path", "/?[^/]*$", "")
    depth = F.lit(0)
    for i, tail in reversed(list(enumerate(tails))):
        depth = F.when((folder == tail) | folder.endswith("/" + tail), len(tails) - i).otherwise(depth)
    files = nodes.where(F.col("kind") == "file").withColumn("exact", folder == "/".join(parts)).withColumn("depth", depth).where("depth > 0")
    best = files.agg(F.max(F.struct("exact", "depth")).alias("best"))
    return files.join(best, F.when(F.col("best.exact"), F.col("exact")).otherwise(F.col("depth") == F.col("best.depth"))).drop("exact", "depth", "best")


def edges_from(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("node_id").alias("from_node_id")).distinct(), "from_node_id", "left_semi")


def edges_to(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("node_id").alias("to_node_id")).distinct(), "to_node_id", "left_semi")


def with_cross_refs(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """Edges of all namespaces, and resolved references as edges of their own kind."""
    linked = refs.where((F.col("status") == "resolved") & F.col("resolved_node_id").isNotNull())
    extra = linked.select(
        F.col("from_namespace").alias("namespace"), "from_node_id", F.col("resolved_node_id").alias("to_node_id"), F.lit(CROSS_REF_KIND).alias("kind"),
        F.col("to_path").alias("file_path"), F.lit(0).cast("long").alias("line"), F.concat(F.lit("cross_ref:"), F.col("raw")).alias("fingerprint"),
    )
    return edges.select(*extra.columns).unionByName(extra)


def nodes_by_exact_name(nodes: DataFrame, name: str, limit: int) -> DataFrame:
    return nodes.where(F.col("name") == name).dropDuplicates(["node_id"]).orderBy(*PLACE).limit(limit)


def graph_view(nodes: DataFrame, edges: DataFrame, limit: int, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first `limit` nodes by kind and place, and at most four times as many edges between them."""
    some = nodes.orderBy("kind", *PLACE).limit(limit)
    ids = some.select("node_id")
    inner = edges_to(edges_from(edges.where(F.col("kind").isin(*kinds)), ids), ids)
    return some, inner.orderBy("file_path", "line", "fingerprint").limit(4 * limit)


def annotations_of(nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """node_id and its tags (kind, value) in order of their ordinals."""
    mine = tags.join(nodes.select("node_id"), "node_id", "left_semi")
    return mine.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "value"))), lambda t: F.concat(t["kind"], F.lit("="), t["value"])).alias("tags"))


def docs_snapshot(nodes: DataFrame, annotations: DataFrame, kinds: list[str]) -> DataFrame:
    return nodes.where(F.col("kind").isin(*kinds)).join(annotations, "node_id", "left")


def outgoing_doc_edges(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Calls and imports of the given nodes beside the name of their target."""
    mine = edges_from(edges.where(F.col("kind").isin("calls", "imports_from")), ids)
    to = nodes.select(F.col("node_id").alias("to_node_id"), F.col("qualified_name").alias("target"))
    return mine.join(to, "to_node_id").select("from_node_id", "to_node_id", "kind", "target")


def reference_predicate(path: str | None, symbol: str | None) -> Column:
    """What a link to a path, a symbol or both points at."""
    qualified = F.col("qualified_name")
    named = (F.col("name") == symbol) | (qualified == symbol) | qualified.endswith(f".{symbol}") | qualified.endswith(f"::{symbol}") if symbol else F.lit(True)
    if path and symbol:
        return (F.col("file_path") == path) & named
    return has_path_prefix(F.col("file_path"), path) if path else named


def resolve_reference(nodes: DataFrame, path: str | None, symbol: str | None) -> DataFrame:
    """The first node that a link points at: files first."""
    return nodes.where(reference_predicate(path, symbol)).orderBy(F.col("kind") != "file", "node_id").limit(1)


def namespaces(nodes: DataFrame) -> DataFrame:
    return nodes.select("namespace").distinct().orderBy("namespace")


def identity(df: DataFrame | None = None) -> list[Column]:
    return [F.col(c) for c in IDENTITY]


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the first in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def numbered(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Adds each row's number from 1 in the order, which must be total: rows are sorted in ranges, whose sizes tell where each range begins. No task sees all rows."""
    ranges = saved(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    base = ranges.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    number = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.col("__base")
    return ranges.join(base, "__range").withColumn(name, number.cast("long")).drop("__range", "__base")
