"""Mutations as new versions of tables.

Parquet has no MERGE: an operator returns the table's next version, and
replace_namespaces() swaps it in, namespace by namespace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kodegraf.operators.scans import first_of
from kodegraf.schema import CALL_KINDS

NODE_KEY = ["namespace", "qualified_name", "file_path", "start_line"]


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of their key but keep the old id; of several new rows of a key the one of the largest id counts."""
    new = first_of(new, NODE_KEY, [F.col("node_id").desc()])
    kept = old.join(new, NODE_KEY, "left_anti")
    ids = old.select(*NODE_KEY, F.col("node_id").alias("__old"))
    merged = new.join(ids, NODE_KEY, "left").withColumn("node_id", F.coalesce("__old", "node_id")).drop("__old")
    return kept.unionByName(merged)


def upsert_edges(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """New fingerprints are added, the first row of each; known ones stay as they are."""
    first = first_of(new, ["namespace", "fingerprint"], order)
    return old.unionByName(first.join(old, ["namespace", "fingerprint"], "left_anti").select(*old.columns))


def replace_annotations(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Annotations of known nodes replace theirs with all tags; others are refused."""
    known = new.join(nodes.select("node_id"), "node_id", "left_semi")
    return old.join(known.select("node_id"), "node_id", "left_anti").unionByName(known.select(*old.columns))


def delete_files(files: DataFrame, nodes: DataFrame, edges: DataFrame, **of_nodes: DataFrame) -> dict[str, DataFrame]:
    """All tables without the files' nodes and edges, edges at such nodes, and what hangs on them by node_id."""
    f = files.select("file_path").distinct()
    gone = nodes.join(f, "file_path", "left_semi").select("node_id")
    e = edges.join(f, "file_path", "left_anti")
    e = e.join(gone.withColumnRenamed("node_id", "from_node_id"), "from_node_id", "left_anti").join(gone.withColumnRenamed("node_id", "to_node_id"), "to_node_id", "left_anti")
    return {"nodes": nodes.join(f, "file_path", "left_anti"), "edges": e.select(*edges.columns)} | {k: t.join(gone, "node_id", "left_anti") for k, t in of_nodes.items()}


def delete_namespace(namespace: str, **tables: DataFrame) -> dict[str, DataFrame]:
    return {k: t.where(F.col("namespace") != namespace) for k, t in tables.items()}


def delete_package_edges(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Without the implements edges of line 0 that are anchored on the files."""
    a = anchors.select("file_path", F.lit("implements").alias("kind"), F.lit(0).cast("long").alias("line")).distinct()
    return edges.join(a, ["file_path", "kind", "line"], "left_anti").select(*edges.columns)


def parse_cache_misses(files: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Files (file_path, content, context) that no cached result of this parser version and package context covers."""
    keyed = files.withColumn("content_hash", F.sha2("content", 256)).withColumn("context_hash", F.sha2("context", 256)).withColumn("version", F.lit(version))
    return keyed.join(cache, ["file_path", "content_hash", "context_hash", "version"], "left_anti")


def unresolved_index(edges: DataFrame) -> DataFrame:
    """namespace, lookup_hash, fingerprint_hash of edges with a source but no target: by the last part of the text they point at."""
    open_ = edges.where(F.col("from_node_id").isNotNull() & F.col("to_node_id").isNull() & (F.col("kind") != "contains"))
    key = F.regexp_extract("target_text", r"([^.:/]+)$", 1)
    return open_.where(key != "").select("namespace", F.sha2(key, 256).alias("lookup_hash"), F.sha2("fingerprint", 256).alias("fingerprint_hash"))


def replayed(index: DataFrame, added: DataFrame) -> DataFrame:
    """Pending edges that an added node's name may resolve."""
    names = added.select("namespace", F.explode(F.array_distinct(F.array("name", F.regexp_extract("qualified_name", r"([^.:/]+)$", 1)))).alias("k")).select("namespace", F.sha2("k", 256).alias("lookup_hash")).distinct()
    return index.join(names, ["namespace", "lookup_hash"], "left_semi")


def replace_cross_refs(old: DataFrame, new: DataFrame, namespace: str) -> DataFrame:
    return old.where(F.col("from_namespace") != namespace).unionByName(new.where(F.col("from_namespace") == namespace).select(*old.columns))


def refresh_documents(old: DataFrame, rebuilt: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Search documents of the scoped nodes, or of all, rebuilt."""
    return rebuilt if scope is None else old.join(scope.select("node_id"), "node_id", "left_anti").unionByName(rebuilt.join(scope.select("node_id"), "node_id", "left_semi").select(*old.columns))


def affected_nodes(old: DataFrame, new: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Ids, old and new, of changed and deleted files."""
    c, d = changed.select("file_path"), deleted.select("file_path")
    before = old.join(c.union(d).distinct(), "file_path", "left_semi").select("node_id")
    return before.union(new.join(c.distinct(), "file_path", "left_semi").select("node_id")).distinct()


def force_reparse(edges: DataFrame, changed: DataFrame, unchanged_files: DataFrame) -> DataFrame:
    """Unchanged files that own an edge at a changed node."""
    ids = changed.select("node_id").distinct()
    touching = edges.join(ids.withColumnRenamed("node_id", "to_node_id"), "to_node_id", "left_semi").select("file_path").union(edges.join(ids.withColumnRenamed("node_id", "from_node_id"), "from_node_id", "left_semi").select("file_path"))
    return touching.distinct().join(unchanged_files.select("file_path"), "file_path", "left_semi")


def replace_namespaces(table: DataFrame, path: str) -> None:
    """Write the namespaces that the table holds over those at path, leaving others."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace").parquet(path)


def strict_only(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind") != CALL_KINDS[1])
