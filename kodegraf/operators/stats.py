"""Counts and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kodegraf.schema import CALL_KINDS


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """namespace, n_nodes, n_files (distinct paths), n_edges, strict_calls, fallback_calls, fallback_ratio."""
    n = nodes.groupBy("namespace").agg(F.count("*").alias("n_nodes"), F.countDistinct("file_path").alias("n_files"))
    e = edges.groupBy("namespace").agg(F.count("*").alias("n_edges"), F.count_if(F.col("kind") == "calls").alias("strict_calls"), F.count_if(F.col("kind") == "fallback_calls").alias("fallback_calls"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    both = n.join(e, "namespace", "left").select("namespace", "n_nodes", "n_files", *map(none, ("n_edges", "strict_calls", "fallback_calls")))
    return both.withColumn("fallback_ratio", fallback_ratio(F.col("strict_calls"), F.col("fallback_calls")))


def fallback_ratio(strict: Column, fallback: Column) -> Column:
    return F.coalesce(F.try_divide(fallback.cast("double"), (strict + fallback).cast("double")), F.lit(0.0))


def fallback_level(ratio: Column) -> Column:
    return F.when(ratio <= 0.02, "ok").when(ratio <= 0.10, "watch").otherwise("warn")


def by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def untested(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n_nodes, n_untested of the given nodes."""
    tested = edges.where(F.col("kind") == "tested_by").select(F.col("to_node_id").alias("node_id")).distinct().withColumn("tested", F.lit(1))
    return nodes.select("node_id").distinct().join(tested, "node_id", "left").agg(F.count("*").alias("n_nodes"), (F.count("*") - F.count("tested")).alias("n_untested"))


def coverage(docs: DataFrame, reasons: DataFrame) -> DataFrame:
    """namespace, n_documents, n_reasons, n_explained (nodes with a reason)."""
    d = docs.groupBy("namespace").agg(F.count("*").alias("n_documents"))
    r = reasons.groupBy("namespace").agg(F.count("*").alias("n_reasons"), F.countDistinct("node_id").alias("n_explained"))
    return d.join(r, "namespace", "left").select("namespace", "n_documents", F.coalesce("n_reasons", F.lit(0)).alias("n_reasons"), F.coalesce("n_explained", F.lit(0)).alias("n_explained"))


def unresolved_diagnostics(edges: DataFrame) -> DataFrame:
    """Counts of edges without an end, by kind, by file and by reason, in one pass of grouping sets."""
    lost = edges.where(F.col("from_node_id").isNull() | F.col("to_node_id").isNull())
    reason = F.when(F.col("from_node_id").isNull() & F.col("to_node_id").isNull(), "missing_both").when(F.col("from_node_id").isNull(), "missing_from").otherwise("missing_to")
    sets = lost.withColumn("reason", reason).groupingSets([["kind"], ["file_path"], ["reason"]], "kind", "file_path", "reason").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    dimension = F.when(F.col("g") == 3, "kind").when(F.col("g") == 5, "file").otherwise("reason")
    return sets.select(dimension.alias("dimension"), F.coalesce("kind", "file_path", "reason").alias("value"), "n")


def classify_update(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path and added, modified, skipped or deleted, from (file_path, hash) of both sides."""
    o, n = old.select("file_path", F.col("hash").alias("old")), new.select("file_path", F.col("hash").alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "skipped").otherwise("modified")
    return o.join(n, "file_path", "full").select("file_path", state.alias("state"))


def folder_children(nodes: DataFrame, folder: str) -> DataFrame:
    """child, is_folder, n_files, n_declarations of the immediate children of a folder, nested ones counted in."""
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    inside = nodes.where(F.col("file_path").startswith(prefix)) if prefix else nodes
    rest = F.substring("file_path", len(prefix) + 1, 1 << 20)
    inside = inside.withColumn("part", F.split_part(rest, F.lit("/"), F.lit(1))).withColumn("deep", F.contains(rest, F.lit("/"))).where("part <> ''")
    grouped = inside.groupBy(F.concat(F.lit(prefix), "part").alias("child")).agg(F.bool_or("deep").alias("is_folder"), F.countDistinct("file_path").alias("n_files"), F.count_if(~F.col("kind").isin("file", "package")).alias("n_declarations"))
    return grouped.orderBy(~F.col("is_folder"), "child")


def calls_only(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind").isin(*CALL_KINDS))


def minimal_context(nodes: DataFrame, edges: DataFrame, risk: DataFrame, top: int = 50) -> DataFrame:
    """One row: counts, mean and largest risk of the top rows, level, and untested ones among them."""
    best = risk.orderBy(F.col("risk").desc(), "file_path", "start_line", "qualified_name", "node_id").limit(top)
    tested = edges.where(F.col("kind") == "tested_by").select(F.col("to_node_id").alias("node_id")).distinct().withColumn("tested", F.lit(1))
    r = best.join(tested, "node_id", "left").agg(F.count("*").alias("n_changed"), F.coalesce(F.avg("risk"), F.lit(0.0)).alias("mean_risk"), F.coalesce(F.max("risk"), F.lit(0.0)).alias("max_risk"), (F.count("*") - F.count("tested")).alias("test_gaps"))
    n = nodes.agg(F.count("*").alias("n_nodes"), F.countDistinct("file_path").alias("n_files"))
    e = edges.agg(F.count("*").alias("n_edges"))
    # Three tables of one row each.
    level = F.when(F.col("max_risk") >= 0.7, "high").when(F.col("max_risk") >= 0.4, "medium").otherwise("low")
    one = lambda df: df.withColumn("__k", F.lit(1))
    return one(n).join(one(e), "__k").join(one(r), "__k").withColumn("risk_level", level).drop("__k")
