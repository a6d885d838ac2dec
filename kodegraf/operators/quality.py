"""Documentation lint, deduplication and uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kodegraf.operators.scans import first_of

CATEGORIES = ("orphan", "missing", "stale", "unannotated", "contradiction", "dead_ref", "incomplete", "drifted")


def orphans(doc_files: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents of files that are no more."""
    return doc_files.select("file_path").distinct().join(sources.select("file_path"), "file_path", "left_anti")


def missing(doc_files: DataFrame, sources: DataFrame) -> DataFrame:
    """Source files without a document."""
    return sources.select("file_path").distinct().join(doc_files.select("file_path"), "file_path", "left_anti")


def stale(doc_files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files whose document is older than their newest node, in whole seconds: (file_path, time) on both sides."""
    d = doc_files.groupBy("file_path").agg(F.min("time").alias("doc_time"))
    s = sources.groupBy("file_path").agg(F.max("time").alias("source_time"))
    return d.join(s, "file_path").where("doc_time < source_time")


def unannotated(nodes: DataFrame, annotations: DataFrame) -> DataFrame:
    return nodes.join(annotations, "node_id", "left_anti")


def incomplete(annotations: DataFrame) -> DataFrame:
    """Annotations without an intent."""
    return annotations.where(F.col("intent").isNull() | (F.trim("intent") == ""))


def drifted(nodes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotated nodes that are newer than their annotation: node_id and updated_at on both sides."""
    a = annotations.select("node_id", F.col("updated_at").alias("annotated_at"))
    return nodes.join(a, "node_id").where("updated_at > annotated_at").select("node_id")


def contradictions(nodes: DataFrame, annotations: DataFrame, tags: DataFrame) -> DataFrame:
    """Drifted nodes whose annotation tells parameters."""
    return drifted(nodes, annotations).join(tags.where(F.col("kind") == "param"), "node_id", "left_semi")


def dead_refs(refs: DataFrame) -> DataFrame:
    return refs.where(F.col("status") == "dead")


def without_ignored(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings (category, subject) that no rule (category, pattern) matches; * in a pattern stands for any run, the category * for all."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("pattern", r"([.+?^$(){}|\[\]\\])", r"\\$1"), r"\*", ".*"), F.lit("$"))
    r = rules.select(F.col("category").alias("rc"), pattern.alias("rx"))
    # Rules are a short list; all of them are tried on each finding.
    tried = r.agg(F.collect_list(F.struct("rc", "rx")).alias("rules"))
    hit = F.exists("rules", lambda x: ((x["rc"] == "*") | (x["rc"] == F.col("category"))) & F.rlike("subject", x["rx"]))
    return findings.join(F.broadcast(tried), F.lit(True)).where(~F.coalesce(hit, F.lit(False))).drop("rules")


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return first_of(rows, keys, order)


def unique_values(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and value where exactly one distinct value exists."""
    return rows.groupBy(*keys).agg(F.countDistinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")


def merge_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols of equal file, name and lines become one, a class if any is one; of overlapping ones of a name the earlier start stays.

    A symbol goes if an earlier one of its file and name reaches into it: a
    running maximum of ends, so that no pairs are formed.
    """
    from pyspark.sql import Window

    one = symbols.groupBy("file_path", "name", "start_line", "end_line").agg(F.when(F.bool_or(F.col("kind") == "class"), "class").otherwise(F.min("kind")).alias("kind"))
    w = Window.partitionBy("file_path", "name").orderBy("start_line", F.col("end_line").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return one.withColumn("reach", F.max("end_line").over(w)).where(F.col("reach").isNull() | (F.col("reach") < F.col("start_line"))).drop("reach")


def deleted_files(existing: DataFrame, current: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Known files that are neither there nor merely unreadable."""
    return existing.select("file_path").distinct().join(current.unionByName(unreadable).select("file_path"), "file_path", "left_anti")


def prunable(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Generated documents that are no longer made; hand-written ones stay."""
    return previous.where("generated").select("file_path").join(current.select("file_path"), "file_path", "left_anti")


def summary(index: Column, intent: Column, text: Column) -> Column:
    """What stands for a node: its index tag, else its intent, else its summary."""
    full = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(full(index), full(intent), full(text))
