"""Folder trees, outlines and keyword search in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kodegraf.schema import PLACE

KIND_RANK = ("folder", "package", "file", "class", "type", "function", "test")


def tree(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """id, parent_id, kind, label of folders, files and symbols. Folders are the prefixes of paths, so that no recursion is needed."""
    files = nodes.select("namespace", "file_path").distinct()
    parts = F.split("file_path", "/")
    prefix = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    steps = files.select("namespace", "file_path", F.size(parts).alias("n"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"))
    steps = steps if depth is None else steps.where(F.col("k") <= depth)
    rows = steps.select(
        "namespace", prefix(F.col("k")).alias("id"), F.when(F.col("k") > 1, prefix(F.col("k") - 1)).alias("parent_id"),
        F.when(F.col("k") == F.col("n"), "file").otherwise("folder").alias("kind"), F.element_at(parts, F.col("k")).alias("label"),
    )
    rows = rows.groupBy("namespace", "id", "parent_id", "label").agg(F.min("kind").alias("kind"))
    if depth is not None:
        return rows
    symbols = nodes.where(~F.col("kind").isin("file", "package")).select("namespace", F.concat("file_path", F.lit("#"), "qualified_name").alias("id"), F.col("file_path").alias("parent_id"), F.col("name").alias("label"), "kind")
    return rows.unionByName(symbols)


def sorted_tree(rows: DataFrame) -> DataFrame:
    rank = F.lit(len(KIND_RANK))
    for i, k in reversed(list(enumerate(KIND_RANK))):
        rank = F.when(F.col("kind") == k, i).otherwise(rank)
    return rows.orderBy("namespace", "parent_id", rank, "label", "id")


def describe_file(nodes: DataFrame, path: str) -> DataFrame:
    """Declarations of a file in written order; the file node itself is left out."""
    return nodes.where((F.col("file_path") == path) & ~F.col("kind").isin("file", "package")).orderBy(*PLACE)


def suggestions(nodes: DataFrame, target: str, limit: int = 10) -> DataFrame:
    """Paths that hold the last part of a target that was not found."""
    last = target.rstrip("/").split("/")[-1].lower()
    return nodes.where(F.contains(F.lower("file_path"), F.lit(last))).select("file_path").distinct().orderBy("file_path").limit(limit)


def tree_search(rows: DataFrame, query: str, limit: int) -> DataFrame:
    """The first rows, in depth-first order of ids, whose label holds the query in any case."""
    return rows.where(F.contains(F.lower("label"), F.lit(query.lower()))).orderBy("namespace", "id", "kind").limit(limit)


def nested(rows: list[dict]) -> list[dict]:
    """Rows of tree() as nested dictionaries, for answers."""
    by_id = {(r["namespace"], r["id"]): r | {"children": []} for r in rows}
    roots = []
    for r in by_id.values():
        up = by_id.get((r["namespace"], r["parent_id"]))
        (up["children"] if up else roots).append(r)
    return roots


def rendered_docs(nodes: DataFrame) -> DataFrame:
    """file_path and the Markdown of each source file; files with only a file node are left out."""
    line = F.concat(F.lit("- `"), "qualified_name", F.lit("` ("), "kind", F.lit(", lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"))
    decl = nodes.where(~F.col("kind").isin("file", "package")).select("file_path", F.struct("start_line", "qualified_name", "node_id", line.alias("line")).alias("d"))
    lines = F.transform(F.array_sort(F.collect_list("d")), lambda d: d["line"])
    return decl.groupBy("file_path").agg(F.concat(F.lit("# "), F.first("file_path"), F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("markdown"))


def docs_index(docs: DataFrame) -> DataFrame:
    """index.md: a link to each document, by folder. One row, of as many lines as there are documents."""
    entry = docs.select(F.regexp_replace("file_path", "/?[^/]*$", "").alias("dir"), F.struct("file_path", F.concat(F.lit("- ["), "file_path", F.lit("]("), "file_path", F.lit(")")).alias("line")).alias("e"))
    folder = entry.groupBy("dir").agg(F.concat(F.lit("## "), F.when(F.col("dir") == "", F.lit(".")).otherwise(F.col("dir")), F.lit("\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["line"]), "\n")).alias("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("dir", "text"))), lambda p: p["text"])
    return folder.agg(F.lit("index.md").alias("file_path"), F.concat(F.lit("# Index\n\n"), F.array_join(parts, "\n\n"), F.lit("\n")).alias("markdown"))


def anchor(name):
    """Markdown anchor: lower case, letters, digits and underscores, spaces as dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), " ", "-"), "[^a-z0-9_-]", "")
