"""Change risk: hunks of a diff against the line ranges of nodes."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kodegraf.operators.relations import check_page
from kodegraf.schema import PLACE

#: Lines of a bucket of the range join.
BUCKET = 64


def hit_nodes(hunks: DataFrame, nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(node_id, hunk_count): hunks that overlap each node's lines, in the same file.

    Files join by path; ranges inside a file meet in buckets of lines. Long
    nodes (over 64 buckets, such as whole files) are few a file and join by path
    alone, so that no range explodes into many buckets.
    """
    h = hunks.select("file_path", F.col("start_line").alias("hs"), F.col("end_line").alias("he")).withColumn("h", F.monotonically_increasing_id())
    n = nodes.select("file_path", "node_id", F.col("start_line").alias("ns"), F.col("end_line").alias("ne"))
    n = n.join(h.select("file_path").distinct(), "file_path", "left_semi")
    buckets = lambda a, b: F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))
    long = F.col("ne") - F.col("ns") > 64 * bucket
    overlap = (F.col("hs") <= F.col("ne")) & (F.col("he") >= F.col("ns"))
    first = F.greatest(F.floor(F.col("hs") / bucket), F.floor(F.col("ns") / bucket))
    near = h.withColumn("b", F.explode(buckets("hs", "he"))).join(n.where(~long).withColumn("b", F.explode(buckets("ns", "ne"))), ["file_path", "b"]).where(overlap & (F.col("b") == first))
    # A whole file is hit by all its hunks: hunks are counted by their range first.
    ranges = h.groupBy("file_path", "hs", "he").agg(F.count("*").alias("c"))
    far = ranges.join(n.where(long), "file_path").where(overlap).groupBy("node_id").agg(F.sum("c").alias("hunk_count"))
    return near.groupBy("node_id").agg(F.count("*").alias("hunk_count")).unionByName(far)


def out_degree(edges: DataFrame) -> DataFrame:
    """(node_id, out_degree) over all edge kinds."""
    return edges.groupBy(F.col("from_node_id").alias("node_id")).agg(F.count("*").alias("out_degree"))


def risks(hunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Hit nodes with risk = hunks x (outgoing edges + 1)."""
    hit = nodes.join(hit_nodes(hunks, nodes), "node_id")
    degree = out_degree(edges.join(hit.select(F.col("node_id").alias("from_node_id")), "from_node_id", "left_semi"))
    return hit.join(degree, "node_id", "left").withColumn("risk", (F.col("hunk_count") * (F.coalesce("out_degree", F.lit(0)) + 1)).cast("double")).drop("out_degree")


def top_risks(hunks: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    check_page(limit, offset)
    return risks(hunks, nodes, edges).orderBy(F.col("risk").desc(), *PLACE).offset(offset).limit(limit)


def changed_ids(hunks: DataFrame, nodes: DataFrame) -> DataFrame:
    ranges = hunks.select("file_path", "start_line", "end_line").distinct()  # how often a range is hit doesn't matter
    return hit_nodes(ranges, nodes).select("node_id").orderBy("node_id")


_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")


def parse_diff(text: str) -> list[tuple[str, int, int]]:
    """(file, first line, last line) of each hunk's new side; a pure deletion covers its line."""
    out, path = [], None
    for line in text.splitlines():
        if line.startswith("+++ "):
            path = line[6:] if line.startswith("+++ b/") else None
        elif path and (m := _HUNK.match(line)):
            start, count = int(m[1]), int(m[2]) if m[2] is not None else 1
            out.append((path, start, max(start + count - 1, start)))
    return out


def diff_hunks(spark: SparkSession, repo_dir: str, base: str, timeout: int = 30) -> DataFrame:
    """Hunks of `git diff base`, from a local checkout on the driver."""
    if base.startswith("-"):
        raise ValueError("a base must not start with a dash")
    text = subprocess.run(["git", "-C", repo_dir, "diff", "--unified=0", "--no-color", base, "--"], capture_output=True, text=True, timeout=timeout, check=True).stdout
    return spark.createDataFrame(parse_diff(text), "file_path string, start_line int, end_line int")
