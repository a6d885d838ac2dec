"""The driver's tables seen as a code graph.

Each view is one SELECT that Spark and DuckDB both understand, with the names of
its inputs in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

T = 1_000_000_000_000

NODES = f"""
SELECT CAST({T} + r_regionkey AS BIGINT) AS node_id, 'geo' AS namespace, 'package' AS kind, r_name AS name,
  concat('geo.', r_name) AS qualified_name, concat('geo/', r_name) AS file_path, CAST(1 AS BIGINT) AS start_line, CAST(1 AS BIGINT) AS end_line
FROM {{region}}
UNION ALL
SELECT CAST({2 * T} + n_nationkey AS BIGINT), 'geo', 'file', n_name, concat('geo/', r_name, '/', n_name), concat('geo/', r_name, '/', n_name), CAST(1 AS BIGINT), CAST(1000000 AS BIGINT)
FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
UNION ALL
SELECT CAST({3 * T} + s_suppkey AS BIGINT), 'geo', 'class', s_name, concat('geo.', n_name, '.', s_name), concat('geo/', r_name, '/', n_name), CAST(10 * s_suppkey + 1 AS BIGINT), CAST(10 * s_suppkey + 9 AS BIGINT)
FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
UNION ALL
SELECT CAST({4 * T} + c_custkey AS BIGINT), 'geo', 'type', c_name, concat('geo.', n_name, '.', c_name), concat('geo/', r_name, '/', n_name), CAST(500000 + 10 * c_custkey + 1 AS BIGINT), CAST(500000 + 10 * c_custkey + 9 AS BIGINT)
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
UNION ALL
SELECT CAST({5 * T} + p_partkey AS BIGINT), 'catalog', 'function', p_name, concat('catalog.', p_brand, '.P', CAST(p_partkey AS VARCHAR(20))), concat('catalog/', p_type, '/', p_brand), CAST(10 * p_partkey + 1 AS BIGINT), CAST(10 * p_partkey + 9 AS BIGINT)
FROM {{part}}
UNION ALL
SELECT CAST({6 * T} + o_orderkey AS BIGINT), 'catalog', 'test', concat('O', CAST(o_orderkey AS VARCHAR(20))), concat('catalog.tests.O', CAST(o_orderkey AS VARCHAR(20))), concat('catalog/tests/', o_orderpriority), CAST(10 * o_orderkey + 1 AS BIGINT), CAST(10 * o_orderkey + 9 AS BIGINT)
FROM {{orders}}
"""

_ORDER = "concat('catalog/tests/', o_orderpriority)"
_NATION = "concat('geo/', r_name, '/', n_name)"

RAW_EDGES = f"""
SELECT 'catalog' AS namespace, CAST({6 * T} + l_orderkey AS BIGINT) AS from_node_id, CAST({5 * T} + l_partkey AS BIGINT) AS to_node_id,
  CASE WHEN l_returnflag = 'R' THEN 'fallback_calls' ELSE 'calls' END AS kind, {_ORDER} AS file_path, CAST(l_linenumber AS BIGINT) AS line,
  concat('calls:', CAST(l_orderkey AS VARCHAR(20)), ':', CAST(l_partkey AS VARCHAR(20)), ':', CAST(l_linenumber AS VARCHAR(20))) AS fingerprint
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
UNION ALL
SELECT 'catalog', CAST({5 * T} + p_partkey AS BIGINT), CAST({5 * T} + floor(p_partkey / 2) AS BIGINT), CASE WHEN p_partkey % 5 = 0 THEN 'fallback_calls' ELSE 'calls' END,
  concat('catalog/', p_type, '/', p_brand), CAST(10 * p_partkey + 2 AS BIGINT), concat('calls:p:', CAST(p_partkey AS VARCHAR(20)))
FROM {{part}} WHERE p_partkey > 0
UNION ALL
SELECT 'catalog', CAST({6 * T} + l_orderkey AS BIGINT), CAST({5 * T} + l_partkey AS BIGINT), 'tested_by', {_ORDER}, CAST(l_linenumber AS BIGINT),
  concat('tested_by:', CAST(l_orderkey AS VARCHAR(20)), ':', CAST(l_partkey AS VARCHAR(20)), ':', CAST(l_linenumber AS VARCHAR(20)))
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE l_linestatus = 'F'
UNION ALL
SELECT 'geo', CAST({T} + r_regionkey AS BIGINT), CAST({2 * T} + n_nationkey AS BIGINT), 'contains', concat('geo/', r_name), CAST(1 AS BIGINT), concat('contains:n:', CAST(n_nationkey AS VARCHAR(20)))
FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
UNION ALL
SELECT 'geo', CAST({2 * T} + n_nationkey AS BIGINT), CAST({3 * T} + s_suppkey AS BIGINT), 'contains', {_NATION}, CAST(1 AS BIGINT), concat('contains:s:', CAST(s_suppkey AS VARCHAR(20)))
FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
UNION ALL
SELECT 'geo', CAST({2 * T} + n_nationkey AS BIGINT), CAST({4 * T} + c_custkey AS BIGINT), 'contains', {_NATION}, CAST(1 AS BIGINT), concat('contains:c:', CAST(c_custkey AS VARCHAR(20)))
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
UNION ALL
SELECT 'geo', CAST({3 * T} + s_suppkey AS BIGINT), CAST({3 * T} + floor(s_suppkey / 3) AS BIGINT), 'inherits', {_NATION}, CAST(10 * s_suppkey + 1 AS BIGINT), concat('inherits:s:', CAST(s_suppkey AS VARCHAR(20)))
FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey WHERE s_suppkey > 0
UNION ALL
SELECT 'geo', CAST({2 * T} + n_nationkey AS BIGINT), CAST({2 * T} + (7 * n_nationkey + 1) % 25 AS BIGINT), 'imports_from', {_NATION}, CAST(1 AS BIGINT), concat('imports_from:n:', CAST(n_nationkey AS VARCHAR(20)))
FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
"""

#: One edge a fingerprint: the first by source, target and kind.
EDGES = """
SELECT namespace, from_node_id, to_node_id, kind, file_path, line, fingerprint
FROM (SELECT *, row_number() OVER (PARTITION BY namespace, fingerprint ORDER BY from_node_id, to_node_id, kind) AS rn FROM {raw_edges}) WHERE rn = 1
"""

HUNKS = """
SELECT event_id AS hunk_id, concat('catalog/', p_type, '/', p_brand) AS file_path,
  CAST(10 * p_partkey + 1 + event_id % 15 - 3 AS BIGINT) AS start_line, CAST(10 * p_partkey + 1 + event_id % 15 - 3 + event_id % 12 AS BIGINT) AS end_line
FROM {events} JOIN {part} ON p_partkey = event_id % 200
"""

CROSS_REFS = f"""
SELECT 'catalog' AS from_namespace, CAST({5 * T} + l_partkey AS BIGINT) AS from_node_id, concat('ccg://geo/', {_NATION}, '#', s_name) AS raw, 'geo' AS to_namespace,
  {_NATION} AS to_path, s_name AS to_symbol, CASE WHEN s_acctbal >= 0 THEN CAST({3 * T} + s_suppkey AS BIGINT) END AS resolved_node_id, CASE WHEN s_acctbal >= 0 THEN 'resolved' ELSE 'dead' END AS status
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM {{lineitem}}) JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
"""

DOCUMENTS = "SELECT source AS namespace, doc_id AS node_id, text AS content, lang AS language FROM {documents}"
REASONS = "SELECT source AS namespace, doc_id AS node_id, c.text AS content, turn FROM {conversations} c JOIN {documents} d ON c.conv_id = d.doc_id WHERE role = 'user'"
ANNOTATIONS = """
SELECT d.doc_id AS node_id, d.source AS namespace, CASE WHEN quality = 1 THEN concat('intent ', CAST(d.doc_id AS VARCHAR(20))) END AS intent,
  CASE WHEN toxic = 1 THEN concat('rule ', CAST(d.doc_id AS VARCHAR(20))) END AS rule
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
"""
DOC_FILES = """
SELECT DISTINCT concat('catalog/', p_type, '/', p_brand) AS file_path, CAST(p_size % 7 AS BIGINT) AS age FROM {part}
WHERE length(concat('catalog/', p_type, '/', p_brand)) % 2 = 0
UNION ALL SELECT 'orphan/a', CAST(0 AS BIGINT) UNION ALL SELECT 'orphan/b', CAST(0 AS BIGINT) UNION ALL SELECT 'orphan/c', CAST(0 AS BIGINT)
"""
SNAPSHOT_OLD = """
SELECT concat(o_orderpriority, '/', CAST(extract(YEAR FROM o_orderdate) AS VARCHAR(20)), '-', CAST(extract(MONTH FROM o_orderdate) AS VARCHAR(20))) AS file_path, CAST(sum(o_orderkey) AS BIGINT) AS hash
FROM {orders} GROUP BY 1
"""
SNAPSHOT_NEW = """
SELECT CASE WHEN file_path LIKE '%-7' THEN concat(file_path, '-moved') ELSE file_path END AS file_path, CASE WHEN file_path LIKE '%-3' THEN hash + 1 ELSE hash END AS hash
FROM {snapshot_old} WHERE file_path NOT LIKE '%-11'
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations", "pages")
VIEWS = {
    "nodes": NODES, "raw_edges": RAW_EDGES, "edges": EDGES, "hunks": HUNKS, "cross_refs": CROSS_REFS, "docs": DOCUMENTS, "reasons": REASONS,
    "annotations": ANNOTATIONS, "doc_files": DOC_FILES, "snapshot_old": SNAPSHOT_OLD, "snapshot_new": SNAPSHOT_NEW,
}


class Graph:
    """The views over one directory of tables, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                inputs = {x: getattr(self, x) for x in (*TABLES, *VIEWS) if "{" + x + "}" in VIEWS[name]}
                self._made[name] = self.spark.sql(VIEWS[name], **inputs)
        return self._made[name]


def duckdb_sql(body: str) -> str:
    """body with the views it names in front, for DuckDB. Views are named g_<view> there."""
    needed: list[str] = []

    def need(name: str) -> None:
        if name in needed:
            return
        for x in VIEWS:
            if "{" + x + "}" in VIEWS[name]:
                need(x)
        needed.append(name)

    for v in VIEWS:
        if "{" + v + "}" in body:
            need(v)
    names = {t: t for t in TABLES} | {v: f"g_{v}" for v in VIEWS}
    ctes = [f"g_{v} AS ({VIEWS[v].format(**names)})" for v in needed]
    filled = body
    for k, v in names.items():
        filled = filled.replace("{" + k + "}", v)
    if filled.lstrip().upper().startswith("WITH "):
        recursive = filled.lstrip()[5:].lstrip().upper().startswith("RECURSIVE ")
        rest = filled.lstrip()[5:].lstrip()
        rest = rest[10:] if recursive else rest
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*ctes, rest]) if ctes else filled
    return (f"WITH {', '.join(ctes)}\n" if ctes else "") + filled
