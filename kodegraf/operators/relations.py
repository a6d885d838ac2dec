"""One-hop relations, their evidence, entry points, flows and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kodegraf.operators.scans import first_of
from kodegraf.schema import CALL_KINDS, PLACE

#: Pattern: direction seen from the target, edge kinds.
PATTERNS = {
    "callers_of": ("incoming", CALL_KINDS), "callees_of": ("outgoing", CALL_KINDS), "imports_of": ("outgoing", ("imports_from",)), "importers_of": ("incoming", ("imports_from",)),
    "children_of": ("outgoing", ("contains",)), "tests_for": ("incoming", ("tested_by",)), "inheritors_of": ("incoming", ("inherits",)),
}


def peers(edges: DataFrame, targets: DataFrame, direction: str, kinds: tuple[str, ...]) -> DataFrame:
    """(target_id, node_id) once each, for the targets' node ids."""
    near, far = ("to_node_id", "from_node_id") if direction == "incoming" else ("from_node_id", "to_node_id")
    t = targets.select(F.col("node_id").alias(near)).distinct()
    return edges.where(F.col("kind").isin(*kinds)).join(t, near, "left_semi").select(F.col(near).alias("target_id"), F.col(far).alias("node_id")).distinct()


def related(nodes: DataFrame, edges: DataFrame, targets: DataFrame, pattern: str, strict: bool = False) -> DataFrame:
    """target_id beside each related node, once."""
    direction, kinds = PATTERNS[pattern]
    kinds = ("calls",) if strict and kinds == CALL_KINDS else kinds
    return nodes.join(peers(edges, targets, direction, kinds), "node_id")


def page(df: DataFrame, limit: int = 50, offset: int = 0, order=PLACE) -> DataFrame:
    """A page in total order. Limits lie between 1 and 500."""
    check_page(limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


def check_page(limit: int, offset: int = 0) -> None:
    if not 0 < limit <= 500:
        raise ValueError("limit must lie between 1 and 500")
    if offset < 0:
        raise ValueError("offset must not be negative")


def call_evidence(edges: DataFrame, targets: DataFrame, direction: str = "incoming") -> DataFrame:
    """One edge for each target and peer: calls before fallback calls, then by place."""
    near, far = ("to_node_id", "from_node_id") if direction == "incoming" else ("from_node_id", "to_node_id")
    t = targets.select(F.col("node_id").alias(near)).distinct()
    calls = edges.where(F.col("kind").isin(*CALL_KINDS)).join(t, near, "left_semi")
    return first_of(calls, [near, far], [F.col("kind") != "calls", "file_path", "line", "fingerprint"])


def strict_counts(edges: DataFrame, targets: DataFrame, direction: str = "incoming") -> DataFrame:
    """target_id, total, strict_count, tentative_count of call peers."""
    near = "to_node_id" if direction == "incoming" else "from_node_id"
    strict = F.count_if(F.col("kind") == "calls")
    return call_evidence(edges, targets, direction).groupBy(F.col(near).alias("target_id")).agg(F.count("*").alias("total"), strict.alias("strict_count"), (F.count("*") - strict).alias("tentative_count"))


def flow_entrypoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and tests that nothing calls, itself included."""
    called = edges.where(F.col("kind").isin(*CALL_KINDS)).select(F.col("to_node_id").alias("node_id"))
    return nodes.where(F.col("kind").isin("function", "test")).join(called, "node_id", "left_anti")


def flows_summary(flows: DataFrame, members: DataFrame) -> DataFrame:
    """flow_id, name, n_members; flows without members count 0."""
    n = members.groupBy("flow_id").agg(F.count("*").alias("n"))
    return flows.join(n, "flow_id", "left").select("flow_id", "name", F.coalesce("n", F.lit(0)).alias("n_members"))


def affected_flows(flows: DataFrame, members: DataFrame, changed: DataFrame) -> DataFrame:
    """Flows that hold a changed node, with the affected nodes ascending."""
    hit = members.join(changed.select("node_id").distinct(), "node_id", "left_semi").groupBy("flow_id").agg(F.array_sort(F.collect_set("node_id")).alias("affected"))
    return flows.join(hit, "flow_id").select("flow_id", "name", "affected")


def top_groups(members: DataFrame, key: str, limit: int) -> DataFrame:
    """The largest groups."""
    return members.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key).limit(limit)


def in_rank_order(nodes: DataFrame, ranked: DataFrame) -> DataFrame:
    """Nodes in the order of (node_id, rank); missing ones drop."""
    return nodes.join(ranked, "node_id").orderBy("rank")


# --- references between namespaces -------------------------------------------------


def parsed_links(rows: DataFrame, column: str = "raw") -> DataFrame:
    """Adds to_namespace, to_path, to_symbol of links of the link scheme; rows that are none drop.

    Links with user information, a query or a `..` segment are none.
    """
    from kodegraf.schema import LINK_SCHEME

    body = F.regexp_extract(column, f"^{LINK_SCHEME}(.*)$", 1)
    ns, path, symbol = (F.regexp_extract(body, r"^([^/#?@]+)(?:/([^#?]*))?(?:#([^?]*))?$", k) for k in (1, 2, 3))
    ok = F.col(column).startswith(LINK_SCHEME) & (ns != "") & ~F.concat(F.lit("/"), path, F.lit("/")).contains("/../")
    return rows.where(ok).withColumns({"to_namespace": ns, "to_path": F.regexp_replace(path, "/+$", ""), "to_symbol": symbol})


def resolved_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds resolved_node_id and status. Each distinct target is looked up once; of several nodes a file, then the lowest id, wins.

    A link to a namespace alone is resolved, without a node, if the namespace has nodes.
    """
    target = ["to_namespace", "to_path", "to_symbol"]
    t = links.select(*target).distinct()
    n = nodes.select(F.col("namespace").alias("to_namespace"), "node_id", "kind", "name", "qualified_name", "file_path")
    order = [F.col("kind") != "file", "node_id"]
    last = F.regexp_extract("qualified_name", r"([^.:]+)$", 1)

    def pick(found: DataFrame) -> DataFrame:
        return first_of(found, target, order).select(*target, "node_id")

    symbols = n.select("to_namespace", "node_id", "kind", "file_path", F.explode(F.array_distinct(F.array("name", "qualified_name", last))).alias("to_symbol"))
    exact = pick(t.where("to_path <> '' and to_symbol <> ''").join(symbols.withColumnRenamed("file_path", "to_path"), target))
    folders = n.select("to_namespace", "node_id", "kind", F.explode(_prefixes(F.col("file_path"))).alias("to_path"))
    paths = pick(t.where("to_path <> '' and to_symbol = ''").join(folders, ["to_namespace", "to_path"]))
    loose = pick(t.where("to_path = '' and to_symbol <> ''").join(symbols.drop("file_path"), ["to_namespace", "to_symbol"]))
    whole = t.where("to_path = '' and to_symbol = ''").join(nodes.select(F.col("namespace").alias("to_namespace")).distinct(), "to_namespace", "left_semi").select(*target, F.lit(None).cast("long").alias("node_id"))
    hits = exact.unionByName(paths).unionByName(loose).unionByName(whole).withColumn("__hit", F.lit(True))
    return links.join(hits, target, "left").withColumn("resolved_node_id", F.col("node_id")).withColumn("status", F.when(F.col("__hit"), "resolved").otherwise("dead")).drop("node_id", "__hit")


def _prefixes(path):
    """A path and all folders above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def list_cross_refs(refs: DataFrame, namespace: str, direction: str = "both", status: str | None = None) -> DataFrame:
    """References out of a namespace and into it; those from a namespace into itself are listed once, as outgoing."""
    out = refs.where(F.col("from_namespace") == namespace).withColumn("direction", F.lit("outbound"))
    into = refs.where((F.col("to_namespace") == namespace) & (F.col("from_namespace") != namespace)).withColumn("direction", F.lit("inbound"))
    both = {"outbound": out, "inbound": into}.get(direction) if direction != "both" else out.unionByName(into)
    return both if status is None else both.where(F.col("status") == status)
