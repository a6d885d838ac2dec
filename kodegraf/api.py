"""The engine: what a caller can ask of a stored code graph."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kodegraf.functions import annotations as ann
from kodegraf.functions import tokens as tk
from kodegraf.functions.paths import clean_target
from kodegraf.operators import changes, quality, relations, resolve, scans, search, stats, store, traverse, tree
from kodegraf.schema import DEFAULT_NAMESPACE, LINK_SCHEME
from kodegraf.sources import code, packages
from kodegraf.sources.work import saved

#: Columns of the stored tables beside the namespace, which is a folder.
TABLES = {
    "nodes": "node_id LONG, kind STRING, name STRING, qualified_name STRING, file_path STRING, start_line INT, end_line INT, hash STRING, language STRING",
    "edges": "from_node_id LONG, to_node_id LONG, kind STRING, file_path STRING, line INT, fingerprint STRING, source_text STRING, target_text STRING",
    "tags": "node_id LONG, summary STRING, context STRING, position INT, kind STRING, type STRING, name STRING, value STRING, ordinal INT",
    "documents": "node_id LONG, content STRING",
    "postings": "node_id LONG, token STRING, len LONG, tf LONG",
    "reasons": "node_id LONG, place INT, content STRING",
    "reason_postings": "node_id LONG, place INT, token STRING, len LONG, tf LONG",
    "packages": "language STRING, import_path STRING, name STRING, dir STRING, file_path STRING",
    "methods": "file_path STRING, language STRING, rec STRING, owner STRING, method STRING",
    "parse_cache": "content_hash STRING, context_hash STRING, version STRING, rec STRING, file_path STRING, language STRING, kind STRING, name STRING, qualified_name STRING, start_line INT, end_line INT, target STRING, text STRING, hash STRING",
    "flows": "flow_id LONG, name STRING",
    "flow_members": "flow_id LONG, node_id LONG, ordinal LONG",
    "declared": "file_path STRING, language STRING, declared STRING",
}


class NotFound(LookupError):
    """The target names no node, or several."""


class Engine:
    """Tables under one folder, each partitioned by namespace. Answers are DataFrames; only small pools are collected."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str, namespaces: list[str] | None = None) -> DataFrame:
        reader = self.spark.read.schema(f"{TABLES[name]}, namespace STRING") if name in TABLES else self.spark.read
        return scans.in_namespaces(reader.parquet(f"{self.root}/{name}"), namespaces)

    # --- building ------------------------------------------------------------------

    def parse_project(self, path: str, namespace: str = DEFAULT_NAMESPACE, includes: list[str] = (), excludes: list[str] = (), fallback_calls: bool = False, max_file_bytes: int = 0, max_total_bytes: int = 0) -> dict:
        """Parse a source tree and write its nodes, edges and tags. Node ids are hashes of namespace, name, file and line."""
        files = code.read_tree(self.spark, path, includes, excludes, max_file_bytes, max_total_bytes)
        records = self._parsed(files, namespace)
        return self._store(records, namespace, fallback_calls, packages.manifests(path))

    def _has(self, name: str, namespace: str) -> bool:
        """Whether a table of the namespace is stored."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/namespace={namespace}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _parsed(self, files: DataFrame, namespace: str) -> DataFrame:
        """Records of all files: those of unchanged contents come from the parse cache, which then holds all."""
        key = ["file_path", "content_hash", "context_hash", "version"]
        # A file is parsed by itself, so that no other file is context of it.
        files = files.withColumn("context", F.lit(""))
        hashed = files.select("file_path", F.sha2("content", 256).alias("content_hash"), F.sha2("context", 256).alias("context_hash"), F.lit(code.VERSION).alias("version"))
        if self._has("parse_cache", namespace):
            cache = self.table("parse_cache", [namespace]).drop("namespace")
            new = code.parsed(store.parse_cache_misses(files, cache.select(*key).distinct(), code.VERSION))
            known = cache.join(hashed, key, "left_semi").select(*new.columns)
            records = saved(new.unionByName(known), "records")
        else:
            records = saved(code.parsed(files), "records")
        cached = records.join(hashed.withColumnRenamed("content_hash", "hash"), ["file_path", "hash"]).withColumn("content_hash", F.col("hash"))
        self._write(cached.withColumn("namespace", F.lit(namespace)).select("namespace", *[c.split()[0] for c in TABLES["parse_cache"].split(", ")]), "parse_cache", namespace)
        return records

    def _store(self, records: DataFrame, namespace: str, fallback: bool, found: dict[str, str], nodes: DataFrame | None = None, edges: DataFrame | None = None, tags: DataFrame | None = None, declared: DataFrame | None = None, methods: DataFrame | None = None) -> dict:
        """Write the records' nodes, edges and tags, packages and methods beside the given ones, which stay."""
        ns = F.lit(namespace).alias("namespace")
        beside = lambda new, old: new if old is None else new.unionByName(old.select(*new.columns))
        own = records.where("rec = 'node' and kind = 'file'").select("file_path", "language").join(records.where("rec = 'package'").select("file_path", F.col("name").alias("declared")), "file_path", "left")
        declared = saved(beside(own, declared), "declared")
        held = saved(packages.discovered(self.spark, declared, found), "packages")
        made = held.select("language", "import_path", "name", "dir").distinct()
        package = made.select(F.xxhash64(F.lit(namespace), F.lit("package"), "import_path").alias("node_id"), ns, F.lit("package").alias("kind"), "name", F.col("import_path").alias("qualified_name"), F.col("dir").alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("").alias("hash"), "language")
        node = records.where("rec = 'node'").select(F.xxhash64(F.lit(namespace), "qualified_name", "file_path", "start_line").alias("node_id"), ns, "kind", "name", "qualified_name", "file_path", "start_line", "end_line", "hash", "language")
        nodes = saved(beside(node.dropDuplicates(["node_id"]), nodes).unionByName(package), "nodes")
        methods = saved(beside(records.where("rec in ('method', 'wants')").select("file_path", "language", "rec", F.col("name").alias("owner"), F.col("target").alias("method")), methods), "methods")
        semantic = self._semantic_edges(declared, methods, nodes, namespace)
        parsed = self._edges(records, nodes, namespace, fallback, semantic, edges)
        contains = resolve.package_contains(held.withColumn("namespace", F.lit(namespace)), nodes).withColumn("line", F.lit(1)).withColumn("source_text", F.lit(None).cast("string")).withColumn("target_text", F.col("file_path"))
        edges = saved(beside(parsed, edges).unionByName(contains.select(*parsed.columns)).unionByName(semantic.select(*parsed.columns)), "edges")
        tags = saved(beside(self._tags(records, nodes, namespace), tags), "tags")
        tables = {"nodes": nodes, "edges": edges, "tags": tags, "packages": held.withColumn("namespace", F.lit(namespace)), "methods": methods.withColumn("namespace", F.lit(namespace)), "declared": declared.withColumn("namespace", F.lit(namespace))}
        for name, df in tables.items():
            self._write(df, name, namespace)
        lost = edges.where("from_node_id is null or to_node_id is null").count()
        return {"nodes": nodes.count(), "edges": edges.count(), "unresolved": lost}

    def _semantic_edges(self, declared: DataFrame, methods: DataFrame, nodes: DataFrame, namespace: str) -> DataFrame:
        """Structural implements of Go, by folder and package, at line 0 of the first file of the group."""
        group = F.concat_ws("|", F.regexp_replace("file_path", "/?[^/]*$", ""), "declared").alias("package")
        of_file = declared.where("language = 'go'").select("file_path", group)
        anchor = of_file.groupBy("package").agg(F.min("file_path").alias("file_path"))
        m = methods.join(of_file, "file_path")
        met = resolve.structural_implements(m.where("rec = 'method'").select("package", F.col("owner").alias("receiver"), "method"), m.where("rec = 'wants'").select("package", F.col("owner").alias("interface"), "method"))
        by_name = quality.unique_values(nodes.where("kind in ('class', 'type')"), ["qualified_name"], "node_id")
        end = lambda of, id_: by_name.select(F.col("qualified_name").alias(of), F.col("node_id").alias(id_))
        e = met.where("receiver <> interface").join(anchor, "package").join(end("receiver", "from_node_id"), "receiver").join(end("interface", "to_node_id"), "interface")
        mark = F.concat_ws(":", F.lit("implements"), "file_path", "receiver", "interface")
        return e.select(F.lit(namespace).alias("namespace"), "from_node_id", "to_node_id", F.lit("implements").alias("kind"), "file_path", F.lit(0).alias("line"), mark.alias("fingerprint"), F.col("receiver").alias("source_text"), F.col("interface").alias("target_text"))

    def update(self, path: str, namespace: str = DEFAULT_NAMESPACE, includes: list[str] = (), excludes: list[str] = (), fallback_calls: bool = False) -> dict:
        """Bring a stored namespace up to date.

        Parsed anew are added and modified files, unchanged ones whose edges end
        at changed nodes or may end at added ones, and the neighbours of added
        files in their folder. What was derived before (search documents, flows,
        links) is refreshed for the nodes of these files.
        """
        files = code.read_tree(self.spark, path, includes, excludes)
        nodes, edges, tags, declared, methods = (self.table(t, [namespace]).drop("namespace") for t in ("nodes", "edges", "tags", "declared", "methods"))
        nodes, edges, tags = (t.withColumn("namespace", F.lit(namespace)) for t in (nodes, edges, tags))
        nodes = nodes.where("kind <> 'package'")
        old = nodes.where("kind = 'file'").select("file_path", "hash")
        state = saved(stats.classify_update(old, files.select("file_path", F.sha2("content", 256).alias("hash"))), "state")
        counts = {r.state: r.n for r in stats.by(state, "state").collect()}
        summary = {k: counts.get(k, 0) for k in ("added", "modified", "skipped", "deleted")}
        if summary["skipped"] == sum(summary.values()):
            return summary
        fresh = state.where("state in ('added', 'modified')").select("file_path")
        stale = state.where("state in ('modified', 'deleted')").select("file_path")
        same = state.where("state = 'skipped'").select("file_path")
        parsed = self._parsed(files, namespace)  # what did not change comes from the cache
        changed = nodes.join(stale, "file_path", "left_semi")
        touched = store.force_reparse(edges.where("to_node_id is not null"), changed, same)
        added = parsed.where("rec = 'node'").join(fresh, "file_path", "left_semi").withColumn("namespace", F.lit(namespace))
        hoped = store.replayed(store.unresolved_index(edges), added).select(F.col("fingerprint_hash").alias("h")).distinct()
        hoping = edges.withColumn("h", F.sha2("fingerprint", 256)).join(hoped, "h", "left_semi").select("file_path").distinct().join(same, "file_path", "left_semi")
        folder = F.regexp_replace("file_path", "/?[^/]*$", "").alias("dir")
        peers = same.select("file_path", folder).join(state.where("state = 'added'").select(folder).distinct(), "dir", "left_semi").select("file_path")
        again = saved(touched.union(hoping).union(peers).distinct(), "again")
        gone = saved(stale.union(again).distinct(), "gone")
        records = parsed.join(fresh.union(again).distinct(), "file_path", "left_semi")
        stay = lambda t: saved(t.join(gone, "file_path", "left_anti"), "left")
        kept_edges = store.delete_package_edges(edges.where("fingerprint not like 'contains:package:%'").withColumn("line", F.col("line").cast("long")), edges.select("file_path").distinct()).withColumn("line", F.col("line").cast("int"))
        kept_tags = saved(tags.join(nodes.join(gone, "file_path", "left_semi").select("node_id"), "node_id", "left_anti"), "left")
        before = saved(nodes.select("node_id", "file_path"), "before")
        out = self._store(records, namespace, fallback_calls, packages.manifests(path), stay(nodes), stay(kept_edges), kept_tags, stay(declared), stay(methods))
        scope = saved(store.affected_nodes(before, self.table("nodes", [namespace]).select("node_id", "file_path"), fresh.union(again).distinct(), state.where("state = 'deleted'").select("file_path")), "scope")
        if self._has("documents", namespace):
            self._index(namespace, scope)
        if self._has("flows", namespace):
            self.postprocess(namespace, flows=True, fts=False)
        if self._has_links():
            self.sync_cross_refs()
        return summary | out

    def _edges(self, records: DataFrame, nodes: DataFrame, namespace: str, fallback: bool, semantic: DataFrame, others: DataFrame | None = None) -> DataFrame:
        """Resolved edges of the records; calls see the implements edges of the tree, those of semantic and of other files included."""
        e = records.where("rec = 'edge'").select(F.lit(namespace).alias("namespace"), "kind", "file_path", F.col("start_line").alias("line"), F.col("name").alias("source_text"), F.col("target").alias("target_text"), F.concat_ws(":", "kind", "file_path", F.coalesce("name", F.lit("")), "target", F.col("start_line").cast("string")).alias("fingerprint")).dropDuplicates(["fingerprint"])
        around = resolve.enclosing_callable(e.select("file_path", "line"), nodes).withColumnRenamed("node_id", "enclosing")
        by_name = quality.unique_values(nodes, ["qualified_name"], "node_id")
        in_file = quality.unique_values(nodes.where("kind <> 'file'"), ["file_path", "name"], "node_id")
        names = quality.unique_values(nodes.where("kind in ('class', 'type')"), ["name"], "node_id")
        file_ids = nodes.where("kind = 'file'").select("file_path", F.col("node_id").alias("file_id"))
        e = e.join(around, ["file_path", "line"], "left").join(file_ids, "file_path", "left")
        e = e.join(by_name.select(F.col("qualified_name").alias("source_text"), F.col("node_id").alias("own")), "source_text", "left")
        qualified = nodes.select("node_id", "qualified_name")
        calls = e.where("kind = 'calls'")
        who = nodes.select(F.col("node_id").alias("enclosing"), F.regexp_replace("qualified_name", r"[.][^.]+$", "").alias("receiver"))
        # The source of a relation of types may be named without its package.
        e = e.join(in_file.select("file_path", F.col("name").alias("source_text"), F.col("node_id").alias("own_bare")), ["file_path", "source_text"], "left").withColumn("own", F.coalesce("own", "own_bare"))
        rest = e.where("kind not in ('calls', 'imports_from')").join(by_name.select(F.col("qualified_name").alias("target_text"), F.col("node_id").alias("t1")), "target_text", "left")
        rest = rest.join(in_file.select("file_path", F.col("name").alias("target_text"), F.col("node_id").alias("t2")), ["file_path", "target_text"], "left").join(names.select(F.col("name").alias("target_text"), F.col("node_id").alias("t3")), "target_text", "left")
        peer = F.concat_ws(".", F.regexp_extract("source_text", r"^(.+)[.][^.]+$", 1), "target_text")
        rest = rest.withColumn("peer", peer).join(by_name.select(F.col("qualified_name").alias("peer"), F.col("node_id").alias("t4")), "peer", "left")
        rest = rest.withColumn("to_node_id", F.coalesce("t1", "t4", "t2", "t3")).withColumn("from_node_id", F.when(F.col("kind") == "contains", F.coalesce("own", "file_id")).otherwise(F.col("own")))
        known = [x.where("kind = 'implements' and from_node_id is not null and to_node_id is not null").select("from_node_id", "to_node_id") for x in (rest, semantic, others) if x is not None]
        pairs = reduce(DataFrame.unionByName, known)
        ends = lambda id_, name: qualified.select(F.col("node_id").alias(id_), F.col("qualified_name").alias(name))
        implements = pairs.join(ends("from_node_id", "implementer"), "from_node_id").join(ends("to_node_id", "interface"), "to_node_id").select(F.lit(namespace).alias("namespace"), "interface", "implementer")
        implements = saved(implements.distinct(), "implements")
        called = resolve.resolve_calls(calls.join(who, "enclosing", "left").withColumn("callee", F.col("target_text")), nodes, fallback, implements)
        called = called.withColumn("kind", F.when(F.col("rule") == "fallback", "fallback_calls").otherwise(F.col("kind"))).withColumn("from_node_id", F.coalesce("enclosing", "file_id"))
        imports = e.where("kind = 'imports_from'").withColumn("import_path", F.regexp_replace(F.regexp_replace("target_text", r"^[./]+", ""), r"[.]|::", "/"))
        found = resolve.import_suffix(imports, nodes).select("import_path", F.col("file_path").alias("imported")).join(file_ids.select(F.col("file_path").alias("imported"), F.col("file_id").alias("to_node_id")), "imported")
        module = file_ids.select(F.regexp_replace("file_path", r"(/__init__)?[.]\w+$", "").alias("import_path"), F.col("file_id").alias("m"))
        imports = imports.join(found.select("import_path", "to_node_id"), "import_path", "left").join(quality.unique_values(module, ["import_path"], "m"), "import_path", "left")
        named = quality.unique_values(nodes.where("kind = 'package'"), ["qualified_name"], "node_id").select(F.col("qualified_name").alias("target_text"), F.col("node_id").alias("p"))
        # A package of the tree, else its file, else the files of the folder that ends like the import.
        imports = imports.join(named, "target_text", "left").withColumn("to_node_id", F.coalesce("p", "m", "to_node_id")).withColumn("from_node_id", F.col("file_id"))
        cols = ["namespace", "from_node_id", "to_node_id", "kind", "file_path", "line", "fingerprint", "source_text", "target_text"]
        all_edges = called.select(*cols).unionByName(rest.select(*cols)).unionByName(imports.select(*cols))
        tests = nodes.where("kind = 'test'").select(F.col("node_id").alias("from_node_id"))
        tested = all_edges.where("kind = 'calls' and to_node_id is not null").join(tests, "from_node_id", "left_semi")
        tested = tested.withColumn("kind", F.lit("tested_by")).withColumn("fingerprint", F.concat(F.lit("tested_by:"), "fingerprint"))
        return all_edges.unionByName(tested.select(*cols))

    def _tags(self, records: DataFrame, nodes: DataFrame, namespace: str) -> DataFrame:
        comments = records.where("rec = 'comment'").withColumn("comment_id", F.xxhash64("file_path", "start_line", "text"))
        said = saved(ann.parsed_comments(comments.select("comment_id", "file_path", "start_line", "end_line", "target", "text", "language")), "comments")
        code_lines = records.where("rec = 'code'").select("file_path", F.col("start_line").alias("line"), "end_line")
        own = nodes.join(records.select("file_path").distinct(), "file_path", "left_semi")
        above = resolve.bind_comments(said.where("target is null"), own.where("kind not in ('file', 'package')"), code_lines)
        held = said.where("target <> '0'").select("comment_id", "file_path", F.col("target").cast("int").alias("start_line")).join(own.where("kind not in ('file', 'package')"), ["file_path", "start_line"]).select("node_id", "comment_id")
        # A file takes its first comment: the docstring of the module, or one that belongs to no declaration's body.
        content = (F.col("annotation.summary") != "") | (F.col("annotation.context") != "") | (F.size("annotation.tags") > 0)
        first = said.where("target is null or target = '0'").groupBy("file_path").agg(F.min_by(F.struct("comment_id", content.alias("any")), F.struct("start_line", "comment_id")).alias("c")).where("c.any")
        of_file = first.join(own.where("kind = 'file'").select("file_path", "node_id"), "file_path").select("node_id", "c.comment_id")
        bound = held.unionByName(above.join(held, "node_id", "left_anti")).unionByName(of_file).dropDuplicates(["node_id"])
        full = bound.join(said, "comment_id").select(F.lit(namespace).alias("namespace"), "node_id", F.col("annotation.summary").alias("summary"), F.col("annotation.context").alias("context"), F.posexplode_outer("annotation.tags").alias("position", "tag"))
        return full.select("namespace", "node_id", "summary", "context", F.coalesce("position", F.lit(0)).alias("position"), "tag.*")

    def _write(self, df: DataFrame, name: str, namespace: str) -> None:
        """The namespace's rows, also if there are none, in place of those before."""
        if not re.fullmatch(r"[\w.-]+", namespace):
            raise ValueError(f"not a namespace: {namespace}")
        df.where(F.col("namespace") == namespace).drop("namespace").write.mode("overwrite").parquet(f"{self.root}/{name}/namespace={namespace}")

    def _index(self, namespace: str, scope: DataFrame | None = None) -> None:
        """Search documents, reasons and the postings of both: of all nodes, or of those in scope (node_id), the others as they are."""
        nodes, tags = self.table("nodes", [namespace]), self.table("tags", [namespace])
        if scope is not None:
            nodes, tags = nodes.join(scope, "node_id", "left_semi"), tags.join(scope, "node_id", "left_semi")
        docs = search.document_text(nodes, search.said(tags))
        reasons = search.reason_rows(tags).withColumn("place", F.row_number().over(Window.partitionBy("node_id").orderBy("content")).cast("int"))
        made = {"documents": docs, "reasons": reasons, "postings": search.postings(docs), "reason_postings": search.postings(reasons, ("node_id", "place"))}
        ready = {}
        for name, new in made.items():
            old = self.table(name, [namespace]) if scope is not None and self._has(name, namespace) else None
            rows = new if old is None else store.refresh_documents(old, new, scope.unionByName(new.select("node_id")).distinct())
            # Sorted by token, so that a search reads the row groups of its terms only.
            ready[name] = saved(rows.repartitionByRange("token").sortWithinPartitions("token") if "token" in rows.columns else rows, name)
        for name, rows in ready.items():
            self._write(rows, name, namespace)

    def purge_index(self, namespace: str = DEFAULT_NAMESPACE) -> None:
        """Empty the search tables of a namespace."""
        for name in ("documents", "postings", "reasons", "reason_postings"):
            self._write(self.table(name, [namespace]).limit(0), name, namespace)

    def delete_namespace(self, namespace: str) -> None:
        """Remove a namespace from all tables."""
        for name in TABLES:
            if self._has(name, namespace):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/namespace={namespace}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def postprocess(self, namespace: str = DEFAULT_NAMESPACE, flows: bool = True, fts: bool = True) -> dict:
        """Rebuild flows and search documents of a namespace."""
        nodes, edges = self.table("nodes", [namespace]), self.table("edges", [namespace])
        if fts:
            self._index(namespace)
        if flows:
            starts = relations.flow_entrypoints(nodes, edges).select(F.col("node_id").alias("source"), "node_id")
            made, members = traverse.flow_tables(nodes, traverse.flows(edges.where("to_node_id is not null"), starts, max_nodes=None))
            self._write(made, "flows", namespace)
            self._write(members, "flow_members", namespace)
        return {"flows": flows, "fts": fts, "communities": 0}

    def build(self, path: str, namespace: str = DEFAULT_NAMESPACE, postprocess: str = "full", **options) -> dict:
        """Parse and, unless postprocess is "none", rebuild what depends on it ("minimal": search only)."""
        out = self.parse_project(path, namespace, **options)
        try:
            if postprocess != "none":
                self.postprocess(namespace, flows=postprocess == "full")
            return out | {"status": "ok"}
        except Exception as e:  # the graph itself is written
            return out | {"status": "degraded", "error": str(e)[:500]}

    def _has_links(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/cross_refs")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def sync_cross_refs(self) -> None:
        """Resolve the links of all namespaces anew."""
        see = self.table("tags").where((F.col("kind") == "see") & F.startswith("value", F.lit(LINK_SCHEME)))
        links = relations.parsed_links(see.select(F.col("namespace").alias("from_namespace"), F.col("node_id").alias("from_node_id"), F.col("value").alias("raw")))
        relations.resolved_links(links, self.table("nodes")).write.mode("overwrite").parquet(f"{self.root}/cross_refs")

    # --- asking --------------------------------------------------------------------

    def get_node(self, qualified_name: str, namespace: str = DEFAULT_NAMESPACE) -> DataFrame:
        return scans.node_by_qualified_name(self.table("nodes"), namespace, qualified_name)

    def get_annotation(self, qualified_name: str, namespace: str = DEFAULT_NAMESPACE) -> DataFrame:
        return self.table("tags", [namespace]).join(self.get_node(qualified_name, namespace).select("node_id"), "node_id", "left_semi").orderBy("kind", "ordinal")

    def _target(self, name: str, namespace: str) -> DataFrame:
        found = self.get_node(name, namespace)
        if found.isEmpty():
            found = scans.nodes_by_exact_name(self.table("nodes", [namespace]), name, 10)
            rows = found.collect()
            if len(rows) != 1:
                raise NotFound(f"{name} names {len(rows) or 'no'} nodes" + "".join(f"\n  {r.qualified_name} ({r.file_path}:{r.start_line})" for r in rows))
        return found

    def query_graph(self, pattern: str, target: str, namespace: str = DEFAULT_NAMESPACE, limit: int = 50, offset: int = 0, strict: bool = False) -> DataFrame:
        if pattern not in relations.PATTERNS or pattern == "children_of":
            raise ValueError(f"unknown pattern {pattern}")
        t = self._target(target, namespace)
        edges = self.table("edges", [namespace])
        found = relations.related(self.table("nodes", [namespace]), edges, t, pattern, strict)
        if pattern in ("callers_of", "callees_of"):
            direction = relations.PATTERNS[pattern][0]
            far = "from_node_id" if direction == "incoming" else "to_node_id"
            proof = relations.call_evidence(edges, t, direction).select(F.col(far).alias("node_id"), F.when(F.col("kind") == "calls", "strict").otherwise("tentative").alias("confidence"))
            found = found.join(proof, "node_id", "left")
        return relations.page(found, limit, offset)

    def list_graph_stats(self, namespaces: list[str] | None = None) -> DataFrame:
        return stats.totals(self.table("nodes", namespaces), self.table("edges", namespaces))

    def list_namespaces(self) -> DataFrame:
        return stats.by(self.table("nodes"), "namespace").orderBy("namespace")

    def get_impact_radius(self, target: str, depth: int = 1, max_depth: int = 3, max_nodes: int = 200, namespace: str = DEFAULT_NAMESPACE, federated: bool = False) -> DataFrame:
        start = self._target(target, namespace).select(F.col("node_id").alias("source"), "node_id")
        edges = self.table("edges", None if federated else [namespace]).where("from_node_id is not null and to_node_id is not null")
        edges = scans.with_cross_refs(edges.withColumn("line", F.col("line").cast("long")), self.table("cross_refs")) if federated else edges
        return traverse.impact(edges, start, depth, max_depth, max_nodes).join(self.table("nodes"), "node_id").orderBy("ordinal")

    def trace_flow(self, target: str, max_nodes: int = 200, strict: bool = False, namespace: str = DEFAULT_NAMESPACE) -> DataFrame:
        start = self._target(target, namespace).select(F.col("node_id").alias("source"), "node_id")
        edges = self.table("edges", [namespace]).where("to_node_id is not null")
        return traverse.flows(edges, start, ("calls",) if strict else ("calls", "fallback_calls"), max_nodes).join(self.table("nodes"), "node_id").orderBy("ordinal")

    def detect_changes(self, repo_dir: str, base: str = "HEAD~1", limit: int = 50, offset: int = 0, namespace: str = DEFAULT_NAMESPACE) -> DataFrame:
        hunks = changes.diff_hunks(self.spark, repo_dir, base)
        return changes.top_risks(hunks, self.table("nodes", [namespace]), self.table("edges", [namespace]), limit, offset)

    def get_affected_flows(self, repo_dir: str, base: str = "HEAD~1", namespace: str = DEFAULT_NAMESPACE) -> DataFrame:
        changed = changes.changed_ids(changes.diff_hunks(self.spark, repo_dir, base), self.table("nodes", [namespace]))
        return relations.affected_flows(self.table("flows", [namespace]), self.table("flow_members"), changed).orderBy("name", "flow_id")

    def list_flows(self, by: str = "name", limit: int = 50, offset: int = 0, namespace: str = DEFAULT_NAMESPACE) -> DataFrame:
        order = [F.col("n_members").desc(), "name", "flow_id"] if by == "size" else ["name", "flow_id"]
        return relations.page(relations.flows_summary(self.table("flows", [namespace]), self.table("flow_members")), limit, offset, order)

    def list_cross_refs(self, namespace: str, direction: str = "both", status: str | None = None) -> DataFrame:
        return relations.list_cross_refs(self.table("cross_refs"), namespace, direction, status)

    def describe(self, target: str, namespace: str = DEFAULT_NAMESPACE) -> tuple[str, DataFrame]:
        """(scope, rows): declarations of a file, children of a folder, or suggestions."""
        path, nodes = target.strip().strip("/"), self.table("nodes", [namespace])
        if not path:
            raise ValueError("a target is needed")
        if not nodes.where((F.col("file_path") == path) & (F.col("kind") == "file")).isEmpty():
            return "file", tree.describe_file(nodes, path)
        if not nodes.where(F.startswith("file_path", F.lit(path + "/"))).isEmpty():
            return "directory", stats.folder_children(nodes, path)
        return "unknown", tree.suggestions(nodes, path)

    def search(self, query: str, limit: int = 10, offset: int = 0, path: str = "", namespaces: list[str] | None = None, include_weak: bool = False) -> DataFrame:
        """Files with their hits, in order. The pool is at most 500 rows a namespace, so windows over it are small.

        Only the postings of the query's tokens are read. A query without a term
        finds nothing.
        """
        relations.check_page(limit, offset)
        pool, block = tk.fetch_limit(limit, offset)
        index, reasons = self.table("postings", namespaces), self.table("reason_postings", namespaces)
        sizes, reason_sizes = search.corpus(self.table("documents", namespaces)), search.corpus(self.table("reasons", namespaces))
        terms, natural = tk.query_terms(query), tk.is_question(query)
        strict = search.strict_match(index, query)
        if natural and strict.isEmpty():
            scored = search.bm25(index, terms, sizes).where(F.col("n_terms") >= min(2, len(terms)))
        else:
            scored = strict.join(search.bm25(index, terms, sizes), ["namespace", "node_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        nodes = self.table("nodes", namespaces)
        top = search.ranked(scored.join(nodes.drop("namespace"), "node_id"), pool, ("file_path", "qualified_name", "node_id"))
        top = search.name_scores(top, query).withColumn("path_score", search.path_score(query))
        placed = top.withColumn("position", F.col("rank")) if natural else search.promote_exact(search.rerank(top, block), query)
        hits = search.ranked(search.bm25(reasons, terms, reason_sizes, ("node_id", "place")), pool)
        ok = search.answerable(reasons, terms, reason_sizes).where("can_answer").select("namespace")
        both = search.absorb_reasons(placed, hits.join(ok, "namespace", "left_semi"))
        rows = search.name_scores(both.join(nodes.drop("namespace"), "node_id"), query).withColumn("path_score", search.path_score(query))
        rows = search.evidence(rows.where(scans.has_path_prefix(F.col("file_path"), path)), include_weak)
        return search.federated_pages(search.by_file(rows), limit, offset).orderBy("namespace", "file_no", "position")

    def search_answer(self, query: str, limit: int = 10, offset: int = 0, path: str = "", namespaces: list[str] | None = None, include_weak: bool = False) -> dict:
        """A page of a search as a dictionary: files with their hits, how to go on, and, for an empty page, why."""
        # One file more than asked for tells whether there are more.
        rows = self.search(query, min(limit + 1, 500), offset, path, namespaces, include_weak)
        answer = response(rows, query, limit, offset)
        if not answer["files"]:
            weak = self.search(query, 1, 0, path, namespaces, True).limit(1).count()
            seen = self.search(query, 1, 0, path, namespaces).limit(1).count() if offset else 0
            answer["note"] = search.note(seen, weak, self.table("reasons", namespaces).limit(1).count(), offset)
        return answer

    def get_minimal_context(self, repo_dir: str, base: str = "HEAD~1", namespace: str = DEFAULT_NAMESPACE, task: str = "") -> DataFrame:
        """One row: counts, risk of the 50 riskiest changed nodes, the first five of them, the three largest flows, and tools to go on with."""
        nodes, edges = self.table("nodes", [namespace]), self.table("edges", [namespace])
        risks = saved(changes.risks(changes.diff_hunks(self.spark, repo_dir, base), nodes, edges), "risks")
        out = stats.minimal_context(nodes, edges, risks)
        top = [r.qualified_name for r in risks.orderBy(F.col("risk").desc(), "file_path", "start_line", "qualified_name", "node_id").limit(5).collect()]
        flows = []
        if self._has("flows", namespace):
            members = self.table("flow_members", [namespace])
            flows = [f"{r.name} ({r.n_members})" for r in relations.flows_summary(self.table("flows", [namespace]), members).orderBy(F.col("n_members").desc(), "name", "flow_id").limit(3).collect()]
        words = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        level = F.when(F.col("n_changed") == 0, "unknown").otherwise(F.col("risk_level"))
        return out.withColumns({"risk_level": level, "key_entities": words(top), "top_flows": words(flows), "top_communities": words([]), "suggested_tools": words(suggest_tools(task))})

    def write_docs(self, out: str, namespace: str = DEFAULT_NAMESPACE) -> None:
        """Generated documents as rows (file_path, markdown, hash, generated): one of each source file, index.md with links to all, by folder.

        Documents that are no longer made go with the table's last version;
        hand-written rows (generated false) stay.
        """
        docs = tree.rendered_docs(self.table("nodes", [namespace])).select(F.concat("file_path", F.lit(".md")).alias("file_path"), "markdown")
        docs = saved(docs.withColumn("hash", F.sha2("markdown", 256)).withColumn("generated", F.lit(True)).unionByName(tree.docs_index(docs).withColumn("hash", F.sha2("markdown", 256)).withColumn("generated", F.lit(True))), "docs")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(out)
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            before = self.spark.read.parquet(out)
            gone = quality.prunable(before, docs)
            kept = before.join(gone, "file_path", "left_anti").join(docs.select("file_path"), "file_path", "left_anti")
            docs = saved(docs.unionByName(kept.select(*docs.columns)), "docs")
        docs.write.mode("overwrite").parquet(out)

    def get_doc_content(self, folder: str, name: str, most: int = 1 << 20) -> str:
        """A document of write_docs by its name, up to a size."""
        clean = clean_target(name)
        if not clean.endswith(".md") or ".." in clean.split("/"):
            raise ValueError("not a document of this folder")
        row = self.spark.read.parquet(folder).where(F.col("file_path") == clean).select("markdown", F.octet_length("markdown").alias("n")).first()
        if row is None:
            raise NotFound(f"no document {clean}")
        if row.n > most:
            raise ValueError(f"larger than {most} bytes")
        return row.markdown

    def report(self, kind: str, namespace: str = DEFAULT_NAMESPACE, repo_dir: str | None = None, base: str = "HEAD~1", target: str | None = None) -> str:
        """A short text: "review" (riskiest changes), "debug" (hits and their callers), "onboard" (overview) or "merge" (changes without tests)."""
        line = lambda r: f"- {r.qualified_name} ({r.file_path}:{r.start_line})"
        if kind == "debug":
            hits = self.search(target or "", 10, 0, "", [namespace]).limit(10).collect()
            lines = [line(r) for r in hits]
            if hits:
                lines += ["", "Called by:", *[line(r) for r in self.query_graph("callers_of", hits[0].qualified_name, namespace, 10).collect()]]
            return "\n".join(["Likely places:", *lines])
        if kind == "onboard":
            s = self.list_graph_stats([namespace]).first()
            folders = stats.folder_children(self.table("nodes", [namespace]), "").limit(20).collect()
            return "\n".join([f"{s.n_nodes} nodes, {s.n_edges} edges in {s.n_files} files" if s else "empty", *[f"- {r.child}: {r.n_declarations} declarations" for r in folders]])
        if kind not in ("review", "merge"):
            raise ValueError(f"unknown report {kind}")
        nodes, edges = self.table("nodes", [namespace]), self.table("edges", [namespace])
        risk = changes.top_risks(changes.diff_hunks(self.spark, repo_dir, base), nodes, edges, 20)
        if kind == "merge":
            tested = edges.where("kind = 'tested_by'").select(F.col("to_node_id").alias("node_id"))
            risk = risk.where("kind in ('function', 'class')").join(tested, "node_id", "left_anti")
        rows = risk.orderBy(F.col("risk").desc(), "file_path", "start_line").collect()
        return "\n".join(["Riskiest changes:" if kind == "review" else "Changed without tests:", *[f"{line(r)} risk {r.risk:g}" for r in rows]])

    def wiki_tree(self, namespace: str = DEFAULT_NAMESPACE, depth: int | None = 2) -> list[dict]:
        """Nested folders down to a depth, for display."""
        return tree.nested([r.asDict() for r in tree.sorted_tree(tree.tree(self.table("nodes", [namespace]), depth)).collect()])

    def lint(self, namespace: str = DEFAULT_NAMESPACE, ignored: list[tuple[str, str]] = ()) -> DataFrame:
        """category and subject of findings that need no generated documents, without those that an ignored (category, pattern) names."""
        nodes = self.table("nodes", [namespace]).where("kind in ('function', 'class', 'type')")
        tags = self.table("tags", [namespace])
        bare = quality.unannotated(nodes, tags.select("node_id")).select(F.lit("unannotated").alias("category"), F.col("qualified_name").alias("subject"))
        intent = tags.where("kind = 'intent' and trim(value) <> ''").select("node_id")
        part = nodes.join(tags.select("node_id"), "node_id", "left_semi").join(intent, "node_id", "left_anti").select(F.lit("incomplete").alias("category"), F.col("qualified_name").alias("subject"))
        found = bare.unionByName(part)
        return quality.without_ignored(found, self.spark.createDataFrame(list(ignored), "category string, pattern string")) if ignored else found


def response(rows: DataFrame, query: str, limit: int, offset: int) -> dict:
    """The answer of a search: files with their hits in order, and how to go on. For a page of limit + 1 files, which is small."""
    files: dict[tuple, dict] = {}
    for r in rows.collect():
        f = files.setdefault((r.namespace, r.file_path), {"namespace": r.namespace, "file_path": r.file_path, "hits": [], "no": r.file_no})
        f["hits"].append({"name": r.name, "qualified_name": r.qualified_name, "kind": r.kind, "start_line": r.start_line, "matched": list(r.matched)})
    shown = [f for f in files.values() if f["no"] <= offset + limit]
    more = any(f["no"] > offset + limit for f in files.values())
    last = max((f.pop("no") for f in files.values() if f in shown), default=offset)
    return {"query": query, "offset": offset, "files": shown, "has_more": more, "next_offset": last if more else None}


class ResultCache:
    """Answers by key for a while; the soonest to expire goes when it is full."""

    def __init__(self, seconds: float = 300, most: int = 1000, clock=None):
        import time

        self.seconds, self.most, self.clock, self.held = seconds, most, clock or time.monotonic, {}

    def get(self, key: str) -> str | None:
        value, until = self.held.get(key, (None, 0))
        if until <= self.clock():
            self.held.pop(key, None)
            return None
        return value

    def put(self, key: str, value: str) -> None:
        if key not in self.held and len(self.held) >= self.most:
            self.held.pop(min(self.held, key=lambda k: self.held[k][1]))
        self.held[key] = (value, self.clock() + self.seconds)

    def flush(self) -> None:
        self.held.clear()


# Words of a task and the tools to begin with; the first row with a word of the task counts.
TOOLS = (
    ("review pr merge diff", "detect_changes get_affected_flows search"),
    ("debug bug error fix", "search query_graph trace_flow"),
    ("refactor rename dead clean", "get_impact_radius query_graph search"),
    ("onboard understand explore arch", "list_flows get_minimal_context search"),
    ("", "detect_changes search query_graph"),
)


def suggest_tools(task: str) -> list[str]:
    """Three tools that the words of a task speak for, in order."""
    low = task.lower()
    return next(tools.split() for words, tools in TOOLS if not words or any(w in low for w in words.split()))
