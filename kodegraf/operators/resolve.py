"""Edge resolution: interval joins, suffix joins and cascades of unique lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kodegraf.operators.quality import unique_values

CALLABLE = ("function", "test")
BUCKET = 64


def enclosing_callable(points: DataFrame, nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(file_path, line, node_id): the smallest function or test around each point; ties go to the earlier start, then the lower id.

    Ranges are cut into buckets of lines, so that a long file is not joined by its path alone.
    """
    p = points.select("file_path", "line").distinct().withColumn("b", F.floor(F.col("line") / bucket))
    n = nodes.where(F.col("kind").isin(*CALLABLE)).select("file_path", "node_id", "start_line", "end_line").withColumn("b", F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))))
    inside = p.join(n, ["file_path", "b"]).where("line between start_line and end_line")
    return inside.groupBy("file_path", "line").agg(F.min_by("node_id", F.struct(F.col("end_line") - F.col("start_line"), "start_line", "node_id")).alias("node_id"))


def import_suffix(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """(import_path, file_path, depth): files of the directory that ends in the longest run of the import's last segments.

    Both sides explode their suffixes and meet by equality. All winners must lie
    in one directory; the smallest path stands for them.
    """
    suffixes = lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(p, F.size(p) - i + 1, i), "/").alias("suffix")))
    imp = imports.select("import_path").distinct().select("import_path", F.inline(suffixes(F.split("import_path", "/"))))
    folder = F.regexp_replace("file_path", "/?[^/]*$", "")
    files = nodes.where(F.col("kind") == "file").select("file_path", folder.alias("dir")).where("dir <> ''").select("file_path", "dir", F.inline(suffixes(F.split("dir", "/"))))
    met = imp.join(files.drop("depth"), "suffix")
    best = met.withColumn("r", F.rank().over(Window.partitionBy("import_path").orderBy(F.col("depth").desc()))).where("r = 1")
    return best.groupBy("import_path").agg(F.countDistinct("dir").alias("n"), F.min("file_path").alias("file_path"), F.max("depth").alias("depth")).where("n = 1").drop("n")


def resolve_calls(calls: DataFrame, nodes: DataFrame, fallback: bool = False, implements: DataFrame | None = None) -> DataFrame:
    """Adds to_node_id and rule to calls (call_id, namespace, file_path, callee, receiver).

    The first rule that gives exactly one node decides: the method of the
    caller's receiver, with implements (namespace, interface, implementer) the
    method of the only type that implements the called interface, the qualified
    name, an owner and name beside the caller or its type, the caller's package
    and the bare name, the bare name in the caller's file; then, if asked for, the first callable of that name in place order, as
    a fallback.
    """
    n = nodes.where(F.col("kind").isin(*CALLABLE)).select("namespace", "node_id", "name", "qualified_name", F.col("file_path").alias("path"), "start_line")
    bare = F.regexp_extract("callee", r"([^.:]+)$", 1)
    c = calls.withColumn("bare", bare).withColumn("own", F.concat_ws(".", "receiver", bare)).withColumn("peer", F.concat_ws(".", F.regexp_extract("receiver", r"^([^.]+)", 1), bare))
    # A callee with an owner is looked for beside the caller, and beside the caller's own type.
    owned = F.col("receiver").isNotNull() & F.col("callee").contains(".")
    c = c.withColumn("beside", F.when(owned, F.concat_ws(".", "receiver", "callee"))).withColumn("near", F.when(owned, F.concat_ws(".", F.regexp_extract("receiver", r"^(.+)[.][^.]+$", 1), "callee")))
    by_qn = unique_values(n, ["namespace", "qualified_name"], "node_id")
    by_file = unique_values(n, ["namespace", "path", "name"], "node_id")
    lookups = [("receiver", by_qn, {"qualified_name": "own"}), ("qualified", by_qn, {"qualified_name": "callee"}), ("beside", by_qn, {"qualified_name": "beside"}), ("near", by_qn, {"qualified_name": "near"}), ("package", by_qn, {"qualified_name": "peer"}), ("file", by_file, {"path": "file_path", "name": "bare"})]
    if fallback:
        first = n.groupBy("namespace", "name").agg(F.min_by("node_id", F.struct("path", "start_line", "qualified_name", "node_id")).alias("node_id"))
        lookups.append(("fallback", first, {"name": "bare"}))
    for rule, table, on in lookups:
        c = c.join(table.withColumnsRenamed(on | {"node_id": f"__{rule}"}), ["namespace", *on.values()], "left")
    names = [rule for rule, _, _ in lookups]
    if implements is not None:
        c = c.join(_through(implements, n).withColumnRenamed("node_id", "__dispatch"), ["namespace", "callee"], "left")
        names.insert(1, "dispatch")
    target, which = F.coalesce(*[F.col(f"__{r}") for r in names]), F.coalesce(*[F.when(F.col(f"__{r}").isNotNull(), r) for r in names])
    return c.withColumn("to_node_id", target).withColumn("rule", which).select(*calls.columns, "to_node_id", "rule")


def _through(implements: DataFrame, methods: DataFrame) -> DataFrame:
    """(namespace, callee, node_id): for interfaces, by qualified and by bare name, the method of the only implementer that has it. `.` and `::` part names alike."""
    impl = implements.select("namespace", "interface", F.col("implementer").alias("owner")).distinct()
    owned = methods.select("namespace", "node_id", F.regexp_replace("qualified_name", r"[.:]+[^.:]+$", "").alias("owner"), F.regexp_extract("qualified_name", r"([^.:]+)$", 1).alias("method"))
    met = impl.join(owned, ["namespace", "owner"])
    names = F.array_distinct(F.array(F.col("interface"), F.regexp_extract("interface", r"([^.:]+)$", 1)))
    spoken = met.withColumn("name", F.explode(names)).withColumn("callee", F.explode(F.array(F.concat_ws(".", "name", "method"), F.concat_ws("::", "name", "method"))))
    return unique_values(spoken, ["namespace", "callee"], "node_id")


def interface_dispatch(calls: DataFrame, implements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(call_id, to_node_id): the method of the only type that implements the called interface; else the interface's own method."""
    owner = F.regexp_replace("callee", r"[.:]+[^.:]+$", "")
    method = F.regexp_extract("callee", r"([^.:]+)$", 1)
    c = calls.select("call_id", "namespace", owner.alias("owner"), method.alias("method"))
    n = nodes.where(F.col("kind").isin(*CALLABLE)).select("namespace", F.col("qualified_name").alias("qn"), "node_id")
    impl = implements.select("namespace", F.col("interface").alias("owner"), F.col("implementer").alias("impl")).distinct()
    through = c.join(impl, ["namespace", "owner"]).withColumn("qn", F.concat_ws(".", "impl", "method")).join(n, ["namespace", "qn"])
    only = unique_values(through, ["call_id"], "node_id").withColumnRenamed("node_id", "only")
    own = unique_values(c.withColumn("qn", F.concat_ws(".", "owner", "method")).join(n, ["namespace", "qn"]), ["call_id"], "node_id").withColumnRenamed("node_id", "own")
    return c.join(only, "call_id", "left").join(own, "call_id", "left").select("call_id", F.coalesce("only", "own").alias("to_node_id")).where("to_node_id is not null")


def structural_implements(methods: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(package, receiver, interface): receivers whose method set holds all methods of an interface of their package."""
    want = interfaces.select("package", "interface", "method").distinct()
    size = want.groupBy("package", "interface").agg(F.count("*").alias("size"))
    have = methods.select("package", "receiver", "method").distinct().join(want, ["package", "method"]).groupBy("package", "receiver", "interface").agg(F.count("*").alias("n"))
    return have.join(size, ["package", "interface"]).where("n = size").select("package", "receiver", "interface")


def tested_by(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_path, line, callee, node_id): calls inside a test of their file."""
    tests = nodes.where(F.col("kind") == "test")
    return calls.select("file_path", "line", "callee").distinct().join(enclosing_callable(calls, tests), ["file_path", "line"])


def as_of_binding(uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """Adds type: that of the latest binding of the variable at or before the line, in its file. A merge of both sides by line, without pairs."""
    b = bindings.select("file_path", "variable", F.col("line").alias("l"), F.lit(0).alias("use"), F.col("type").alias("t"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in uses.schema if f.name not in ("file_path", "variable")])
    u = uses.select("file_path", "variable", F.col("line").alias("l"), F.lit(1).alias("use"), F.lit(None).cast("string").alias("t"), *[F.col(f.name) for f in uses.schema if f.name not in ("file_path", "variable")])
    w = Window.partitionBy("file_path", "variable").orderBy("l", "use").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return b.unionByName(u).withColumn("type", F.last("t", ignorenulls=True).over(w)).where("use = 1 and type is not null").select(*uses.columns, "type")


def bind_comments(comments: DataFrame, nodes: DataFrame, code_lines: DataFrame) -> DataFrame:
    """(node_id, comment_id): the first comment of a file that ends above a node with nothing but blank, comment and decorator lines between.

    code_lines (file_path, line and, for runs of lines, end_line) are the other
    lines. The last code line up to a comment's end and that before a node agree
    exactly if none lies between: both come from one window over the lines of a
    file, and comments meet nodes by equality.
    """
    end = F.col("end_line") if "end_line" in code_lines.columns else F.col("line")
    run = F.struct(F.col("line").cast("long").alias("s"), end.cast("long").alias("e"))
    none = F.lit(None).cast(run_type := "struct<s: bigint, e: bigint>")
    marks = code_lines.select("file_path", F.col("line").cast("long").alias("at"), F.lit(0).alias("what"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("cs"), run.cast(run_type).alias("run"))
    # Before a node counts what lies above its line; a comment's last line counts whole.
    heads = nodes.select("file_path", (F.col("start_line") - 1).cast("long").alias("at"), F.lit(1).alias("what"), F.col("node_id").alias("id"), F.lit(None).cast("long").alias("cs"), none.alias("run"))
    said = comments.select("file_path", F.col("end_line").cast("long").alias("at"), F.lit(2).alias("what"), F.col("comment_id").alias("id"), F.col("start_line").cast("long").alias("cs"), none.alias("run"))
    before = Window.partitionBy("file_path").orderBy("at", "what").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("run", ignorenulls=True).over(before)
    placed = marks.unionByName(heads).unionByName(said).withColumn("run", last).withColumn("low", F.when(F.col("run").isNull(), 0).otherwise(F.least("run.e", "at")))
    first = placed.where("what = 2").groupBy("file_path", "low").agg(F.min(F.struct("cs", F.col("id").alias("comment_id"), F.col("at").alias("ce"))).alias("c"))
    found = placed.where("what = 1").join(first, ["file_path", "low"]).where("c.ce <= at")
    return found.select(F.col("id").alias("node_id"), "c.comment_id")


def package_contains(packages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from package nodes to the file nodes of their files, where exactly one node of the kind exists; the fingerprint hashes import path and file."""
    p = unique_values(nodes.where(F.col("kind") == "package"), ["namespace", "qualified_name"], "node_id").withColumnsRenamed({"node_id": "from_node_id", "qualified_name": "import_path"})
    f = unique_values(nodes.where(F.col("kind") == "file"), ["namespace", "file_path"], "node_id").withColumnRenamed("node_id", "to_node_id")
    return packages.join(p, ["namespace", "import_path"]).join(f, ["namespace", "file_path"]).select(
        "namespace", "from_node_id", "to_node_id", F.lit("contains").alias("kind"), "file_path", F.concat(F.lit("contains:package:"), F.sha2(F.concat_ws("\0", "import_path", "file_path"), 256)).alias("fingerprint")
    )


def lookup_keys(nodes: DataFrame) -> DataFrame:
    """(node_id, key): every name a node may be called by: its name, its qualified name, both spelled with dots, and all tails of it."""
    dotted = F.regexp_replace("qualified_name", "::", ".")
    parts = F.split(dotted, "[.]")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    return nodes.select("node_id", F.explode(F.array_distinct(F.concat(F.array("name", "qualified_name"), tails))).alias("key"))


def external_import(path):
    """Whether an import path looks like one from outside: not relative, and a scheme, a scope, no slash or a dotted first segment."""
    first = F.split_part(path, F.lit("/"), F.lit(1))
    return ~F.startswith(path, F.lit(".")) & (F.startswith(path, F.lit("node:")) | F.startswith(path, F.lit("@")) | F.contains(path, F.lit("://")) | ~F.contains(path, F.lit("/")) | F.contains(first, F.lit(".")))
