"""Packages of a source tree, from declared packages, folders and manifests.

Manifests (go.mod, package.json, tsconfig.json) are small and few; they become
tables of scopes. A file meets its nearest scope by its own folder prefixes, so
that no range join is needed.
"""

from __future__ import annotations

import json
import os
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kodegraf.functions.paths import excluded
from kodegraf.sources.code import SKIPPED

MANIFESTS = ("go.mod", "package.json", "tsconfig.json")


def manifests(root: str) -> dict[str, str]:
    """Texts of the manifests below a root, by relative path."""
    found = {}
    for folder, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in SKIPPED)
        for f in sorted(set(files) & set(MANIFESTS)):
            with open(os.path.join(folder, f), encoding="utf-8", errors="replace") as h:
                found[os.path.relpath(os.path.join(folder, f), root).replace(os.sep, "/")] = h.read()
    return found


def go_module(text: str) -> str:
    m = re.search(r"^\s*module\s+\"?([^\s\"]+)", text, re.M)
    return m[1] if m else ""


def _json(text: str) -> dict:
    try:
        found = json.loads(re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S))
        return found if isinstance(found, dict) else {}
    except ValueError:
        return {}


def node_scopes(found: dict[str, str]) -> list[tuple[str, str]]:
    """(folder, import path) of the root package and of the packages of its workspaces."""
    root = _json(found.get("package.json", "{}"))
    globs = root.get("workspaces") or []
    globs = globs.get("packages", []) if isinstance(globs, dict) else globs
    wanted, unwanted = [g for g in globs if not g.startswith("!")], [g[1:] for g in globs if g.startswith("!")]
    out = [("", root["name"])] if root.get("name") else []
    for path, text in found.items():
        folder = posixpath.dirname(path)
        if posixpath.basename(path) == "package.json" and folder and excluded(folder, wanted) and not excluded(folder, unwanted) and (name := _json(text).get("name")):
            out.append((folder, name))
    return out


def alias_scopes(found: dict[str, str]) -> list[tuple[str, str, str]]:
    """(folder of the config, folder that an alias stands for, alias)."""
    out = []
    for path, text in found.items():
        if posixpath.basename(path) == "tsconfig.json":
            folder, options = posixpath.dirname(path), _json(text).get("compilerOptions") or {}
            for alias, targets in (options.get("paths") or {}).items():
                for t in targets:
                    to = posixpath.normpath(posixpath.join(folder, options.get("baseUrl") or ".", t.removesuffix("*").rstrip("/")))
                    out.append((folder, "" if to == "." else to, alias.removesuffix("*").rstrip("/")))
    return out


def discovered(spark: SparkSession, files: DataFrame, found: dict[str, str]) -> DataFrame:
    """(language, import_path, name, dir, file_path) of files (file_path, language, declared).

    Of one import path all files must agree on name, language and, but for
    declared packages (Java, Kotlin), which may be split, on the folder; others
    are ambiguous and drop.
    """
    f = files.select("file_path", "language", "declared", F.regexp_replace("file_path", "/?[^/]*$", "").alias("dir"))
    module = go_module(found.get("go.mod", ""))
    last = lambda path, sep: F.element_at(F.split(path, sep), -1)
    out = []
    go = f.where((F.col("language") == "go") & ~F.col("file_path").like("%\\_test.go") & F.col("declared").isNotNull() & ~F.col("declared").like("%\\_test"))
    if module:
        out.append(go.select("language", F.when(F.col("dir") == "", F.lit(module)).otherwise(F.concat(F.lit(module + "/"), "dir")).alias("import_path"), F.col("declared").alias("name"), "dir", "file_path"))
    dotted = F.regexp_replace("dir", "/", ".")
    out.append(f.where("language = 'python' and dir <> ''").select("language", dotted.alias("import_path"), last(dotted, "[.]").alias("name"), "dir", "file_path"))
    out.append(f.where("language in ('java', 'kotlin') and declared is not null").select("language", F.col("declared").alias("import_path"), last(F.col("declared"), "[.]").alias("name"), "dir", "file_path"))
    node = f.where("language in ('typescript', 'javascript') and dir <> ''").withColumn("name", last(F.col("dir"), "/"))
    parts = F.split("dir", "/")
    prefixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    above = node.withColumn("prefix", F.explode(prefixes))
    below = lambda folder: F.regexp_replace(F.expr(f"substring(dir, length({folder}) + 1)"), "^/", "")
    joined = lambda a, b: F.concat_ws("/", a, F.when(b != "", b))
    if scopes := node_scopes(found):
        s = spark.createDataFrame(scopes, "prefix string, scope string")
        best = above.join(s, "prefix").groupBy("language", "name", "dir", "file_path").agg(F.max_by(F.struct("prefix", "scope"), F.length("prefix")).alias("s"))
        out.append(best.select("language", joined(F.col("s.scope"), below("s.prefix")).alias("import_path"), "name", "dir", "file_path"))
    if aliases := alias_scopes(found):
        a = spark.createDataFrame(aliases, "config string, prefix string, alias string")
        met = above.where("language = 'typescript'").join(a, "prefix").where("config = '' or dir = config or startswith(dir, config || '/')")
        out.append(met.select("language", joined(F.when(F.col("alias") != "", F.col("alias")), below("prefix")).alias("import_path"), "name", "dir", "file_path").where("import_path <> ''"))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    split = F.first("language").isin("java", "kotlin")
    clear = every.groupBy("import_path").agg(F.countDistinct("name", "language").alias("n"), F.when(split, F.lit(1)).otherwise(F.countDistinct("dir")).alias("d"), F.min("dir").alias("first_dir")).where("n = 1 and d = 1")
    return every.distinct().join(clear.select("import_path", "first_dir"), "import_path").select("language", "import_path", "name", F.col("first_dir").alias("dir"), "file_path")
