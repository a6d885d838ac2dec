"""Commands over the engine: python -m kodegraf.cli COMMAND --store DIR ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from kodegraf.api import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kodegraf")
    p.add_argument("--store", required=True, help="folder of the graph's tables")
    p.add_argument("--namespace", default="default")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="parse a source tree and rebuild what depends on it")
    b.add_argument("path")
    b.add_argument("--include", action="append", default=[])
    b.add_argument("--exclude", action="append", default=[])
    b.add_argument("--fallback-calls", action="store_true")
    b.add_argument("--postprocess", choices=["full", "minimal", "none"], default="full")
    u = sub.add_parser("update", help="parse what changed and refresh what depends on it")
    u.add_argument("path")
    u.add_argument("--include", action="append", default=[])
    u.add_argument("--exclude", action="append", default=[])
    u.add_argument("--fallback-calls", action="store_true")
    for name in ("status", "namespaces", "purge", "delete"):
        sub.add_parser(name)
    n = sub.add_parser("lint", help="findings about comments; rules are CATEGORY=PATTERN of findings to pass over, * for any run")
    n.add_argument("--rule", action="append", default=[])
    n.add_argument("--strict", action="store_true", help="fail if there is a finding")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--path", default="")
    d = sub.add_parser("describe")
    d.add_argument("target")
    q = sub.add_parser("query")
    q.add_argument("pattern")
    q.add_argument("target")
    c = sub.add_parser("changes")
    c.add_argument("repo")
    c.add_argument("--base", default="HEAD~1")
    o = sub.add_parser("docs")
    o.add_argument("out")
    for x in (s, q, c):
        x.add_argument("--limit", type=int, default=10)
        x.add_argument("--offset", type=int, default=0)
    return p


def run(spark: SparkSession, argv: list[str]) -> DataFrame | dict | None:
    a = parser().parse_args(argv)
    e, ns = Engine(spark, a.store), a.namespace
    if a.command == "build":
        return e.build(a.path, ns, a.postprocess, includes=a.include, excludes=a.exclude, fallback_calls=a.fallback_calls)
    if a.command == "update":
        return e.update(a.path, ns, a.include, a.exclude, a.fallback_calls)
    if a.command == "docs":
        return e.write_docs(a.out, ns)
    if a.command == "purge":
        return e.purge_index(ns)
    if a.command == "delete":
        return e.delete_namespace(ns)
    if a.command == "lint":
        found = e.lint(ns, [tuple(r.split("=", 1)) for r in a.rule])
        if a.strict and not found.isEmpty():
            raise SystemExit(1)
        return found
    return {
        "status": lambda: e.list_graph_stats([ns]), "namespaces": e.list_namespaces,
        "search": lambda: e.search(a.query, a.limit, a.offset, a.path, [ns]), "describe": lambda: e.describe(a.target, ns)[1],
        "query": lambda: e.query_graph(a.pattern, a.target, ns, a.limit, a.offset), "changes": lambda: e.detect_changes(a.repo, a.base, a.limit, a.offset, ns),
    }[a.command]()


def main(argv: list[str] | None = None) -> None:
    import sys

    out = run(SparkSession.builder.appName("kodegraf").getOrCreate(), sys.argv[1:] if argv is None else argv)
    if isinstance(out, DataFrame):
        for line in out.toJSON().toLocalIterator():
            print(line)
    elif out is not None:
        print(json.dumps(out))


if __name__ == "__main__":
    main()
