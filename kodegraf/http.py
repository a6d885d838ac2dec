"""JSON answers for a web front: one function a path, over the engine. Hosting is left to the caller."""

from __future__ import annotations

from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

from kodegraf.api import Engine, NotFound
from kodegraf.operators import scans, tree


def _rows(df: DataFrame, most: int = 500) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


def answer(engine: Engine, url: str) -> tuple[int, object]:
    """(status, JSON value) of a GET."""
    parts = urlsplit(url)
    args = {k: v[0] for k, v in parse_qs(parts.query).items()}
    ns = args.get("namespace", "default")
    limit, offset = int(args.get("limit", 10)), int(args.get("offset", 0))
    routes = {
        "namespaces": lambda: _rows(engine.list_namespaces()),
        "tree": lambda: engine.wiki_tree(ns, int(args.get("depth", 2))),
        "search": lambda: _rows(tree.tree_search(tree.tree(engine.table("nodes", [ns])), args["q"], limit)),
        "retrieve": lambda: _rows(engine.search(args["q"], limit, offset, args.get("path", ""), [ns])),
        "node": lambda: _rows(engine.get_node(args["name"], ns)),
        "describe": lambda: dict(zip(("scope", "rows"), (lambda s: (s[0], _rows(s[1])))(engine.describe(args["target"], ns)))),
        "references": lambda: _rows(scans.resolve_reference(engine.table("nodes", [ns]), args.get("path"), args.get("symbol"))),
        "graph": lambda: dict(zip(("nodes", "edges"), map(_rows, scans.graph_view(engine.table("nodes", [ns]), engine.table("edges", [ns]), limit, args.get("kinds", "calls").split(","))))),
    }
    try:
        found = routes.get(parts.path.rstrip("/").rsplit("/", 1)[-1])
        return (200, found()) if found else (404, {"error": "unknown path"})
    except NotFound as e:
        return 404, {"error": str(e)}
    except (KeyError, ValueError) as e:
        return 400, {"error": str(e)}
