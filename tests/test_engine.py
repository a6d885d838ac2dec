"""The engine over a small source tree, structured comments, and the event queue."""

import json

import pytest

from kodegraf.api import Engine, NotFound, suggest_tools
from kodegraf.cli import run
from kodegraf.functions import annotations as ann
from kodegraf.functions import paths
from kodegraf.http import answer
from kodegraf.sources import code
from kodegraf.streaming import queue

GO = """package store

// Save writes a record.
//
// Kept simple on purpose.
// @intent keep records durable
// @see ccg://default/app/main.py#main
func Save(r Record) error {
	return flush(r)
}

func flush(r Record) error {
	return nil
}

func TestSave(t *testing.T) {
	Save(Record{})
}
"""
PY = '''"""Entry of the program."""
import app.util


class Base:
    pass


class Child(Base):
    def go(self):
        """Run.

        @domainRule never twice
        """
        return helper()


def helper():
    return 1


def main():
    helper()
'''


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    src, store = tmp_path_factory.mktemp("src"), tmp_path_factory.mktemp("store")
    for p, text in {"store/save.go": GO, "app/main.py": PY, "app/util.py": "def tool():\n    pass\n", "vendor/x.go": GO, "broken.py": "def ("}.items():
        (src / p).parent.mkdir(exist_ok=True, parents=True)
        (src / p).write_text(text)
    e = Engine(spark, str(store))
    assert e.build(str(src))["status"] == "ok"
    e.sync_cross_refs()
    return e


def names(df):
    return sorted(r.qualified_name for r in df.collect())


def test_nodes_and_edges(engine):
    assert {"store.Save", "store.flush", "app.main.Child.go", "app.main.helper", "broken.py"} <= set(names(engine.table("nodes")))
    assert "vendor" not in " ".join(r.file_path for r in engine.table("nodes").collect())
    assert names(engine.query_graph("callers_of", "app.main.helper")) == ["app.main.Child.go", "app.main.main"]
    assert names(engine.query_graph("callees_of", "Save")) == ["store.flush"]
    assert names(engine.query_graph("tests_for", "store.Save")) == ["store.TestSave"]
    assert names(engine.query_graph("inheritors_of", "app.main.Base")) == ["app.main.Child"]
    assert names(engine.query_graph("imports_of", "app/main.py")) == ["app/util.py"]
    with pytest.raises(NotFound):
        engine.query_graph("callers_of", "nothing")


def test_answers(engine):
    assert names(engine.trace_flow("store.TestSave")) == ["store.Save", "store.TestSave", "store.flush"]
    assert "store.Save" in names(engine.get_impact_radius("store.flush"))
    assert engine.describe("app")[0] == "directory" and engine.describe("app/main.py")[0] == "file" and engine.describe("zzz")[0] == "unknown"
    assert [r.value for r in engine.get_annotation("store.Save").collect() if r.kind == "intent"] == ["keep records durable"]
    hits = engine.search("Save").collect()
    assert hits[0].qualified_name == "store.Save" and "name" in hits[0].matched
    assert any("intent" in r.matched for r in engine.search("durable records").collect())
    # The first comment of a file speaks for the file too.
    assert [(r.status, r.to_path) for r in engine.list_cross_refs("default").collect()] == [("resolved", "app/main.py")] * 2
    assert engine.list_graph_stats().first().namespace == "default"
    assert engine.list_flows().count() > 0
    assert engine.lint().count() > 0
    assert answer(engine, "/api/node?name=store.Save")[1][0]["kind"] == "function"
    assert answer(engine, "/api/nope")[0] == 404 and answer(engine, "/api/node")[0] == 400
    assert run(engine.spark, ["--store", engine.root, "status"]).count() == 1
    assert suggest_tools("review the diff") == ["detect_changes", "get_affected_flows", "search"]
    assert suggest_tools("Fix the bug") == ["search", "query_graph", "trace_flow"] and suggest_tools("") == ["detect_changes", "search", "query_graph"]
    assert engine.search("!!!").count() == 0 and engine.search("").count() == 0
    assert "store.Save" in names(engine.search("Kept simple purpose", include_weak=True))  # the comment's text is indexed
    page = engine.search_answer("Save", 1)
    assert page["files"][0]["file_path"] == "store/save.go" and not page["has_more"] and "note" not in page
    assert engine.search_answer("nothinglikethis")["note"] == "nothing was retrieved"
    assert engine.lint(ignored=[("unannotated", "*")]).where("category = 'unannotated'").count() == 0


def test_generated_documents_are_read_pruned_and_listed(engine, tmp_path):
    out = str(tmp_path / "docs")
    engine.write_docs(out)
    hand = engine.spark.createDataFrame([("notes.md", "by hand", "", False), ("old.go.md", "gone", "", True)], "file_path string, markdown string, hash string, generated boolean")
    engine.spark.read.parquet(out).unionByName(hand).write.parquet(out + "2")
    engine.write_docs(out + "2")
    assert sorted(r.file_path for r in engine.spark.read.parquet(out + "2").collect()) == ["app/main.py.md", "app/util.py.md", "index.md", "notes.md", "store/save.go.md"]
    assert "`store.Save`" in engine.get_doc_content(out, "store/save.go.md") and "[app/main.py.md](app/main.py.md)" in engine.get_doc_content(out, "./index.md")
    for bad in ("../x.md", "x.txt"):
        with pytest.raises(ValueError):
            engine.get_doc_content(out, bad)
    with pytest.raises(NotFound):
        engine.get_doc_content(out, "none.md")


TREE = {
    "go.mod": "module ex.com/shop\n\ngo 1.22\n",
    "store/types.go": "package store\n\ntype Saver interface {\n\tSave(x int) error\n}\n\ntype Base struct {\n\tn int\n}\n\ntype Disk struct {\n\tBase\n\tpath string\n}\n\nfunc (d *Disk) Save(x int) error {\n\treturn nil\n}\n",
    "store/use.go": "package store\n\nvar _ Saver = (*Disk)(nil)\n\n// An aside.\nvar cache = map[int]int{}\n\nfunc Run(s Saver) {\n\tSaver.Save(s, 1)\n}\n",
    "py/app/main.py": "# Starts all.\n# @intent begin here\nimport py.lib\n\n\n# Runs it.\n@wrapped\ndef main():\n    pass\n",
    "py/lib/__init__.py": "",
    "java/a/Shop.java": "package com.shop;\n\npublic class Shop extends\n    Base<Item> implements Open,\n    Closed {\n  private Till till;\n  void run() {\n    till.count(1);\n  }\n}\n",
    "java/a/Till.java": "package com.shop;\n\npublic class Till {\n  public int count(int x) {\n    return x;\n  }\n}\n",
    "web/package.json": '{"name": "@shop/web"}',
    "package.json": '{"name": "shop", "workspaces": ["web"]}',
    "web/src/ui/page.ts": "import { x } from './x'\nexport class Page extends Base implements View {\n}\n",
    "tsconfig.json": '{"compilerOptions": {"paths": {"@ui/*": ["web/src/*"]}}} // comment',
    "rust/s.rs": "use std::{io::{self, Read}, fmt};\n\npub trait Speak {\n    fn say(&self);\n}\n\npub struct Dog {\n}\n\nimpl Speak for Dog {\n    fn say(&self) {\n    }\n}\n\nfn go(d: Dog) {\n    Speak::say(&d);\n}\n",
}


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    src = tmp_path_factory.mktemp("shop")
    for p, text in TREE.items():
        (src / p).parent.mkdir(exist_ok=True, parents=True)
        (src / p).write_text(text)
    e = Engine(spark, str(tmp_path_factory.mktemp("graph")))
    assert e.build(str(src), "shop")["status"] == "ok"
    return e, src


def pairs(e, kind):
    by_id = {r.node_id: r.qualified_name for r in e.table("nodes", ["shop"]).collect()}
    return {(by_id.get(r.from_node_id), by_id.get(r.to_node_id)) for r in e.table("edges", ["shop"]).where(f"kind = '{kind}'").collect() if r.from_node_id and r.to_node_id}


def test_packages_of_all_languages(shop):
    e, _ = shop
    got = {(r.qualified_name, r.file_path) for r in e.table("nodes", ["shop"]).where("kind = 'package'").collect()}
    assert got == {("ex.com/shop/store", "store"), ("py.app", "py/app"), ("py.lib", "py/lib"), ("com.shop", "java/a"), ("@shop/web/src/ui", "web/src/ui"), ("@ui/ui", "web/src/ui")}
    assert {("ex.com/shop/store", "store/use.go"), ("com.shop", "java/a/Till.java"), ("@ui/ui", "web/src/ui/page.ts")} <= pairs(e, "contains")
    assert ("py/app/main.py", "py.lib") in pairs(e, "imports_from")


def test_relations_of_types_and_dispatch(shop):
    e, _ = shop
    assert {("store.Disk", "store.Saver"), ("Dog", "Speak")} <= pairs(e, "implements") and ("store.Disk", "store.Base") in pairs(e, "inherits")
    edges = {(r.kind, r.source_text, r.target_text) for r in e.table("edges", ["shop"]).collect()}
    assert {("inherits", "com.shop.Shop", "Base"), ("implements", "com.shop.Shop", "Open"), ("implements", "com.shop.Shop", "Closed"), ("inherits", "Page", "Base"), ("implements", "Page", "View")} <= edges
    assert {("imports_from", None, x) for x in ("std::io", "std::io::Read", "std::fmt")} <= edges
    # By the type of a field, through the interface's only implementer, and through a trait's.
    assert {("com.shop.Shop.run", "com.shop.Till.count"), ("store.Run", "store.Disk.Save"), ("go", "Dog.say")} <= pairs(e, "calls")


def test_comments_above_other_code_bind_to_nothing(shop):
    e, _ = shop
    by_id = {r.node_id: r.qualified_name for r in e.table("nodes", ["shop"]).collect()}
    assert {(by_id[r.node_id], r.summary) for r in e.table("tags", ["shop"]).collect()} == {("py.app.main.main", "Runs it."), ("py/app/main.py", "Starts all."), ("store/use.go", "An aside.")}


def test_update_refreshes_what_is_derived(shop):
    e, src = shop
    assert e.search("Flush", namespaces=["shop"]).count() == 0
    (src / "store" / "flush.go").write_text("package store\n\n// Empties the buffers.\n// @intent never lose a record\nfunc Flush(d *Disk) {\n\td.Save(1)\n}\n")
    got = e.update(str(src), "shop")
    assert (got["added"], got["modified"], got["deleted"]) == (1, 0, 0)
    assert e.search("Flush", namespaces=["shop"]).first().qualified_name == "store.Flush"
    assert "store.Flush" in names(e.search("lose record", namespaces=["shop"]))
    assert "Flush" in {r.name for r in e.list_flows(namespace="shop", limit=100).collect()}
    assert ("ex.com/shop/store", "store/flush.go") in pairs(e, "contains") and ("store.Disk", "store.Saver") in pairs(e, "implements")
    (src / "store" / "flush.go").unlink()
    assert e.update(str(src), "shop")["deleted"] == 1
    assert e.search("Flush", namespaces=["shop"]).count() == 0
    # As a build from scratch gives it.
    fresh = Engine(e.spark, e.root + "-fresh")
    fresh.build(str(src), "shop")
    for t in ("nodes", "edges", "documents", "postings", "reasons", "flow_members"):
        a, b = (sorted(map(str, x.table(t, ["shop"]).collect())) for x in (e, fresh))
        assert a == b, t
    e.purge_index("shop")
    assert e.search("Save", namespaces=["shop"]).count() == 0


def test_update_parses_what_changed(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def one():\n    later()\n\n\ndef two():\n    one()\n")
    (src / "b.py").write_text("def gone():\n    pass\n")
    e = Engine(spark, str(tmp_path / "store"))
    e.parse_project(str(src), "u", fallback_calls=True)
    assert e.update(str(src), "u")["skipped"] == 2
    (src / "b.py").unlink()
    (src / "c.py").write_text("def later():\n    pass\n")
    got = e.update(str(src), "u", fallback_calls=True)
    assert (got["added"], got["modified"], got["skipped"], got["deleted"]) == (1, 0, 1, 1)
    assert names(e.table("nodes", ["u"]).where("kind <> 'file'")) == ["a.one", "a.two", "c.later"]
    calls = {(r.source, r.target) for r in e.table("edges", ["u"]).where("kind in ('calls', 'fallback_calls')").selectExpr("kind as source", "target_text as target").collect()}
    assert calls == {("calls", "one"), ("fallback_calls", "later")}


def test_stored_flows_are_whole(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("".join(f"def f{i}():\n    pass\n\n\n" for i in range(250)) + "def main():\n" + "".join(f"    f{i}()\n" for i in range(250)))
    e = Engine(spark, str(tmp_path / "store"))
    assert e.build(str(src), "w")["status"] == "ok"
    assert [(r.name, r.n_members) for r in e.list_flows(namespace="w").collect()] == [("main", 251)]
    assert e.trace_flow("a.main", namespace="w").count() == 200


def test_answers_are_kept_for_a_while():
    from kodegraf.api import ResultCache

    now = [0.0]
    c = ResultCache(10, 2, lambda: now[0])
    c.put("a", "1")
    now[0] = 5
    c.put("b", "2")
    c.put("c", "3")
    assert (c.get("a"), c.get("b"), c.get("c")) == (None, "2", "3")
    now[0] = 16
    assert c.get("b") is None
    c.flush()


def test_structured_comments():
    a = ann.parse(ann.normalize("/**\n * Sums.\n * Both.\n *\n * More.\n * @param {int} x the first\n *   of two\n * @returns y\n */", "java"))
    assert (a["summary"], a["context"]) == ("Sums. Both.", "More.")
    assert [(t["kind"], t["type"], t["name"], t["value"]) for t in a["tags"]] == [("param", "int", "x", "the first of two"), ("return", "", "", "y")]
    assert ann.normalize("//go:noinline\n// Text", "go") == "Text" and ann.normalize("# a\n# b", "python") == "a\nb"
    assert ann.parse("") == {"summary": "", "context": "", "tags": []}


def test_fingerprints_round_trip(spark):
    from pyspark.sql import functions as F

    from kodegraf.functions import fingerprints as fp

    f = F.lit("a/x.go")
    cases = {
        "calls": (fp.build("calls", f, F.lit("b.C"), F.lit(7)), (None, "b.C", 7)), "imports": (fp.build("imports_from", f, F.lit("x:y"), F.lit(1)), (None, "x:y", 1)),
        "contains": (fp.build("contains", f, F.lit("p.T")), (None, "p.T", None)), "implements": (fp.build("implements", f, F.lit("T"), F.lit("q::I")), ("T", "q::I", None)),
        "inherits": (fp.build("inherits", f, F.lit("p::T"), F.lit("p::B")), ("p::T", "p::B", None)), "legacy": (F.lit("inherits:a/x.go:T:B"), ("T", "B", None)),
        "tested": (fp.build("tested_by", f, F.lit("Run"), F.lit("p.TestRun")), ("p.TestRun", "Run", None)),
    }
    row = spark.range(1).select(*[fp.parse(c, f).alias(k) for k, (c, _) in cases.items()]).first()
    assert {k: (row[k].source, row[k].target, row[k].line) for k in cases} == {k: want for k, (_, want) in cases.items()}


def test_path_rules():
    assert paths.split_top_level("a, Map<b, c>, f(x, y), [d,e]") == ["a", "Map<b, c>", "f(x, y)", "[d,e]"] and paths.split_top_level("") == []
    assert paths.clean_target(" ./a//b/ ") == "a/b"
    assert paths.excluded("a/b.go", ["a"]) and paths.excluded("x/b_test.go", ["*_test.go"]) and paths.excluded("a/gen/x.go", [r".*/gen/.*"])
    assert not paths.excluded("ab/c.go", ["a"]) and not paths.excluded("a", ["("])
    assert paths.included("a", ["a/b"]) and paths.included("a/b/c", ["a/b"]) and not paths.included("c", ["a/b"])


def test_files_that_cannot_be_parsed_keep_their_node():
    assert [r["kind"] for r in code.parse_file("x.py", b"def (")] == ["file"]
    assert [r["kind"] for r in code.parse_file("x.go", b"\xff\xfe")] == ["file"]


def test_package_behind_a_long_comment():
    text = "// License.\n" * 100 + "package store\n\nfunc Save() {\n}\n"
    assert [r["qualified_name"] for r in code.parse_file("s/x.go", text.encode()) if r["rec"] == "node"] == ["s/x.go", "store.Save"]


def test_queue_hands_on_the_latest_admitted_event(spark, tmp_path):
    events = [
        {"ref": "refs/heads/main", "after": "1", "repository": {"full_name": "o/a", "clone_url": "u1"}},
        {"ref": "refs/heads/main", "after": "2", "repository": {"full_name": "o/a", "clone_url": "u2"}},
        {"ref": "refs/heads/dev", "after": "3", "repository": {"full_name": "o/a", "clone_url": "u3"}},
        {"ref": "refs/heads/main", "after": "4", "deleted": True, "repository": {"full_name": "o/b", "clone_url": "u4"}},
        {"ref": "refs/tags/v1", "after": "5", "repository": {"full_name": "o/b", "clone_url": "u5"}},
        {"ref": "refs/heads/main", "after": "6", "repository": {"full_name": "o/no", "clone_url": "u6"}},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(json.dumps({"time": i, "value": json.dumps(e)}) for i, e in enumerate(events)))
    stream = spark.readStream.schema("time long, value string").json(str(tmp_path / "in"))
    done = []
    q = queue.run_queue(stream, [("o/*", []), ("!o/no", [])], lambda *a: done.append(a), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert done == [("o/a", "main", "u2")]


def test_retries_and_signatures():
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise OSError

    assert not queue.with_retries(fails, waits.append) and len(calls) == 3 and waits == [1.0, 2.0]

    def never():
        calls.append(2)
        raise queue.NotRetryable

    assert not queue.with_retries(never, waits.append) and calls.count(2) == 1
    import hashlib
    import hmac

    assert queue.signed(b"x", b"k", "sha256=" + hmac.new(b"k", b"x", hashlib.sha256).hexdigest()) and not queue.signed(b"x", b"k", "sha256=00")


def test_windows_over_events(spark, tmp_path):
    got = queue.windowed_counts(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "1 hour")
    assert sum(r.n for r in got.collect()) == 1000
