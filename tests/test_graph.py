"""Graph operators on small literal cases, and queries against their SQL."""

import math
import random

import duckdb
import pytest

from kodegraf.operators import changes, quality, relations, resolve, scans, search, stats, store, traverse, tree
from kodegraf.plans import queries as Q
from kodegraf.sources.fixtures import Graph, T

SF = "/root/testdata/sf0.001"
NODE = "node_id long, namespace string, kind string, name string, qualified_name string, file_path string, start_line long, end_line long"
EDGE = "namespace string, from_node_id long, to_node_id long, kind string, file_path string, line long, fingerprint string"


def nodes(spark, *rows):
    return spark.createDataFrame([(i, "n", k, n, f"p.{n}", f, a, b) for i, k, n, f, a, b in rows], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([("n", a, b, k, "f.go", i, f"{k}:{i}") for i, (a, b, k) in enumerate(rows)], EDGE)


def starts(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "source long, node_id long")


def norm(v):
    return "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


SOME = (
    "detect_changes_top_risk callers_of call_evidence strict_tentative_counts flow_entrypoints flows_page affected_flows cross_refs_resolve hunk_overlaps graph_stats unresolved_diagnostics "
    "update_classification describe_folder impact_radius_d2 impact_radius_capped tokenize split_identifiers stop_words postings search_documents reason_rank can_answer rerank_blocks absorb_reasons "
    "evidence_cut file_paging federated_page natural_merge tree_children render_docs lint_stale lint_ignored merged_symbols enclosing_callable import_suffix_match resolve_calls as_of_binding bind_comments "
    "package_contains upsert_nodes upsert_edges_first_wins cascade_delete unresolved_replay coalesce_latest admission_last_match"
).split()


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, duck, name):
    df = Q.QUERIES[name](Graph(spark, SF))
    got = sorted(tuple(map(norm, r)) for r in df.select(*sorted(df.columns)).collect())
    res = duck.execute(Q.SQL[name])
    cols = [c[0] for c in res.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    assert sorted(df.columns) == sorted(cols)
    assert got == sorted(tuple(norm(r[i]) for i in order) for r in res.fetchall())


def test_impact_takes_depth_cycles_and_caps(spark):
    e = edges(spark, (1, 2, "calls"), (2, 3, "contains"), (3, 1, "calls"), (4, 3, "calls"), (4, 5, "calls"), (8, 9, "calls"))
    at = lambda d, n=200: {r.node_id: r.depth for r in traverse.impact(e, starts(spark, 1), d, max_nodes=n).collect()}
    assert at(0) == {1: 0}
    assert at(1) == {1: 0, 2: 1, 3: 1}
    assert at(9) == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    whole, cut = (traverse.impact(e, starts(spark, 1), 3, max_nodes=n).collect() for n in (5, 4))
    assert not any(r.truncated for r in whole) and all(r.truncated for r in cut) and len(cut) == 4
    assert [r.node_id for r in sorted(cut, key=lambda r: r.ordinal)][:3] == [1, 2, 3]  # outgoing before incoming


def test_flows_follow_the_order_of_the_frontier(spark):
    e = edges(spark, (1, 3, "calls"), (1, 2, "calls"), (2, 4, "calls"), (3, 5, "fallback_calls"), (5, 1, "calls"))
    run = lambda **k: [r.node_id for r in sorted(traverse.flows(e, starts(spark, 1), **k).collect(), key=lambda r: r.ordinal)]
    assert run() == [1, 3, 2, 5, 4]
    assert run(kinds=("calls",)) == [1, 3, 2, 4]
    assert run(max_nodes=3) == [1, 3, 2]
    two = traverse.flows(e, starts(spark, 2, 5)).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in two} == {2: 2, 5: 5}


def brute_reach(edges, starts, kinds):
    """(source, node_id, depth) of all that calls lead to, by breadth-first search."""
    out = {}
    for r in edges.where(edges.kind.isin(*kinds)).select("from_node_id", "to_node_id").distinct().collect():
        out.setdefault(r.from_node_id, []).append(r.to_node_id)
    found = set()
    for s in starts:
        at = {s: 0}
        for n in (line := [s]):
            for m in out.get(n, ()):
                if m not in at:
                    at[m] = at[n] + 1
                    line.append(m)
        found |= {(s, n, d) for n, d in at.items()}
    return found


def test_rebuilt_flows_reach_to_the_end(spark):
    g = Graph(spark, SF)
    called, inner = ("calls", "fallback_calls"), ("calls", "fallback_calls", "cross_ref", "inherits")
    entries = [r.node_id for r in relations.flow_entrypoints(g.nodes, g.edges).collect()]
    for name, edges, begin, kinds in (("rebuild_flows", g.edges, entries, called), ("trace_cross_namespace", scans.with_cross_refs(g.edges, g.cross_refs), [5 * T + 99], inner)):
        want = brute_reach(edges, begin, kinds)
        assert max(d for _, _, d in want) > 3
        assert {tuple(r) for r in Q.QUERIES[name](g).collect()} == want


def test_reach_takes_few_turns_for_long_chains(spark, monkeypatch):
    """Called nodes are traced once, by doubled depths: the tables written don't grow with the depth."""
    written, save = [], traverse.saved
    monkeypatch.setattr(traverse, "saved", lambda df, what="step": written.append(what) or save(df, what))
    chain = [(i, i + 1, "calls") for i in range(1, 41)]
    e = edges(spark, *chain, *((100 + i, 1, "calls") for i in range(60)))
    found = {tuple(r) for r in traverse.reach(e, starts(spark, *range(100, 160))).collect()}
    assert found == brute_reach(e, range(100, 160), ("calls",)) and len(found) == 60 * 42
    assert len(written) < 15


def test_rebuilt_flows_take_few_turns(spark, monkeypatch):
    written, save = [], traverse.saved
    monkeypatch.setattr(traverse, "saved", lambda df, what="step": written.append(what) or save(df, what))
    g = Graph(spark, SF)
    deepest = max(r.depth for r in Q.rebuild_flows(g).collect())
    assert deepest >= 7 and "level" not in written


@pytest.mark.parametrize("name", ["affected_flows", "flows_page", "flows_summary", "top_members"])
def test_flow_queries_take_few_turns_and_match_sql(spark, duck, name, monkeypatch):
    written, save = [], traverse.saved
    monkeypatch.setattr(traverse, "saved", lambda df, what="step": written.append(what) or save(df, what))
    test_query_matches_sql(spark, duck, name)
    assert "closure" in written and "level" not in written


@pytest.mark.parametrize("entries", [(90, 91, 92), tuple(range(90, 130))])
def test_reach_equals_brute_force(spark, entries):
    """Few starts are followed by level, many by the sets of called nodes; cycles, repeated edges, other kinds and dead ends included."""
    rng = random.Random(5)
    inner = [(rng.randrange(30), rng.randrange(32), rng.choice(("calls", "fallback_calls", "contains"))) for _ in range(60)]
    tops = [(s, rng.randrange(30), "calls") for s in entries for _ in range(2)] + [(90, 90, "calls"), (90, 3, "calls"), (90, 3, "calls")]
    e = edges(spark, *inner, *tops)
    want = brute_reach(e, entries, ("calls", "fallback_calls"))
    got = [tuple(r) for r in traverse.reach(e, starts(spark, *entries)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    only = starts(spark, 3, 7, 90, 555)
    assert {tuple(r) for r in traverse.reach(e, starts(spark, *entries), within=only).collect()} == {w for w in want if w[1] in (3, 7, 90)}


def test_reach_names_a_missing_node_once(spark):
    e = spark.createDataFrame([("n", 1, 2, "calls", "f", 1, "a"), ("n", 2, None, "calls", "f", 2, "b"), ("n", 1, None, "calls", "f", 3, "c"), ("n", 9, 2, "calls", "f", 4, "d")], EDGE)
    for at in ((1,), (1, 9, 50)):
        got = sorted((tuple(r) for r in traverse.reach(e, starts(spark, *at)).collect()), key=str)
        assert [r for r in got if r[0] == 1] == [(1, 1, 0), (1, 2, 1), (1, None, 1)]


def test_all_orders_and_all_ranked_parts_are_read(spark):
    g = Graph(spark, SF)
    want = {(f"catalog/tests/{o.o_orderpriority}", 10 * o.o_orderkey + 4, 6 * T + o.o_orderkey) for o in g.orders.collect()}
    assert {tuple(r) for r in Q.tested_by(g).collect()} == want
    parts = sorted(g.part.collect(), key=lambda p: (-p.p_retailprice, p.p_partkey))
    got = [(r.node_id, r["rank"]) for r in Q.ordered_load(g).collect()]
    assert len(parts) > 100 and got == [(5 * T + p.p_partkey, i) for i, p in enumerate(parts, 1)]


def test_risk_counts_hunks_and_edges(spark):
    n = nodes(spark, (1, "function", "a", "x.go", 1, 5), (2, "function", "b", "x.go", 6, 9), (3, "file", "x.go", "x.go", 1, 100_000))
    h = spark.createDataFrame([("x.go", 2, 3), ("x.go", 5, 6), ("y.go", 1, 9)], "file_path string, start_line int, end_line int")
    e = edges(spark, (1, 2, "calls"), (1, 3, "calls"))
    got = {r.node_id: (r.hunk_count, r.risk) for r in changes.top_risks(h, n, e).collect()}
    assert got == {1: (2, 6.0), 2: (1, 1.0), 3: (2, 2.0)}
    assert changes.top_risks(h.limit(0), n, e).count() == 0
    for bad in ((0, 0), (501, 0), (5, -1)):
        with pytest.raises(ValueError):
            relations.check_page(*bad)


def test_diff_text_becomes_hunks():
    text = "--- a/x.go\n+++ b/x.go\n@@ -1,2 +3,4 @@ f\n@@ -9 +9,0 @@\n@@ -12 +12 @@\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    assert changes.parse_diff(text) == [("x.go", 3, 6), ("x.go", 9, 9), ("x.go", 12, 12)]


def test_links_resolve_once_or_die(spark):
    n = nodes(spark, (1, "file", "x.go", "a/x.go", 1, 9), (2, "function", "Run", "a/x.go", 2, 3))
    raw = ["ccg://n/a/x.go", "ccg://n/a/x.go#Run", "ccg://n#Run", "ccg://n", "ccg://m", "ccg://n/a", "ccg://u@n/a", "ccg://n/../a", "http://n", "ccg://n/a/x.go#Nope"]
    links = relations.parsed_links(spark.createDataFrame([(r,) for r in raw], "raw string"))
    got = {r.raw: (r.resolved_node_id, r.status) for r in relations.resolved_links(links, n).collect()}
    assert got == {
        "ccg://n/a/x.go": (1, "resolved"), "ccg://n/a/x.go#Run": (2, "resolved"), "ccg://n#Run": (2, "resolved"), "ccg://n": (None, "resolved"),
        "ccg://m": (None, "dead"), "ccg://n/a": (1, "resolved"), "ccg://n/a/x.go#Nope": (None, "dead"),
    }


def test_bm25_prefers_rare_terms_and_counts_nodes(spark):
    d = spark.createDataFrame([("n", 1, "common common rareword"), ("n", 2, "common other"), ("n", 3, "common thing"), ("n", 3, "common again"), ("n", 4, "raremost")], "namespace string, node_id long, content string")
    index, sizes = search.postings(d), search.corpus(d)
    got = {r.node_id: r.score for r in search.bm25(index, ["common", "rare"], sizes).collect()}
    assert set(got) == {1, 2, 3, 4} and got[4] > got[2] and got[1] > got[2]
    assert len(search.ranked(search.bm25(index, ["common"], sizes), 2).collect()) == 2
    assert {r.node_id for r in search.bm25(index, ["rar"], sizes).collect()} == set()  # short terms match whole words


def test_subsequence_scores_order_names():
    s = search.subsequence_score
    assert s("parse", "parse") > s("parse", "parser") > s("prs", "parser") > 0
    assert s("ab", "xaxb") < s("ab", "abxx") and s("rpase", "parse") == 0 and s("", "x") == 0


def test_names_score_as_stated():
    """Literal cases: an exact name above longer ones, whole words above scattered letters, boundaries behind acronyms."""
    like = lambda q, n, qn=None: search.name_likeness(q)(n, qn or n)
    assert round(like("server", "startNewServer"), 2) == 0.48 and round(like("server", "serviceProvider"), 2) == 0.34
    assert like("server", "Server") > like("server", "serverPool") > like("server", "startNewServer") > like("server", "serviceProvider") > 0
    for q, word, scattered in (("processor", "paymentProcessor", "pathResolverCacheSessionStore"), ("response", "parseJsonResponse", "resolveNamespace")):
        assert like(q, word) > like(q, scattered)
    assert like("server", "HTTPServer") == like("server", "HttpServer")
    assert like("search document", "SearchDocument") > like("search document", "searchDoc")
    assert like("ExecuteC", "tmplFunc") == 0 < like("c", "cmd") and like("syncqueue", "add", "app.SyncQueue.add") == 0.5 * like("syncqueue", "SyncQueue")
    assert like("app", "add", "app.add") == 0 and like("adir", "parseTreeSitterLanguageDefinitionRegistryConfigurationLoaderFactoryGlobals") == pytest.approx(0.0096, abs=5e-5)


def test_stop_words_are_the_stated_ones():
    from kodegraf.functions import tokens as tk

    assert set(tk.STOP_WORDS).isdisjoint("get set list new run call has all add use type error if into then have".split()) and "shall" in tk.STOP_WORDS
    assert tk.query_terms("what can we do") == ["we"] and tk.query_terms("how is it") == ["how", "is", "it"]
    assert not tk.is_question("get user by id") and tk.is_question("where are users saved") and tk.is_question("one two three four")


def test_strict_match_takes_prefixes_parts_and_queries_without_terms(spark):
    d = spark.createDataFrame([("n", 1, "getUserById get user by id"), ("n", 2, "user list"), ("n", 3, "a_b other")], "namespace string, node_id long, content string")
    index = search.postings(d)
    found = lambda q: sorted(r.node_id for r in search.strict_match(index, q).collect())
    assert found("use") == [1, 2] and found("userId") == [1] and found("user lis") == [2] and found("get-user") == [1] and found("a_b") == [3]
    assert found("!!!") == found("") == []
    assert search.bm25(index, [], search.corpus(d)).count() == 0 and [r.can_answer for r in search.answerable(index, [], search.corpus(d)).collect()] == [False]
    assert [r.can_answer for r in search.answerable(index, ["user", "nowhere"], search.corpus(d)).collect()] == [True]


def test_numbers_are_global_without_one_task(spark):
    rows = spark.range(0, 1000, 1, 7).selectExpr("id % 13 as a", "id as b")
    from pyspark.sql import functions as F

    got = scans.numbered(rows, [F.desc("a"), F.col("b")]).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: (-r.a, r.b))] == list(range(1, 1001))
    assert scans.numbered(rows.limit(0), [F.col("a"), F.col("b")]).count() == 0


def test_comments_bind_over_blank_and_passed_lines_only(spark):
    n = spark.createDataFrame([(1, "f", 5), (2, "f", 20), (3, "f", 30), (4, "g", 2)], "node_id long, file_path string, start_line int")
    c = spark.createDataFrame([(10, "f", 1, 2), (11, "f", 3, 3), (12, "f", 15, 16), (13, "f", 28, 28), (14, "f", 40, 41), (15, "g", 1, 1)], "comment_id long, file_path string, start_line int, end_line int")
    code = spark.createDataFrame([("f", 5, 12), ("f", 18, 18), ("f", 20, 28), ("f", 30, 33)], "file_path string, line int, end_line int")
    got = {r.node_id: r.comment_id for r in resolve.bind_comments(c, n, code).collect()}
    assert got == {1: 10, 3: 13, 4: 15}  # code at 18 parts 12 from node 2; a comment on the last line of code binds


def test_document_text_holds_file_names_languages_and_annotations(spark):
    n = spark.createDataFrame([(1, "n", "function", "getUser", "app.getUser", "src/User.Store.py", 1, 2), (2, "n", "type", "T", "T", "Makefile", 1, 2)], "node_id long, namespace string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int")
    tags = spark.createDataFrame([(1, "Reads.", "Slowly.", "second", 1), (1, "Reads.", "Slowly.", "first", 0), (2, None, "", None, 0)], "node_id long, summary string, context string, value string, position int")
    got = {r.node_id: r.content for r in search.document_text(n, search.said(tags)).collect()}
    assert got == {1: "getUser app.getUser function get user app user store py python Reads. Slowly. first second", 2: "T T type t makefile"}


def test_identifier_parts(spark):
    from pyspark.sql import functions as F

    from kodegraf.functions import tokens as tk

    words = ["HTTPServer", "parseHTML5", "snake_case", "a.b/c", "한글Name", ""]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(tk.split_identifier(F.col("w"))).collect()]
    assert got == [["http", "server"], ["parse", "html", "5"], ["snake", "case"], ["a", "b", "c"], ["한글name"], []]  # a change of case needs a lower-case letter
    assert [tk.query_parts(w) for w in words[:4]] == got[:4]
    assert tk.is_question("how does the parser resolve names") and not tk.is_question("parser")
    assert tk.fetch_limit(10) == (50, 50) and tk.fetch_limit(10, 495)[0] == 500


def test_calls_resolve_by_the_first_unique_rule(spark):
    n = spark.createDataFrame([(1, "n", "function", "Run", "p.T.Run", "a.go", 1, 5), (2, "n", "function", "Run", "p.U.Run", "b.go", 1, 5), (3, "n", "function", "Go", "p.Go", "a.go", 7, 9), (4, "n", "function", "Go", "q.Go", "c.go", 7, 9)], NODE)
    c = spark.createDataFrame([(1, "n", "a.go", "x.Run", "p.T"), (2, "n", "z.go", "p.U.Run", None), (3, "n", "a.go", "Go", "p.T"), (4, "n", "a.go", "Run", None), (5, "n", "z.go", "Run", None), (6, "n", "z.go", "None", None)], "call_id long, namespace string, file_path string, callee string, receiver string")
    got = {r.call_id: (r.to_node_id, r.rule) for r in resolve.resolve_calls(c, n, fallback=True).collect()}
    assert got == {1: (1, "receiver"), 2: (2, "qualified"), 3: (3, "package"), 4: (1, "file"), 5: (1, "fallback"), 6: (None, None)}


def test_interfaces_dispatch_to_the_only_implementer(spark):
    n = spark.createDataFrame([(1, "n", "function", "Do", "p.T.Do", "a.go", 1, 5), (2, "n", "function", "Do", "p.I.Do", "a.go", 6, 7), (3, "n", "function", "Do", "p.J.Do", "a.go", 8, 9)], NODE)
    impl = spark.createDataFrame([("n", "p.I", "p.T"), ("n", "p.J", "p.T"), ("n", "p.J", "p.I")], "namespace string, interface string, implementer string")
    c = spark.createDataFrame([(1, "n", "p.I.Do"), (2, "n", "p.J.Do")], "call_id long, namespace string, callee string")
    assert {r.call_id: r.to_node_id for r in resolve.interface_dispatch(c, impl, n).collect()} == {1: 1, 2: 3}


def test_store_keeps_first_and_cascades(spark):
    n = nodes(spark, (1, "function", "a", "x.go", 1, 5), (2, "function", "b", "y.go", 1, 5))
    e = edges(spark, (1, 2, "calls"), (2, 2, "calls"))
    out = store.delete_files(spark.createDataFrame([("x.go",)], "file_path string"), n, e, tags=spark.createDataFrame([(1,), (2,)], "node_id long"))
    assert [r.node_id for r in out["nodes"].collect()] == [2] and [r.from_node_id for r in out["edges"].collect()] == [2] and [r.node_id for r in out["tags"].collect()] == [2]


def test_tables_without_rows(spark):
    n, e = nodes(spark, (1, "function", "a", "x.go", 1, 5)).limit(0), edges(spark, (1, 2, "calls")).limit(0)
    assert stats.totals(n, e).count() == 0 and tree.tree(n).count() == 0 and relations.flow_entrypoints(n, e).count() == 0
    assert traverse.flows(e, starts(spark, 1).limit(0)).count() == 0
    assert scans.longest_suffix(n, "a/b").count() == 0 and quality.merge_symbols(n).count() == 0


def test_replacing_a_namespace_leaves_others(spark, tmp_path):
    p = str(tmp_path / "nodes")
    store.replace_namespaces(spark.createDataFrame([(1, "a"), (2, "b")], "id long, namespace string"), p)
    store.replace_namespaces(spark.createDataFrame([(3, "b")], "id long, namespace string"), p)
    assert sorted((r.id, r.namespace) for r in spark.read.parquet(p).collect()) == [(1, "a"), (3, "b")]
