"""The training-data operators against brute force, libraries, and odd inputs."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from kodegraf.llm import ann, bagminhash, mixing, packing, pii, quality_classifier, quality_rules, secret_scan, token_counts, toxicity

WORDS = [a + b for a in ("ka", "lo", "mi", "ten", "sur", "vel") for b in ("", "ra", "no", "dis", "pe", "gun", "tal")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    return [None, "", " \t\n", "a", "a a a a a a a a a", prose(rng, 40), prose(rng, 40), "\n".join(["same line"] * 30), "x" * 30_000, "ab " * 20_000, "ÄÖÜ ß 日本語 🎉 \x1c \x85", "#*$%&|<> " * 30, prose(rng, 3000)]


def clashing(df):
    """The same rows twice over, with further columns of names that operators use inside."""
    from pyspark.sql import functions as F

    both = df.unionByName(df)
    for c in ("n_words", "w", "bands", "rank", "length", "bucket", "size", "sid", "start", "label", "text_2", "id"):
        both = both.withColumn(c, F.lit(1))
    return both


# --- 1 -------------------------------------------------------------------------------


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    at = collections.defaultdict(list)
    for i in range(n - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_rules_match_brute_force_and_sql(spark, odd_texts):
    docs = frame(spark, odd_texts)
    got = quality_rules.quality_rules(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert [tuple(r) for r in got[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]].itertuples(index=False)] == [brute_rules(t) for t in odd_texts]
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    sql = con.execute(quality_rules.SQL).df().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, sql, check_dtype=False)


def test_cascade_order_follows_rejections_per_cost_and_not_the_verdict(spark, odd_texts):
    names = [r.name for r in quality_rules.RULES]
    order = quality_rules.cascade_order([t or "" for t in odd_texts])
    assert sorted(order) == sorted(names)
    docs = frame(spark, odd_texts)
    a, b = (quality_rules.quality_rules(docs, o).toPandas().sort_values("doc_id").kept.tolist() for o in (names, names[::-1]))
    assert a == b

    slow = quality_rules.Rule("slow", lambda t: sum(range(20_000)) < 0)
    fast = quality_rules.Rule("fast", lambda t: True)
    assert quality_rules.cascade_order(["a b c"] * 20, (slow, fast)) == ["fast", "slow"]


def test_cascade_order_prices_rules_given_those_before():
    rule = quality_rules.Rule
    texts = ["a"] * 10 + ["b"] * 20 + ["c"] * 60 + ["d"] * 10

    def waits(n):
        return sum(range(n)) < 0

    # Alone "ab" rejects most; after it "a" rejects nothing that is left, so that "d" goes before it.
    rules = (rule("a", lambda t: waits(3000) or t.text == "a"), rule("ab", lambda t: waits(3000) or t.text in "ab"), rule("d", lambda t: waits(3000) or t.text == "d"))
    order = quality_rules.cascade_order(texts, rules)
    assert order[0] == "ab" and order[-1] == "a"
    # A measurement that is paid for beforehand costs nothing any more.
    long = [" ".join(f"w{i % 50}" for i in range(3000))] * 20
    rules = (rule("waits", lambda t: waits(6000) or True), rule("repeats", lambda t: t.n_repeat_words > 0))
    assert quality_rules.cascade_order(long, rules, ("n_repeat_words",)) == ["repeats", "waits"]
    assert quality_rules.cascade_order(long, rules) == ["waits", "repeats"]


def test_quality_rules_filter_as_they_report(spark, odd_texts):
    docs = clashing(frame(spark, odd_texts + [prose(random.Random(i), 50) for i in range(20)]))
    report = quality_rules.quality_rules(docs)
    assert report.count() == 2 * (len(odd_texts) + 20)
    kept = quality_rules.accepted(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.toPandas().doc_id) == sorted(report.where("kept").toPandas().doc_id)
    assert quality_rules.quality_rules(docs.limit(0)).count() == quality_rules.accepted(docs.limit(0)).count() == 0


# --- 2 -------------------------------------------------------------------------------


def brute_classes(texts):
    bags = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").encode().split()) else None for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and 5 * sum((bags[i] & bags[j]).values()) >= 4 * sum((bags[i] | bags[j]).values()):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def copies(rng, n_base=12):
    texts = []
    for _ in range(n_base):
        base = prose(rng, rng.randint(30, 120)).split()
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    return texts


def test_near_duplicates_match_brute_force(spark, odd_texts):
    texts = copies(random.Random(5)) + odd_texts
    got = bagminhash.near_duplicates(frame(spark, texts)).toPandas().sort_values("doc_id")
    want = brute_classes(texts)
    assert got.class_id.tolist() == want
    size = collections.Counter(want)
    assert got.class_size.tolist() == [size[c] for c in want]
    assert got.kept.tolist() == [i == c for i, c in enumerate(want)]


def test_near_duplicates_take_repeated_rows_and_empty_tables(spark, odd_texts):
    docs = clashing(frame(spark, odd_texts[:7]))
    assert bagminhash.near_duplicates(docs).count() == 14
    assert bagminhash.near_duplicates(docs.limit(0)).count() == 0
    assert bagminhash.kept_documents(docs).columns == docs.columns


def test_near_duplicates_compare_every_text_of_a_document(spark):
    rng = random.Random(12)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(5, a), (5, b), (7, b + " one"), (8, a), (9, c), (9, ""), (None, c + " more"), (None, prose(rng, 30))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = bagminhash.near_duplicates(docs).toPandas()
    found = collections.Counter((None if pd.isna(i) else int(i), None if pd.isna(c) else int(c), n) for i, c, n in got[["doc_id", "class_id", "class_size"]].itertuples(index=False))
    assert found == collections.Counter([(5, 5, 4), (5, 5, 4), (7, 5, 4), (8, 5, 4), (9, 9, 2), (9, 9, 1), (None, 9, 2), (None, None, 1)])
    kept = sorted(bagminhash.kept_documents(docs.unionByName(docs)).toPandas().text)
    assert len(kept) == 5 and kept[:2] == ["", ""] and sum(t in (a, b) for t in kept) == 1 and c in kept


def linked_classes(texts):
    """Classes over all pairs that share a window, by brute force."""
    bags = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").encode().split()) else collections.Counter() for t in texts]
    weight, holders = [b.total() for b in bags], collections.defaultdict(list)
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, bag in enumerate(bags):
        both = collections.Counter()
        for g, n in bag.items():
            for j, m in holders[g]:
                both[j] += min(n, m)
            holders[g].append((i, n))
        for j, o in both.items():
            if 9 * o >= 4 * (weight[i] + weight[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_lose_no_link_of_ten_thousand_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = bagminhash.near_duplicates(docs).toPandas().sort_values("doc_id")
    rows = docs.select("doc_id", "text").toPandas().sort_values("doc_id")
    at = rows.doc_id.tolist()
    assert got.class_id.tolist() == [at[c] for c in linked_classes(rows.text.tolist())]


def test_near_duplicates_settle_a_crowded_group(spark):
    """Heavily edited copies of one text and texts that share a repeated line: many pairs close to the similarity."""
    rng = random.Random(13)
    base, line, texts = prose(rng, 120).split(), prose(rng, 6), []
    for _ in range(700):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [f"{line} " * rng.randint(30, 50) + prose(rng, 40) for _ in range(300)]
    got = bagminhash.near_duplicates(frame(spark, texts)).toPandas().sort_values("doc_id")
    assert got.class_id.tolist() == linked_classes(texts)


def test_cell_counts_never_bound_below_the_overlap():
    rng = np.random.default_rng(4)
    bags = []
    for n in (1, 30, 900, 1100, 9000, 200_000):
        h = np.unique(rng.integers(0, 3000, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        bags.append((h, rng.integers(1, 200 if n > 5000 else 3, len(h))))
    w = np.array([int(c.sum()) for _, c in bags])
    i, j = np.triu_indices(len(bags))
    most = bagminhash.most_overlap(w, [bagminhash.cell_counts(b) for b in bags], i, j)
    assert all(m >= bagminhash.overlap(bags[a], bags[b])[0] for m, a, b in zip(most, i, j))


def test_few_links_take_one_table_and_classes_as_by_rounds(spark, monkeypatch):
    written, save = [], bagminhash.saved
    monkeypatch.setattr(bagminhash, "saved", lambda df, what: written.append(what) or save(df, what))
    rng = random.Random(5)
    path = rng.sample(range(1000, 1060), 60)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + list(zip(path, path[1:])) + [(2**62, -(2**62)), (7, 7)]
    for some in (links, []):
        df = spark.createDataFrame(some, "a long, b long")
        written.clear()
        got = bagminhash.components(df)
        assert written == ["labels"]
        by_rounds = bagminhash.components(df, few=-1)
        assert len(written) > 3
        assert got.dtypes == by_rounds.dtypes and sorted(got.collect()) == sorted(by_rounds.collect())


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = []
    for s in range(60):
        k = bagminhash.mix64(h + np.uint64(s))
        o = np.argsort(k)
        x = bagminhash.signatures([(k[o], a[o]), (k[o], b[o])])
        got.append((x[0] == x[1]).mean())
    assert abs(np.mean(got) - true) < 4 * np.std(got) / 60**0.5 + 0.005


# --- 3 and 7 -------------------------------------------------------------------------


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    texts, quality, toxic = [], [], []
    for i in range(400):
        t, bad, mean = prose(rng, rng.randint(30, 80)), rng.random() < 0.3, rng.random() < 0.2
        if mean:
            w = t.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["nastyword", "meanword"]))
            t = " ".join(w)
        if bad:
            t = " | ".join(t.split())
        texts.append(t)
        quality.append(int(not bad))
        toxic.append(int(mean))
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(zip(quality, toxic))] + [(900, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, quality, toxic


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_classifiers_are_right_on_held_out_rows(labelled, which):
    docs, labels, quality, toxic = labelled
    run, truth, cut = (quality_classifier.quality_scores, quality, 0.3) if which == "quality" else (toxicity.toxicity_scores, toxic, 0.5)
    got = run(docs, labels).toPandas().sort_values("doc_id")
    assert got.held_out.tolist() == [held(i) for i in range(400)]
    assert got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= cut)).all()
    out = got[got.held_out]
    assert np.mean([p == truth[i] for i, p in zip(out.doc_id, out.predicted)]) > 0.95


@pytest.mark.parametrize("run", [quality_classifier.quality_scores, toxicity.toxicity_scores])
def test_classifiers_take_odd_inputs(spark, odd_texts, labelled, run):
    docs, labels = clashing(frame(spark, odd_texts)), labelled[1]
    assert run(docs, labels).count() == 2 * len(odd_texts)
    assert run(docs, labels.limit(0)).toPandas().score.nunique() == 1
    assert run(docs.limit(0), labels).count() == 0


def test_context_sums_match_a_plain_loop():
    rng = random.Random(6)
    texts = [["the", "The", "!!", "a", "a", "zz9", "7"][: rng.randint(0, 7)] * rng.randint(1, 3) for _ in range(20)]
    words, shapes = {"the": 0, "a": 1}, {x: i for i, x in enumerate(sorted({quality_classifier.shape(t) for t in ["the", "The", "!!", "7"]} | {quality_classifier.SAME}))}
    got_w, got_s = quality_classifier.context_sums(texts, words, shapes)
    unit = np.sqrt(quality_classifier.NONZERO)
    vector = lambda t: (quality_classifier.index_vector(t.lower()) if t.lower() in words else 0) + quality_classifier.index_vector(quality_classifier.shape(t))
    want_w, want_s = np.zeros(got_w.shape), np.zeros(got_s.shape)
    for tokens in texts:
        for i, t in enumerate(tokens):
            for j in range(max(0, i - 2), min(len(tokens), i + 3)):
                if i != j:
                    if t.lower() in words:
                        want_w[words[t.lower()]] += vector(tokens[j]) * unit
                    want_s[shapes[quality_classifier.shape(t)]] += vector(tokens[j]) * unit
                    if i and tokens[i - 1] == t:
                        want_s[shapes[quality_classifier.SAME]] += vector(tokens[j]) * unit
    np.testing.assert_allclose(got_w, want_w, atol=1e-3)
    np.testing.assert_allclose(got_s, want_s, atol=1e-3)


def slopes(loss, params, eps=1e-5):
    out = []
    for p in params:
        g = np.zeros_like(p)
        for i in np.ndindex(p.shape):
            keep = p[i]
            p[i] = keep + eps
            up = loss()
            p[i] = keep - eps
            g[i] = (up - loss()) / (2 * eps)
            p[i] = keep
        out.append(g)
    return out


def test_network_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    z, y = rng.normal(size=(12, 5)), rng.integers(0, 2, 12).astype(float)
    p = [rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=3), rng.normal(size=1)]

    def loss():
        s = np.tanh(z @ p[0] + p[1]) @ p[2] + p[3]
        return np.mean(np.logaddexp(0, s) - y * s) + 0.5e-4 * ((p[0] ** 2).sum() + (p[2] ** 2).sum())

    for got, want in zip(quality_classifier.network_gradient(p, z, y), slopes(loss, p)):
        np.testing.assert_allclose(got, want, atol=1e-7)


@pytest.mark.parametrize("shift", [0.0, -6.0])
def test_risk_gradient_is_that_of_the_non_negative_risk(shift):
    rng = np.random.default_rng(2)
    p, u, prior = rng.normal(size=(9, 4)), rng.normal(size=(20, 4)) + shift, 0.4
    params = [np.ones(4), np.array([0.3])]

    def parts():
        zp, zu = p @ params[0] + params[1], u @ params[0] + params[1]
        return prior * sum(np.log1p(np.exp(-z)) for z in zp) / 9, sum(np.log1p(np.exp(z)) for z in zu) / 20 - prior * sum(np.log1p(np.exp(z)) for z in zp) / 9

    below, got = toxicity.risk_gradient(params[0], params[1][0], p, u, prior)
    assert below == (parts()[1] < 0) == (shift < 0)
    want = slopes((lambda: -parts()[1]) if below else (lambda: sum(parts())), params)
    np.testing.assert_allclose(got, np.concatenate(want), atol=1e-7)


def test_samples_hold_rows_without_an_id_alike(spark):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(500)] + [(1, None)], "doc_id long, text string")
    from kodegraf.llm.common import sampled

    a, b = (sorted(map(str, sampled(x, 50, ["text"]).toPandas().text)) for x in (docs, docs.repartition(7)))
    assert a == b and len(a) == 50
    assert sampled(docs.limit(0), 50, ["text"]).count() == 0


def test_held_out_labels_are_not_read(labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled[:2]
    other = labels.withColumn("toxic", F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.toxicity_scores(docs, x).toPandas().sort_values("doc_id").score.tolist() for x in (labels, other))
    assert a == b


# --- 4 -------------------------------------------------------------------------------


def test_token_counts_match_the_unigram_tokenizer(spark, odd_texts):
    from tokenizers import Tokenizer, models, normalizers

    count = token_counts.counter(token_counts.public_path())
    low = min(s for _, s in count.pieces)
    lib = Tokenizer(models.Unigram([("<unk>", 0.0), *count.pieces, *[(f"<0x{i:02X}>", low) for i in range(256)]], unk_id=0, byte_fallback=True))
    lib.normalizer = normalizers.Sequence([normalizers.Prepend(token_counts.SPACE), normalizers.Replace(" ", token_counts.SPACE)])
    rng = random.Random(1)
    texts = ["".join(rng.choice(["ab", " ", "  ", "é", "\n", "tion", "日", "🎉", "the", "\t", "▁", "x1", "Q"]) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += [t for t in odd_texts if t]
    for t in texts:
        assert count(t) == len(lib.encode(t, add_special_tokens=False).ids), t
    got = token_counts.token_counts(clashing(frame(spark, odd_texts))).toPandas()
    assert len(got) == 2 * len(odd_texts)
    assert got.n_tokens[got.doc_id == 0].tolist() == [0, 0]


# --- 5 -------------------------------------------------------------------------------


def test_nearest_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24))
    x[300:600] = x[0]  # one vector many times
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    rows += [(2000, None, 0), (2020, [0.0] * 24, 0), (2040, [float("nan")] * 24, 0), (2060, [None] + [1.0] * 23, 0), (2080, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = ann.nearest(df).toPandas()
    assert set(got.query_id) == set(range(0, 1500, 20))
    hit = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g.vec_id)
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -np.round(s, 9)))[:20]
        hit += len(set(best) & set(g.vec_id))
        np.testing.assert_allclose(g.score, s[g.vec_id], atol=1e-12)
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
    assert hit / (20 * 75) >= 0.9
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id < 5")).toPandas()["rank"].tolist() == [1, 2, 3, 4]


def test_work_of_a_query_stays_where_clusters_grow_in_number(spark):
    rng, tested = np.random.default_rng(3), []
    for clusters in (40, 160):
        centre = rng.normal(size=(clusters, 16)) * 4
        x = (centre[:, None] + rng.normal(size=(clusters, 50, 16)) * 0.3).reshape(-1, 16)
        x = x[rng.permutation(len(x))]
        index = ann.fit_index(x[: ann.FIT_ROWS], len(x), rows_a_part=100)
        tested.append(index.probes * len(x) / index.router.parts)
        got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), rows_a_part=100).toPandas()
        hit = 0
        for q, g in got.groupby("query_id"):
            s = x @ x[q]
            s[q] = -np.inf
            hit += len(set(np.argsort(-s)[:20]) & set(g.vec_id))
        assert hit >= 0.9 * len(got)
    assert tested[0] <= 0.1 * 2000 and tested[1] <= 0.05 * 8000, tested


def test_neighbours_take_large_norms_and_clashing_columns(spark):
    x = np.random.default_rng(5).normal(size=(200, 8)) * 1e9
    rows = spark.createDataFrame([(i, v.tolist(), 1, 2, 3, "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, part int, score int, rank int, query_id string")
    got, hit = ann.nearest(rows.unionByName(rows)).toPandas(), 0
    assert len(got) == 10 * 20
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        assert set(collections.Counter(g.vec_id).values()) == {2} and q not in set(g.vec_id)
        hit += len(set(np.argsort(-s)[:10]) & set(g.vec_id))
        np.testing.assert_allclose(g.score, s[g.vec_id])
    assert hit >= 0.9 * 100


def test_parts_are_balanced():
    part = ann.balanced_parts(np.random.default_rng(1).normal(size=(800, 16)), 8)
    assert np.bincount(part).max() <= 111


# --- 6 and 10 ------------------------------------------------------------------------


def brute_secrets(t):
    assign = re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t)
    out = [(m.start(), 0, m.end()) for m in assign if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16])


def brute_personal(t):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return sorted(out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15])


def test_base_spans_match_the_patterns():
    rng = random.Random(4)
    bits = ["a", "@", ".", "-", "+", "1", "12", "256", "0", "4111111111111111", " ", "(", ")", "b.c", "password", "Token", "ſecret", "apiKey", "=", ":", '"', "AKIA", "ABCDEFGH0123456", "deadbeef", "0" * 9, "é", "\n"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(t) == brute_personal(t), t
        assert secret_scan.base_spans(t) == brute_secrets(t), t


def test_secret_scan_reports_base_and_dear_values(spark, odd_texts):
    texts = [*odd_texts, 'x password = "36fdea71d793cf922e" y', "pwd: Zx9!kQ72LmP and auth = changeme123"]
    got = secret_scan.secrets(frame(spark, texts)).toPandas().sort_values("doc_id")
    for t, r in zip(texts, got.itertuples()):
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{i}:{j}" for i, k, j in brute_secrets(t or ""))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    assert got.spans.iloc[-1] == "guess:5:16"
    docs = clashing(frame(spark, texts))
    twice = secret_scan.secrets(docs).toPandas()
    assert sorted(twice.spans) == sorted([*got.spans, *got.spans])
    assert secret_scan.secrets(docs.limit(0)).count() == 0


def test_guess_cost_alone_decides_on_letters():
    found = lambda t: secret_scan.guessed_spans(t, secret_scan.base_spans(t))
    assert found("pwd: hGtRkLpQzXvWmB") == [(5, 3, 19)]
    assert found("password = qKzVwxPj") == [(11, 3, 19)]
    assert found("pwd: placeholder and auth = changeme") == []


def test_guess_costs_order_values():
    cost = secret_scan.guess_cost
    assert cost("password") < cost("P@ssw0rd1") < cost("qwerty12345") < cost("xK9#mQ2$vL7p")
    assert cost("aaaaaaaaaaaaaaaa") < 4 and cost("20201231") < 6 and cost("") == 0
    assert cost("abcdefgh" * 20_000) > 0  # in time proportional to the length
    assert max(map(cost, ["streaming", "authentication", "P@ssword", "newyork2019"])) < 8 < min(map(cost, ["hGtRkLpQz", "7f-qq!Zp02"]))


def test_guess_costs_match_exhaustive_segmentation():
    rank = secret_scan.ranks(secret_scan.public_path())

    def cheapest(value):
        by_start = collections.defaultdict(list)
        for j, found in secret_scan.segments(value, rank).items():
            for i, c in found:
                by_start[i].append((j, c))

        def go(i):
            if i == len(value):
                yield 0.0
            for j, c in by_start[i]:
                yield from (c + secret_scan.SEGMENT + rest for rest in go(j))
            for j in range(i + 1, len(value) + 1):
                c = sum(map(secret_scan._class_cost, value[i:j])) + secret_scan.SEGMENT
                yield from (c + rest for rest in go(j))

        return min(go(0))

    rng = random.Random(11)
    bits = ["a", "Q", "7", "!", "the", "pass", "P4ss", "qwe", "123", "1999", "aa", "xyxy", "é"]
    for _ in range(120):
        value = "".join(rng.choice(bits) for _ in range(rng.randint(1, 5)))[:11]
        assert secret_scan.guess_cost(value) == pytest.approx(cheapest(value)), value


def test_quoted_and_aligned_values_are_read_whole():
    found = lambda t: [t[i:j] for i, _, j in secret_scan.guessed_spans(t, secret_scan.base_spans(t))]
    assert found('passphrase: "correct horse 7 battery zx9"') == ["correct horse 7 battery zx9"]
    assert found("pwd" + " " * 30 + "=    Zx9!kQ72LmP") == ["Zx9!kQ72LmP"]
    assert found('pwd: "kQ72LmP!z9') == ["kQ72LmP!z9"]  # a quote that never closes


def test_scans_of_a_long_text_take_time_in_proportion():
    import time

    trees = pii.fit()
    secret, person = "password=aB3dE5fG7hJ9kL2 pwd: x!9Kq#27zz\n", "born: 1961-04-12 or call (415) 555-1234, mail a@b.example.com\n"
    for scan, line in ((lambda t: secret_scan.guessed_spans(t, secret_scan.base_spans(t)), secret), (lambda t: pii.more_spans(t, pii.base_spans(t), trees), person)):
        took = []
        for size in (1 << 18, 1 << 20):
            text = line * (size // len(line))
            began = time.perf_counter()
            assert len(scan(text)) >= size // len(line)
            took.append(time.perf_counter() - began)
        assert took[1] < 8 * took[0] + 0.5, took


def test_personal_data_reports_base_and_judged_spans(spark, odd_texts):
    texts = [*odd_texts, "mail joe.x@mail.example.com or +1 (415) 555-1234", "call 0176/12345 or ssn 123-45-6789", "order 123-45-6789 version 1.2.3"]
    got = pii.personal_data(frame(spark, texts)).toPandas().sort_values("doc_id")
    for t, r in zip(texts, got.itertuples()):
        base = ",".join(f"{pii.BASE[k]}:{i}:{j}" for k, i, j in brute_personal(t or ""))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans.startswith(base)
    assert "ssn" in got.spans.iloc[-2] and got.spans.iloc[-1] == ""
    docs = clashing(frame(spark, texts))
    assert sorted(pii.personal_data(docs).toPandas().spans) == sorted([*got.spans, *got.spans])
    assert pii.personal_data(docs.limit(0)).count() == 0 and pii.redacted(docs.limit(0)).columns == docs.columns
    clean = pii.redacted(clashing(frame(spark, texts))).toPandas()
    assert "[EMAIL] or [PHONE]" in clean.text[clean.doc_id == len(odd_texts)].iloc[0]
    assert clean.text[clean.doc_id == 0].isna().all()


def test_trees_are_precise_on_fresh_examples():
    trees = pii.fit()
    rows, y = pii.examples(800, 9)
    p = trees.probability(np.array([pii.measured(*r) for r in rows]))
    on = np.array([q >= trees.thresholds[r[1]] for q, r in zip(p, rows)])
    assert y[on].mean() > 0.95 and on[y == 1].mean() > 0.9


# --- 8 -------------------------------------------------------------------------------


def test_encoder_matches_the_library(odd_texts):
    e = packing.encoder(packing.public_path())
    for t in [t or "" for t in odd_texts] + ["don't I'm!!'s  x", "<|endoftext|> a", "À\x85b\xa0c", "Σας İ"]:
        assert e(t) == e._ids(t) + b"\0" * 4


def test_packing_is_gapless_whole_and_tight(spark, odd_texts):
    rng = random.Random(6)
    texts = odd_texts + [prose(rng, rng.randint(1, 900)) for _ in range(150)]
    docs = clashing(frame(spark, texts))
    got = packing.packed(docs).toPandas()
    e = packing.encoder(packing.public_path())
    for doc, g in got.groupby("doc_id"):
        raw = e(texts[doc] or "")
        want = [(i // 8192, i // 4, len(raw[i : i + 8192]) // 4, zlib.crc32(raw[i : i + 8192])) for i in range(0, len(raw), 8192)]
        assert sorted(g[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want * 2)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.03 * got.length.sum() / 2048 + 1
    assert packing.packed(docs.limit(0)).count() == 0


def test_patterns_are_all_and_least_squares_are_optimal():
    for bins, most in ((7, 3), (12, 4)):
        want = {p for k in range(1, most + 1) for p in itertools.combinations_with_replacement(range(1, bins + 1), k) if sum(p) == bins}
        got = [tuple(sorted(x for x in r if x)) for r in packing.patterns(bins, most).tolist()]
        assert len(got) == len(set(got)) and set(got) == want
    rng = np.random.default_rng(4)
    for _ in range(5):
        a, y = rng.integers(0, 3, (6, 9)).astype(float), rng.random(6) * 50
        x = packing.nonnegative_least_squares(a, y, 20_000)
        slope = a.T @ (a @ x - y)
        # The conditions of an optimum: no slope where x is positive, none downhill where it is zero.
        assert (x >= 0).all() and np.abs(slope[x > 1e-6]).max(initial=0) < 1e-2 and slope.min() > -1e-2


def test_plan_holds_the_histogram():
    rng = np.random.default_rng(0)
    h = collections.Counter(np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1).tolist())
    h[700] += 10_000  # one length of a third of all
    made, got = packing.plan(dict(h)), collections.Counter()
    for lengths, times in made:
        assert sum(lengths) <= 2048
        got.update({n: lengths.count(n) * times for n in set(lengths)})
    assert got == h
    assert sum(t for _, t in made) <= 1.15 * sum(n * c for n, c in h.items()) / 2048


# --- 9 -------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    sources = [rng.choice(["a", "a", "a", "a", "b", "c", "d", None]) for _ in range(400)]
    texts = [prose(rng, rng.choice([0, 5, 60, 400])) for _ in sources]
    docs = clashing(frame(spark, texts, sources))
    got = mixing.mix_report(docs).toPandas()
    assert len(got) == 800
    got["source"] = [sources[i] for i in got.doc_id]
    assert (got["size"] == [len(texts[i].split()) for i in got.doc_id]).all() and (got.taken <= 2 * got["size"]).all()
    names = ["a", "b", "c", "d", None]
    size = {s: int(got["size"][got.source.isna() if s is None else got.source == s].sum()) for s in names}
    weight, target, free = dict(zip(names, (5, 2, 1, 5, 2))), {}, set(names)
    while free:
        rest = 1.5 * sum(size.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        target |= {s: float(2 * size[s]) for s in over} or share
        free = free - over if over else set()
    for s in names:
        g = got[got.source.isna() if s is None else got.source == s]
        assert (g.source_size == size[s]).all()
        np.testing.assert_allclose(g.target, target[s])
        assert abs(g.taken.sum() - target[s]) <= 2 * mixing.BLOCK + 0.02 * target[s]
    again = mixing.mix_report(docs).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(got[key].itertuples(index=False)) == sorted(again[key].itertuples(index=False))
    mix = mixing.mixed_documents(docs).toPandas()
    assert mix.columns.tolist() == docs.columns
    words = mix.assign(w=mix.text.str.split().str.len()).groupby("doc_id").w.sum()
    want = got.groupby("doc_id").taken.sum()
    assert words.to_dict() == want[want > 0].to_dict()
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_permutations_are_permutations(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p")).toPandas().p
        assert sorted(got) == list(range(n))


@pytest.mark.parametrize("what", ["rules", "near", "kept", "quality", "tokens", "secrets", "toxic", "packed", "mix", "mixed", "personal", "redacted"])
def test_rows_of_nulls_keep_their_place(spark, what):
    text = prose(random.Random(1), 70)
    docs = spark.createDataFrame([(None, text, None, None, None), (None, None, None, None, None), (5, text, None, None, None), (None, text, None, "a", 3)], DOCS)
    labels = spark.createDataFrame([(5, 1, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    run = {
        "rules": quality_rules.quality_rules, "near": bagminhash.near_duplicates, "kept": bagminhash.kept_documents, "quality": lambda d: quality_classifier.quality_scores(d, labels),
        "tokens": token_counts.token_counts, "secrets": secret_scan.secrets, "toxic": lambda d: toxicity.toxicity_scores(d, labels), "packed": packing.packed,
        "mix": mixing.mix_report, "mixed": mixing.mixed_documents, "personal": pii.personal_data, "redacted": pii.redacted,
    }[what]
    got = run(docs).toPandas()
    if what == "mixed":
        assert got.text.str.split().str.len().sum() >= 1.5 * 210 - 4 * mixing.BLOCK
    else:
        assert len(got) == (2 if what == "kept" else 4)  # three of the rows have one text


# --- pipeline ------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(9)
    texts = [prose(rng, 60) for _ in range(120)]
    texts += [t + " joe.x@mail.example.com" for t in texts[:20]]
    texts += [" | ".join(prose(rng, 60).split()) for _ in range(40)]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(" | " not in t), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.toPandas()
    assert set(seen["quality_classifier"].doc_id) == set(range(140))
    assert set(seen["near_duplicates"].doc_id) == set(range(120))
    assert not seen["personal_data"].text.str.contains("@").any()
    assert set(seen["packing"].columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"}
    for r in seen["packing"].itertuples():
        assert len(r.ids) == r.length and zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32
    for name in list(seen)[:-1]:
        assert seen[name].columns.tolist() == ["doc_id", "text", "lang", "source", "n_chars"]
    assert cp.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_intermediate_tables_are_cleared(spark, tmp_path):
    from kodegraf.llm.common import work_path

    folder = os.path.dirname(work_path(spark, "x").removeprefix("file:"))
    print(folder)
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    got = bagminhash.near_duplicates(frame(spark, copies(random.Random(2), 4)))
    assert got.count() > 0
    assert sorted(x.split("-")[0] for x in set(os.listdir(folder)) - before) == ["classed", "classed", "classes", "sketches"]
