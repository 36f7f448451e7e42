"""Search, fusion, graphs, spans and decisions on small hand-made tables."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import models
from granary.operators import chunking, corpus, decide, graph, metrics, search, spans, stats, tree
from granary.plans import queries


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


NODES = "chunk_id string, document_id string, chunk_index int, content string, embedding array<float>, level int"


def test_search_orders_by_distance_then_id(spark):
    nodes = df(spark, [("c0", "d", 0, "", [1.0, 0.0, 0.0], 0), ("c1", "d", 1, "", [0.0, 1.0, 0.0], 0), ("c2", "d", 2, "", [0.9, 0.1, 0.0], 0), ("c3", "d", 3, "", [0.9, 0.1, 0.0], 1), ("c4", "d", 4, "", None, 0)], NODES)
    q = df(spark, [("q", [1.0, 0.0, 0.0])], "qid string, embedding array<float>")
    found = [tuple(r) for r in search.knn(nodes, q, 3).orderBy("rank").select("chunk_id", "rank").collect()]
    assert found == [("c0", 1), ("c2", 2), ("c3", 3)]
    by = {(r["level"], r["chunk_id"]) for r in search.knn(nodes, q, 1, keys=("level",)).collect()}
    assert by == {(0, "c0"), (1, "c3")}
    a = search.knn(nodes, q, 4).select("chunk_id", F.round("score", 9)).collect()
    b = search.knn_sql(nodes.where("embedding is not null"), q, 4).select("chunk_id", F.round("score", 9)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert search.knn(nodes, q.where("false"), 3).count() == 0


def test_fusion_and_budget(spark):
    hits = df(spark, [("q", 0, 1, "c1", 0.9), ("q", 0, 2, "c2", 0.5), ("q", 1, 1, "c3", 0.8), ("q", 1, 2, "c2", 0.4)], "qid string, path int, rank int, chunk_id string, score double")
    assert [(r["chunk_id"], r["score"]) for r in search.merged(hits).orderBy("rank").collect()] == [("c1", 0.9), ("c3", 0.8), ("c2", 0.5)]
    rrf = {r["chunk_id"]: r["score"] for r in search.reciprocal_ranks(hits).collect()}
    assert rrf["c2"] == pytest.approx(2 / 62) and rrf["c1"] == pytest.approx(1 / 61)
    long = df(spark, [("q", f"c{k}", 1.0 - k / 10, "x" * 400) for k in range(10)], "qid string, chunk_id string, score double, content string")
    assert search.within_budget(long, 250, F.col("content")).count() == 2
    assert search.within_budget(long, 1, F.col("content")).count() == 1


CHUNKS = "chunk_id string, document_id string, chunk_index int, content string, language string, embedding array<double>"


def test_edges(spark):
    c = df(spark, [("d:0", "d", 0, "see Section 3 compute_total", "python", [1.0, 0.0]), ("d:1", "d", 2, "in section 3: compute_total", "python", [0.99, 0.01]), ("e:0", "e", 0, "nothing", None, [0.0, 1.0])], CHUNKS)
    pairs = lambda x: {(r["src"], r["dst"]) for r in x.collect()}
    one = {("d:0", "d:1")}
    assert pairs(graph.sequential_edges(c)) == one and pairs(graph.semantic_edges(c, 0.7)) == one
    assert pairs(graph.reference_edges(c)) == one and pairs(graph.identifier_edges(c)) == one
    assert {r["type"] for r in graph.chunk_graph(c).collect()} == {"sequential", "semantic", "xref", "ast"}


def test_semantic_edges_equal_dense(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    c = df(spark, [(f"c{k:02}", "d", k, "", None, v.tolist()) for k, v in enumerate(x)], CHUNKS)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    want = set()
    for i in range(40):
        near = sorted((-sim[i, j], j) for j in range(40) if j != i)[:3]
        want |= {tuple(sorted((f"c{i:02}", f"c{j:02}"))) for s, j in near if -s > 0.5}
    got = {(r["src"], r["dst"]) for r in graph._pairs("semantic", "src", "dst", graph.neighbours(c, 0.5, 3, block=16)).collect()}
    assert got == want


def test_walks_agree_with_dense_and_with_joins(spark):
    edges = df(spark, [("s", str(k), str(k + 1)) for k in range(6)] + [("s", "0", "3")], "type string, src string, dst string")
    nodes = df(spark, [(str(k),) for k in range(9)], "chunk_id string")
    seeds = df(spark, [("q", "0"), ("q", "8"), ("r", "5"), ("r", "nowhere")], "qid string, chunk_id string")
    found = {(r["qid"], r["chunk_id"]): r["p"] for r in graph.personalized_ranks(edges, nodes, seeds).collect()}
    m = np.zeros((9, 9))
    for a, b in [(k, k + 1) for k in range(6)] + [(0, 3)]:
        m[a, b] = m[b, a] = 1
    m = m / np.maximum(m.sum(axis=0), 1)
    for q, at in (("q", [0, 8]), ("r", [5])):
        r = np.zeros(9)
        r[at] = 1 / len(at)
        p = r.copy()
        for _ in range(20):
            p = 0.85 * m @ p + 0.15 * r
        assert all(found.get((q, str(k)), 0.0) == pytest.approx(p[k], abs=1e-12) for k in range(9))
    start = seeds.where("chunk_id <> 'nowhere'").withColumn("r", F.when(F.col("qid") == "q", 0.5).otherwise(1.0))
    joined = {(r["qid"], r["chunk_id"]): r["p"] for r in graph.walked_by_joins(graph.transitions(edges), start, 0.15, 4).collect()}
    assert joined and all(v > 0 for v in joined.values())


def test_near_duplicates_are_greedy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 3))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    keep = [True] * 30
    for i in range(30):
        if keep[i]:
            for j in range(i + 1, 30):
                if u[i] @ u[j] > 0.8:
                    keep[j] = False
    items = df(spark, [(f"c{k}", k, v.tolist()) for k, v in enumerate(x)], "chunk_id string, position int, embedding array<double>")
    assert {r["chunk_id"]: r["kept"] for r in graph.near_duplicate_mask(items, 0.8).collect()} == {f"c{k}": v for k, v in enumerate(keep)}


def test_chains_and_entailment(spark):
    e = df(spark, [("a", "b", "entailment", 0.9), ("b", "c", "elaboration", 0.5), ("c", "a", "entailment", 1.0), ("b", "d", "contradiction", 1.0)], "src string, dst string, label string, confidence double")
    found = [(r["chain"], round(r["score"], 3)) for r in graph.entailment_chains(e, df(spark, [("q", "a")], "qid string, chunk_id string")).orderBy("rank").collect()]
    assert found == [("a>b", 0.9), ("a>b>c", 0.45)]
    c = df(spark, [("d:0", "d", 0, "one two three", None, [1.0, 0.0]), ("d:1", "d", 1, "one two three", None, [1.0, 0.1])], CHUNKS)
    assert graph.entailment_edges(c, models.judge_pair).count() == 2


def test_chunks_cover_and_count(spark):
    code = "def area(x):\n    return x\n\n\ndef total(y):\n    return y\n" * 12
    s = df(spark, [("p", "p.md", "Sentence about retrieval. " * 120, 10), ("c", "geo.py", code, 0), ("t", "t.txt", "short", 0), ("e", "e.txt", "", 0)], "document_id string, filename string, text string, char_start int")
    rows = chunking.chunked(s, 600, 100, 300).collect()
    assert {r["document_id"] for r in rows} == {"p", "c"}
    for doc, text, at in (("p", "Sentence about retrieval. " * 120, 10), ("c", code, 0)):
        mine = sorted((r for r in rows if r["document_id"] == doc), key=lambda r: r["chunk_index"])
        assert [r["chunk_id"] for r in mine] == [f"{doc}:{k}" for k in range(len(mine))]
        assert all(text[r["char_start"] - at : r["char_end"] - at] == r["content"] for r in mine)
        assert all(a["char_end"] <= b["char_start"] for a, b in zip(mine, mine[1:], strict=False))
    assert all(r["language"] == "python" for r in rows if r["document_id"] == "c")


def test_repairs(spark):
    s = df(spark, [("d:0", "d", 0, 0.8, 0.2, 0.9, 0.5), ("d:1", "d", 1, 0.9, 0.9, 0.05, 0.4), ("d:2", "d", 2, 0.9, 0.9, 0.05, 0.4), ("d:3", "d", 3, 0.7, 0.9, 0.9, 0.0)], "chunk_id string, document_id string, chunk_index int, hit_rate double, precision double, co_retrieval_entropy double, generation_utility double")
    assert {(r["op_type"], tuple(r["chunk_ids"])) for r in chunking.repairs(s).collect()} == {("split", ("d:0",)), ("re_anchor", ("d:3",)), ("merge", ("d:1", "d:2"))}


def test_spans(spark):
    gold = df(spark, [("q", "doc", 100, 200, 2), ("q", "doc", 100, 200, 1)], "qid string, document_id string, char_start int, char_end int, grade int")
    chunks = df(spark, [("a", "doc", 0, 90), ("b", "doc", 90, 210), ("c", "doc", 180, 300), ("d", "other", 90, 210)], "chunk_id string, document_id string, char_start int, char_end int")
    assert [tuple(r) for r in spans.judged_chunks(gold, chunks).collect()] == [("q", "b", 2)]
    docs = df(spark, [("d", "Steel is an alloy of iron and carbon with improved strength.")], "document_id string, text string")
    s = df(spark, [("d", " alloy of iron "), ("d", "alloy of irn and carbon"), ("d", "quantum chromodynamics lattice"), ("x", "y"), ("d", None)], "document_id string, snippet string")
    got = {r["snippet"]: (r["char_start"], r["char_end"]) for r in spans.located(s, docs).collect()}
    assert got[" alloy of iron "] == (12, 25) and got["alloy of irn and carbon"][0] is not None
    assert got["quantum chromodynamics lattice"] == got["y"] == got[None] == (None, None)
    hits = df(spark, [("d:1", "b", 0), ("d:L1:0", "s", 1), ("x", "z", 0)], "chunk_id string, content string, level int")
    leaves = df(spark, [("d", 0, "aaaa"), ("d", 2, "cccc")], "document_id string, chunk_index int, content string")
    assert {r["chunk_id"]: r["content"] for r in spans.with_neighbours(hits, leaves, 2).collect()} == {"d:1": "aa b cc", "d:L1:0": "s", "x": "z"}


def test_routes(spark):
    q = df(spark, [("a", "What is X?"), ("b", "overview of the methodology"), ("c", "section 3.2 error handling")], "qid string, query string")
    assert {r["qid"]: r["strategy"] for r in decide.keyword_route(q).collect()} == {"a": "hyde", "b": "step_back", "c": "semantic"}
    near = df(spark, [("a", k + 1, d) for k, d in enumerate([1.0, 1.0, 1.0, 1.0])] + [("b", k + 1, d) for k, d in enumerate([0.0, 5.0, 6.0, 7.0])], "qid string, rank long, distance double")
    got = {r["qid"]: (r["strategy"], r["entropy"]) for r in decide.entropy_route(q, near, low=0.5, high=1.2).collect()}
    assert got["a"] == ("step_back", pytest.approx(np.log(4))) and got["b"][0] == "semantic" and got["c"] == ("semantic", None)
    h = df(spark, [(0.1, "semantic"), (0.2, "semantic"), (1.5, "dphf"), (1.6, "hyde"), (2.9, "step_back"), (3.0, "step_back")], "entropy double, strategy string")
    assert decide.entropy_thresholds(h).first()["agreement"] == 1.0
    s = df(spark, [(x, y) for x, y in zip([0.1, 0.2, 0.3, 0.7, 0.8, 0.9], [False] * 3 + [True] * 3, strict=True)], "score double, relevant boolean")
    assert 0.3 < decide.score_threshold(s).first()["tau"] <= 0.7
    assert decide.score_threshold(s.where("relevant")).first()["tau"] == pytest.approx(0.8)


def test_correction(spark):
    hits = df(spark, [("a", "c", 0.3, "cross_encoder"), ("b", "c", 0.1, "bi_encoder"), ("d", "c", 0.0, "rrf")], "qid string, chunk_id string, score double, score_source string")
    kept, out = decide.threshold_correction(hits, 0.99, 0.0)
    assert {r["qid"] for r in kept.collect()} == {"a", "d"} and {r["qid"]: r["confidence"] for r in out.collect()} == {"a": "high", "b": "rewrite", "d": "high"}
    j = df(spark, [("a", "95"), ("b", "score 5"), ("c", "no number"), ("d", "40.5")], "qid string, answer string")
    assert {r["qid"]: (r["confidence"], r["raw_score"]) for r in decide.judged_correction(j).collect()} == {"a": ("high", 95.0), "b": ("rewrite", 5.0), "c": ("high", 100.0), "d": ("medium", 40.5)}


def test_calibration_and_coverage(spark):
    rows = [("table", "bi_encoder", 0.4 if k % 2 else 0.3, k % 2) for k in range(60)] + [("pdf", "bi_encoder", 0.5, 1)] * 5
    s = df(spark, rows, "modality string, score_source string, score double, relevant int")
    for method in ("platt", "isotonic"):
        got = {(r["modality"], r["score"]): r["calibrated"] for r in decide.calibrated_scores(s, decide.calibrated(s, method=method)).collect()}
        assert got["table", 0.4] > got["table", 0.3] and got["pdf", 0.5] == 0.5
    c = df(spark, [("q", "A", 0.95, [1.0, 0.0]), ("q", "B", 0.9, [0.9, 0.0]), ("q", "C", 0.5, [0.0, 0.8])], "qid string, chunk_id string, score double, relevance array<double>")
    assert [r["chunk_id"] for r in decide.covered_order(c, 2).orderBy("rank").collect()] == ["A", "C", "B"]


def test_metrics(spark):
    run = df(spark, [("q1", "d1", 0.9), ("q1", "d2", 0.8), ("q1", "d3", 0.1), ("q2", "x", 1.0)], "qid string, chunk_id string, score double")
    qrels = df(spark, [("q1", "d1", 1), ("q1", "d2", 1), ("q2", "y", 1), ("q3", "z", 1)], "qid string, chunk_id string, grade int")
    got = {r["qid"]: tuple(r)[1:] for r in metrics.ranking_metrics(run, qrels).collect()}
    assert got["q1"] == (1.0, 1.0, 1.0, 1.0) and got["q2"] == got["q3"] == (0.0, 0.0, 0.0, 0.0)
    a = df(spark, [("a", "The Answer.", ["answer"]), ("b", "red green", ["green blue", "x"]), ("c", "", [""]), ("d", None, ["x"])], "qid string, predicted string, gold array<string>")
    assert {r["qid"]: (r["em"], round(r["f1"], 3)) for r in metrics.answer_scores(a).collect()} == {"a": (1.0, 1.0), "b": (0.0, 0.5), "c": (1.0, 1.0), "d": (0.0, 0.0)}


def test_statistics(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(0.7, 0.1, 200)
    s = df(spark, [("a", str(k), float(x)) for k, x in enumerate(v)], "config string, qid string, value double")
    r = stats.bootstrap_intervals(s, resamples=1000).first()
    assert r["lo"] < 0.7 < r["hi"] and r["p"] <= 0.01
    p = df(spark, [("a", 0.001), ("b", 0.02), ("c", 0.5), ("d", 0.9)], "name string, p double")
    assert [x["name"] for x in stats.holm(p).where("rejected").collect()] == ["a"]
    assert {x["name"] for x in stats.benjamini_hochberg(p).where("rejected").collect()} == {"a", "b"}


def test_tree(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(3, 48)) * 5
    x = np.vstack([c + rng.normal(size=(25, 48)) for c in centres])
    found = tree.clusters(x, most=8)
    assert {i for c in found for i in c} == set(range(75)) and found == tree.clusters(x, most=8) and len(found) >= 2
    leaves = df(spark, [(f"doc:{k}", "doc", k, f"text {k}", v.tolist()) for k, v in enumerate(x)] + [("one:0", "one", 0, "alone", x[0].tolist())], "chunk_id string, document_id string, chunk_index int, content string, embedding array<float>")
    nodes = tree.hierarchy(leaves, models.summarize, lambda t: models.embed(t, 48), most=8)
    rows = nodes.collect()
    ids = {r["chunk_id"] for r in rows}
    assert max(r["level"] for r in rows) >= 1 and all(set(r["child_ids"]) <= ids for r in rows)
    assert {r["level"] for r in rows if r["document_id"] == "one"} == {0}
    q = df(spark, [("q", x[3].tolist())], "qid string, embedding array<float>")
    for way in (tree.traversed, tree.collapsed):
        got = way(nodes, q, 5, budget=100).collect()
        assert got and len({r["chunk_id"] for r in got}) == len(got)
    assert tree.corpus_tier(leaves.withColumn("level", F.lit(0)).where("document_id = 'one'"), models.summarize, models.embed).count() == 0


def test_splits_and_manifests(spark):
    c = df(spark, [(f"c{k}",) for k in range(8)], "collection_id string")
    for exact in (False, True):
        got = [r["split"] for r in corpus.collection_splits(c, exact=exact).collect()]
        assert {s: got.count(s) for s in corpus.SPLITS} == {"calibration": 2, "dev": 2, "test": 4}
    assert {r["split"] for r in corpus.collection_splits(c.limit(2)).collect()} == {"test"}
    q = df(spark, [(False, ["s"], {"a": True}), (None, ["s"], {"a": True}), (False, [], {"a": True}), (False, ["s"], {"a": False}), (False, ["s"], {})], "answerable boolean, gold_spans array<string>, checks map<string, boolean>")
    assert q.where(corpus.is_clean(F.col("answerable"), F.col("gold_spans"), F.col("checks"))).count() == 1


def test_overlap_ranks_every_text_for_every_query(spark, tmp_path):
    rng = np.random.default_rng(7)
    words = ["Alpha", "beta", "été", "ÉTÉ", "γ", "delta.", "\x1ceta", "x\u00a0y", "zeta", "iota"]
    some = lambda n: "".join(str(w) + str(s) for w, s in zip(rng.choice(words, n), rng.choice([" ", "\t", "\n ", "\x0b"], n), strict=True))
    docs = df(spark, [(i, some(int(rng.integers(0, 9)))) for i in range(150)] + [(150, None), (151, "")], "doc_id long, text string").repartition(5)
    items = df(spark, [(i, some(4)) for i in range(60)] + [(60, "none of them"), (61, ""), (62, None)], "item_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    pairs = items.select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query")).crossJoin(docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "text"))
    want = search.ranked(pairs.withColumn("score", models.rerank(F.col("query"), F.col("text"))), 5).select("qid", "chunk_id", F.round("score", 6), "rank")
    got = queries.rerank_overlap(spark, str(tmp_path)).select("qid", "chunk_id", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() == 63 * 5
    few = search.most_overlap(docs.where("doc_id >= 148").select(F.col("doc_id").cast("string").alias("chunk_id"), "text"), df(spark, [("q", "zz")], "qid string, query string"), 9)
    assert [(r["chunk_id"], r["score"]) for r in few.orderBy("rank").collect()] == [("148", 0.0), ("149", 0.0), ("151", 0.0), ("150", None)]


def test_search_keeps_the_least_ids_of_equal_vectors(spark):
    rng = np.random.default_rng(3)
    same, far = [rng.standard_normal(16).tolist() for _ in range(3)], [(2 + rng.standard_normal(16)).tolist() for _ in range(300)]
    vectors = [*(v for v in same for _ in range(300)), *far]
    nodes = df(spark, [(f"{i:04}", vectors[j]) for i, j in enumerate(rng.permutation(len(vectors)).tolist())], "chunk_id string, embedding array<double>").coalesce(1)
    q = nodes.where("chunk_id < '0040'").select(F.col("chunk_id").alias("qid"), "embedding")
    want = search.knn_sql(nodes, q, 11).where("qid <> chunk_id")
    want = search.ranked(want.drop("rank"), 10).select("qid", "rank", "chunk_id")
    got = search.knn(nodes, q, 10, exclude_self=True).select("qid", "rank", "chunk_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    one = search.knn(nodes, df(spark, [("q", same[0])], "qid string, embedding array<double>"), 10).orderBy("rank").select("chunk_id")
    assert [r[0] for r in one.collect()] == sorted(r["chunk_id"] for r in nodes.where(F.col("embedding") == F.array(*map(F.lit, same[0]))).collect())[:10]


def test_hierarchies_have_as_many_summaries_as_clusters(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    points = np.concatenate([c + 0.02 * rng.standard_normal((15, 16)) for c in centres]).tolist()
    for name, label in (("one", lambda i: 0), ("many", lambda i: i // 3)):
        df(spark, [(i, p, label(i)) for i, p in enumerate(points)], "vec_id long, embedding array<float>, label long").write.parquet(str(tmp_path / name / "embeddings.parquet"))
    first = [r["n"] for r in queries.tree_levels(spark, str(tmp_path / "one")).where("level = 1").collect()]
    assert first == [len(tree.clusters(np.array(points, dtype=np.float32).astype(np.float64)))] and first[0] >= 12
    assert queries.corpus_tier(spark, str(tmp_path / "many")).count() >= 12


def test_bootstrap_queries_take_the_default_resamples(spark, monkeypatch):
    seen = []
    for name in ("bootstrap_intervals", "compared"):
        real = getattr(stats, name)
        call = lambda *a, real=real, **b: seen.append(inspect.signature(real).bind(*a, **b)) or real(*a, **b)
        monkeypatch.setattr(stats, name, call)
    assert queries.bootstrap_ci(spark, "/root/testdata/sf0.001").count() == 5 and queries.compare_configs(spark, "/root/testdata/sf0.001").count() == 4
    for bound in seen:
        bound.apply_defaults()
    assert len(seen) >= 2 and {b.arguments["resamples"] for b in seen} == {10_000}


def test_code_that_no_parser_takes(spark):
    deep = "(" * 100_000 + ")" * 100_000
    form = "import a\n\x0cdef f():\n    return 'x\u2028y'\r\nclass A:\r\n    b = 1\n"
    assert chunking.statement_starts(deep) == chunking.statement_starts("x = '\x00'") == set()
    assert [form[a:b] for a, b in chunking.code_spans(form, 30, "python")] == ["import a\n", "\x0cdef f():\n    return 'x\u2028y'\r\n", "class A:\r\n    b = 1\n"]
    s = df(spark, [("a", "a.py", deep, 0), ("b", "b.py", form, 0), ("c", "c.py", None, 0), ("d", "d.py", " \n\n", 0)], "document_id string, filename string, text string, char_start int")
    rows = chunking.chunked(s).collect()
    for doc, text in (("a", deep), ("b", form)):
        assert "".join(r["content"] for r in sorted((r for r in rows if r["document_id"] == doc), key=lambda r: r["chunk_index"])) == text
    assert {r["document_id"] for r in rows} == {"a", "b"}


def test_longest_run_is_the_first_of_the_longest():
    rng = np.random.default_rng(12)
    for _ in range(400):
        t, s = ("".join(rng.choice(list("abc d"), size=rng.integers(1, n))) for n in (60, 20))
        n = max((k for k in range(1, len(s) + 1) if any(s[i : i + k] in t for i in range(len(s) - k + 1))), default=0)
        at = min((t.find(s[i : i + n]) for i in range(len(s) - n + 1) if s[i : i + n] in t), default=0) if n else 0
        assert spans.longest_run(t, s) == (at, s.find(t[at : at + n]), n)


def test_facets_against_a_loop(spark):
    rng = np.random.default_rng(13)
    rows = [(str(q), f"c{c}", float(rng.random()), rng.random(3).tolist()) for q in range(20) for c in range(int(rng.integers(1, 9)))]
    c = df(spark, rows, "qid string, chunk_id string, score double, relevance array<double>")
    found = decide.covered_order(c, 4, 0.3).collect()
    for q in {r[0] for r in rows}:
        mine = {i: (s, np.array(v)) for x, i, s, v in rows if x == q}
        lo, hi = (f(s for s, _ in mine.values()) for f in (min, max))
        left, order, cover = sorted(mine, key=lambda i: -mine[i][0]), [], np.zeros(3)
        while left and len(order) < 4:
            adds = {i: np.maximum(mine[i][1] - cover, 0).sum() for i in left}
            low, high = min(adds.values()), max(adds.values())
            worth = {i: 0.7 * ((adds[i] - low) / (high - low) if high > low else 0) + 0.300001 * ((mine[i][0] - lo) / (hi - lo) if hi > lo else 0) for i in left}
            pick = max(left, key=worth.get)
            order.append(pick)
            left.remove(pick)
            cover = np.maximum(cover, mine[pick][1])
        assert [r["chunk_id"] for r in sorted((r for r in found if r["qid"] == q), key=lambda r: r["rank"])] == order + left
    assert decide.covered_order(c.where("false"), 4).collect() == []


def test_gold_documents_and_overlap_against_loops(spark):
    """Every document against every snippet, by plain loops."""
    rng = np.random.default_rng(21)
    words = [f"w{k}" for k in range(40)]
    docs = [(str(k), " ".join(rng.choice(words, size=rng.integers(0, 60)))) for k in range(60)] + [("n", None), ("e", "")]
    asked = []
    for k in range(40):
        text = docs[int(rng.integers(0, 60))][1] or ""
        at = int(rng.integers(0, max(1, len(text))))
        asked.append((str(k), text[at : at + int(rng.integers(1, 60))] + ("" if k % 3 else " ")))
    asked += [("odd", "not there at all, not one word of it is there"), ("none", None), ("blank", "  ")]
    d, q = df(spark, docs, "document_id string, text string"), df(spark, asked, "qid string, snippet string")
    want = {(i, j) for i, s in asked for j, t in docs if s and s.strip() and t and s.strip() in t}
    assert {(r["qid"], r["document_id"]) for r in spans.holders(q, d).collect()} == want and want
    split = lambda t: set((t or "").lower().split())
    best = {i: sorted(docs[:60], key=lambda d: (-len(split(s) & split(d[1])), d[0]))[:5] for i, s in asked[:40]}
    found = search.most_overlap(d.where("text is not null").selectExpr("document_id as chunk_id", "text").where("chunk_id <> 'e'"), q.where("snippet is not null").selectExpr("qid", "snippet as query"), 5)
    got = {(r["qid"], r["rank"]): r["chunk_id"] for r in found.collect()}
    assert all(got[i, k + 1] == doc for i, mine in best.items() for k, (doc, _) in enumerate(mine))
