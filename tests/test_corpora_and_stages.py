"""Evaluation sets, flat corpora, running counts, cross-fitting, and the pipeline's prefetching and outcomes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import models
from granary.operators import corpus, decide, stats, tree
from granary.plans import config, indexing, retrieval
from granary.streaming import prefetch


def test_step_rules_equal_loops_under_ties(spark):
    rng = np.random.default_rng(40)
    for n, scale in ((200, 0.02), (200, 1.0), (1, 0.01)):
        p = (rng.integers(0, 40, size=n) / 40 * scale).tolist()
        df = spark.createDataFrame([(str(k), x) for k, x in enumerate(p)] + [("null", None)], "name string, p double")
        order = sorted(range(n), key=lambda k: (p[k], str(k)))
        stop = next((i for i, k in enumerate(order) if p[k] > 0.05 / (n - i)), n)
        found = {r["name"]: r["rejected"] for r in stats.holm(df).collect()}
        assert found == {str(k): i < stop for i, k in enumerate(order)} | {"null": False}
        last = max((i for i, k in enumerate(order) if p[k] <= 0.05 * (i + 1) / n), default=-1)
        found = {r["name"]: r["rejected"] for r in stats.benjamini_hochberg(df).collect()}
        assert found == {str(k): i <= last for i, k in enumerate(order)} | {"null": False}
    assert stats.holm(df.where("false")).collect() == []


def test_resamples_do_not_depend_on_how_many_are_drawn_at_once(monkeypatch):
    values = np.random.default_rng(43).random(257)
    whole = values[np.random.default_rng(7).integers(0, 257, size=(300, 257))].mean(axis=1)
    for draws in (1, 257 * 7, 10**9):
        monkeypatch.setattr(stats, "DRAWS", draws)
        assert (stats._resampled(values, 300, 7) == whole).all()


def test_cross_fit_equals_plain_ridge(spark):
    rng = np.random.default_rng(41)
    x = np.round(rng.normal(size=(60, 4)), 2)
    x[:, 3] = 1.0  # a feature without spread
    r = np.round(rng.random((60, 3)), 2)
    features = spark.createDataFrame([(f"q{k}", x[k].tolist()) for k in range(60)], "qid string, features array<double>").repartition(5)
    rewards = spark.createDataFrame([(f"q{k}", *map(float, r[k])) for k in range(60)], "qid string, semantic double, dphf double, step_back double")
    fold = {a["qid"]: a["f"] for a in features.select("qid", F.pmod(F.xxhash64("qid"), F.lit(5)).alias("f")).collect()}
    found = {a["qid"]: a["strategy"] for a in decide.cross_fitted(features, rewards).collect()}
    for f in range(5):
        mine = np.array([fold[f"q{k}"] == f for k in range(60)])
        router = decide.RewardRouter().fit(x[~mine], r[~mine])
        assert [found[f"q{k}"] for k in np.flatnonzero(mine)] == router.decide(x[mine])
    assert decide.cross_fitted(features.where("false"), rewards).collect() == []
    one = decide.cross_fitted(features.where("qid = 'q1'"), rewards).collect()
    assert [a["strategy"] for a in one] == ["dphf"]
    fitted = {a["qid"]: a["strategy"] for a in decide.reward_router(features, rewards)(features).collect()}
    assert [fitted[f"q{k}"] for k in range(60)] == decide.RewardRouter().fit(x, r).decide(x)


def test_evaluation_sets(spark):
    text = "Alpha beta gamma delta. " * 30
    docs = spark.createDataFrame([("d1", "a.txt", text), ("d2", "b.txt", text), ("d3", "c.txt", None)], "document_id string, filename string, text string")
    spans = [("q1", [("d1", 0, 40)]), ("q2", [("d2", 100, 130), ("d9", 0, 5)]), ("q3", []), ("q4", [("d3", 0, 9)])]
    asked = spark.createDataFrame([(q, "what", "x", "factual", "dev" if q == "q1" else None, s) for q, s in spans], "qid string, question string, answer string, type string, split string, gold_spans array<struct<document_id:string,char_start:int,char_end:int>>")
    questions, passages, judged = corpus.from_manifest(asked, docs.select("document_id", "filename"), docs, prose_target=200, prose_min=10)
    assert {(r["qid"], r["split"]) for r in questions.collect()} == {("q1", "dev"), ("q2", "test")}
    assert {r["document_id"] for r in passages.collect()} == {"d1", "d2"}
    assert {(r["qid"], r["chunk_id"], r["grade"]) for r in judged.collect()} == {("q1", "d1:0", 1), ("q2", "d2:0", 1)}
    assert corpus.evaluation_set(asked, passages.withColumn("char_start", F.lit(0)).withColumn("char_end", F.lit(10)), split="dev")[0].count() == 1
    members = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1"), ("c", "9")], "collection_id string, doc_id string")
    known = spark.createDataFrame([("1", "x"), ("2", "y")], "doc_id string, text string")
    assert {(r["collection_id"], r["doc_id"]) for r in corpus.assembled(members, known).collect()} == {("a", "1"), ("a", "2")}
    made = corpus.manifest(known.withColumn("filename", F.lit("f")))
    assert corpus.verified(made, known).collect()[0]["status"] == "ok"


@pytest.fixture(scope="module")
def nodes(spark):
    rng = np.random.default_rng(42)
    rows = [(f"{d}:{k}", d, k, f"{d} text {k} of {d}", (np.eye(8)[3 * (d == "b") + k % 2] + rng.normal(size=8) * 0.05).tolist(), 0, []) for d in "ab" for k in range(16)]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, content string, embedding array<float>, level int, child_ids array<string>")


def test_flat_corpora_are_climbed_once(spark, nodes):
    cfg = config.with_values(config.Pipeline(), {"raptor.target_dim": 3})
    embed = lambda t: models.embed(t, 8)
    once = indexing.over_flat(nodes, cfg, embed).persist()
    assert once.where("level = 0").count() == 32 and once.where("level > 0").count() > 1
    again = indexing.over_flat(once, cfg, embed)
    assert again.count() == once.count()
    tier = tree.corpus_tier(once, models.summarize, embed, dims=3).persist()
    kept = tier.withColumn("content", F.lit("made before"))
    reused = tree.corpus_tier(once, models.summarize, embed, existing=kept, dims=3).collect()
    assert {r["chunk_id"] for r in reused} == {r["chunk_id"] for r in tier.collect()} and {r["content"] for r in reused} == {"made before"}


def test_tokens_join_to_their_text(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", " One two\n three  "), (1, 1, "user", "x"), (1, 2, "assistant", "  "), (2, 0, "assistant", ""), (2, 1, "assistant", None)], "conv_id long, turn int, role string, text string")
    made = prefetch.token_stream(turns).orderBy("conv_id", "turn", "n").collect()
    joined = {}
    for r in made:
        joined[r["conv_id"], r["turn"]] = joined.get((r["conv_id"], r["turn"]), "") + r["token"]
    assert joined == {(1, 0): " One two\n three  ", (1, 2): "  "}
    cache = spark.createDataFrame([(1, 0, "kept")], "conv_id long, turn int, text string")
    assert [(r["turn"], r["token"]) for r in prefetch.replayed(turns, cache).collect() if r["turn"] == 0] == [(0, "kept")]


PLAIN = {"raptor.enabled": False, "router.enabled": False, "rerank.enabled": False, "expansion.enabled": False, "graph.enabled": False}


def test_prefetched_queries_go_through_no_stage(spark, nodes):
    cfg = config.with_values(config.Pipeline(), PLAIN | {"prefetch.enabled": True, "correction.enabled": False, "top_k": 2})
    vec = "array<float>"
    buffer = spark.createDataFrame([(1, "E", 1, [1.0] + [0.0] * 7), (1, "N", 2, [0.0] * 7 + [1.0])], f"conv_id long, entity string, place int, embedding {vec}")
    results = spark.createDataFrame([(1, "E", f"a:{k}", 1.0 / (k + 1), k + 1) for k in range(4)], "conv_id long, entity string, chunk_id string, score double, rank int")
    q = spark.createDataFrame([("hit", 1, "x", [1.0, 0.1] + [0.0] * 6), ("empty", 1, "x", [0.0] * 7 + [2.0]), ("other", 2, "x", [1.0] + [0.0] * 7), ("far", 1, "x", [0.0, 1.0] + [0.0] * 6)], f"qid string, conv_id long, query string, embedding {vec}")
    out = retrieval.run(nodes, q, cfg, prefetched=(buffer, results))
    hits = [(r["qid"], r["rank"], r["chunk_id"]) for r in out.hits.orderBy("qid", "rank").collect()]
    assert [h for h in hits if h[0] == "hit"] == [("hit", 1, "a:0"), ("hit", 2, "a:1")] and {h[0] for h in hits} == {"hit", "other", "far"}
    assert {(r["qid"], r["n"]) for r in out.trace.where("stage = 'prefetch_hit'").collect()} == {("hit", 4 if cfg.top_k > 3 else 2), ("empty", 0)}
    assert {r["qid"] for r in out.decisions.collect()} == {"other", "far"} and out.outcomes.count() == 4
    off = retrieval.run(nodes, q, config.with_values(cfg, {"prefetch.enabled": False}), prefetched=(buffer, results))
    assert off.decisions.count() == 4


def test_outcomes_where_nothing_is_found(spark, nodes):
    q = spark.createDataFrame([("q", "x", [1.0] + [0.0] * 7)], "qid string, query string, embedding array<float>")
    bare = nodes.where("false")
    use = retrieval.Models(embed=lambda t: models.embed(t, 8), generate=lambda system, user: F.lit("1"))
    said = lambda n, **v: [(r["qid"], r["confidence"]) for r in retrieval.run(n, q, config.with_values(config.Pipeline(), PLAIN | {f"correction.{k}": x for k, x in v.items()}), use=use).outcomes.collect()]
    assert said(bare, variant="sscc") == [("q", "none")] and said(bare, variant="crag") == [("q", "none")]
    assert said(bare, variant="sscc", enable_query_rewrite=False) == [("q", "low")]
    assert said(nodes, variant="sscc", sscc_tau_bi=2.0) == [("q", "medium")] and said(nodes, variant="crag") == [("q", "medium")]
    assert said(nodes, variant="crag", enable_query_rewrite=False) == [("q", "low")]


def test_a_fitted_router_decides(spark, nodes):
    q = spark.createDataFrame([("q1", "x", [1.0] + [0.0] * 7), ("q2", "y", [0.0, 1.0] + [0.0] * 6)], "qid string, query string, embedding array<float>")
    cfg = config.with_values(config.Pipeline(), PLAIN | {"router.enabled": True, "router.variant": "learned", "correction.enabled": False})
    use = retrieval.Models(embed=lambda t: models.embed(t, 8))
    router = lambda rows: rows.select("qid", F.when(F.col("qid") == "q1", "step_back").otherwise("dphf").alias("strategy"))
    fitted = retrieval.run(nodes, q, cfg, use=use, router=router)
    assert {r["qid"]: r["strategy"] for r in fitted.decisions.collect()} == {"q1": "step_back", "q2": "dphf"}
    assert {r["strategy"] for r in retrieval.run(nodes, q, cfg, use=use).decisions.collect()} == {"semantic"}
