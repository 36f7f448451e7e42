"""Indexing a corpus, evaluating runs, drafting and merging questions."""

import json

from pyspark.sql import functions as F

from granary.functions import models
from granary.operators import corpus, decide
from granary.plans import config, evaluation, indexing


def test_index_has_all_levels(spark):
    rows = [(f"d{d}", f"d{d}.md", "".join(f"Sentence {k} of topic {d} in the corpus. " for k in range(60)), 0) for d in range(3)]
    sections = spark.createDataFrame(rows, "document_id string, filename string, text string, char_start int")
    cfg = config.with_values(config.Pipeline(), {"chunking.prose_target_chars": 200, "raptor.target_dim": 3, "raptor.max_clusters": 4})
    nodes = indexing.index(sections, cfg).collect()
    assert {r["level"] for r in nodes} >= {0} and len({r["chunk_id"] for r in nodes}) == len(nodes)
    flat = indexing.index(sections, config.with_values(cfg, {"raptor.enabled": False}))
    assert {r["level"] for r in flat.collect()} == {0}
    assert indexing.passages(spark.createDataFrame([("p", "x")], "chunk_id string, content string")).first()["document_id"] == "p"


def test_evaluation(spark):
    runs = spark.createDataFrame([("a", "q1", "x", 1.0), ("b", "q1", "y", 1.0), ("a", "q2", "y", 1.0)], "config string, qid string, chunk_id string, score double")
    qrels = spark.createDataFrame([("q1", "x", 1), ("q2", "y", 1)], "qid string, chunk_id string, grade int")
    got = {(r["config"], r["qid"]): r["success"] for r in evaluation.by_config(runs, qrels).collect()}
    assert got == {("a", "q1"): 1.0, ("a", "q2"): 1.0, ("b", "q1"): 0.0, ("b", "q2"): 0.0}
    hits = spark.createDataFrame([("q1", "x", 1.0, "passage")], "qid string, chunk_id string, score double, content string")
    asked = spark.createDataFrame([("q1", "why?", ["a"]), ("q2", "how?", ["b"])], "qid string, query string, gold array<string>")
    out = {r["qid"]: r["predicted"] for r in evaluation.answers(hits, asked).collect()}
    assert "[1] passage" in out["q1"] and out["q2"] == ""
    forced = spark.createDataFrame([("semantic", "q1", 1.0), ("dphf", "q1", 0.0), ("semantic", "q2", 0.0), ("dphf", "q2", 1.0)], "strategy string, qid string, value double")
    decided = spark.createDataFrame([("mine", "q1", "semantic"), ("mine", "q2", "hyde")], "router string, qid string, strategy string")
    means = {r["router"]: (r["mean"], r["best_fixed"]) for r in evaluation.routers(decided, forced).collect()}
    assert means == {"mine": (1.0, 0.5), "oracle": (1.0, 0.5), "always-semantic": (0.5, 0.5), "always-dphf": (0.5, 0.5)}
    test = spark.createDataFrame([("a", 0.1, 0.001), ("b", -0.1, 0.001), ("c", 0.1, 0.9), ("d", 0.1, 0.001)], "config string, mean double, p double")
    dev = spark.createDataFrame([("a", 0.2), ("b", -0.2), ("c", 0.1), ("d", -0.1)], "config string, mean double")
    assert {r["config"]: r["verdict"] for r in evaluation.survival(dev, test).collect()} == {"a": "yes", "b": "no", "c": "not significant", "d": "unstable"}


def test_drafts_and_batches(spark):
    docs = spark.createDataFrame([("d1", "Steel is an alloy of iron and carbon.")], "doc_id string, text string")
    chosen = spark.createDataFrame([("c", "factual", "d1")], "collection_id string, question_type string, doc_id string")
    reply = json.dumps({"question": "What is steel?", "answer": "an alloy", "snippets": [{"document_id": "d1", "snippet": "alloy of iron"}]})
    made = corpus.drafted(chosen, docs, lambda system, user: F.lit("unknown" if "unknown" in system else f"Here: {reply}")).collect()
    assert len(made) == 1 and made[0]["gold_spans"][0]["char_start"] == 12 and made[0]["answerable"] is False
    v = lambda t: models.vector(t, 8).tolist()
    one = spark.createDataFrame([("a", "c1", v("x")), ("b", "c2", v("y"))], "qid string, collection_id string, embedding array<float>")
    two = spark.createDataFrame([("c", "c3", v("x")), ("d", "c4", v("z"))], "qid string, collection_id string, embedding array<float>")
    assert {r["qid"] for r in corpus.merged_batches([one, two]).collect()} == {"a", "b", "d"}


def test_learned_router(spark):
    rows = [(str(k), [float(k % 2), float(k)], "semantic" if k % 2 else "dphf") for k in range(40)]
    f = spark.createDataFrame([r[:2] for r in rows], "qid string, features array<double>")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "qid string, strategy string")
    got = {r["qid"]: r["strategy"] for r in decide.learned_router(f, labels)(f).collect()}
    assert sum(got[r[0]] == r[2] for r in rows) >= 38
