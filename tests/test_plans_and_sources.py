"""Configurations, the pipeline, node tables, loaders, streaming and the registered queries."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from granary.functions import models
from granary.plans import config, queries, retrieval
from granary.sources import loaders, nodes
from granary.streaming import prefetch


def test_variants_apply_and_differ():
    assert len(config.ABLATIONS) == 24
    full = config.apply("full")
    assert config.apply("wo_raptor").raptor.enabled is False and config.apply("wo_nli_edges").graph.edges == ("sequential", "semantic", "xref", "ast")
    assert config.apply("wo_graph", config.Pipeline()).graph.enabled is False and full.graph.enabled
    assert config.apply("baseline").fusion.hyde_expansion == "modality" and config.baseline(config.Pipeline()).fusion.hyde_expansion == "none"
    assert config.loads(config.dumps(full)) == full
    with pytest.raises(ValueError):
        config.loads('{"no_such": 1}')
    with pytest.raises(KeyError):
        config.apply("nothing")


def test_config_takes_environment(monkeypatch):
    monkeypatch.setenv("WAY", "collapsed")
    assert config.loads('{"raptor": {"retrieval_mode": "${WAY}"}}').raptor.retrieval_mode == "collapsed"


@pytest.fixture(scope="module")
def small(spark):
    rows = [(f"a:{k}", "a", k, f"doc A paragraph {k} discussing subtopic {k}", models.vector(f"doc A paragraph {k} discussing subtopic {k}", 24).tolist(), 0) for k in range(12)]
    leaves = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, content string, embedding array<float>, level int").withColumn("child_ids", F.array().cast("array<string>"))
    q = spark.createDataFrame([("q1", "What is subtopic 2?"), ("q2", "overview of doc A")], "qid string, query string")
    return leaves, q, retrieval.Models(embed=lambda t: models.embed(t, 24))


@pytest.mark.parametrize("name", ["full", "baseline", "semantic_only", "wo_rerank", "wo_modality_hyde"])
def test_pipeline_runs_under_variants(small, name):
    leaves, q, use = small
    out = retrieval.run(leaves, q, config.with_values(config.apply(name), {"top_k": 3}), use=use)
    rows = out.hits.collect()
    assert {r["qid"] for r in rows} == {"q1", "q2"} and all(r["rank"] <= 3 for r in rows)
    assert out.decisions.count() == 2 and out.outcomes.count() == 2
    stages = {r["stage"] for r in out.trace.collect()}
    cfg = config.apply(name)
    assert ("rerank" in stages) == cfg.rerank.enabled and ("graph_rescore" in stages) == (cfg.graph.enabled and not cfg.rerank.enabled)


def test_forced_routes_and_runs(small):
    leaves, q, use = small
    cfg = config.with_values(config.semantic_only(config.Pipeline()), {"top_k": 2})
    assert {r["strategy"] for r in retrieval.run(leaves, q, cfg, forced="step_back", use=use).decisions.collect()} == {"step_back"}
    got = retrieval.ablations(leaves, q, ("semantic_only",), use=use)
    assert {r["config"] for r in got.collect()} == {"semantic_only"}


def test_node_table(spark, tmp_path):
    t = nodes.NodeTable(spark, str(tmp_path / "nodes"), dim=2)
    assert t.count() == 0
    row = lambda k, v: (k, "d", 0, "x", v, 0)
    schema = "chunk_id string, document_id string, chunk_index int, content string, embedding array<float>, level int"
    t.upsert(spark.createDataFrame([row("U Know What's Up", [1.0, 0.0]), row("b", [0.0, 1.0])], schema))
    t.upsert(spark.createDataFrame([row("b", [0.5, 0.5])], schema))
    assert t.count() == 2 and {r["chunk_id"]: list(r["embedding"]) for r in t.read().collect()}["b"] == [0.5, 0.5]
    wanted = spark.createDataFrame([(0, "b"), (1, "gone"), (2, "U Know What's Up")], "pos int, chunk_id string")
    assert [r["chunk_id"] for r in nodes.by_ids(t.read(), wanted).orderBy("pos").collect()] == ["b", "U Know What's Up"]
    with pytest.raises(Exception, match="length"):
        t.upsert(spark.createDataFrame([row("c", [1.0])], schema))


def test_calls(spark):
    w = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k2", "b")], "key string, text string")
    calls = spark.createDataFrame([("k1", None, None, None, "old")], nodes.CALL)
    got, new = nodes.cached_calls(w, calls, F.upper)
    assert sorted(tuple(r) for r in got.select("key", "payload").collect()) == [("k1", "old"), ("k2", "B"), ("k2", "B")]
    assert [tuple(r) for r in new.collect()] == [("k2", "B")]
    with pytest.raises(Exception, match="not in the table"):
        nodes.cached_calls(w, calls, F.upper, "read_only")[0].collect()
    text = 'say "é"\n'
    key = spark.createDataFrame([(text,)], "t string").select(nodes.call_key("embed", "p", "m", F.col("t"))).first()[0]
    assert key == nodes.python_call_key("embed", "p", "m", text)


def test_loaders(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"q1": {"a": 1, "b": 0}}))
    assert loaders.judgements(spark, str(tmp_path / "q.json")).count() == 2
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    assert loaders.csv_text(spark, str(tmp_path / "t.csv")) == "a, b\n1, 2"
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "x.md").write_bytes(b"caf\xc3\xa9 \xff")
    (tmp_path / "docs" / "empty.md").write_bytes(b"")
    got = loaders.text_files(spark, str(tmp_path / "docs")).collect()
    assert [(r["filename"], r["text"]) for r in got] == [("x.md", "café �")]
    refs = spark.createDataFrame([("github://o/r@main:src/a.py",), ("arxiv://1234.5",), ("nope",)], "r string").select(loaders.source_kind(F.col("r")).alias("k")).select("k.*").collect()
    assert tuple(refs[0]) == ("github", "o/r", "main", "src/a.py") and refs[1]["name"] == "1234.5" and refs[2]["scheme"] is None
    rows = spark.createDataFrame([("1", "q?", "x", ["y", ""], [("t", "p one", True), ("u", "p two", False)]), ("2", "r?", "z", [], [("t", "p", False)])], "id string, question string, answer string, answer_aliases array<string>, paragraphs array<struct<title:string,text:string,is_supporting:boolean>>")
    asked, passages, grades = loaders.multi_hop(rows)
    assert asked.count() == 1 and passages.count() == 2 and [tuple(r) for r in grades.collect()] == [("1", "1::0", 1)]


def test_prefetch_batch_and_stream_agree(spark, tmp_path):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    turns.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in"))
    q = prefetch.unseen(stream).writeStream.format("memory").queryName("unseen").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("unseen").collect())) == sorted(map(tuple, prefetch.unseen(turns).collect()))
    q = prefetch.buffer_stream(stream, 5).writeStream.format("memory").queryName("held").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    held = spark.table("held").collect()
    assert len(held) == prefetch.unseen(turns).count() and max(r["size"] for r in held) <= 5
    b = spark.createDataFrame([(1, "A", 1, [1.0, 0.0]), (1, "B", 2, [0.0, 1.0])], "conv_id long, entity string, place int, embedding array<double>")
    asked = spark.createDataFrame([(1, "x", [1.0, 0.1]), (1, "y", [0.7, 0.7]), (2, "z", [1.0, 0.0])], "conv_id long, qid string, embedding array<double>")
    assert {r["qid"]: r["hit"] for r in prefetch.lookups(b, asked).collect()} == {"x": True, "y": False, "z": False}


def test_queries_are_registered():
    assert set(queries.SQL) <= set(queries.QUERIES) and set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", ["knn_topk", "rrf_fusion", "edges_semantic", "ppr_scores", "ndcg_at_k", "answer_em_f1", "holm", "collection_split", "span_qrels"])
def test_queries_equal_sql(spark, name):
    import duckdb

    sf_dir, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations", "pages"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, sf_dir).select(*want.columns)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))
