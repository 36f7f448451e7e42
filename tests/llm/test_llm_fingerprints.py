"""Fingerprints: edited texts, equality, and likeness against generalised Jaccard similarity."""

import collections
import hashlib

import numpy as np
from pyspark.sql import functions as F

from granary.llm import fingerprints


def _edited(data):
    """data: (doc_id, text) in order; what each text becomes."""
    out = []
    for k, (_, text) in enumerate(data):
        after = data[(k + 1) % len(data)][1]
        half = len(text) // 2
        out.append(text[: len(text) - half] + after[:half])
    return out


def _likeness(a, b):
    x, y = collections.Counter(a.split()), collections.Counter(b.split())
    keys = x.keys() | y.keys()
    if not keys:
        return 1.0
    return sum(min(x[k], y[k]) for k in keys) / sum(max(x[k], y[k]) for k in keys)


def test_edits_and_likeness(spark):
    rng = np.random.default_rng(1)
    data = [(k, " ".join(f"w{x}" for x in rng.integers(0, 40, size=rng.integers(1, 80)))) for k in range(150)]
    data += [(200, ""), (201, None), (202, "a"), (203, "é\U0001f600 x" * 9), (204, "same text here"), (205, "same text here"), (-7, "low"), (2**62, "high " * 5000)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("pos", F.lit(1)).withColumn("h", F.lit(2))
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(df).collect()}
    order = sorted(((i, t or "") for i, t in data), reverse=True)
    errors = []
    for k, ((doc_id, text), edited) in enumerate(zip(order, _edited(order), strict=True)):
        r = found[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r["near_edited"] - _likeness(text, edited), r["near_next"] - _likeness(text, order[(k + 1) % len(order)][1])]
    assert np.sqrt(np.mean(np.square(errors))) < 0.07 and abs(np.mean(errors)) < 0.02
    assert all(abs(r["near_next_error"] - np.sqrt(r["near_next"] * (1 - r["near_next"]) / fingerprints.SAMPLES)) < 1e-9 for r in found.values())
    assert found[204]["fingerprint"] == found[205]["fingerprint"] != ""
    assert found[200]["fingerprint"] == found[201]["fingerprint"] == ""
    assert len(found) == len(data)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert fingerprints.fingerprint_documents(spark.createDataFrame([], schema)).collect() == []
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(3, "a b c d")], schema)).collect()[0]
    assert one["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest() and one["near_next"] == 1.0
    odd = spark.createDataFrame([(None, "x y"), (None, None), (1, "b"), (1, "a"), (1, "a")], schema)
    assert len(fingerprints.fingerprint_documents(odd).collect()) == 5


def test_hot_ids_are_dealt_to_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "LEAST_ROWS", 5)
    data = [(None, f"n{k % 9}") for k in range(90)] + [(50, f"h{k} x") for k in range(40)] + [(50, "same same")] * 60 + [(k, f"t{k}") for k in range(100)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    rows = fingerprints.with_edits(df).select("range", "pos", "doc_id", "text", "edited").collect()
    by_range = collections.Counter(r["range"] for r in rows)
    assert len(rows) == len(data) and max(by_range.values()) <= 60
    order = sorted(rows, key=lambda r: (-r["range"], r["pos"]))
    ids = [r["doc_id"] for r in order]
    assert ids == sorted((i for i in ids if i is not None), reverse=True) + [None] * 90
    assert [r["edited"] for r in order] == _edited([(r["doc_id"], r["text"]) for r in order])
    assert sum(r["range"] < 0 for r in rows) == 90 and len({r["range"] for r in rows if r["doc_id"] is None}) > 5 and len({r["range"] for r in rows if r["doc_id"] == 50}) > 5
    assert len(fingerprints.fingerprint_documents(df).collect()) == len(data)


def test_plan_has_no_python(spark, tmp_path):
    df = spark.createDataFrame([(k, f"a b {k}") for k in range(20)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "docs"))
    kept = spark.read.parquet(str(tmp_path / "docs"))
    for made in (fingerprints.with_edits(kept), fingerprints.fingerprint_documents(kept)):
        plan = made._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
