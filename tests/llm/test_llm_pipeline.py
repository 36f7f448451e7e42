"""The pipeline: every stage against brute force on a table of odd rows, then all of them on a small table."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import toxicity
from tests.llm.test_llm_operators import DOC, _added_pii, _base_pii, _labelled, _near, rows

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = list(corpus_pipeline.COLUMNS)
#: Nulls in every column, empty and long texts, ties, repeated rows and ids.
ROWS = [
    (9001, None, "en", "a", None), (9002, "", None, "a", 0), (9003, " \n\t", "en", None, 3), (None, "mail a@b.org now", "en", "b", 16), (None, None, None, None, None),
    (9004, "card 4111 1111 1111 1111, ip 10.0.0.1 and x@y.example +1 555 123 4567", "de", "b", 69), (9005, "IBAN DE89 3704 0044 0532 0130 00", "de", "b", 32), (9006, "word " * 9000, "en", "c", 45_000),
    (9007, "one two three", "en", "b", 13), (9007, "one two three", "en", "b", 13), (9007, "four five", "en", "b", 9), (9008, "0" * 5000 + ".1.1.1", "en", "c", 5006), (9009, "<|endoftext|> İ. x", "tr", "é", 18),
]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Labelled documents, groups of near copies and odd rows, with extra columns whose names the operators use; the folder holds their labels."""
    rng = np.random.default_rng(30)
    data = [(k, t, "en", "abc"[k % 3], len(t)) for k, t, _ in _labelled()]
    for k in range(12):
        words = [f"w{x}" for x in rng.integers(0, 10**6, size=150)]
        for j in range(3):
            mine = list(words)
            mine[int(rng.integers(0, 150))] = f"x{j}"
            data.append((5000 + 10 * k + j, " ".join(mine), "en", "d", None))
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(k, bad, 1) for k, _, bad in _labelled()] + [(None, 1, 1), (9007, None, None)], "doc_id long, toxic int, text int").write.parquet(str(folder / "labels.parquet"))
    docs = spark.createDataFrame(data + ROWS, DOC)
    for name in ("id", "n", "size", "key", "group", "spans", "__id", "__words", "__extra", "length"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs, str(folder)


def run(spark, table, name, docs=None):
    held, folder = table
    return STAGES[name](spark, held if docs is None else docs, folder)


def odd(table):
    return table[0].where("doc_id is null or doc_id >= 5000")


def test_toxicity_stage(spark, table):
    out = run(spark, table, "toxicity")
    assert out.columns == COLUMNS
    left = collections.Counter(rows(out, *COLUMNS))
    whole = collections.Counter(rows(table[0], *COLUMNS))
    insults = collections.Counter({r: n for r, n in whole.items() if r[1] and set(r[1].split()) & {"idiot", "moron", "scumbag"}})
    assert not left - whole and sum((left & insults).values()) <= 0.02 * sum(insults.values()) and sum(((whole - insults) - left).values()) <= 0.02 * sum(whole.values())
    labels = spark.read.parquet(f"{table[1]}/labels.parquet")
    kept = [r[0] for r in rows(toxicity.score_documents(table[0], labels).where("predicted = 0"), "doc_id")]
    assert collections.Counter(kept) == collections.Counter(r[0] for r in left.elements())


def test_near_duplicates_stage(spark, table):
    docs = odd(table)
    out = run(spark, table, "near duplicates", docs)
    data = rows(docs, *COLUMNS)
    once = {r[0]: r[1] for r in data if r[0] is not None and r[0] != 9007}
    root = {i: r for i, (_, r) in _near(once.items(), 80).items()}
    want = [r for r in data if r[0] is None or r[0] == 9007 or root[r[0]] == r[0]]
    got, expected = collections.Counter(rows(out, *COLUMNS)), collections.Counter(want)
    assert out.columns == COLUMNS and not got - expected and not expected - got and len(want) == len(data) - 24


def test_personal_data_stage(spark, table):
    def cleaned(text):
        if text is None:
            return None
        out, end = [], 0
        spans = sorted((a, b, k) for k, a, b in _base_pii(text) + _added_pii(text))
        for n, (a, b, kind) in enumerate(spans):
            if a >= end:
                stop = b
                for x, y, _ in spans[n + 1 :]:
                    stop = max(stop, y) if x < stop else stop
                out += [text[end:a], f"[{kind.upper()}]"]
                end = stop
        return "".join(out) + text[end:]

    out = run(spark, table, "personal data")
    want = [(i, cleaned(t), lang, source, None if t is None else len(cleaned(t))) for i, t, lang, source, _ in rows(table[0], *COLUMNS)]
    assert out.columns == COLUMNS and collections.Counter(rows(out, *COLUMNS)) == collections.Counter(want)
    assert any("[IBAN]" in (r[1] or "") for r in want) and any("[CARD]" in (r[1] or "") and "[PHONE]" in r[1] for r in want)


def _mixed(data):
    """(source, text) of the mix by a loop over rows in the order of their keys; texts cut as the budget asks."""
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = collections.defaultdict(list)
    for r in data:
        by[r[3]].append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (1.0, 2.0, 3.0)[k % 3] for k, s in enumerate(names)}
    size = {s: sum(count(r[1]) for r in by[s]) for s in names}
    target, free, left = {}, set(names), float(sum(size.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= over
    out = []
    for s in names:
        whole = int(target[s] + 1e-6)
        epochs = min(3, whole // size[s]) if size[s] else 0
        rest = whole - epochs * size[s]
        key = lambda r: (int(hashlib.md5(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16), r[0] or 0, count(r[1]))
        for r in sorted(by[s], key=key):
            n = count(r[1])
            if not n:
                out.append((s, r[1]))
                continue
            out += [(s, r[1])] * epochs
            if rest > 0:
                out.append((s, r[1] if rest >= n else "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", r[1])[:rest])))
            rest -= n
    return collections.Counter(out)


def test_mixing_stage(spark, table):
    out = run(spark, table, "mixing")
    assert out.columns == COLUMNS and collections.Counter(rows(out, "source", "text")) == _mixed(rows(table[0], *COLUMNS))
    assert out.where("n_chars <> length(text) and doc_id between 1 and 4999").count() == 0


def test_packing_stage(spark, table):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = rows(run(spark, table, "packing"), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    want = collections.Counter()
    for doc_id, text in rows(table[0], "doc_id", "text"):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.update((doc_id, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096)))
    assert collections.Counter(r[:5] for r in found) == want
    held = collections.defaultdict(list)
    for r in found:
        held[r[5]].append((r[6], r[3]))
    for parts in held.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096
    assert len(held) <= 2 + sum(r[3] for r in found) // 4096


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, table, name):
    out = run(spark, table, name, table[0].where("false"))
    assert out.collect() == [] and (name == "packing" or out.columns == COLUMNS)


def test_run(spark):
    assert list(STAGES) == ["toxicity", "near duplicates", "personal data", "mixing", "packing"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.where("length < 1 or length > 4096").count() == 0 and out.count() > 0
    assert out.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").count() == 0
