"""The training-data operators against brute force, and their edge cases."""

import collections
import hashlib
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import embeddings, licenses, minhash, mixing, packing, pii, quality, suffixes, toxicity
from granary.llm.common import hashed_words
from granary.llm.components import components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 5), (4, "one two three", "en", "b", 13), (4, "one two three", "en", "b", 13),
    (None, "one two three four five six", "en", None, 27), (5, "word " * 20_000, "en", "a", 100_000), (6, "éß \U0001f600 \x1c x", "de", "é", 9), (7, "one two three four five six", None, "b", 27),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names the operators use themselves."""
    extra = ("id", "n", "size", "score", "key", "range", "length", "rank", "vec", "group", "spans", "taken", "__id")
    df = spark.createDataFrame(ODD, DOC)
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- mixing


def test_mix_equals_sql(spark):
    from granary.llm.queries import SQL, op1_mixing

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(SQL["op1_mixing"]).fetchall())
    assert sorted(rows(op1_mixing(spark, SF), "doc_id", "size", "source_size", "target", "taken")) == want


def test_mix_targets_and_edges(odd, none):
    found = rows(mixing.mix_plan(odd), "source", "size", "source_size", "target", "taken")
    total = sum(r[1] for r in found)
    targets = {r[0]: (r[2], r[3]) for r in found}
    assert total == sum(t for _, t in targets.values())
    assert all(t <= 3 * s for s, t in targets.values())
    for source, (_, target) in targets.items():
        assert sum(r[4] for r in found if r[0] == source) == int(target + 1e-6)
    assert all(r[4] <= 3 * r[1] for r in found)
    assert len(found) == len(ODD)
    assert rows(mixing.mix_plan(none), "doc_id") == []
    assert rows(mixing.mix_plan(odd), "taken") == rows(mixing.mix_plan(odd), "taken")


def test_mixed_documents_follow_the_plan(docs):
    plan = {r[0]: r[1] for r in rows(mixing.mix_plan(docs), "doc_id", "taken")}
    words = collections.Counter()
    for doc_id, text in rows(mixing.mix_documents(docs), "doc_id", "text"):
        words[doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert {k: v for k, v in plan.items() if v} == {k: v for k, v in words.items() if v}


@pytest.mark.parametrize("repeats", [3, 40])
def test_mixed_repeated_rows_keep_the_budget(spark, monkeypatch, repeats):
    monkeypatch.setattr(mixing, "ALIKE", 7)
    data = [(1, "a b c d", "en", "s", 7), (1, "a", "en", "s", 1), (1, "x y z w", "de", "s", 7), (None, "n m", None, "s", 3), (2, None, "en", "s", None), (3, "q r", "en", None, 3), (4, "big " * 50, "en", "t", 200)]
    df = spark.createDataFrame(data * repeats, DOC)
    plan = rows(mixing.mix_plan(df), "source", "size", "target", "taken")
    assert len(plan) == len(data) * repeats and all(r[3] <= 3 * r[1] for r in plan)
    want = {s: int(next(r[2] for r in plan if r[0] == s) + 1e-6) for s in ("s", "t", None)}
    mixed = rows(mixing.mix_documents(df), "source", "text")
    for source, words in want.items():
        assert sum(r[3] for r in plan if r[0] == source) == words
        assert sum(len((t or "").split()) for s, t in mixed if s == source) == words
    assert sum(t is None for _, t in mixed) == repeats
    assert sorted(mixed, key=str) == sorted(rows(mixing.mix_documents(df), "source", "text"), key=str)


# --- vectors


def _vector_links(data, threshold):
    good = [(i, np.array(v, dtype=np.float64), lab) for i, v, lab in data if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, up = collections.Counter(), {i: i for i, _, _ in data if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and i != j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (links[i], root(i)) for i in up}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 64))
    data = [(k, (base[k % 40] + rng.normal(size=64) * rng.choice([0.0, 0.1, 0.3])).astype(np.float32).tolist(), k % 2) for k in range(400)]
    data += [(500 + k, (base[0] + rng.normal(size=64) * 0.05).astype(np.float32).tolist(), 0) for k in range(600)]  # a cell of many blocks
    data += [(2000, None, 0), (2001, [0.0] * 64, 0), (2002, [float("nan")] * 64, 0), (2003, [None] + [1.0] * 63, 0), (2004, [], 0), (2005, base[0].tolist(), None), (2006, [1.0, 2.0], 0), (None, base[0].tolist(), 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x"))
    found = {r[0]: r[1:] for r in rows(embeddings.near_vectors(df), "vec_id", "n_links", "component_id", "kept")}
    want = _vector_links([(i, None if v is None else np.array([np.nan if x is None else x for x in v], dtype=np.float32).tolist(), lab) for i, v, lab in data], 0.93)
    assert found[None] == (0, None, False)
    assert {i: r[:2] for i, r in found.items() if i is not None} == want
    assert all(r[2] == (i == r[1]) for i, r in found.items() if i is not None)
    assert rows(embeddings.near_vectors(df.where("false")), "vec_id") == []


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x = embeddings.unit(rng.normal(size=(2000, 64)))
    y = rng.normal(size=(2000, 64))
    y = embeddings.unit(y - (y * x).sum(axis=1)[:, None] * x)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y
    kx, ky = (embeddings.cell_keys(v, np.zeros(2000)) for v in (x, y))
    met = ((kx[:, :, :1] == ky) | (ky[:, :, :1] == kx)).any(axis=(1, 2))
    assert met.mean() > 0.98


def test_nearest_lattice_point():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)) * 2
    p = embeddings.nearest_e8(x)
    steps = embeddings.minimal_vectors() / 2
    assert len(steps) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    best = ((x - p) ** 2).sum(axis=1)
    assert all((((x - p - s) ** 2).sum(axis=1) >= best - 1e-9).all() for s in steps)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5, 5), (None, 7)]
    found = dict(rows(components(spark.createDataFrame(chain, "u long, v long")), "id", "component_id"))
    assert found == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(50)}
    assert rows(components(spark.createDataFrame([], "u long, v long")), "id") == []


# --- licenses


def _base_license(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base_equals_brute_force(spark, odd, none):
    texts = ["MIT License and the\nGNU General-Public license", "mit licenses", "Apache License, Version 2.0. apache license apache license", "émit license", "under the MIT Mit License"]
    more = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), odd, more):
        found = licenses.scan_licenses(df)
        got = rows(found, "n_words", "n_base", "first_word", "last_word", "base_labels")
        assert sorted(got, key=str) == sorted((_base_license(r[0]) for r in rows(df, "text")), key=str)
        for base, labels, score in rows(found, "base_labels", "labels", "score"):
            assert set(filter(None, base.split(","))) <= set(labels.split(",")) and 0 <= score <= 1
            assert labels == ",".join(sorted(set(filter(None, labels.split(",")))))
    assert rows(licenses.scan_licenses(none), "doc_id") == []


def test_license_rules_and_suppression():
    assert len(licenses.rules()) > 300
    assert licenses.scan("Licensed under the Apache License, Version 2.0.").labels == "apache,apache-2.0"
    assert licenses.scan("This work is licensed under the GNU General Public License, version 3.").labels == "gpl,gpl-3.0"
    assert licenses.scan("Licensed under CC BY-NC 4.0.").labels == "cc-by-nc-4.0"
    assert licenses.scan("SPDX-License-Identifier: BSD-3-Clause").labels == "bsd-3-clause"
    assert licenses.scan("the license of a driver under water").labels == ""
    assert licenses.scan(None) == licenses.scan("")


NOTICES = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#   http://www.apache.org/licenses/LICENSE-2.0',
    "apache-1.1": "This product includes software developed by the Apache Software Foundation (http://www.apache.org/).",
    "gpl-2.0-or-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-or-later": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1-or-later": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "fdl": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-4-clause": "3. All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License)",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "cddl-1.0": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "zlib": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "postgresql": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted",
    "artistic-1.0-perl": "you can redistribute it and/or modify it under the same terms as Perl itself",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "cc0-1.0": "the author has waived all copyright and related or neighboring rights to this work",
    "openssl": "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit",
    "odbl-1.0": "made available under the Open Database License",
}


def test_license_notices_are_detected():
    for label, notice in NOTICES.items():
        assert label in licenses.scan(f"Some words before. {notice}, and after.").labels.split(","), label
    assert len(licenses.SIGNATURES) > 150 and all(r.keywords for r in licenses.rules())
    names = {label for label, *_ in licenses.SIGNATURES}
    assert len(names) > 80


def test_suppression_equals_a_loop_over_pairs():
    rng = np.random.default_rng(20)
    rule = licenses.rules()[0]
    for _ in range(2000):
        hits = [(int(a), int(a + n), rule) for a, n in zip(rng.integers(0, 30, size=12), rng.integers(1, 12, size=12), strict=True)]
        want = []
        for a, b, _ in hits:
            if not any(x <= a and b <= y for x, y in want):
                want.append((a, b))
        assert [h[:2] for h in licenses._standing(hits)] == want


def test_license_scan_of_ten_megabytes_takes_linear_time():
    began = time.time()
    found = licenses.scan("licensed under the MIT license; all rights reserved, and so on. " * 160_000)
    assert time.time() - began < 60 and found.n_base == 160_000 and found.spans[-1][1:] == (11 * 159_999 + 5, 11 * 159_999 + 8)


# --- repeated passages


def _repeats(data, length=50):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in data if i is not None}
    where = collections.defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - length + 1):
            where[tuple(w[k : k + length])].add(i)
    out = {}
    for i, w in words.items():
        hit = np.zeros(len(w), dtype=bool)
        for k in range(len(w) - length + 1):
            if len(where[tuple(w[k : k + length])]) > 1:
                hit[k : k + length] = True
        if hit.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).view(np.int8)))
            out[i] = ",".join(f"{a}:{b}" for a, b in zip(edge[::2], edge[1::2], strict=True))
    return out


def test_passages_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    new = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, size=n))
    exact, under, long_ = new(50), new(49), new(400)
    data = [(k, f"{new(30)} {exact} {new(40)}") for k in range(3)] + [(10 + k, f"{new(60)} {under} {new(60)}") for k in range(4)]
    data += [(20, f"{new(100)} {long_}"), (21, f"{long_} {new(10)} {long_}"), (22, new(300)), (23, new(20)), (24, None), (25, ""), (None, exact), (26, exact.upper()), (30, data[0][1]), (31, new(70)), (31, new(70))]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("seed", F.lit(1)).withColumn("id", F.lit(2))
    found = dict(rows(suffixes.passage_digest(suffixes.repeated_passages(df)), "doc_id", "spans"))
    assert found == _repeats([d for d in data if d[0] != 31])
    assert rows(suffixes.repeated_passages(df.where("false")), "doc_id") == []
    left = dict(rows(suffixes.without_repeats(df.where("doc_id in (0, 1, 2, 20, 21, 22)")), "doc_id", "text"))
    assert not _repeats(left.items()) and exact in left[0] and left[22] == data[9][1]


def test_passages_of_the_table(spark, docs):
    found = dict(rows(suffixes.passage_digest(suffixes.repeated_passages(docs)), "doc_id", "spans"))
    assert found == _repeats(rows(docs, "doc_id", "text"))


def _later(data, length=50):
    """Repeated windows that a smaller id has too, as spans."""
    words = {i: t.split() for i, t in data}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][k : k + length]), i)
    out = {}
    for i, w in words.items():
        hit = np.zeros(len(w), dtype=bool)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                hit[k : k + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).view(np.int8)))
        out[i] = ",".join(f"{a}:{b}" for a, b in zip(edge[::2], edge[1::2], strict=True))
    return out


def test_later_passages_ignore_documents_with_a_frequent_line_only(spark):
    rng = np.random.default_rng(14)
    new = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, size=n))
    line = new(45)
    passages = [f"{new(6)} {line} {new(9)}" for _ in range(4)]
    data = [(1, f"{new(30)} {line} {new(30)}")]
    for k, p in enumerate(passages):
        data += [(5 + 10 * k, f"{new(20)} {p} {new(20)}"), (9 + 10 * k, f"{new(7)} {p} {new(7)}")]
    # a passage of many documents, each with words of its own around it
    data += [(100 + k, f"{new(40)} {passages[0]} {new(40)}") for k in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = {r["doc_id"]: r["later"] for r in suffixes.passage_digest(suffixes.repeated_passages(df)).collect()}
    want = _later(data)
    assert want[5] == "" and want[9] == "7:67" and found == {i: x for i, x in want.items() if i != 1}
    left = dict(rows(suffixes.without_repeats(df), "doc_id", "text"))
    assert all(sum(p in t for t in left.values()) == 1 for p in passages)


def test_passages_whose_seed_has_many_variants(spark):
    rng = np.random.default_rng(15)
    new = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, size=n))
    place = -1
    while place != 17:  # the seed itself is selected, not one that overlaps what is before or after it
        before, seed, after = new(17), new(16), new(17)
        place = suffixes.rolled(hashed_words([f"{before} {seed} {after}".encode()])[0], suffixes.SEED).argmin()
    # hundreds share more with each of the two than the two's neighbours in any order, and under 50 words with anyone
    data = [(k, f"{new(60)} {seed} {after} {new(60)}") for k in range(2, 302)] + [(k, f"{new(60)} {before} {seed} {new(60)}") for k in range(302, 602)]
    data += [(k, f"{new(60)} {before} {seed} {after} {new(60)}") for k in (1, 900)]
    found = suffixes.passage_digest(suffixes.repeated_passages(spark.createDataFrame(data, "doc_id long, text string"))).collect()
    assert {r["doc_id"]: (r["spans"], r["later"]) for r in found} == {1: ("60:110", ""), 900: ("60:110", "60:110")}


# --- near copies


def _near(data, percent):
    sets, up = {}, {}
    for i, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        up[i] = i

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_documents_equal_brute_force(spark, percent):
    rng = np.random.default_rng(5)
    data = []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**6, size=int(rng.integers(20, 300)))]
        for _ in range(4):
            mine = list(words)
            for at in rng.integers(0, len(mine), size=int(rng.integers(0, 3))):
                mine[at] = f"x{rng.integers(0, 10**6)}"
            data.append((len(data), " ".join(mine)))
    words = [f"h{x}" for x in rng.integers(0, 10**6, size=120)]
    for k in range(300):  # a group of several blocks
        data.append((1000 + k, " ".join(words[: k % 7] + [f"y{k}"] + words[k % 7 :])))
    data += [(5000, None), (5001, ""), (5002, "A b"), (5003, "a  B"), (5004, "a b c")]
    df = spark.createDataFrame([*data, (None, "a b")], "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("id", F.lit("x"))
    found = {r[0]: r[1:] for r in rows(minhash.near_documents(df, percent), "doc_id", "n_shingles", "component_id", "kept")}
    assert found.pop(None) == (1, None, False)
    assert {i: r[:2] for i, r in found.items()} == _near(data, percent)
    assert all(r[2] == (i == r[1]) for i, r in found.items())


def test_near_documents_edges(odd, none):
    assert len(rows(minhash.near_documents(odd), "doc_id")) == len(ODD)
    assert rows(minhash.near_documents(none), "doc_id") == []
    assert len(rows(minhash.without_near_copies(odd), "doc_id")) == len(ODD)
    assert minhash.without_near_copies(odd).columns == odd.columns


# --- quality


def test_quality_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score_quality(docs).join(labels, "doc_id")
    good = rows(found.select((F.col("keep") == (F.col("quality") == 1)).cast("int").alias("ok")), "ok")
    assert np.mean(good) > 0.95


def test_quality_edges(odd, none):
    found = rows(quality.score_quality(odd), "doc_id", "posterior", "score", "keep")
    assert len(found) == len(ODD) and all(0 <= r[1] <= 1 and 0 <= r[2] <= 1 and r[3] == (r[2] >= 0.5) for r in found)
    assert rows(quality.score_quality(none), "doc_id") == []


def test_expectation_maximisation_equals_plain_loops():
    rng = np.random.default_rng(31)
    m = len(quality.LABELLERS)
    patterns = {int(sum(rng.choice([quality.BAD, quality.GOOD, quality.GOOD, quality.GOOD, quality.ABSTAIN]) * 3**j for j in range(m))): int(rng.integers(1, 50)) for _ in range(60)}
    vote = {c: [c // 3**j % 3 for j in range(m)] for c in patterns}
    belief = {}
    for c, v in vote.items():
        bad = [x == quality.BAD for x in v]
        kinds = [0.9 * b / max(1, sum(bad)) for b in bad]
        belief[c] = [1 - sum(kinds), *kinds]
    for _ in range(200):
        mass = [sum(n * belief[c][k] for c, n in patterns.items()) for k in range(m + 1)]
        prior = [(x + 0.5) / (sum(mass) + 0.5 * (m + 1)) for x in mass]
        share = [[[0.5 + sum(n * belief[c][k] for c, n in patterns.items() if vote[c][j] == x) for x in (0, 1)] for k in range(m + 1)] for j in range(m)]
        new = {}
        for c, v in vote.items():
            w = list(prior)
            for k in range(m + 1):
                for j in range(m):
                    if v[j] != quality.ABSTAIN:
                        w[k] *= share[j][k][v[j]] / sum(share[j][k])
            new[c] = [x / sum(w) for x in w]
        moved = max(abs(a - b) for c in patterns for a, b in zip(new[c], belief[c], strict=True))
        if moved < 1e-9:
            break
        belief = new
    codes = np.array(sorted(patterns))
    assert np.allclose(quality.fit_labels(patterns).posterior(codes), [belief[c][0] for c in codes.tolist()], atol=1e-6)


def test_quality_score_equals_plain_sums_and_reruns_agree(spark, docs):
    weights = np.random.default_rng(32).normal(size=(2 << quality.BITS) + 1)
    for text in (b"", b"One two, THREE 4!", b"a b c " * 50):
        words = hashed_words([text])[0]
        code = quality.votes(quality.facts(text, words))
        one, runs, cast = quality.features(text, words, code)
        want = weights[-1] + sum(float(weights[k]) for k in cast) + (np.mean([weights[k] for k in one]) if len(one) else 0) + (np.mean([weights[k] for k in runs]) if len(runs) else 0)
        assert quality.raw_score(weights, text, words, code) == pytest.approx(want)
    twice = docs.union(docs.withColumn("text", F.concat("text", F.lit(" again"))))
    first, second = (sorted(rows(quality.score_quality(d), "doc_id", "score"), key=str) for d in (twice, twice.repartition(5)))
    assert first == second


def test_labeller_accuracies_are_recovered():
    """Bad documents show one fault or two, and labellers seldom accuse good ones."""
    rng = np.random.default_rng(6)
    n, m = 20_000, len(quality.LABELLERS)
    truth = rng.random(n) < 0.8
    fault = rng.integers(0, m, size=(n, 2))
    codes = np.zeros(n, dtype=np.int64)
    for j in range(m):
        bad = np.where(truth, rng.random(n) < 0.01, (fault == j).any(axis=1) & (rng.random(n) < 0.95))
        codes += np.where(rng.random(n) < 0.05, quality.ABSTAIN, np.where(bad, quality.BAD, quality.GOOD)) * 3**j
    labels = quality.fit_labels(dict(collections.Counter(codes.tolist())))
    assert ((labels.posterior(codes) >= 0.5) == truth).mean() > 0.88
    assert all(a > 0.9 for a, _ in labels.accuracies().values())


# --- personal data


def _base_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p[-400:]) <= 255 and not p[:-400].strip("0") for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_equals_brute_force(spark, docs, odd, none):
    rng = np.random.default_rng(7)
    made = ["".join(rng.choice(list("a.@-1234+ ()%_9b0\n"), size=rng.integers(0, 120))) for _ in range(4000)]
    texts = [r[0] or "" for r in rows(docs, "text")] + made + ["4111 1111 1111 1111 4111-1111-1111-1111", "a@b@c.de x@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4"]
    assert all(pii.base_spans(t) == _base_pii(t) for t in texts)
    found = {r[0]: r[1:] for r in rows(pii.span_digest(docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")}
    for doc_id, text in rows(docs, "doc_id", "text"):
        base = _base_pii(text)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert found[doc_id] == (*(sum(k == kind for k, _, _ in base) for kind in pii.BASE_KINDS), hashlib.sha256(line.encode()).hexdigest())
    assert len(rows(pii.span_digest(odd), "doc_id")) == len(ODD) and rows(pii.span_digest(none), "doc_id") == []
    assert pii.redact(odd).columns == odd.columns


def test_pii_checksums_context_and_redaction():
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"] and kinds("IBAN DE88 3704 0044 0532 0130 00.") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == [] and kinds("ssn 000-45-6789") == []
    assert kinds("imei 490154203237518") == ["imei"] and kinds("490154203237518") == []
    near, far = pii.find_spans("my card: 4111111111111111")[0], pii.find_spans("4111111111111111")[0]
    assert near[3] > far[3]
    assert pii.redacted("write to a@b.org or +1 555 123 4567!") == "write to [EMAIL] or [PHONE]!"
    assert pii.find_spans("a" * 200_000 + " " + "1" * 200_000) == []


def _added_pii(t):
    """Added spans by other means: every place is tried, and overlaps are looked for one by one."""
    out, base = [], _base_pii(t)
    near = lambda a, b, cues: any(c in f"{t[max(0, a - 40) : a]} {t[b : b + 40]}".lower() for c in cues)
    at = 0
    while m := re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}").search(t, at):
        at, size = m.end(), pii.IBAN_LENGTHS.get(m[0][:2], 0)
        ends = [e for e in range(m.start(), m.end() + 1) if len(t[m.start() : e].replace(" ", "")) == size]
        code = t[m.start() : ends[0]].replace(" ", "") if size and ends else ""
        if code and not re.match("[A-Za-z0-9]", t[ends[0] : ends[0] + 1]) and int("".join(str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)) for c in code[4:] + code[:4])) % 97 == 1:
            out.append(("iban", m.start(), ends[0]))
    for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", t):
        area, group, serial = map(int, m[0].split("-"))
        if area not in (0, 666) and area < 900 and group and serial and near(m.start(), m.end(), ("ssn", "social security")):
            out.append(("ssn", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([ -]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if len(d) == 15 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0 and near(m.start(), m.end(), ("imei", "device", "handset")):
            out.append(("imei", m.start(), m.end()))
    return [s for s in out if not any(a < s[2] and s[1] < b for _, a, b in base)]


def test_added_pii_equals_brute_force():
    rng = np.random.default_rng(17)
    parts = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "123-45-6789", "666-12-3456", "imei 490154203237518", "device",
             "49-015420-323751-8", "4111 1111 1111 1111", "+1 490154203237518", "a@b.org", "1.2.3.4", "x", "9", " ", "-", "IBAN", "social security"]
    for _ in range(3000):
        t = "".join(str(rng.choice(parts)) + str(rng.choice(["", " ", ". ", "\n"])) for _ in range(int(rng.integers(1, 9))))
        assert [s[:3] for s in pii.find_spans(t) if s[0] in pii.ADDED_KINDS] == sorted(_added_pii(t), key=lambda s: (pii.KINDS.index(s[0]), s[1])), t


def test_pii_of_long_and_zero_filled_texts(spark):
    texts = ["0" * 5000 + ".1.1.1", "1.2.3." + "0" * 9000 + "4 " + "9" * 9000 + ".1.1.1", "a@b.org 123-45-6789 ssn " * 40_000, "+" + "1" * 50_000, "card 4111 1111 1111 1111, imei 490154203237518 " * 20_000]
    found = rows(pii.span_digest(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")), "doc_id", "n_email", "n_ip", "n_card", "n_phone")
    assert sorted(found) == [(0, 0, 1, 0, 0), (1, 0, 1, 0, 0), (2, 40_000, 0, 0, 0), (3, 0, 0, 0, 0), (4, 0, 0, 20_000, 0)]


# --- packing


def test_pack_whole_table(spark, docs, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    marks = spark.createDataFrame([(k, t) for k, t in enumerate(["a<|endoftext|>b", "<|EndOfText|> x", "x <|startoftext|>", "\u0130. \u0130\u0130!?", "a\x1cb \u0130c"])], "doc_id long, text string")
    for df in (docs, marks, odd):
        got = rows(packing.pack(packing.token_pieces(df, path)), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
        want = []
        for doc_id, text in rows(df, "doc_id", "text"):
            ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
            want += [(doc_id, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
        assert sorted((r[:5] for r in got), key=str) == sorted(want, key=str)
        at = collections.defaultdict(list)
        for r in got:
            at[r[5]].append((r[6], r[3]))
        for parts in at.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= 4096
    assert len(at) <= 1 + sum(r[3] for r in got) // 4096 + 1
    assert rows(packing.pack(packing.token_pieces(none, path)), "doc_id") == []


def test_ids_of_random_texts_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    rng = np.random.default_rng(18)
    pool = [chr(c) for c in range(1, 0x250)] + list(" .,!?'\n\t  aAbB") * 20 + ["\u0130"] * 20 + ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "\u03a3", "\ufb01", "e\u0301", "\u4e2d", "\u200b", "\u2028", "'s", "'LL"] * 3
    texts = ["".join(rng.choice(pool, size=rng.integers(0, 30))) for _ in range(4000)]
    for k in range(0, len(texts), 200):
        for t, ids in zip(texts[k : k + 200], encoder.texts(texts[k : k + 200]), strict=True):
            assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_alike_pieces_are_dealt_to_many_ranges(spark):
    alike = spark.createDataFrame([(None, 0, 0, 1, 7)] * 3000 + [(5, 0, 0, 4096, 8)] * 3, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    found = rows(packing.pack(alike), "length", "sequence_id", "offset")
    assert len(found) == len(set(found)) == 3003 and sorted(r[2] for r in found if r[0] == 1) == list(range(3000)) and len({r[1] for r in found}) == 4


def test_configurations_use_fewer_sequences_than_best_fit():
    rng = np.random.default_rng(19)
    for low, high, gain in ((1300, 1500, 0.05), (1025, 2400, 0.03), (1025, 4096, 0.0), (1, 4096, 0.0)):
        counts = dict(collections.Counter(rng.integers(low, high, size=20_000).tolist()))
        best, fit = packing.Plan.best(counts), packing.Plan(counts, configured=False)
        assert best.sequences <= (1 - gain) * fit.sequences
        taken, filled = collections.Counter(), collections.defaultdict(list)
        for length, _, n, seq, offset in best.slots:
            taken[length] += n
            for k in range(n):
                filled[seq + k].append((offset, length))
        assert taken == counts and len(filled) == best.sequences
        for parts in filled.values():
            ends = [0, *(a + n for a, n in sorted(parts))]
            assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(8)
    sizes = np.minimum(4096, rng.lognormal(6.5, 1.1, size=30_000).astype(int) + 1)
    counts = dict(collections.Counter(sizes.tolist()))
    plan = packing.Plan.best(counts)
    used = collections.Counter()
    for length, _, count, _, _ in plan.slots:
        used[length] += count
    assert used == counts
    assert plan.sequences <= 1.01 * sizes.sum() / 4096 + 1
    big = packing.Plan.best({k: v * 10**6 for k, v in counts.items()})
    assert len(big.slots) < 200_000


# --- toxicity


def _labelled():
    rng = np.random.default_rng(9)
    plain = ["".join(rng.choice(list("theandorinstre"), size=rng.integers(2, 9))) for _ in range(3000)]
    insults = ["idiot", "moron", "scumbag"]
    data = []
    for k in range(900):
        words = list(rng.choice(plain, size=60))
        if bad := k % 4 == 0:
            words[int(rng.integers(0, 60))] = insults[k // 4 % 3]
        data.append((k, " ".join(words), int(bad)))
    return data


def test_toxicity_learns_and_tolerates_gaps(spark, none):
    data = _labelled()
    docs = spark.createDataFrame([d[:2] for d in data] + [(5000 + k, t) for k, t in enumerate(["the i d i o t and", "an idi-ot is", "idioot he", "the and or in", "1diot", None, ""])], "doc_id long, text string").withColumn("score", F.lit(3))
    labels = spark.createDataFrame([(d[0], d[2]) for d in data] + [(None, 1), (3, None)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    found = {r[0]: r[1:] for r in rows(toxicity.score_documents(docs, labels), "doc_id", "held_out", "score", "predicted")}
    held = [(found[k][2], bad) for k, _, bad in data if found[k][0]]
    assert len(held) > 100 and np.mean([p == b for p, b in held]) > 0.98
    assert all(found[k][0] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in found)
    assert [found[5000 + k][2] for k in range(7)] == [1, 1, 1, 0, 1, 0, 0]
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in found.values())
    assert rows(toxicity.score_documents(none, labels), "doc_id") == []


def test_toxicity_without_toxic_labels(spark, odd):
    labels = spark.createDataFrame([(4, 0)], "doc_id long, toxic int")
    found = rows(toxicity.score_documents(odd, labels), "predicted")
    assert len(found) == len(ODD) and {r[0] for r in found} == {0}
