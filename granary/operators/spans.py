"""Gold spans: where snippets stand, which chunks hold them, and what stands beside a hit."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap(a_start, a_stop, b_start, b_stop):
    return F.greatest(F.lit(0), F.least(a_stop, b_stop) - F.greatest(a_start, b_start))


def judged_chunks(gold: DataFrame, chunks: DataFrame, least: float = 0.5) -> DataFrame:
    """(qid, chunk_id, grade): chunks that hold at least ``least`` of a gold span of their document; the best grade counts."""
    g = gold.select("qid", "document_id", F.col("char_start").alias("a"), F.col("char_end").alias("b"), "grade")
    met = chunks.join(g, "document_id").where("char_start < b and a < char_end")
    covered = overlap(F.col("a"), F.col("b"), F.col("char_start"), F.col("char_end")) / F.greatest(F.lit(1), F.col("b") - F.col("a"))
    return met.where(covered >= least).groupBy("qid", "chunk_id").agg(F.max("grade").alias("grade"))


#: Snippets that every task may hold.
FEW = 100_000
#: Words of the run by which a snippet is looked up.
RUN = 4


def holders(snippets: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, document_id, snippet): the documents that hold a snippet (qid, snippet), white space around it aside.

    A snippet's first and last word may be parts of a document's; the words between are whole in it. A run of RUN of these names
    the snippet by a hash, as it does every place of a document, and what the hashes join is confirmed by a string search. Few
    snippets are held by every task, so that documents are read once and not shuffled; more are joined by shuffling hashes.
    Snippets of fewer words are looked for as they are, against all documents. Null and blank snippets are held by none.
    """
    white = r"[ \t\n\r]+"
    clean = F.btrim(F.col("snippet"), F.lit(" \t\n\r"))
    asked = snippets.select("qid", "snippet", clean.alias("__clean"), F.split(clean, white).alias("__w")).where("__clean <> ''")
    run = lambda words, at: F.xxhash64(*[words[at + k] for k in range(RUN)])
    long_ = asked.where(F.size("__w") >= RUN + 2).withColumn("__run", run(F.col("__w"), 1))
    short = asked.where(F.size("__w") < RUN + 2)
    hold = F.broadcast if snippets.limit(FEW + 1).count() <= FEW else (lambda x: x)
    words = documents.select("document_id", "text", F.split("text", white).alias("__d"))
    places = F.explode(F.sequence(F.lit(0), F.size("__d") - RUN))
    hashed = words.where(F.size("__d") >= RUN).select("document_id", "__d", places.alias("__at")).select("document_id", run(F.col("__d"), F.col("__at")).alias("__run"))
    met = hashed.join(hold(long_), "__run").select("qid", "document_id", "snippet", "__clean").distinct()
    sure = met.join(documents.select("document_id", "text"), "document_id").where(F.contains("text", F.col("__clean")))
    rest = documents.join(hold(short), F.contains("text", F.col("__clean")))
    return sure.select("qid", "document_id", "snippet").union(rest.select("qid", "document_id", "snippet")).distinct()


def located(snippets: DataFrame, documents: DataFrame, least: float = 0.8) -> DataFrame:
    """``snippets`` (document_id, snippet) with char_start and char_end in the document; null where nothing is close enough.

    Exact places come from a string search. For the misses alone the longest run of characters that the two share is looked up
    in Python; it lines the snippet up with the text, and the text beneath the snippet is taken where it is similar enough.
    """
    clean = F.btrim(F.col("snippet"), F.lit(" \t\n\r"))
    both = snippets.join(documents.select("document_id", F.col("text").alias("__text")), "document_id", "left")
    exact = both.withColumn("__at", F.when(F.length(clean) > 0, F.instr(F.col("__text"), clean)))
    missed = F.col("__at") == 0
    near = exact.withColumn("__run", F.pandas_udf(_runs, "struct<at:int,inside:int,size:int>")(F.when(missed, F.col("__text")), F.when(missed, clean)))
    lined_up = F.col("__run.at") - F.col("__run.inside")
    start = F.greatest(F.lit(0), lined_up)
    stop = F.least(F.length("__text"), F.greatest(F.col("__run.at") + F.col("__run.size"), lined_up + F.length(clean)))
    near = near.withColumn("__start", start).withColumn("__stop", stop)
    beneath = F.substring(F.col("__text"), F.col("__start") + 1, F.col("__stop") - F.col("__start"))
    alike = F.pandas_udf(_similarity, "double")(F.when(F.col("__run.size") > 0, beneath), clean) >= least
    out = near.withColumn("char_start", F.when(F.col("__at") > 0, F.col("__at") - 1).when(alike, F.col("__start")))
    out = out.withColumn("char_end", F.when(F.col("__at") > 0, F.col("__at") - 1 + F.length(clean)).when(F.col("char_start").isNotNull(), F.col("__stop")))
    return out.drop("__text", "__at", "__run", "__start", "__stop")


def _similarity(texts: pd.Series, snippets: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or s is None else SequenceMatcher(None, t, s, autojunk=False).ratio() for t, s in zip(texts, snippets, strict=True)], dtype="Float64")


def _runs(texts: pd.Series, snippets: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if not t or not s else longest_run(t, s) for t, s in zip(texts, snippets, strict=True)]
    return pd.DataFrame(rows, columns=["at", "inside", "size"], dtype="Int32")


def longest_run(text: str, snippet: str) -> tuple[int, int, int]:
    """(place in the text, place in the snippet, length) of the longest run of characters in both, the first of the text's, then of the snippet's.

    Whether runs of a length are shared falls with the length, so it is found by halving; hashes of all runs of a length are
    differences of prefix sums. Hashes that agree are confirmed on the characters.
    """
    a, b = (_prefix_sums(x) for x in (text, snippet))
    low, high = 0, min(len(text), len(snippet))
    best = (0, 0, 0)
    while low < high:
        size = (low + high + 1) // 2
        if found := _shared(text, snippet, a, b, size):
            low, best = size, (*found, size)
        else:
            high = size - 1
    return best


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _prefix_sums(text: str) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    power = np.full(len(points), _BASE, dtype=np.uint64)
    power[:1] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(points * (points + _BASE) * power, out=sums[1:])
    return sums, power


def _shared(text: str, snippet: str, a: tuple, b: tuple, size: int) -> tuple[int, int] | None:
    """The first places of a run of ``size`` characters that both have."""
    (sums_a, power), (sums_b, _) = a, b
    # a run's sum carries the power of its place: multiplying by the power that is missing makes places alike
    top = max(len(text), len(snippet)) - size
    full = power if len(power) > top else b[1]
    lift = full[: top + 1][::-1]
    here = (sums_a[size:] - sums_a[:-size]) * lift[: len(text) - size + 1]
    there = (sums_b[size:] - sums_b[:-size]) * lift[: len(snippet) - size + 1]
    for at in np.flatnonzero(np.isin(here, there)).tolist():
        inside = snippet.find(text[at : at + size])
        if inside >= 0:
            return at, inside
    return None


def with_neighbours(hits: DataFrame, leaves: DataFrame, window: int = 200) -> DataFrame:
    """Hits on leaves with the end of the chunk before and the start of the chunk after in their content. Others stay as they are."""
    if window <= 0:
        return hits
    key = F.regexp_extract("chunk_id", r"^(.+):(\d+)$", 1)
    place = F.regexp_extract("chunk_id", r"^(.+):(\d+)$", 2)
    leaf = (F.coalesce(F.col("level"), F.lit(0)) == 0) & (place != "")
    named = hits.withColumn("__d", F.when(leaf, key)).withColumn("__i", F.when(leaf, place.cast("int")))
    beside = leaves.select(F.col("document_id").alias("__d"), F.col("chunk_index").alias("__j"), F.col("content").alias("__c"))
    before = beside.select("__d", (F.col("__j") + 1).alias("__i"), F.expr(f"right(__c, {window})").alias("__b"))
    after = beside.select("__d", (F.col("__j") - 1).alias("__i"), F.expr(f"left(__c, {window})").alias("__a"))
    out = named.join(before, ["__d", "__i"], "left").join(after, ["__d", "__i"], "left")
    return out.withColumn("content", F.concat_ws(" ", "__b", "content", "__a")).drop("__d", "__i", "__b", "__a")
