"""Passages that repeat across documents, by sparse suffixes at content-selected positions and the windows around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import hashed_words, mix, slices, stage, tune, utf8

#: A passage is of so many words at least, a suffix is retained where its first SEED words are selected.
LENGTH, SEED = 50, 16
#: Windows of a record, so that a very long document has several.
RECORD = 20_000
_Q = np.uint64(0xA0761D6478BD642F)
_EMPTY = np.empty(0, dtype=np.int64)


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * _Q + words[k : k + n]
    return mix(out)


def selected(values: np.ndarray, window: int) -> np.ndarray:
    """The position of the leftmost least value of each run of ``window`` values: any equal stretch selects equal positions.

    Block-wise running minima from both ends give each window's least value in linear time.
    """
    n = len(values)
    if n < window:
        return _EMPTY
    # the place makes ties go left; 2**26 places are told apart
    place = np.arange(n, dtype=np.uint64) & np.uint64((1 << 26) - 1)
    keyed = (values >> np.uint64(26) << np.uint64(26)) | place
    blocks = -(-n // window)
    padded = np.full(blocks * window, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keyed
    grid = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(back[: n - window + 1], ahead[window - 1 : n])
    start = np.arange(n - window + 1, dtype=np.int64)
    low = (least & np.uint64((1 << 26) - 1)).astype(np.int64)
    return start + ((low - start) & ((1 << 26) - 1))


def _document_words(texts: list) -> Iterator[np.ndarray]:
    whole = [t or "" for t in texts]
    for lo, hi in slices(whole):
        words, start = hashed_words([utf8(t) for t in whole[lo:hi]])
        for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
            yield words[a:b]


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number of words and two hashes of the sequence of words; the positions selected, with their seeds."""
    for pdf in batches:
        rows = []
        for words in _document_words(pdf["text"].tolist()):
            turn = mix(words + np.arange(len(words), dtype=np.uint64) * _Q)
            seeds = rolled(words, SEED)
            at = np.unique(selected(seeds, LENGTH - SEED + 1))
            rows.append((len(words), int(turn.sum(dtype=np.uint64).astype(np.int64)), int(mix(turn).sum(dtype=np.uint64).astype(np.int64)), seeds[at].astype(np.int64), at.astype(np.int32)))
        out = pd.DataFrame(rows, columns=["n", "c1", "c2", "seeds", "places"])
        out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
        yield out


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of a document: hashes and starts of its windows of LENGTH words whose selected position is live."""
    for pdf in batches:
        for k, words in enumerate(_document_words(pdf["text"].tolist())):
            n, c1, c2 = pdf["n"].iat[k], pdf["c1"].iat[k], pdf["c2"].iat[k]
            turn = mix(words + np.arange(len(words), dtype=np.uint64) * _Q)
            if len(words) != n or int(turn.sum(dtype=np.uint64).astype(np.int64)) != c1 or int(mix(turn).sum(dtype=np.uint64).astype(np.int64)) != c2:
                continue
            seeds = rolled(words, SEED)
            live = np.zeros(len(seeds), dtype=bool)
            live[np.asarray(pdf["live"].iat[k], dtype=np.int64)] = True
            at = np.flatnonzero(live[selected(seeds, LENGTH - SEED + 1)])
            # runs of SEED words that cover the window name it
            named = np.zeros(len(at), dtype=np.uint64)
            for off in (*range(0, LENGTH - SEED, SEED), LENGTH - SEED):
                named = named * _Q + seeds[at + off]
            named = mix(named).astype(np.int64)
            rows = [(pdf["id"].iat[k], named[i : i + RECORD], at[i : i + RECORD].astype(np.int32)) for i in range(0, len(at), RECORD)]
            yield pd.DataFrame(rows, columns=["doc", "windows", "starts"])


_SPANS = "array<struct<start:long,stop:long>>"


def _merged(starts: Column) -> Column:
    """Spans of the windows that start at ``starts``, joined where they touch."""

    def run(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            at = np.unique(np.asarray(row, dtype=np.int64))
            first = np.flatnonzero(np.diff(at, prepend=-LENGTH - 1) > LENGTH)
            last = np.append(first[1:], len(at)) - 1
            out.append([{"start": a, "stop": b + LENGTH} for a, b in zip(at[first].tolist(), at[last].tolist(), strict=True)] if len(at) else [])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, _SPANS)(starts)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_repeated, spans, later): the documents that hold a passage of LENGTH words or more that another document has too.

    ``spans`` are the maximal repeated stretches in words from 0, end exclusive; ``later`` the parts of them that a document of
    a smaller id also has, which is what goes when one occurrence of each passage stays. Words are the longest runs without
    white space, A-Z lower-cased. Suffixes are retained where the hash of their first SEED words is the least in a window, so
    that every passage of LENGTH words retains one in all its occurrences. Seeds that occur in one document only go at once.
    Around the others every window of LENGTH words that retains them is named by a hash, and the least and the greatest
    document of each window decide whether it repeats, and in which documents it is later: a document that shares the seed, but
    not the window, has no say. A window retains one suffix, so there are at most as many as words, and a frequent seed or
    window is joined in parts; texts are read twice and shuffled once, to meet the places of their suffixes that are left.

    Documents of equal word sequences are one here: all of them repeat from end to end. Null, empty and shorter texts and null
    ids give no rows; rows repeated under one id are one document. Other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    signed = stage(docs.mapInPandas(_digest, "doc_id long, n long, c1 long, c2 long, seeds array<long>, places array<int>"), "sa-signed").where(F.col("n") >= LENGTH)
    classes = signed.groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("top"))
    named = stage(classes, "sa-classes")
    same = [F.col(f"s.{c}") == F.col(f"k.{c}") for c in ("n", "c1", "c2")]
    firsts = signed.alias("s").join(named.alias("k"), [*same, F.col("s.doc_id") == F.col("k.id")]).select("k.id", "s.n", "s.c1", "s.c2", "s.seeds", "s.places").dropDuplicates(["id", "c1", "c2"])
    anchors = stage(firsts.select("id", "n", "c1", "c2", F.explode(F.arrays_zip("seeds", "places")).alias("a")).select("id", "n", "c1", "c2", F.col("a.seeds").alias("seed"), F.col("a.places").alias("place")), "sa-anchors")
    often = stage(anchors.groupBy("seed").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("seed"), "sa-often")
    live = stage(anchors.join(often, "seed").groupBy("id", "n", "c1", "c2").agg(F.collect_list("place").alias("live")), "sa-live")
    texts = docs.join(live, F.col("doc_id") == F.col("id")).select("id", "n", "c1", "c2", "live", "text")
    records = stage(texts.mapInPandas(_windows, "doc long, windows array<long>, starts array<int>"), "sa-records")
    shared = stage(records.select("doc", F.explode("windows").alias("window")).groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least <> most").select("window", "least"), "sa-shared")
    each = records.select("doc", F.explode(F.arrays_zip("windows", "starts")).alias("w")).select("doc", F.col("w.windows").alias("window"), F.col("w.starts").alias("start"))
    passages = each.join(shared, "window").select("doc", "start", (F.col("doc") > F.col("least")).alias("later"))
    by_doc = passages.groupBy("doc").agg(F.collect_list("start").alias("all"), F.collect_list(F.when(F.col("later"), F.col("start"))).alias("some"))
    by_doc = stage(by_doc.select(F.col("doc").alias("id"), _merged(F.col("all")).alias("spans"), _merged(F.col("some")).alias("later")), "sa-passages")
    by_class = named.join(by_doc, "id", "left").where("id <> top or spans is not null")
    out = signed.select("doc_id", "n", "c1", "c2").distinct().alias("s").join(by_class.alias("k"), same)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("s.n").alias("stop")))
    copied = F.col("k.id") != F.col("k.top")
    none = F.array().cast(_SPANS)
    spans = F.when(copied, whole).otherwise(F.col("k.spans"))
    later = F.when(F.col("doc_id") > F.col("k.id"), whole).otherwise(F.coalesce(F.col("k.later"), none))
    out = out.select("doc_id", F.col("s.n").alias("n_words"), spans.alias("spans"), later.alias("later"))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return out.select("doc_id", "n_words", covered.alias("n_repeated"), "spans", "later")


def passage_digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_repeated, spans, later) with spans as start:stop texts, comma-joined."""
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"], x["stop"])), ",").alias(c)
    return found.select("doc_id", "n_words", "n_repeated", line("spans"), line("later"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the passages that a document of a smaller id has too; n_chars, where there is one, is counted anew."""

    def cut(texts: pd.Series, later: pd.Series) -> pd.Series:
        import re

        word = re.compile("[^ \t-\r]+")
        out = []
        for text, spans in zip(texts, later, strict=True):
            if text is None or spans is None or not len(spans):
                out.append(text)
                continue
            ends = [(m.start(), m.end()) for m in word.finditer(text)]
            kept, at = [], 0
            for s in spans:
                kept.append(text[at : ends[s["start"]][0]])
                at = ends[s["stop"] - 1][1]
            out.append("".join(kept) + text[at:])
        return pd.Series(out, dtype=object)

    spans = repeated_passages(docs).select(F.col("doc_id").alias("__id"), F.col("later").alias("__later")).dropDuplicates(["__id"])
    joined = docs.join(spans, F.col("doc_id") == F.col("__id"), "left").withColumn("text", F.pandas_udf(cut, "string")("text", "__later"))
    out = joined.select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
