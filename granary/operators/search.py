"""Batched vector search, fusion of hit lists and budget cuts. Queries are rows: every operator is keyed by qid."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.vectors import relevance, squared_l2

#: Query vectors that every task may hold; more are searched by slices of the query set, each against all leaves.
QUERY_BLOCK = 4096


def ranked(hits: DataFrame, k: int | None = None, score: str = "score", keys: tuple[str, ...] = ("qid",), ties: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """``hits`` with ``rank`` from 1 by score descending, then ids; the first ``k`` if given."""
    order = W.partitionBy(*keys).orderBy(F.desc(score), *[F.asc(t) for t in ties])
    out = hits.withColumn("rank", F.row_number().over(order).cast("long"))
    return out.where(F.col("rank") <= k) if k is not None else out


def knn(nodes: DataFrame, queries: DataFrame, k: int, keys: tuple[str, ...] = (), metric: str = "l2", exclude_self: bool = False) -> DataFrame:
    """(qid, [keys], chunk_id, distance, score, rank): the exact ``k`` nearest nodes of each query.

    ``nodes`` has chunk_id, embedding and ``keys`` (searched apart, like levels or documents); ``queries`` has qid and embedding.
    The query set is small beside the nodes: it is collected as matrices of at most QUERY_BLOCK rows, each node partition
    keeps its own best k of each query by one matrix product a batch, and only these meet in the window that ranks them. So
    nodes are scanned once a block and never shuffled. Distances are recomputed in doubles for all that the product can't tell
    from the k-th, and equal ones are ordered by id before any is dropped.
    """
    wanted = queries.select("qid", "embedding").where("embedding is not null")
    return _by_blocks(wanted, lambda block: _knn_block(nodes, block, k, keys, metric, exclude_self))


def _by_blocks(queries: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results of a search by slices of about QUERY_BLOCK queries."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    split = queries.withColumn("__block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    out, *rest = [search(split.where(F.col("__block") == b).drop("__block")) for b in range(blocks)]
    for p in rest:
        out = out.unionByName(p)
    return out


def _knn_block(nodes: DataFrame, queries: DataFrame, k: int, keys: tuple[str, ...], metric: str, exclude_self: bool) -> DataFrame:
    spark = nodes.sparkSession
    held = queries.toPandas()
    qids = held["qid"].astype(str).tolist()
    matrix = np.array(held["embedding"].tolist(), dtype=np.float64) if len(held) else np.empty((0, 1))
    table = spark.sparkContext.broadcast((qids, matrix, (matrix**2).sum(axis=1)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.select(*keys).schema) if keys else ""
    schema = f"qid string, chunk_id string{', ' + fields if fields else ''}, distance double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q, square = table.value
        best: dict[tuple, list[tuple[float, str]]] = {}
        for pdf in batches:
            pdf = pdf[pdf["embedding"].notna()]
            if not len(pdf) or not len(names):
                continue
            groups = pdf.groupby(list(keys), sort=False, dropna=False) if keys else [((), pdf)]
            for key, part in groups:
                x = np.array(part["embedding"].tolist(), dtype=np.float64)
                ids = part["chunk_id"].to_numpy()
                norm = (x**2).sum(axis=1)
                rough = square[:, None] - 2 * q @ x.T + norm
                take = min(len(ids), k + exclude_self)
                # all that may be as near as the last taken, but for rounding: ties are decided by distance and id below
                margin = 8 * (x.shape[1] + 4) * np.finfo(np.float64).eps * (square + np.nanmax(norm, initial=0.0))
                cut = np.partition(rough, take - 1, axis=1)[:, take - 1] + margin
                place = np.empty(len(ids), dtype=np.int64)
                place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
                for row, name in enumerate(names):
                    near = np.flatnonzero(~(rough[row] > cut[row]))
                    exact = ((q[row] - x[near]) ** 2).sum(axis=1)
                    exact = np.sqrt(exact) if metric == "l2" else exact
                    first = np.lexsort((place[near], exact))[:take]
                    slot = best.setdefault((name, key), [])
                    slot += [(d, c) for d, c in zip(exact[first].tolist(), ids[near[first]].tolist(), strict=True) if not (exclude_self and c == name)]
                    if len(slot) > 4 * k + 64:
                        slot.sort()
                        del slot[k:]
        rows = [(name, c, *(key if isinstance(key, tuple) else (key,)), d) for (name, key), slot in best.items() for d, c in sorted(slot)[:k]]
        yield pd.DataFrame(rows, columns=["qid", "chunk_id", *keys, "distance"])

    near = nodes.select("chunk_id", *keys, "embedding").mapInPandas(run, schema)
    out = near.withColumn("score", relevance(F.col("distance")))
    order = W.partitionBy("qid", *keys).orderBy("distance", "chunk_id")
    return out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def knn_sql(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The same search as a join: for few nodes, and to check the other one."""
    pairs = F.broadcast(queries.select("qid", F.col("embedding").alias("q"))).join(nodes.select("chunk_id", "embedding"), F.lit(True))
    scored = pairs.select("qid", "chunk_id", F.sqrt(squared_l2(F.col("q"), F.col("embedding"))).alias("distance"))
    return ranked(scored.withColumn("score", relevance(F.col("distance"))), k)


def most_overlap(texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, score, rank): of all texts the ``k`` of highest ``overlap_score`` of each query, ties by id.

    ``texts`` has chunk_id and text, ``queries`` qid and query. The query set is held by tasks like that of ``knn``, as lists of
    the queries that have a word. A text's words are looked up there once, which counts the words it shares with every query, and
    each task keeps its own best k of a query, also those that share nothing. So texts are read once a block and never shuffled.
    Texts or queries that are null have a null score, which comes last.
    """
    return _by_blocks(queries.select("qid", "query"), lambda block: _overlap_block(texts, block, k))


def _overlap_block(texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    # words are cut from lower-case bytes, where white space is that of the expression
    as_bytes = lambda c: F.lower(c).cast("binary")
    held = [(r["qid"], None if r["q"] is None else set(bytes(r["q"]).split())) for r in queries.select("qid", as_bytes(F.col("query")).alias("q")).collect()]
    having: dict[bytes, list[int]] = {}
    for i, (_, words) in enumerate(held):
        for w in words or ():
            having.setdefault(w, []).append(i)
    table = texts.sparkSession.sparkContext.broadcast(([(q, None if w is None else len(w)) for q, w in held], {w: np.array(i, dtype=np.int32) for w, i in having.items()}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, by_word = table.value
        unknown = np.array([n is None for _, n in names], dtype=bool)
        best: list[list[tuple[int, str]]] = [[] for _ in names]
        for pdf in batches:
            if not len(pdf) or not names:
                continue
            shared = np.zeros((len(names), len(pdf)), dtype=np.int64)
            for j, text in enumerate(pdf["text"]):
                if text is None:
                    shared[:, j] = -1
                elif found := by_word.keys() & set(text.split()):
                    shared[:, j] = np.bincount(np.concatenate([by_word[w] for w in found]), minlength=len(names))
            shared[unknown] = -1
            ids = pdf["chunk_id"].to_numpy()
            # one number for the order by count and id: none are equal, so the cut is exact
            place = np.empty(len(ids), dtype=np.int64)
            place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
            order = place - shared * len(ids)
            near = np.argpartition(order, k - 1, axis=1)[:, :k] if k < len(ids) else np.tile(np.arange(len(ids)), (len(names), 1))
            for row, slot in enumerate(best):
                slot += zip((-shared[row, near[row]]).tolist(), ids[near[row]].tolist(), strict=True)
                slot.sort()
                del slot[k:]
        rows = [(name, c, None if less > 0 else -less / (n + 1e-9)) for (name, n), slot in zip(names, best, strict=True) for less, c in slot]
        yield pd.DataFrame(rows, columns=["qid", "chunk_id", "score"]).astype({"score": "Float64"})

    near = texts.select("chunk_id", as_bytes(F.col("text")).alias("text")).mapInPandas(run, "qid string, chunk_id string, score double")
    return ranked(near, k)


def merged(hits: DataFrame) -> DataFrame:
    """Union of paths by id: the first path's row wins, then all by score. ``hits`` has qid, path, rank, chunk_id, score."""
    first = W.partitionBy("qid", "chunk_id").orderBy("path", "rank")
    kept = hits.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "rank")
    return ranked(kept)


def reciprocal_ranks(hits: DataFrame, k: int = 60) -> DataFrame:
    """(qid, chunk_id, score, rank): the sum of 1 / (k + rank) over all lists and all occurrences. Ranks count from 1."""
    summed = hits.groupBy("qid", "chunk_id").agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))).alias("score"))
    return ranked(summed)


def best_occurrences(hits: DataFrame) -> DataFrame:
    """Of each chunk its best-scored row."""
    one = W.partitionBy("qid", "chunk_id").orderBy(F.desc("score"), "level" if "level" in hits.columns else "chunk_id")
    return ranked(hits.withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n", *[c for c in ("rank",) if c in hits.columns]))


def within_budget(hits: DataFrame, budget: int, text: Column) -> DataFrame:
    """Rows in score order while the running cost, a quarter of the characters and at least 1, stays within the budget; the first row always.

    Costs are positive, so running sums grow and the first row above the budget ends the list.
    """
    cost = F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")
    order = W.partitionBy("qid").orderBy(F.desc("score"), "chunk_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = hits.withColumn("used", F.sum(cost).over(order)).withColumn("__n", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")))
    return out.where((F.col("used") <= budget) | (F.col("__n") == 1)).drop("__n")


def min_max(score: str = "score") -> Column:
    """A score scaled to 0..1 within its query; 0 where all are equal."""
    low, high = F.min(score).over(W.partitionBy("qid")), F.max(score).over(W.partitionBy("qid"))
    return F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(0.0)
