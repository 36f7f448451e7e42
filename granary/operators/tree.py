"""Summary hierarchies over node tables, and retrieval from them.

Nodes: chunk_id, document_id, chunk_index, content, embedding, level, child_ids (and any other column of the store).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import membership_hash
from granary.functions.vectors import cosine
from granary.operators.lineage import cut
from granary.operators.search import best_occurrences, knn, ranked, within_budget

CORPUS = "__corpus__"


def reduced(points: np.ndarray, dims: int) -> np.ndarray:
    """Principal components of unit vectors, at most ``dims`` and two fewer than points (stands for a neighbour embedding)."""
    unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    centred = unit - unit.mean(axis=0)
    keep = max(2, min(dims, len(points) - 2))
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
    return (u * s * sign)[:, :keep]


def mixture(points: np.ndarray, k: int, covariance: str, seed: int, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Responsibilities and Bayesian information criterion of a Gaussian mixture by expectation-maximisation."""
    n, d = points.shape
    rng = np.random.default_rng(seed)
    centres = points[[int(rng.integers(n))]]
    while len(centres) < k:
        gap = ((points[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, points[int(rng.choice(n, p=gap / gap.sum())) if gap.sum() > 0 else int(rng.integers(n))]])
    resp = np.eye(k)[((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)]
    last = -np.inf
    for _ in range(rounds):
        mass = resp.sum(axis=0) + 1e-10
        means, log = (resp.T @ points) / mass[:, None], np.empty((n, k))
        tied = np.zeros((d, d))
        shapes = []
        for c in range(k):
            off = points - means[c]
            cov = (resp[:, c, None] * off).T @ off / mass[c]
            tied += cov * mass[c] / n
            shapes.append(np.diag(np.diag(cov)) if covariance == "diag" else np.eye(d) * np.trace(cov) / d if covariance == "spherical" else cov)
        for c in range(k):
            cov = (tied if covariance == "tied" else shapes[c]) + 1e-6 * np.eye(d)
            low = np.linalg.cholesky(cov)
            z = np.linalg.solve(low, (points - means[c]).T)
            log[:, c] = np.log(mass[c] / n) - 0.5 * (z**2).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * d * math.log(2 * math.pi)
        top = log.max(axis=1, keepdims=True)
        each = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        resp, total = np.exp(log - each[:, None]), float(each.sum())
        if abs(total - last) < 1e-6 * n:
            break
        last = total
    free = {"full": k * d * (d + 1) / 2, "tied": d * (d + 1) / 2, "diag": k * d, "spherical": k}[covariance] + k * d + k - 1
    return resp, -2 * total + free * math.log(n)


def soft_clusters(points: np.ndarray, most: int, covariance: str, threshold: float, seed: int) -> list[list[int]]:
    """Soft clusters of the mixture of least criterion, the search ending after three sizes without a gain."""
    best, least, worse = None, math.inf, 0
    for k in range(1, max(1, min(most, len(points) - 1)) + 1):
        resp, bic = mixture(points, k, covariance, seed)
        if bic < least:
            best, least, worse = resp, bic, 0
        else:
            worse += 1
            if worse == 3:
                break
    cut = max(threshold, 1 / best.shape[1] + 1e-6) if best.shape[1] > 1 else 0.0
    member = best >= cut
    member[np.arange(len(best)), best.argmax(axis=1)] |= ~member.any(axis=1)
    return [np.flatnonzero(member[:, c]).tolist() for c in range(best.shape[1]) if member[:, c].any()]


def clusters(points: np.ndarray, *, dims: int = 10, most: int = 50, covariance: str = "full", threshold: float = 0.1, least: int = 4, refine: int = 64, seed: int = 42) -> list[list[int]]:
    """Clusters in two stages: of all points, then anew inside clusters that are still large. Few points are one cluster."""
    if len(points) < max(least, dims + 2):
        return [list(range(len(points)))] if len(points) else []
    out = []
    for group in soft_clusters(reduced(points, dims), most, covariance, threshold, seed):
        if len(group) > max(dims + 2, refine):
            inner = soft_clusters(reduced(points[group], dims), most, covariance, threshold, seed)
            out += [[group[i] for i in c] for c in inner]
        else:
            out.append(group)
    return out


def clustered(nodes: DataFrame, by: str = "document_id", **options) -> DataFrame:
    """(by, cluster, chunk_id): each group of nodes clustered in a task of its own."""
    seed = options.get("seed", 42)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chunk_index", "chunk_id"])
        found = clusters(np.array(pdf["embedding"].tolist(), dtype=np.float64), **(options | {"seed": seed}))
        rows = [(pdf[by].iloc[0], c, pdf["chunk_id"].iloc[i]) for c, members in enumerate(found) for i in members]
        return pd.DataFrame(rows, columns=[by, "cluster", "chunk_id"])

    return nodes.select(by, "chunk_id", "chunk_index", "embedding").groupBy(by).applyInPandas(run, f"{by} string, cluster int, chunk_id string")


def hierarchy(leaves: DataFrame, summarize: Callable, embed: Callable, max_levels: int = 3, min_nodes: int = 4, **options) -> DataFrame:
    """Leaves and the summary nodes over them, level by level and document by document.

    A document's climb ends at ``max_levels``, under ``min_nodes`` nodes or at a single cluster. ``summarize(array of texts)`` and
    ``embed(text)`` are column functions. A summary's id is document:Llevel:number.
    """
    base = leaves.select("chunk_id", "document_id", "chunk_index", "content", "embedding", F.lit(0).alias("level"), F.array().cast("array<string>").alias("child_ids"))
    every = at = base
    for level in range(1, max_levels + 1):
        size = at.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_nodes)
        found = clustered(at.join(size.select("document_id"), "document_id", "left_semi"), least=min_nodes, **options)
        several = found.groupBy("document_id").agg(F.max("cluster").alias("top")).where("top > 0").select("document_id")
        members = found.join(several, "document_id", "left_semi").join(at.select("chunk_id", "chunk_index", "content"), "chunk_id")
        gathered = members.groupBy("document_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "content"))).alias("m"))
        text = summarize(F.transform("m", lambda x: x["content"]))
        made = gathered.select(
            F.concat_ws(":", "document_id", F.lit(f"L{level}"), "cluster").alias("chunk_id"), "document_id", F.col("cluster").alias("chunk_index"), text.alias("content"),
            F.lit(level).alias("level"), F.transform("m", lambda x: x["chunk_id"]).alias("child_ids"),
        )
        at = cut(made.withColumn("embedding", embed(F.col("content"))).select(*base.columns))
        if at.isEmpty():
            break
        every = every.unionByName(at)
    return every


def top_nodes(nodes: DataFrame) -> DataFrame:
    """Each document's nodes of its highest level."""
    high = F.max("level").over(W.partitionBy("document_id"))
    return nodes.withColumn("__h", high).where("level = __h").drop("__h")


def corpus_tier(nodes: DataFrame, summarize: Callable, embed: Callable, existing: DataFrame | None = None, **options) -> DataFrame:
    """Summary nodes over the documents' top nodes; none with under two documents or four nodes.

    A cluster is named by its members. One that ``existing`` nodes hold isn't summarized again: its node is given back as it is.
    """
    top = top_nodes(nodes.where(~F.startswith("chunk_id", F.lit(CORPUS))))
    sizes = top.agg(F.count_distinct("document_id").alias("docs"), F.count(F.lit(1)).alias("n"), F.max("level").alias("level")).first()
    if sizes["docs"] < 2 or sizes["n"] < 4:
        return nodes.where(F.lit(False))
    found = clustered(top.withColumn("chunk_index", F.lit(0)).withColumn("corpus", F.lit("corpus")), by="corpus", **options)
    gathered = found.join(top.select("chunk_id", "content"), "chunk_id").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))).alias("m"))
    ids = F.transform("m", lambda x: x["chunk_id"])
    named = gathered.select(F.concat(F.lit(CORPUS + ":"), membership_hash(ids)).alias("chunk_id"), F.col("cluster").alias("chunk_index"), ids.alias("child_ids"), F.transform("m", lambda x: x["content"]).alias("texts"))
    every = named
    if existing is not None:
        named = named.join(existing.select("chunk_id"), "chunk_id", "left_anti")
    made = named.withColumn("content", summarize(F.col("texts"))).withColumn("embedding", embed(F.col("content")))
    out = made.select("chunk_id", F.lit(CORPUS).alias("document_id"), "chunk_index", "content", "embedding", F.lit(sizes["level"] + 1).cast("int").alias("level"), "child_ids")
    return out if existing is None else out.unionByName(existing.select(*out.columns).join(every.select("chunk_id"), "chunk_id", "left_semi"))


def _described(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    return hits.join(nodes.select("chunk_id", "document_id", "content", "child_ids", *(["level"] if "level" not in hits.columns else [])), "chunk_id")


def collapsed(nodes: DataFrame, queries: DataFrame, k: int, budget: int = 2000, fetch: int = 7, metric: str = "l2") -> DataFrame:
    """Hits of all levels together, each level's best first, within a token budget."""
    near = knn(nodes, queries, max(3 * k, fetch), keys=("level",), metric=metric).drop("rank")
    return within_budget(best_occurrences(_described(near, nodes)), budget, F.col("content")).drop("used")


def traversed(nodes: DataFrame, queries: DataFrame, k: int, budget: int = 2000, fetch: int = 7, max_levels: int = 3, metric: str = "l2") -> DataFrame:
    """Hits on the way down: the best of the top level, then the best children of these, to the leaves.

    Where nothing has children, the level below is searched whole. Without summaries the leaves are searched.
    """
    start = nodes.where(F.col("level") <= max_levels + 1).agg(F.max("level")).first()[0] or 0
    if start == 0:
        near = _described(knn(nodes.where("level = 0"), queries, 3 * k, metric=metric).drop("rank"), nodes)
        return within_budget(best_occurrences(near), budget, F.col("content")).drop("used")
    vectors = nodes.select("chunk_id", "embedding", "level", "document_id", "content", "child_ids")
    frontier = _described(knn(nodes.where(F.col("level") == start), queries, fetch, metric=metric), nodes).select("qid", "chunk_id", "score", "level", "document_id", "content", "child_ids")
    frontier = cut(frontier)
    out = frontier
    for level in range(start, 0, -1):
        children = frontier.select("qid", F.explode("child_ids").alias("chunk_id"))
        below = children.join(vectors, "chunk_id").join(queries.select("qid", F.col("embedding").alias("q")), "qid")
        scored = below.withColumn("score", (cosine(F.col("embedding"), F.col("q")) + 1) / 2).drop("q", "embedding")
        ranked_ = ranked(scored, fetch)
        childless = queries.select("qid", "embedding").join(children.select("qid").distinct(), "qid", "left_anti")
        flat = _described(knn(nodes.where(F.col("level") == level - 1), childless, fetch, metric=metric), nodes)
        columns = ("qid", "chunk_id", "score", "level", "document_id", "content", "child_ids")
        frontier = cut(ranked_.select(*columns).unionByName(flat.select(*columns)))
        out = out.unionByName(frontier)
    return within_budget(best_occurrences(out), budget, F.col("content")).drop("used")
