"""Comparing pipelines: rankings and answers by configuration, routers from forced runs, and effects that last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions import models
from granary.functions.text import numbered
from granary.operators import metrics, search, stats


def by_config(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(config, qid, ndcg, recall, success, rr) of runs (config, qid, chunk_id, score); a query that a config lacks scores 0."""
    configs = runs.select("config").distinct()
    grid = F.concat_ws("\u0001", "config", "qid")
    named = qrels.select("qid", "chunk_id", "grade").crossJoin(configs).select(grid.alias("qid"), "chunk_id", "grade")
    scored = metrics.ranking_metrics(runs.select(grid.alias("qid"), "chunk_id", "score"), named, k)
    parts = F.split("qid", "\u0001")
    return scored.withColumn("config", parts[0]).withColumn("qid", parts[1]).select("config", "qid", "ndcg", "recall", "success", "rr")


def answers(hits: DataFrame, questions: DataFrame, generate=models.generate, contexts: int = 5) -> DataFrame:
    """(qid, predicted, gold) from the best ``contexts`` hits of each question (qid, query, gold); without any the answer is empty."""
    top = search.ranked(hits, contexts).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("t"))
    prompt = F.concat(numbered(F.transform("t", lambda x: x["content"])), F.lit("\n\nQuestion: "), F.col("query"))
    joined = questions.join(top, "qid", "left")
    return joined.select("qid", F.when(F.col("t").isNull(), "").otherwise(generate("Answer from the passages.", prompt)).alias("predicted"), "gold")


def routers(decisions: DataFrame, forced: DataFrame) -> DataFrame:
    """(router, mean, best_fixed) from decisions (router, qid, strategy) and forced scores (strategy, qid, value); the oracle is a router too."""
    score = forced.select("qid", F.when(F.col("strategy") == "hyde", "dphf").otherwise(F.col("strategy")).alias("strategy"), "value")
    routed = decisions.select("router", "qid", F.when(F.col("strategy") == "hyde", "dphf").otherwise(F.col("strategy")).alias("strategy"))
    fixed = score.select(F.concat(F.lit("always-"), "strategy").alias("router"), "qid", "strategy")
    oracle = score.groupBy("qid").agg(F.max_by("strategy", F.struct("value", "strategy")).alias("strategy")).select(F.lit("oracle").alias("router"), "qid", "strategy")
    every = routed.union(fixed).union(oracle).join(score, ["qid", "strategy"], "left")
    means = every.groupBy("router").agg(F.avg(F.coalesce("value", F.lit(0.0))).alias("mean"))
    best = F.max(F.when(F.startswith("router", F.lit("always-")), F.col("mean"))).over(W.partitionBy())
    return means.withColumn("best_fixed", best)


def survival(dev: DataFrame, test: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(config, verdict) from comparisons (config, mean, p) on two splits: yes or no where the test rejects by Holm, by the sign of its
    mean; unstable where the signs of both splits differ; else not significant."""
    held = stats.holm(test, alpha, name="config").select("config", "mean", "rejected").join(dev.select("config", F.col("mean").alias("dev_mean")), "config", "left")
    sign = F.signum("mean")
    verdict = F.when(F.signum(F.coalesce("dev_mean", F.lit(0.0))) != sign, "unstable").when(F.col("rejected"), F.when(sign > 0, "yes").otherwise("no")).otherwise("not significant")
    return held.select("config", verdict.alias("verdict"))
