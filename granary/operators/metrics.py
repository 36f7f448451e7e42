"""Ranking and answer metrics over runs (qid, chunk_id, score) and judgements (qid, chunk_id, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import exact_match, token_f1


def graded(run: DataFrame, qrels: DataFrame, ties: str = "desc") -> DataFrame:
    """The run of judged queries with rank (score descending, then id, descending by custom) and grade, 0 where unjudged."""
    by_id = F.desc("chunk_id") if ties == "desc" else F.asc("chunk_id")
    judged = run.join(qrels.select("qid").distinct(), "qid", "left_semi")
    order = W.partitionBy("qid").orderBy(F.desc("score"), by_id)
    return judged.withColumn("rank", F.row_number().over(order)).join(qrels, ["qid", "chunk_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def ranking_metrics(run: DataFrame, qrels: DataFrame, k: int = 10, ties: str = "desc") -> DataFrame:
    """(qid, ndcg, recall, success, rr) at ``k`` for every query with a relevant judgement; 0 where the run has nothing."""
    top = graded(run, qrels, ties).where(F.col("rank") <= k)
    gain = F.col("grade") / F.log2(F.col("rank") + 1.0)
    got = top.groupBy("qid").agg(F.sum(gain).alias("dcg"), F.sum((F.col("grade") > 0).cast("long")).alias("hits"), F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"))
    ideal_rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("grade"), "chunk_id"))
    best = qrels.where("grade > 0").withColumn("r", ideal_rank)
    ideal = best.groupBy("qid").agg(F.sum(F.when(F.col("r") <= k, F.col("grade") / F.log2(F.col("r") + 1.0)).otherwise(0.0)).alias("idcg"), F.count(F.lit(1)).alias("relevant"))
    out = ideal.join(got, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "qid", zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(F.col("hits") / F.col("relevant")).alias("recall"),
        zero((F.col("hits") > 0).cast("double")).alias("success"), zero(1.0 / F.col("first")).alias("rr"),
    )


def aggregated(per_query: DataFrame, *keys: str) -> DataFrame:
    metrics = [c for c in per_query.columns if c not in ("qid", *keys)]
    return per_query.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n"))


def recall_curve(run: DataFrame, qrels: DataFrame, depth: int = 30, ties: str = "desc") -> DataFrame:
    """(k, recall) for 1..depth, averaged over judged queries; a short list keeps its last value."""
    relevant = qrels.where("grade > 0").groupBy("qid").agg(F.count(F.lit(1)).alias("relevant"))
    hits = graded(run, qrels, ties).where((F.col("grade") > 0) & (F.col("rank") <= depth)).select("qid", F.col("rank").alias("at"))
    grid = relevant.select("qid", "relevant", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("k"))
    found = grid.join(hits, (grid["qid"] == hits["qid"]) & (hits["at"] <= grid["k"]), "left").groupBy(grid["qid"], "relevant", "k").agg(F.count("at").alias("n"))
    return found.groupBy("k").agg(F.avg(F.col("n") / F.col("relevant")).alias("recall"))


def answer_scores(answers: DataFrame) -> DataFrame:
    """(qid, em, f1) from (qid, predicted, gold array): the best over gold answers; null predictions are empty."""
    one = answers.select("qid", F.coalesce("predicted", F.lit("")).alias("p"), F.explode_outer("gold").alias("g"))
    return one.groupBy("qid").agg(F.max(F.coalesce(exact_match(F.col("p"), F.col("g")), F.lit(0.0))).alias("em"), F.max(F.coalesce(token_f1(F.col("p"), F.col("g")), F.lit(0.0))).alias("f1"))
