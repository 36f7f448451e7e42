"""Bootstrap intervals and tests of per-query scores, and corrections for many comparisons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Numbers drawn at once: the draws of a generator are the same however many are asked for at a time.
DRAWS = 4_000_000


def _resampled(values: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    step = max(1, DRAWS // max(1, len(values)))
    return np.concatenate([values[rng.integers(0, len(values), size=(min(step, resamples - k), len(values)))].mean(axis=1) for k in range(0, resamples, step)])


def bootstrap_intervals(scores: DataFrame, key: str = "config", value: str = "value", resamples: int = 10_000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """(key, mean, lo, hi, p): percentile interval of each key's mean, and the two-sided probability that the mean is 0.

    One grouped task a key: a key's values are one score a query. For paired differences give the differences as values.
    """
    tail = (1 - confidence) / 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("qid")[value].to_numpy(dtype=float)
        means = _resampled(v, resamples, seed)
        lo, hi = np.quantile(means, [tail, 1 - tail])
        p = float((np.abs(means - means.mean()) >= abs(v.mean())).mean())
        return pd.DataFrame({key: [pdf[key].iloc[0]], "mean": [v.mean()], "lo": [lo], "hi": [hi], "p": [min(1.0, max(p, 1 / resamples))]})

    return scores.select(key, "qid", value).where(F.col(value).isNotNull()).groupBy(key).applyInPandas(run, f"{key} string, mean double, lo double, hi double, p double")


def bootstrap_means(scores: DataFrame, value: str, resamples: int, seed: int) -> DataFrame:
    """(b, mean) of resamples drawn by arithmetic: index (b * 7919 + i * 104729 + seed) mod n. A join, for any number of scores."""
    n = W.partitionBy()
    numbered = scores.select(F.col(value).alias("v"), (F.row_number().over(W.orderBy("qid")) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(n).alias("n"))
    draws = numbered.select("i", "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    at = draws.select("b", F.pmod(F.col("b").cast("long") * 7919 + F.col("i") * 104729 + F.lit(seed), F.col("n")).alias("i"))
    return at.join(numbered.select("i", "v"), "i").groupBy("b").agg(F.avg("v").alias("mean"))


def paired_differences(scores: DataFrame, reference: str, key: str = "config", value: str = "value") -> DataFrame:
    """(config, qid, value): each other config's score minus the reference's, 0 where either is missing."""
    ref = scores.where(F.col(key) == reference).select("qid", F.col(value).alias("r"))
    others = scores.where(F.col(key) != reference)
    grid = ref.crossJoin(others.select(key).distinct())  # one row a configuration
    return grid.join(others, [key, "qid"], "left").select(key, "qid", (F.coalesce(value, F.lit(0.0)) - F.coalesce("r", F.lit(0.0))).alias(value))


#: Ranges of values in which running counts are taken.
RANGES = 64


def running_counts(rows: DataFrame, value: str, *counts: str) -> DataFrame:
    """``rows``, one a value, with below_<c>, the sum of each count over all smaller values, and all_<c>, over all values.

    Values are cut into RANGES ranges by quantiles; windows run inside a range, and over one row a range for what lies before
    it. So no task holds all rows. Null values go.
    """
    rows = rows.where(F.col(value).isNotNull())
    cuts = rows.agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 100 * RANGES)).first()[0] or []
    ranged = rows.withColumn("__range", F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c < F.col(value))) if cuts else F.lit(0))
    sums = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__s_{c}") for c in counts])
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # over one row a range
    ahead = sums.select("__range", *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in counts], *[F.sum(f"__s_{c}").over(W.partitionBy()).alias(f"all_{c}") for c in counts])
    inside = W.partitionBy("__range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__i_{c}") for c in counts]).join(F.broadcast(ahead), "__range")
    return out.select(*rows.columns, *[(F.col(f"__b_{c}") + F.col(f"__i_{c}")).alias(f"below_{c}") for c in counts], *[f"all_{c}" for c in counts])


def holm(p_values: DataFrame, alpha: float = 0.05, p: str = "p", name: str = "name") -> DataFrame:
    """``p_values`` with ``rejected`` by Holm's step-down: the first p above alpha / (m - place) ends it. One row a comparison.

    Limits rise with the place, so equal values fare alike, and it is enough to know how many values lie below each: all below
    the least that fails are rejected.
    """
    each = running_counts(p_values.groupBy(F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("n")), "__p", "n")
    fails = F.col("__p") > alpha / (F.col("all_n") - F.col("below_n"))
    least = each.agg(F.min(F.when(fails, F.col("__p"))).alias("__least"))
    out = p_values.crossJoin(F.broadcast(least))
    return out.withColumn("rejected", F.col(p).isNotNull() & (F.col("__least").isNull() | (F.col(p) < F.col("__least")))).drop("__least")


def benjamini_hochberg(p_values: DataFrame, q: float = 0.05, p: str = "p", name: str = "name") -> DataFrame:
    """``p_values`` with ``rejected`` by the step-up rule: all up to the largest value at or below q times the share of values up to it."""
    each = running_counts(p_values.groupBy(F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("n")), "__p", "n")
    passes = F.col("__p") <= q * (F.col("below_n") + F.col("n")) / F.col("all_n")
    last = each.agg(F.max(F.when(passes, F.col("__p"))).alias("__last"))
    out = p_values.crossJoin(F.broadcast(last))
    return out.withColumn("rejected", F.coalesce(F.col(p) <= F.col("__last"), F.lit(False))).drop("__last")


def compared(scores: DataFrame, reference: str, resamples: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(config, mean, lo, hi, p, rejected, significant) against a reference config: Holm over all and an interval without 0."""
    found = bootstrap_intervals(paired_differences(scores, reference), resamples=resamples, seed=seed)
    return holm(found, alpha, name="config").withColumn("significant", F.col("rejected") & ((F.col("lo") > 0) | (F.col("hi") < 0)))


def youden_threshold(scores: DataFrame) -> DataFrame:
    """(threshold, j): the score that parts relevant from other rows best, true minus false positive rate, from cumulative counts."""
    by = scores.groupBy("score").agg(F.sum(F.col("relevant").cast("long")).alias("pos"), F.sum((~F.col("relevant")).cast("long")).alias("neg"))
    each = running_counts(by, "score", "pos", "neg")
    j = (F.col("all_pos") - F.col("below_pos")) / F.col("all_pos") - (F.col("all_neg") - F.col("below_neg")) / F.col("all_neg")
    return each.select("score", j.alias("j")).agg(F.max_by("score", F.struct("j", "score")).alias("threshold"), F.max("j").alias("j"))


def dispersion(values: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    """(n, low, p25, median, p75, high, deviation, ratio): a signal's spread, and how far the labels explain it.

    ``ratio`` is the sum of squares between the labels' means over that within labels; near 0 the signal tells nothing of them.
    From sums by label alone. Null values and labels go; no rows give one row of nulls with n = 0.
    """
    rows = values.where(F.col(label).isNotNull() & F.col(value).isNotNull()).select(F.col(label).alias("l"), F.col(value).cast("double").alias("v"))
    per = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count(F.lit(1))).alias("within"))
    parts = per.agg(F.sum("within").alias("within"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"))
    between = F.greatest(F.lit(0.0), F.col("s2") - F.col("s1") * F.col("s1") / F.col("total"))
    ratio = parts.select((between / F.greatest(F.col("within"), F.lit(1e-9))).alias("ratio"))
    spread = rows.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), *[F.percentile("v", p).alias(n) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))], F.max("v").alias("high"), F.stddev_pop("v").alias("deviation"))
    return spread.crossJoin(F.broadcast(ratio))


def agreements(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """(router, agreement): how often each router (router, qid, strategy) decides as the truth (qid, strategy); and always its commonest."""
    known = truth.select("qid", F.col("strategy").alias("__t"))
    share = F.avg(F.coalesce(F.col("strategy") == F.col("__t"), F.lit(False)).cast("double")).alias("agreement")
    fixed = truth.groupBy("strategy").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("agreement")).select(F.lit("commonest").alias("router"), "agreement")
    routers = decisions.select("router").distinct()
    grid = routers.crossJoin(known).join(decisions, ["router", "qid"], "left")
    return grid.groupBy("router").agg(share).union(fixed)
