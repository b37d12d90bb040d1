"""Finite-sample conformal thresholds: exact order statistics, never approximate quantiles."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_of(n, alpha: float) -> Column:
    """ceil((n + 1)(1 - alpha)) in the same floating-point steps as numpy takes."""
    return F.ceil((n + 1) * F.lit(1.0 - alpha)).cast("long")


def ranked_value(df: DataFrame, keys: list[str], value: str, rank: Column, name: str = "value") -> DataFrame:
    """Per group n and the rank-th smallest value (null beyond n).

    Ranks come from counts of distinct values, so ties collapse before the window
    and no group is collected into an array.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__c"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("__upto", F.sum("__c").over(upto)).withColumn("n", F.sum("__c").over(Window.partitionBy(*keys)))
    return run.groupBy(*keys, "n").agg(F.min(F.when(F.col("__upto") >= rank, F.col(value))).alias(name), F.max(value).alias("largest"))


def guard_quantile(df: DataFrame, keys: list[str], value: str, alpha: float) -> DataFrame:
    """threshold, saturated, achievable_alpha: beyond the last rank the largest value stands and says so."""
    got = ranked_value(df, keys, value, rank_of(F.col("n"), alpha))
    beyond = rank_of(F.col("n"), alpha) > F.col("n")
    return got.select(*keys, "n", F.when(beyond, F.col("largest")).otherwise(F.col("value")).alias("threshold"), beyond.alias("saturated"), F.when(beyond, 1 / (F.col("n") + 1)).otherwise(alpha).alias("achievable_alpha"))


def judge_quantile(df: DataFrame, keys: list[str], value: str, alpha: float) -> DataFrame:
    """threshold: beyond the last rank the largest possible nonconformity, 1."""
    got = ranked_value(df, keys, value, F.greatest(F.lit(1), rank_of(F.col("n"), alpha)))
    return got.select(*keys, "n", F.coalesce("value", F.lit(1.0)).alias("threshold"))


def bin_edges(horizon: int, bins: int) -> list[int]:
    """Equal bins of steps, edges rounded half to even."""
    edges = [round(horizon * k / bins) for k in range(bins + 1)]
    edges[-1] = max(edges[-1], horizon)
    return edges


def bin_of(step: Column, edges: list[int]) -> Column:
    """The bin of a step; beyond the horizon the last one."""
    inside = sum((F.when(step >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
    return F.greatest(F.lit(0), F.least(F.lit(len(edges) - 2), inside)).cast("int")


def sequential_thresholds(scores: DataFrame, alpha: float = 0.05, method: str = "max", bins: int = 4, horizon: int | None = None) -> DataFrame:
    """(bin, from_step, threshold, saturated, achievable_alpha) over nominal trajectories (episode_id, step, score).

    'max' bounds the chance that an episode ever alarms by one threshold on the
    largest score of each; 'bonferroni' splits alpha over bins of steps, and a bin
    without steps repeats the threshold before it.
    """
    if method == "max":
        top = scores.groupBy("episode_id").agg(F.max("score").alias("top"))
        return guard_quantile(top, [], "top", alpha).select(F.lit(0).alias("bin"), F.lit(0).alias("from_step"), "threshold", "saturated", "achievable_alpha")
    if horizon is None:
        horizon = scores.groupBy("episode_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    edges = bin_edges(horizon, bins)
    top = scores.where(F.col("step") < edges[-1]).groupBy("episode_id", bin_of(F.col("step"), edges).alias("bin")).agg(F.max("score").alias("top"))
    found = guard_quantile(top, ["bin"], "top", alpha / bins)
    all_bins = scores.sparkSession.createDataFrame([(b, edges[b]) for b in range(bins)], "bin int, from_step int")
    joined = all_bins.join(found, "bin", "left")
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    held = F.coalesce(F.last("threshold", ignorenulls=True).over(before), F.lit(float("inf")))
    return joined.select("bin", "from_step", held.alias("threshold"), F.coalesce("saturated", F.lit(False)).alias("saturated"), F.coalesce("achievable_alpha", F.lit(alpha / bins)).alias("achievable_alpha"))


def with_threshold(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds the threshold that holds at each step; thresholds has a row per bin, a handful, so the join is a lookup."""
    edges = [(r.from_step, r.threshold) for r in thresholds.orderBy("from_step").collect()]
    held = F.lit(edges[0][1])
    for start, value in edges[1:]:
        held = F.when(F.col("step") >= start, F.lit(value)).otherwise(held)
    return scores.withColumn("threshold", held)


def alarms(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(episode_id, alarmed): whether any score lies above the threshold of its step."""
    return with_threshold(scores, thresholds).groupBy("episode_id").agg(F.bool_or(F.col("score") > F.col("threshold")).alias("alarmed"))


def contrast(nominal: DataFrame, benign: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Thresholds from nominal episodes alone and with benign ones, the benign alarm fraction under each, and the shift."""
    alone, joint = sequential_thresholds(nominal, alpha), sequential_thresholds(nominal.unionByName(benign), alpha)
    rate = lambda t, name: alarms(benign, t).agg(F.avg(F.col("alarmed").cast("double")).alias(name))
    both = alone.select(F.col("threshold").alias("nominal_threshold")).crossJoin(joint.select(F.col("threshold").alias("union_threshold")))
    both = both.crossJoin(rate(alone, "benign_alarms_nominal")).crossJoin(rate(joint, "benign_alarms_union"))  # one row each
    shift = F.col("union_threshold") - F.col("nominal_threshold")
    return both.withColumn("shift", shift).withColumn("shift_share", shift / F.greatest(F.abs("nominal_threshold"), F.lit(1e-12)))


def class_thresholds(scored: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """t_fail and t_succ per group of (score, y): the two classes' own quantiles, in one pass over both."""
    nonconformity = F.when(F.col("y") == 1, 1 - F.col("score")).otherwise(F.col("score"))
    found = judge_quantile(scored.withColumn("nc", nonconformity), [*keys, "y"], "nc", alpha)
    one = lambda y: F.max(F.when(F.col("y") == y, F.col("threshold")))
    return found.groupBy(*keys).agg(F.coalesce(one(0), F.lit(1.0)).alias("t_fail"), (1 - F.coalesce(one(1), F.lit(1.0))).alias("t_succ"))


def calibrate(scored: DataFrame, target: float = 0.05, least_per_class: int = 5, shrink: float = 0.8, rounds: int = 60) -> DataFrame:
    """t_fail, t_succ, alpha_used, selective_error: the first alpha of the shrinking grid whose error among decided rows meets the target.

    All alphas are judged at once: distinct scores are counted per class, each
    alpha's two order statistics are looked up, and its errors are summed over
    the counts - no loop over jobs.  The grid is a fixed, small table.
    """
    grid, a = [], target
    for k in range(rounds):
        grid.append((k, a))
        if a < 1e-4:
            break
        a *= shrink
    spark = scored.sparkSession
    counts = scored.groupBy("score", "y").agg(F.count("*").alias("c"))
    nc = F.when(F.col("y") == 1, 1 - F.col("score")).otherwise(F.col("score"))
    upto = Window.partitionBy("y").orderBy("nc").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("nc", nc).withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy("y")))
    alphas = F.broadcast(spark.createDataFrame(grid, "k int, alpha double"))  # 60 rows at most
    rank = F.greatest(F.lit(1), F.ceil((F.col("n") + 1) * (1 - F.col("alpha"))).cast("long"))
    cuts = ranked.crossJoin(alphas).groupBy("k", "alpha", "y").agg(F.min(F.when(F.col("upto") >= rank, F.col("nc"))).alias("q"), F.max("n").alias("n"))
    one = lambda y, c: F.max(F.when(F.col("y") == y, c))
    cuts = cuts.groupBy("k", "alpha").agg(
        F.coalesce(one(0, F.col("q")), F.lit(1.0)).alias("t_fail"), (1 - F.coalesce(one(1, F.col("q")), F.lit(1.0))).alias("t_succ"), one(0, F.col("n")).alias("n_failure"), one(1, F.col("n")).alias("n_success")
    )
    from spindrift.functions.expressions import abstain_decision

    judged = counts.crossJoin(F.broadcast(cuts)).withColumn("d", abstain_decision("score", "t_fail", "t_succ"))
    wrong = ((F.col("d") == "success") & (F.col("y") == 0)) | ((F.col("d") == "failure") & (F.col("y") == 1))
    errors = judged.groupBy("k", "alpha", "t_fail", "t_succ", "n_failure", "n_success").agg(
        F.sum(F.when(F.col("d") != "abstain", F.col("c")).otherwise(0)).alias("n_decided"), F.sum(F.when(wrong, F.col("c")).otherwise(0)).alias("n_errors")
    )
    error = F.when(F.col("n_decided") > 0, F.col("n_errors") / F.col("n_decided")).otherwise(0.0)
    stop = (error <= target) | (F.col("alpha") < 1e-4) | (F.col("k") == len(grid) - 1)
    enough = (F.col("n_failure") >= least_per_class) & (F.col("n_success") >= least_per_class)
    picked = errors.withColumn("selective_error", error).where(stop & enough).orderBy("k").limit(1)
    return picked.select("t_fail", "t_succ", F.col("alpha").alias("alpha_used"), "selective_error", "n_decided", "n_errors", "n_success", "n_failure")


def calibrate_by_task(scored: DataFrame, target: float = 0.05, least: int = 30, least_per_class: int = 5) -> DataFrame:
    """(task, t_fail, t_succ, alpha_used): each task with enough rows has its own thresholds, '__default__' those of all rows.

    Tasks are calibrated side by side, each on the counts of its distinct scores.
    """
    import numpy as np
    import pandas as pd

    counts = scored.groupBy("task", "score", "y").agg(F.count("*").alias("c"))
    every = counts.groupBy("score", "y").agg(F.sum("c").alias("c")).select(F.lit("__default__").alias("task"), "score", "y", "c")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        s, y, c = pdf["score"].to_numpy(float), pdf["y"].to_numpy(int), pdf["c"].to_numpy(int)
        n1, n0 = int(c[y == 1].sum()), int(c[y == 0].sum())
        name = pdf["task"].iloc[0]
        if min(n0, n1) < least_per_class or (name != "__default__" and n0 + n1 < least):
            return pd.DataFrame([], columns=["task", "t_fail", "t_succ", "alpha_used"])

        def quantile(v, w, n, alpha):
            order = np.argsort(v, kind="stable")
            rank = int(math.ceil((n + 1) * (1 - alpha)))
            return 1.0 if rank > n else float(v[order][np.searchsorted(np.cumsum(w[order]), max(rank, 1))])

        alpha = target
        for _ in range(60):
            f, t = quantile(s[y == 0], c[y == 0], n0, alpha), 1 - quantile(1 - s[y == 1], c[y == 1], n1, alpha)
            up, down = s >= t, s <= f
            says = np.where(up & ~down, 1, np.where(down & ~up, 0, np.where(up & down, -1, (s >= 0.5 * (f + t)).astype(int))))
            decided = c[says >= 0].sum()
            error = c[(says >= 0) & (says != y)].sum() / decided if decided else 0.0
            if error <= target or alpha < 1e-4:
                break
            alpha *= 0.8
        return pd.DataFrame([(name, f, t, alpha)], columns=["task", "t_fail", "t_succ", "alpha_used"])

    return counts.unionByName(every).groupBy("task").applyInPandas(fit, "task string, t_fail double, t_succ double, alpha_used double")


def lookup_thresholds(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds t_fail and t_succ of the row's task, or of '__default__' where the task has none."""
    own = thresholds.where("task <> '__default__'").select(F.col("task").alias("__t"), F.col("t_fail").alias("__f"), F.col("t_succ").alias("__s"))
    base = thresholds.where("task = '__default__'").select(F.col("t_fail").alias("__bf"), F.col("t_succ").alias("__bs"))
    joined = scored.join(own, F.col("task") == F.col("__t"), "left").join(F.broadcast(base), F.lit(True), "left")  # the default is one row
    return joined.select(*scored.columns, F.coalesce("__f", "__bf").alias("t_fail"), F.coalesce("__s", "__bs").alias("t_succ"))


def exact_rank(n: int, alpha: float) -> int:
    """The rank in exact arithmetic, for tests of the floating-point one."""
    return math.ceil((n + 1) * (1 - Fraction(alpha)))
