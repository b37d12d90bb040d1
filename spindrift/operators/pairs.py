"""Paired comparison of two policies: pairing, intervals, bootstrap and the anytime-valid sequential test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.expressions import psi_e
from spindrift.functions.special import norm_ppf


def pair_trials(trials: DataFrame, a: str, b: str, value: str = "success", position: str = "pos") -> DataFrame:
    """(pair_id, task, a, b) of the trials that both policies ran under one pair id and task.

    Empty pair ids are left out; of several rows of one policy for a pair the last
    by position counts, found by a pre-aggregated max_by rather than a window.
    """
    usable = trials.where(F.col("policy").isin(a, b) & (F.coalesce("pair_id", F.lit("")) != ""))
    last = lambda p: F.max_by(F.when(F.col("policy") == p, F.col(value)), F.when(F.col("policy") == p, F.col(position)))
    # both sides in one aggregation: a single shuffle on the pair's key and no join
    both = usable.groupBy("pair_id", "task").agg(last(a).cast("double").alias("a"), last(b).cast("double").alias("b"), F.max(F.col("policy") == a).alias("__a"), F.max(F.col("policy") == b).alias("__b"))
    return both.where("__a and __b").select("pair_id", "task", "a", "b")


def paired_interval(pairs: DataFrame, keys: list[str] = (), alpha: float = 0.05) -> DataFrame:
    """Wald interval of mean(b - a), clamped to [-1, 1], with the counts of discordant pairs; one pair has no bounds."""
    d, z = F.col("b") - F.col("a"), norm_ppf(1 - alpha / 2)
    got = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("estimate"), F.stddev_samp(d).alias("sd"), F.sum(F.when(d > 0, 1).otherwise(0)).cast("long").alias("b_only"), F.sum(F.when(d < 0, 1).otherwise(0)).cast("long").alias("a_only"))
    half = z * F.col("sd") / F.sqrt("n")
    return got.select(
        *keys,
        "n",
        "estimate",
        F.when(F.col("n") > 1, F.greatest(F.lit(-1.0), F.col("estimate") - half)).alias("lower"),
        F.when(F.col("n") > 1, F.least(F.lit(1.0), F.col("estimate") + half)).alias("upper"),
        "a_only",
        "b_only",
    )


def bootstrap_interval(pairs: DataFrame, key: str, alpha: float = 0.05, rounds: int = 2000, seed: int = 0) -> DataFrame:
    """Percentile bootstrap of mean(b - a) per group.

    Resampling only needs how often each difference occurs, so groups are first
    reduced to counts of distinct differences; a round is then one multinomial
    draw, whatever the number of pairs.
    """
    counted = pairs.groupBy(key, (F.col("b") - F.col("a")).alias("d")).agg(F.count("*").alias("n"))
    kind = dict(pairs.dtypes)[key]

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        n, d = pdf["n"].to_numpy(), pdf["d"].to_numpy(float)
        total = int(n.sum())
        means = np.random.Generator(np.random.PCG64(seed)).multinomial(total, n / total, size=rounds) @ d / total
        low, high = np.percentile(means, [50 * alpha, 100 - 50 * alpha])
        return pd.DataFrame([(pdf[key].iloc[0], total, float(n @ d / total), float(low), float(high))], columns=[key, "n", "estimate", "lower", "upper"])

    return counted.groupBy(key).applyInPandas(draw, f"{key} {kind}, n long, estimate double, lower double, upper double")


def bootstrap_unpaired(trials: DataFrame, key: str, a: str, b: str, value: str = "success", alpha: float = 0.05, rounds: int = 2000, seed: int = 0) -> DataFrame:
    """Percentile bootstrap of mean(b) - mean(a) per group, each arm resampled on its own from its counts of distinct values."""
    counted = trials.where(F.col("policy").isin(a, b)).groupBy(key, (F.col("policy") == b).alias("is_b"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    kind = dict(trials.dtypes)[key]

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, means, centre, total = np.random.Generator(np.random.PCG64(seed)), [], [], 0
        for side in (False, True):
            own = pdf[pdf["is_b"] == side].sort_values("v")
            n, v = own["n"].to_numpy(), own["v"].to_numpy(float)
            if not n.sum():
                return pd.DataFrame([], columns=[key, "n", "estimate", "lower", "upper"])
            means.append(rng.multinomial(n.sum(), n / n.sum(), size=rounds) @ v / n.sum())
            centre.append(n @ v / n.sum())
            total += int(n.sum())
        low, high = np.percentile(means[1] - means[0], [50 * alpha, 100 - 50 * alpha])
        return pd.DataFrame([(pdf[key].iloc[0], total, float(centre[1] - centre[0]), float(low), float(high))], columns=[key, "n", "estimate", "lower", "upper"])

    return counted.groupBy(key).applyInPandas(draw, f"{key} {kind}, n long, estimate double, lower double, upper double")


def confidence_sequence(pairs: DataFrame, keys: list[str], order: list, alpha: float = 0.05, lam_cap: float = 0.5) -> DataFrame:
    """Empirical-Bernstein confidence sequence of mean(b - a), a row per pair, by two stacked prefix windows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    past, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    log_term = math.log(2 / alpha)
    df = pairs.withColumn("x", (F.col("b") - F.col("a") + 1) / 2).withColumn("t", F.row_number().over(w))
    s1, s2, n = F.coalesce(F.sum("x").over(past), F.lit(0.0)), F.coalesce(F.sum(F.col("x") * F.col("x")).over(past), F.lit(0.0)), F.col("t") - 1
    df = df.withColumn("s1", s1).withColumn("s2", s2).withColumn("mu", (0.5 + F.col("s1")) / (n + 1))
    df = df.withColumn("var", F.greatest(F.lit(1e-12), (0.25 + F.col("s2") - 2 * F.col("mu") * F.col("s1") + n * F.col("mu") * F.col("mu")) / (n + 1)))
    df = df.withColumn("lam", F.least(F.lit(lam_cap), F.sqrt(2 * log_term / (F.col("var") * F.col("t") * F.log(F.col("t") + 1)))))
    df = df.withColumn("vpsi", 4 * F.pow(F.col("x") - F.col("mu"), 2) * psi_e("lam"))
    total = F.sum("lam").over(upto)
    centre, radius = F.sum(F.col("lam") * F.col("x")).over(upto) / total, (log_term + F.sum("vpsi").over(upto)) / total
    df = df.withColumn("centre", centre).withColumn("radius", radius)
    return df.select(
        *keys,
        "t",
        "a",
        "b",
        (2 * F.col("centre") - 1).alias("estimate"),
        (2 * F.greatest(F.lit(0.0), F.col("centre") - F.col("radius")) - 1).alias("lower"),
        (2 * F.least(F.lit(1.0), F.col("centre") + F.col("radius")) - 1).alias("upper"),
    )


def sequential_test(pairs: DataFrame, keys: list[str], order: list, alpha: float = 0.05, margin: float = 0.0, min_n: int = 5, stop_early: bool = True) -> DataFrame:
    """Decision, pairs used and final interval per group.

    With stop_early the sequence ends at its first decision; without it, all pairs
    are used and the last decisive step's label stays.
    """
    trace = confidence_sequence(pairs, keys, order, alpha)
    inside = (F.col("lower") > -margin) & (F.col("upper") < margin) if margin > 0 else F.lit(False)
    label = F.when(F.col("t") >= min_n, F.when(F.col("lower") > margin, "B_better").when(F.col("upper") < -margin, "A_better").when(inside, "no_difference_within_margin"))
    trace = trace.withColumn("label", label)
    decided = F.when(F.col("label").isNotNull(), F.col("t"))
    if stop_early:
        first = F.min(decided).over(Window.partitionBy(*keys))
        trace = trace.withColumn("first", first).where(F.col("first").isNull() | (F.col("t") <= F.col("first")))
    last = lambda c: F.max_by(c, "t")
    return trace.groupBy(*keys).agg(
        F.coalesce(F.max_by("label", decided), F.lit("undecided")).alias("decision"), F.max("t").alias("n"), last("estimate").alias("estimate"), last("lower").alias("lower"), last("upper").alias("upper")
    )


def first_crossing(trace: DataFrame, keys: list[str], margin: float = 0.0, min_n: int = 5) -> DataFrame:
    """The first t at which the interval leaves [-margin, margin], and a trace thinned to about 20 rows as an array."""
    crossed = F.when((F.col("t") >= min_n) & ((F.col("lower") > margin) | (F.col("upper") < -margin)), F.col("t"))
    sized = trace.withColumn("step", F.greatest(F.lit(1), F.floor(F.max("t").over(Window.partitionBy(*keys)) / 20)))
    thin = F.when((F.col("t") - 1) % F.col("step") == 0, F.struct("t", "estimate", "lower", "upper"))
    return sized.groupBy(*keys).agg(F.min(crossed).alias("crossed_at"), F.array_sort(F.collect_list(thin)).alias("trace"))
