"""Audit of published success claims: every pair within a task, by intervals and exact tests on the counts alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.expressions import newcombe, wilson
from spindrift.functions.special import fisher_udf


def claim_rates(claims: DataFrame, alpha: float = 0.05) -> DataFrame:
    w = wilson("successes", "trials", alpha)
    return claims.select("policy", "task", "successes", "trials", w["estimate"].alias("rate"), w["lower"].alias("lower"), w["upper"].alias("upper"))


def claim_pairs(claims: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Each unordered pair of claims of one task, in input order: difference, bounds, exact p, resolved.

    claims has policy, task, successes, trials, pos; the join is an equi-join on
    the task, whose claims are few.
    """
    a = claims.select("task", *[F.col(c).alias(f"{c}_a") for c in ("policy", "successes", "trials", "pos")])
    b = claims.select(F.col("task").alias("task_b"), *[F.col(c).alias(f"{c}_b") for c in ("policy", "successes", "trials", "pos")])
    both = a.join(b, (F.col("task") == F.col("task_b")) & (F.col("pos_a") < F.col("pos_b")))
    d = newcombe("successes_a", "trials_a", "successes_b", "trials_b", alpha)
    both = both.select("task", "policy_a", "policy_b", "successes_a", "trials_a", "successes_b", "trials_b", d["estimate"].alias("estimate"), d["lower"].alias("lower"), d["upper"].alias("upper"))
    p = fisher_udf()("successes_a", F.col("trials_a") - F.col("successes_a"), "successes_b", F.col("trials_b") - F.col("successes_b"))
    return both.withColumn("resolved", (F.col("lower") > 0) | (F.col("upper") < 0)).withColumn("p_value", p)
