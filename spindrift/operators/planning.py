"""Sample sizes, splits and schedules, all deterministic in a seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.special import norm_ppf


def required_trials(p_a, p_b, alpha: float = 0.05, power: float = 0.8, rho: float = 0.0) -> Column:
    """Trials per arm to tell p_b from p_a; rho is the correlation of paired outcomes."""
    a, b = F.col(p_a) if isinstance(p_a, str) else F.lit(p_a), F.col(p_b) if isinstance(p_b, str) else F.lit(p_b)
    z = (norm_ppf(1 - alpha / 2) + norm_ppf(power)) ** 2
    va, vb = a * (1 - a), b * (1 - b)
    inside = (a > 0) & (a < 1) & (b > 0) & (b < 1) & (a != b)
    return F.when(inside, F.ceil(z * (va + vb - 2 * rho * F.sqrt(va * vb)) / F.pow(b - a, 2)))


def detectable(n, p_a, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Smallest improvement over p_a that n trials per arm can show."""
    n, a = F.col(n) if isinstance(n, str) else F.lit(n), F.col(p_a) if isinstance(p_a, str) else F.lit(p_a)
    return (norm_ppf(1 - alpha / 2) + norm_ppf(power)) * F.sqrt(2 * a * (1 - a) / n)


def hash_order(key: str, seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)


def split(df: DataFrame, key: str, shares: list[tuple[str, float]], strata: list[str] = (), seed: int = 0) -> DataFrame:
    """Adds part: rows of each stratum, in the order of a seeded hash, dealt to the named shares; cuts are rounded half to even."""
    order = Window.partitionBy(*strata).orderBy(hash_order(key, seed), key)
    df = df.withColumn("__k", F.row_number().over(order)).withColumn("__n", F.count("*").over(Window.partitionBy(*strata)))
    done, part = 0.0, None
    for name, share in shares[:-1]:
        done += share
        here = F.col("__k") <= F.bround(F.col("__n") * done)
        part = F.when(here, name) if part is None else part.when(here, name)
    part = F.lit(shares[-1][0]) if part is None else part.otherwise(shares[-1][0])
    return df.withColumn("part", part).drop("__k", "__n")


def schedule(spark: SparkSession, policies: list[str], conditions: list[str], repeats: int = 1, seed: int = 0) -> DataFrame:
    """Interleaved blinded slots: (slot, block, condition, policy, label, pair_id); each block runs every policy once under one condition."""
    deal = lambda *c: F.sha2(F.concat_ws(":", F.lit(str(seed)), *c), 256)
    p = spark.createDataFrame([(x,) for x in policies], "policy string")
    p = p.withColumn("label", F.char(F.lit(64) + F.row_number().over(Window.orderBy(deal(F.lit("label"), F.col("policy"))))))
    c = spark.createDataFrame([(x,) for x in conditions], "condition string")
    grid = F.broadcast(c).join(spark.range(repeats).withColumnRenamed("id", "repeat"), F.lit(True))
    blocks = grid.withColumn("block", (F.row_number().over(Window.orderBy("repeat", deal(F.lit("block"), F.col("repeat").cast("string"), F.col("condition")))) - 1))
    blocks = blocks.withColumn("pair_id", F.substring(F.sha1(F.concat_ws("-", F.lit(str(seed)), F.col("block").cast("string"), F.col("condition")).cast("binary")), 1, 8))
    slots = blocks.join(F.broadcast(p), F.lit(True))  # policies x conditions x repeats is the schedule itself
    order = Window.orderBy("block", deal(F.lit("slot"), F.col("block").cast("string"), F.col("policy")))
    return slots.select((F.row_number().over(order) - 1).alias("slot"), "block", "condition", "policy", "label", "pair_id")


def trials_needed(p_a: float, p_b: float, alpha: float = 0.05, power: float = 0.8, rho: float = 0.0) -> int:
    """The same as a plain number."""
    if not (0 < p_a < 1 and 0 < p_b < 1) or p_a == p_b:
        raise ValueError("rates must differ and lie strictly inside (0, 1)")
    va, vb = p_a * (1 - p_a), p_b * (1 - p_b)
    return math.ceil((norm_ppf(1 - alpha / 2) + norm_ppf(power)) ** 2 * (va + vb - 2 * rho * math.sqrt(va * vb)) / (p_b - p_a) ** 2)
