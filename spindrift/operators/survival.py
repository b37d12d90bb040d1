"""Censored time to success: Kaplan-Meier, log-rank and two-sample Kolmogorov-Smirnov, without range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.special import chi2_sf1_udf


def censored_time() -> tuple[Column, Column]:
    """(time, event): a success with a time is an event; else the timeout, or else the time, censored. A zero is no time."""
    seen = lambda c: F.when(F.col(c) != 0, F.col(c))
    event = (F.col("success") == 1) & seen("time_to_success").isNotNull()
    return F.when(event, F.col("time_to_success")).otherwise(F.coalesce(seen("timeout"), seen("time_to_success"))), F.when(event, 1).otherwise(0)


def kaplan_meier(times: DataFrame, keys: list[str]) -> DataFrame:
    """time, at_risk, events, survival per group; numbers at risk are a reverse running count over distinct times."""
    counted = times.groupBy(*keys, "time").agg(F.count("*").alias("n"), F.sum("event").cast("long").alias("events"))
    later = Window.partitionBy(*keys).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    upto = Window.partitionBy(*keys).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    risk = counted.withColumn("at_risk", F.sum("n").over(later))
    stays = 1 - F.col("events") / F.col("at_risk")
    dead = F.max(F.when(stays <= 0, 1).otherwise(0)).over(upto) == 1
    alive = F.exp(F.sum(F.when(stays > 0, F.log(stays)).otherwise(0.0)).over(upto))
    return risk.select(*keys, "time", "at_risk", "events", F.when(dead, 0.0).otherwise(alive).alias("survival"))


def median_time(curve: DataFrame, keys: list[str]) -> DataFrame:
    """First time at which survival is at most one half; infinity if it never is."""
    return curve.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col("time"))), F.lit(float("inf"))).alias("median_time"))


def log_rank(times: DataFrame, keys: list[str], arm: str, a: str, b: str) -> DataFrame:
    """Chi-square statistic and p-value of arm a against b, per group."""
    own = times.where(F.col(arm).isin(a, b)).withColumn("is_a", (F.col(arm) == a).cast("int"))
    grid = own.groupBy(*keys, "time").agg(
        F.count("*").alias("m"), F.sum("is_a").alias("m_a"), F.sum("event").alias("d"), F.sum(F.col("event") * F.col("is_a")).alias("d_a")
    )
    later = Window.partitionBy(*keys).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("n", F.sum("m").over(later)).withColumn("n_a", F.sum("m_a").over(later)).where("d > 0 and n > 1")
    share = F.col("n_a") / F.col("n")
    parts = grid.groupBy(*keys).agg(
        F.sum(F.col("d_a") - F.col("d") * share).alias("gap"),
        F.sum(F.col("d") * share * (1 - share) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).alias("var"),
        F.sum("d_a").alias("events_a"),
        (F.sum("d") - F.sum("d_a")).alias("events_b"),
    )
    stat = F.when(F.col("var") > 0, F.col("gap") * F.col("gap") / F.col("var")).otherwise(0.0)
    return parts.select(*keys, stat.alias("statistic"), "events_a", "events_b").withColumn("p_value", chi2_sf1_udf("statistic"))


def ks_distance(times: DataFrame, keys: list[str], arm: str, a: str, b: str, timeout: float | None = None) -> DataFrame:
    """Largest distance of the two arms' distributions of time, failures placed at the timeout (default: the longest time), and its asymptotic p-value."""
    own = times.where(F.col(arm).isin(a, b))
    end = F.lit(timeout) if timeout is not None else F.max("time").over(Window.partitionBy(*keys))
    placed = own.withColumn("at", F.when(F.col("event") == 1, F.col("time")).otherwise(end))
    grid = placed.groupBy(*keys, "at").agg(F.sum((F.col(arm) == a).cast("int")).alias("a"), F.sum((F.col(arm) == b).cast("int")).alias("b"))
    upto, whole = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    gap = F.abs(F.sum("a").over(upto) / F.sum("a").over(whole) - F.sum("b").over(upto) / F.sum("b").over(whole))
    got = grid.withColumn("gap", gap).groupBy(*keys).agg(F.max("gap").alias("distance"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    x = F.col("distance") * F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    tail = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2 * k * k * x * x) for k in range(1, 101)), F.lit(0.0))
    return got.select(*keys, "distance", "n_a", "n_b", F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail))).alias("p_value"))
