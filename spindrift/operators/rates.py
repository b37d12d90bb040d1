"""Rates with intervals: trials, fleets, guards and judges, each in one pass of conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions import special
from spindrift.functions.expressions import wilson
from spindrift.functions.taxonomy import MANUAL_SOURCES


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def success_rates(trials: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Per group and over all tasks: successes, trials and the Wilson interval."""
    counted = trials.groupBy(*keys).agg(F.sum(F.col("success").cast("long")).alias("successes"), F.count("success").alias("trials"))
    w = wilson("successes", "trials", alpha)
    return counted.select(*keys, "successes", "trials", w["estimate"].alias("rate"), w["lower"].alias("lower"), w["upper"].alias("upper"))


def exact_rates(trials: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Clopper-Pearson bounds of each group's rate; the beta quantiles are taken over the grouped rows only."""
    counted = trials.groupBy(*keys).agg(F.sum(F.col("success").cast("long")).alias("successes"), F.count("success").alias("trials"))
    return counted.withColumn("ci", special.interval_udf(special.clopper_pearson, alpha)("successes", "trials")).select(*keys, "successes", "trials", "ci.lower", "ci.upper")


def autonomous(interventions: Column) -> Column:
    """No intervention by teleoperation, reset or stop."""
    return ~F.coalesce(F.exists(interventions, lambda x: x["source"].isin(MANUAL_SOURCES)), F.lit(False))


def intervention_seconds(interventions: Column) -> Column:
    """Summed length of the closed interventions; an open one counts nothing."""
    length = lambda x: F.coalesce(F.greatest(F.lit(0.0), x["t_end"] - x["t_start"]), F.lit(0.0))
    return F.coalesce(F.aggregate(interventions, F.lit(0.0), lambda s, x: s + length(x)), F.lit(0.0))


def fleet_metrics(episodes: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Fleet numbers over all episodes, by policy and by unit in one pass (level: all, policy, unit).

    episodes has success (null: not judged), duration_s, policy, unit_id, interventions.
    """
    base = episodes.select(
        F.coalesce("policy", F.lit("unknown")).alias("policy"),
        F.coalesce("unit_id", F.lit("unknown")).alias("unit_id"),
        F.col("success").cast("int").alias("success"),
        F.coalesce("duration_s", F.lit(0.0)).alias("duration_s"),
        autonomous(F.col("interventions")).alias("autonomous"),
        F.coalesce(F.size("interventions"), F.lit(0)).alias("n_int"),
        intervention_seconds(F.col("interventions")).alias("int_s"),
    )
    grouped = base.groupingSets([[], ["policy"], ["unit_id"]], "policy", "unit_id").agg(
        F.grouping_id().alias("gid"),
        F.count("*").alias("n_episodes"),
        F.count("success").alias("n_judged"),
        F.coalesce(F.sum("success"), F.lit(0)).cast("long").alias("n_success"),
        _count(F.col("autonomous")).alias("n_autonomous"),
        (F.sum("duration_s") / 3600).alias("hours"),
        F.sum("n_int").cast("long").alias("n_interventions"),
        F.sum("int_s").alias("intervention_s"),
    )
    s, a, k, h = wilson("n_success", "n_judged", alpha), wilson("n_autonomous", "n_episodes", alpha), F.col("n_interventions"), F.col("hours")
    return grouped.select(
        F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "policy").otherwise("unit").alias("level"),
        F.coalesce("policy", "unit_id", F.lit("all")).alias("name"),
        "n_episodes",
        "n_judged",
        s["estimate"].alias("success_rate"),
        s["lower"].alias("success_lower"),
        s["upper"].alias("success_upper"),
        a["estimate"].alias("autonomous_rate"),
        a["lower"].alias("autonomous_lower"),
        a["upper"].alias("autonomous_upper"),
        "hours",
        "n_interventions",
        F.when(h > 0, k / h).alias("per_hour"),
        F.when(k > 0, h * 3600 / k).alias("mean_s_between"),
        F.when(h > 0, F.col("intervention_s") / (h * 3600)).alias("time_share"),
    )


def with_poisson_bounds(df: DataFrame, count: str, exposure: str, alpha: float = 0.05) -> DataFrame:
    """Adds rate_lower and rate_upper, Garwood's bounds of count per exposure, to a table of aggregates."""
    return df.withColumn("__ci", special.interval_udf(special.poisson_rate, alpha)(count, exposure)).select(*df.columns, F.col("__ci.lower").alias("rate_lower"), F.col("__ci.upper").alias("rate_upper"))


def pareto(df: DataFrame, column: str, position: str) -> DataFrame:
    """Counts of a column's values with share and rank; ties by first appearance, nulls left out."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    order = Window.orderBy(F.desc("n"), "first")
    return counted.select(column, "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"), F.row_number().over(order).alias("place"))


def guard_metrics(episodes: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: detection on failures, lead times, false alarms on nominal episodes.

    episodes has truth (true nominal, false failed, null unlabelled), detected,
    lead_time_s, duration_s, n_alert_onsets, stopped.
    """
    failed, nominal = ~F.col("truth"), F.col("truth")
    one = episodes.agg(
        F.count("*").alias("n_episodes"),
        _count(F.col("truth").isNull()).alias("n_unlabelled"),
        _count(failed).alias("n_failures"),
        _count(failed & F.col("detected")).alias("n_detected"),
        F.avg(F.when(failed & F.col("detected"), F.col("lead_time_s"))).alias("lead_mean_s"),
        F.percentile(F.when(failed & F.col("detected"), F.col("lead_time_s")), 0.5).alias("lead_median_s"),
        _count(failed & F.col("stopped")).alias("stops_on_failures"),
        _count(nominal).alias("n_nominal"),
        (F.sum(F.when(nominal, F.col("duration_s"))) / 3600).alias("nominal_hours"),
        F.coalesce(F.sum(F.when(nominal, F.col("n_alert_onsets"))), F.lit(0)).cast("long").alias("n_false_alarms"),
        _count(nominal & F.col("detected")).alias("n_nominal_alarmed"),
        _count(nominal & F.col("stopped")).alias("stops_on_nominal"),
    )
    d, f = wilson("n_detected", "n_failures", alpha), wilson("n_nominal_alarmed", "n_nominal", alpha)
    return one.select(
        "*",
        d["estimate"].alias("detection_rate"),
        d["lower"].alias("detection_lower"),
        d["upper"].alias("detection_upper"),
        F.when(F.col("nominal_hours") > 0, F.col("n_false_alarms") / F.col("nominal_hours")).alias("false_alarms_per_hour"),
        f["estimate"].alias("alarm_rate"),
        f["lower"].alias("alarm_lower"),
        f["upper"].alias("alarm_upper"),
    )


def judge_metrics(predictions: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Confusion with abstention over all predictions and by task, in one pass.

    predictions has decision (success, failure, abstain), y (1 or 0), duration_s, task.
    The false-alarm rate is over all true successes, abstained ones included.
    """
    d, y = F.col("decision"), F.col("y") == 1
    decided = d != "abstain"
    grouped = predictions.groupingSets([[], ["task"]], "task").agg(
        F.grouping_id().alias("gid"),
        F.count("*").alias("n"),
        _count(decided).alias("n_decided"),
        (F.sum("duration_s") / 3600).alias("hours"),
        _count((d == "success") & y).alias("tp"),
        _count((d == "failure") & ~y).alias("tn"),
        _count((d == "failure") & y).alias("false_alarms"),
        _count((d == "success") & ~y).alias("missed"),
        _count(y).alias("n_success"),
        _count(y & decided).alias("n_success_decided"),
        _count(~y & decided).alias("n_failure_decided"),
    )
    tpr, tnr = wilson("tp", "n_success_decided", alpha), wilson("tn", "n_failure_decided", alpha)
    fa = wilson("false_alarms", "n_success", alpha)
    per_hour = F.col("n_success") / F.col("hours")
    half = lambda part: (tpr[part] + tnr[part]) / 2
    return grouped.select(
        F.when(F.col("gid") == 1, "ALL").otherwise(F.col("task")).alias("task"),
        "n",
        "n_decided",
        (F.col("n") - F.col("n_decided")).alias("n_abstain"),
        (F.col("n_decided") / F.col("n")).alias("coverage"),
        F.when(F.col("n_decided") > 0, (F.col("tp") + F.col("tn")) / F.col("n_decided")).alias("accuracy"),
        tpr["estimate"].alias("success_recall"),
        tnr["estimate"].alias("failure_recall"),
        wilson("tn", F.col("tn") + F.col("false_alarms"), alpha)["estimate"].alias("failure_precision"),
        half("estimate").alias("balanced_accuracy"),
        half("lower").alias("balanced_lower"),
        half("upper").alias("balanced_upper"),
        F.when(F.col("n_decided") > 0, (F.col("tp") + F.col("missed") - F.col("n_success_decided")) / F.col("n_decided")).alias("success_bias"),
        "false_alarms",
        F.when(F.col("hours") > 0, F.col("false_alarms") / F.col("hours")).alias("false_alarms_per_hour"),
        F.when(F.col("hours") > 0, fa["lower"] * per_hour).alias("false_alarms_per_hour_lower"),
        F.when(F.col("hours") > 0, fa["upper"] * per_hour).alias("false_alarms_per_hour_upper"),
    )
