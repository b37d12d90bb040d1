"""Evaluated against deployed configuration: a fail-closed comparison of long (field, value) manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.expressions import is_unknown

# The fields that are compared, by what a difference means.
FATAL = [
    "policy.weights_sha256", "action.normalization.stats_sha256", "action.normalization.type", "action.space", "action.mode", "action.dim", "action.chunk_size",
    "action.n_action_steps", "action.control_hz", "action.gripper_convention", "observation.normalization.stats_sha256", "observation.preprocessing_sha256",
    "observation.state_dim", "embodiment.robot",
]
WARN = ["runtime.dtype", "runtime.export_format", "runtime.device", "runtime.inference_hz", "embodiment.unit_id", "embodiment.controller", "embodiment.controller_hz", "observation.image_resize", "action.units"]
INFO = ["policy.name", "policy.family", "runtime.framework_version"]


def rules(spark: SparkSession) -> DataFrame:
    """(field, severity): the 26 fields of the contract."""
    return spark.createDataFrame([(f, s) for s, names in (("fatal", FATAL), ("warn", WARN), ("info", INFO)) for f in names], "field string, severity string")


def check(evaluated: DataFrame, deployed: DataFrame, rule_table: DataFrame, allow_unknown: bool = False, ignore: list[str] = (), keys: list[str] = ()) -> DataFrame:
    """(keys, field, evaluated, deployed, finding) for every rule; the manifests are (keys, field, value).

    An unknown value fails a fatal field unless allow_unknown (then it warns), and
    is information on any other.  Fields without a rule are not compared.
    """
    keys = list(keys)
    both = evaluated.select(*keys, "field", F.col("value").alias("evaluated")).join(deployed.select(*keys, "field", F.col("value").alias("deployed")), [*keys, "field"], "full")
    grid = both.select(*keys).distinct().join(F.broadcast(rule_table.where(~F.col("field").isin(list(ignore)))), F.lit(True)) if keys else rule_table.where(~F.col("field").isin(list(ignore)))
    j = grid.join(both, [*keys, "field"], "left")
    unknown = is_unknown("evaluated") | is_unknown("deployed")
    fatal = F.col("severity") == "fatal"
    finding = F.when(unknown, F.when(fatal, F.lit("warn" if allow_unknown else "fatal")).otherwise("info")).when(F.col("evaluated") == F.col("deployed"), "ok").otherwise(F.col("severity"))
    return j.select(*keys, "field", "severity", "evaluated", "deployed", finding.alias("finding"))


def check_cameras(evaluated: DataFrame, deployed: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, field, finding) of (keys, name, width, height, intrinsics_sha256, extrinsics_sha256); different sets of cameras are one fatal finding."""
    keys, columns = list(keys), ("width", "height", "intrinsics_sha256", "extrinsics_sha256")
    side = lambda df, s: df.select(*keys, "name", *[F.col(c).alias(f"{s}_{c}") for c in columns], F.lit(True).alias(f"in_{s}"))
    j = side(evaluated, "a").join(side(deployed, "b"), [*keys, "name"], "full")
    differ = j.groupBy(*keys).agg(F.bool_or(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("differ")).where("differ is not null")
    sets = differ.where("differ").select(*keys, F.lit("observation.cameras").alias("field"), F.lit("fatal").alias("finding"))
    alike = differ.where("not differ")
    if keys:
        same = j.join(alike.select(*keys), keys, "left_semi")
    else:
        same = j.join(F.broadcast(alike), F.lit(True)).drop("differ")  # one row or none
    hashed = lambda c: F.when(F.col(f"a_{c}").isNull() | F.col(f"b_{c}").isNull(), "warn").when(F.col(f"a_{c}") != F.col(f"b_{c}"), "fatal")
    size = F.when((F.col("a_width") != F.col("b_width")) | (F.col("a_height") != F.col("b_height")), "warn")
    rows = F.array(*[F.struct(F.concat(F.lit("observation.cameras["), "name", F.lit(f"].{c}")).alias("field"), f.alias("finding")) for c, f in (("resolution", size), ("intrinsics_sha256", hashed("intrinsics_sha256")), ("extrinsics_sha256", hashed("extrinsics_sha256")))])
    found = same.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*").where("finding is not null")
    return sets.unionByName(found)


def verdict(findings: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Counts of findings, the worst one, and whether the contract holds."""
    n = lambda s: F.sum(F.when(F.col("finding") == s, 1).otherwise(0)).cast("long")
    got = findings.groupBy(*keys).agg(n("fatal").alias("n_fatal"), n("warn").alias("n_warn"), n("info").alias("n_info"), n("ok").alias("n_ok"))
    return got.select("*", F.when(F.col("n_fatal") > 0, "fatal").when(F.col("n_warn") > 0, "warn").when(F.col("n_info") > 0, "info").otherwise("ok").alias("worst"), (F.col("n_fatal") == 0).alias("passed"))


def mismatched_pins(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, a, b) of the environment pins that differ or stand on one side only, from (key, value)."""
    j = a.select("key", F.col("value").alias("a")).join(b.select("key", F.col("value").alias("b")), "key", "full")
    return j.where(~F.col("a").eqNullSafe(F.col("b")))


def normalisation_kind(name: Column) -> Column:
    """mean_std, min_max, quantile, identity or unknown, from the many ways configurations write it."""
    s = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]", "")
    return F.when(s.isin("meanstd", "zscore", "normal", "standard"), "mean_std").when(s.isin("minmax", "bounds"), "min_max").when(s.isin("quantile", "quantiles", "boundsq99", "q01q99"), "quantile").when(s.isin("identity", "none"), "identity").otherwise("unknown")


def policy_family(text: Column) -> Column:
    """The policy family a configuration's own words point to."""
    s = F.lower(text)
    return F.when(s.rlike("gr00t|groot"), "gr00t").when(s.rlike("openpi|pi0|paligemma"), "openpi").when(s.rlike("lerobot|act|diffusion|smolvla"), "lerobot").otherwise("custom")


def overlay(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """The manifest's (field, value) rows with those of changes put over them."""
    j = manifest.select("field", F.col("value").alias("old")).join(changes.select("field", F.col("value").alias("new"), F.lit(True).alias("over")), "field", "full")
    return j.select("field", F.when(F.col("over"), F.col("new")).otherwise(F.col("old")).alias("value"))
