"""Unit and cell fingerprints: joint statistics from excitation runs, population drift detection, graded differences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from spindrift.functions.expressions import distance, grade
from spindrift.operators.conformal import guard_quantile

FIELDS = ["rmse", "lag_s", "backlash", "steady_error", "gain", "max_abs_error"]
# Fixed values: (warn, fail) of each difference, and the floors of the relative ones.
UNIT_TOLERANCE = {"rmse": (0.5, 1.5), "backlash": (0.5, 1.5), "max_abs_error": (0.5, 1.5), "lag_s": (0.02, 0.05), "steady_error": (0.005, 0.02), "gain": (0.05, 0.15)}
UNIT_FLOOR = {"rmse": 0.002, "backlash": 0.001, "max_abs_error": 0.005}
CELL_TOLERANCE = {"shift_px": (2.0, 6.0), "size_rel": (0.02, 0.05), "shift_mm": (3.0, 10.0), "rot_deg": (1.0, 3.0), "mean_luma": (15.0, 40.0), "sharpness": (0.3, 0.6), "color_balance": (0.05, 0.12), "clipping": (0.03, 0.10)}


def _slope(x: np.ndarray, dt: float) -> np.ndarray:
    return np.gradient(x, dt)


def joint_statistics(t: np.ndarray, cmd: np.ndarray, meas: np.ndarray, longest_lag: float = 0.5) -> tuple[float, ...]:
    """The six statistics of one joint's excitation run.

    The whole-sample lag of least tracking error comes first; at it, the error is
    regressed on velocity (what is left of the lag) and on its sign (half the
    backlash).  Ends that a shift or a filter may touch are left out.
    """
    dt = float(np.median(np.diff(t)))
    n, shifts = len(t), max(1, int(longest_lag / dt))
    edge = max(1, int(0.05 * n))
    keep = slice(shifts + edge, n - edge)
    lagged = lambda s: np.interp(t - s, t, cmd)
    errors = [np.mean((meas - lagged(k * dt))[keep] ** 2) for k in range(shifts + 1)]
    base = int(np.argmin(errors)) * dt
    own = lagged(base)
    v = _slope(own, dt)[keep]
    still = 0.05 * (np.abs(v).max() + 1e-12)
    design = np.stack([np.ones_like(v), v, np.where(np.abs(v) > still, np.sign(v), 0.0)], axis=1)
    _, per_speed, per_sign = np.linalg.lstsq(design, (meas - own)[keep], rcond=None)[0]
    lag = max(0.0, base - float(per_speed))
    c, m = lagged(lag)[keep], meas[keep]
    err, vc, vm = m - c, _slope(c, dt), _slope(m, dt)
    slow = np.abs(vc) < 0.05 * (np.abs(vc).max() + 1e-12)
    steady = err[slow].mean() if slow.sum() >= 3 else err.mean()
    fast = np.abs(vc) > 1e-9
    gain = vc[fast] @ vm[fast] / (vc[fast] @ vc[fast] + 1e-12) if fast.sum() > 3 else 1.0
    return float(np.sqrt((err**2).mean())), lag, 2 * abs(float(per_sign)), float(steady), float(gain), float(np.abs(err).max())


def unit_fingerprint(excitation: DataFrame) -> DataFrame:
    """(unit_id, joint, rmse, lag_s, backlash, steady_error, gain, max_abs_error) of (unit_id, joint, t, cmd, meas)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        got = joint_statistics(*(pdf[c].to_numpy(float) for c in ("t", "cmd", "meas")))
        return pd.DataFrame([(str(pdf["unit_id"].iloc[0]), str(pdf["joint"].iloc[0]), *got)], columns=["unit_id", "joint", *FIELDS])

    return excitation.groupBy("unit_id", "joint").applyInPandas(run, "unit_id string, joint string, " + ", ".join(f"{f} double" for f in FIELDS))


def velocity(excitation: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds v: central differences over the median time step, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy("t")
    df = excitation.withColumn("__g", F.lead("t").over(w) - F.col("t"))
    dt = df.groupBy(*keys).agg(F.percentile("__g", 0.5).alias("dt"))
    df = df.join(dt, list(keys))
    after, before = F.lead(value).over(w), F.lag(value).over(w)
    v = F.coalesce((after - before) / (2 * F.col("dt")), (after - F.col(value)) / F.col("dt"), (F.col(value) - before) / F.col("dt"))
    return df.withColumn("v", v).drop("__g")


def long_fields(fingerprints: DataFrame) -> DataFrame:
    """(unit_id, stat, value): every joint's every statistic as a row."""
    entries = F.array(*[F.struct(F.concat_ws(".", "joint", F.lit(f)).alias("stat"), F.col(f).cast("double").alias("value")) for f in FIELDS])
    return fingerprints.select("unit_id", F.explode(entries).alias("e")).select("unit_id", "e.stat", "e.value")


def drift_model(long: DataFrame) -> DataFrame:
    """(stat, center, scale) of nominal fingerprints: median and scaled MAD, floored by a thousandth of the deviation."""
    centre = long.groupBy("stat").agg(F.percentile("value", 0.5).alias("center"), F.stddev_pop("value").alias("sd"))
    j = long.join(centre, "stat")
    return j.groupBy("stat", "center").agg(F.greatest(F.percentile(F.abs(F.col("value") - F.col("center")), 0.5) * 1.4826, F.max("sd") * 1e-3, F.lit(1e-12)).alias("scale"))


def drift_scores(long: DataFrame, model: DataFrame) -> DataFrame:
    """(unit_id, score, worst): the largest standardised deviation of each unit and where it is."""
    z = long.join(model, "stat").withColumn("z", F.abs(F.col("value") - F.col("center")) / F.col("scale"))
    return z.groupBy("unit_id").agg(F.max("z").alias("score"), F.min_by("stat", F.struct(-F.col("z"), "stat")).alias("worst"))


def drift_alarms(long: DataFrame, fit: str, calibration: str, alpha: float = 0.05) -> DataFrame:
    """(unit_id, score, threshold, alarm, worst): fitted and calibrated on two named parts of long (column part)."""
    model = drift_model(long.where(F.col("part") == fit))
    scores = drift_scores(long, model).join(long.select("unit_id", "part").distinct(), "unit_id")
    limit = guard_quantile(scores.where(F.col("part") == calibration), [], "score", alpha).select("threshold")
    return scores.join(F.broadcast(limit), F.lit(True)).select("unit_id", "part", "score", "threshold", (F.col("score") > F.col("threshold")).alias("alarm"), "worst")  # the threshold is one row


def explain_drift(long: DataFrame, model: DataFrame, top: int = 5) -> DataFrame:
    """(unit_id, place, stat, value, z): each unit's worst statistics."""
    z = long.join(model, "stat").withColumn("z", F.abs(F.col("value") - F.col("center")) / F.col("scale"))
    w = Window.partitionBy("unit_id").orderBy(F.desc("z"), "stat")
    return z.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("unit_id", "place", "stat", "value", "z")


def three_sigma(long: DataFrame, fit: str) -> DataFrame:
    """(unit_id, alarm): any statistic beyond three deviations of the fitted part's mean, the plain rule to compare with."""
    facts = long.where(F.col("part") == fit).groupBy("stat").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    j = long.join(facts, "stat")
    return j.groupBy("unit_id").agg(F.bool_or(F.abs(F.col("value") - F.col("m")) > 3 * F.greatest("s", F.lit(1e-12))).alias("alarm"))


def unit_difference(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(joint, stat, reference, current, delta, grade) between two fingerprints; a joint on one side only fails; what improved is no drift."""
    sides = lambda df, s: df.select("joint", *[F.col(f).alias(f"{s}_{f}") for f in FIELDS], F.lit(True).alias(f"in_{s}"))
    j = sides(reference, "a").join(sides(current, "b"), "joint", "full")
    alone = j.where("in_a is null or in_b is null").select("joint", F.lit("present").alias("stat"), F.lit(None).cast("double").alias("reference"), F.lit(None).cast("double").alias("current"), F.lit(1.0).alias("delta"), F.lit("fail").alias("grade"))
    rows = []
    for f in FIELDS:
        a, b, (warn, fail) = F.col(f"a_{f}"), F.col(f"b_{f}"), UNIT_TOLERANCE[f]
        if f in UNIT_FLOOR:
            delta = (b - a) / F.greatest(F.abs(a), F.lit(UNIT_FLOOR[f]))
            mark = F.when(b > a, grade(delta, warn, fail)).otherwise("ok")
        else:
            delta = b - a
            mark = grade(delta, warn, fail)
        rows.append(F.struct(F.lit(f).alias("stat"), a.alias("reference"), b.alias("current"), delta.alias("delta"), mark.alias("grade")))
    both = j.where("in_a and in_b").select("joint", F.explode(F.array(*rows)).alias("r")).select("joint", "r.*")
    return both.unionByName(alone)


def roll_up(findings: DataFrame, keys: list[str]) -> DataFrame:
    """worst, passed and counts of each grade."""
    n = lambda g: F.sum(F.when(F.col("grade") == g, 1).otherwise(0)).cast("long")
    got = findings.groupBy(*keys).agg(n("ok").alias("n_ok"), n("warn").alias("n_warn"), n("fail").alias("n_fail"))
    return got.select("*", F.when(F.col("n_fail") > 0, "fail").when(F.col("n_warn") > 0, "warn").otherwise("ok").alias("worst"), (F.col("n_fail") == 0).alias("passed"))


def photometrics(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Brightness, clipping, sharpness and colour balance of decoded images.

    pixels has keys, width, height and bgr (height x width x 3 bytes).
    """
    kinds = dict(pixels.dtypes)

    def one(data, width, height):
        image = np.frombuffer(data, np.uint8).reshape(height, width, 3).astype(float)
        luma = image @ np.array([0.114, 0.587, 0.299])
        edges = luma[:-2, 1:-1] + luma[2:, 1:-1] + luma[1:-1, :-2] + luma[1:-1, 2:] - 4 * luma[1:-1, 1:-1]
        mean = luma.mean()
        balance = (image.reshape(-1, 3).mean(axis=0) / max(mean, 1e-6)).tolist()
        return mean, luma.std(), (luma <= 5).mean(), (luma >= 250).mean(), edges.var() if edges.size else 0.0, balance

    names = ["mean_luma", "std_luma", "clipped_dark_frac", "clipped_bright_frac", "sharpness", "color_balance"]

    def run(batches):
        for pdf in batches:
            got = [one(d, w, h) for d, w, h in zip(pdf["bgr"], pdf["width"], pdf["height"], strict=True)]
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(got, columns=names)], axis=1)

    ddl = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + ", ".join(f"{n} {'array<double>' if n == 'color_balance' else 'double'}" for n in names)
    return pixels.select(*keys, "width", "height", "bgr").mapInPandas(run, ddl)


@F.pandas_udf(DoubleType())
def rotation_between(a: pd.Series, b: pd.Series) -> pd.Series:
    """Degrees between two rotation vectors, by their quaternions."""

    def quaternion(v):
        v = np.asarray(v, float)
        angle = np.linalg.norm(v)
        return np.array([np.cos(angle / 2), *(np.sin(angle / 2) * v / angle if angle > 0 else v)])

    return pd.Series([None if x is None or y is None else float(np.degrees(2 * np.arccos(min(1.0, abs(quaternion(x) @ quaternion(y)))))) for x, y in zip(a, b, strict=True)], dtype="float64")


def marker_difference(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(marker, stat, delta, grade) of (marker, center_px, size_px, tvec_m, rvec); a reference marker that is gone fails."""
    names = ("center_px", "size_px", "tvec_m", "rvec")
    j = reference.select("marker", *[F.col(c).alias(f"a_{c}") for c in names]).join(current.select("marker", *[F.col(c).alias(f"b_{c}") for c in names], F.lit(True).alias("seen")), "marker", "left")
    j = j.withColumn("rot", F.when(F.col("seen"), rotation_between("a_rvec", "b_rvec")))
    values = {
        "shift_px": F.hypot(F.element_at("b_center_px", 1) - F.element_at("a_center_px", 1), F.element_at("b_center_px", 2) - F.element_at("a_center_px", 2)),
        "size_rel": (F.col("b_size_px") - F.col("a_size_px")) / F.greatest("a_size_px", F.lit(1e-6)),
        "shift_mm": 1000 * distance("a_tvec_m", "b_tvec_m"),
        "rot_deg": F.col("rot"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("stat"), v.alias("delta"), grade(v, *CELL_TOLERANCE[k]).alias("grade")) for k, v in values.items()])
    found = j.where("seen").select("marker", F.explode(rows).alias("r")).select("marker", "r.*").where("delta is not null")
    gone = j.where("seen is null").select("marker", F.lit("missing").alias("stat"), F.lit(1.0).alias("delta"), F.lit("fail").alias("grade"))
    return found.unionByName(gone)


def photometric_difference(reference: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, stat, delta, grade); sharpness and clipping count only when they get worse."""
    names = ("mean_luma", "sharpness", "color_balance", "clipped_dark_frac", "clipped_bright_frac")
    j = reference.select(key, *[F.col(c).alias(f"a_{c}") for c in names]).join(current.select(key, *[F.col(c).alias(f"b_{c}") for c in names]), key)
    lost = (F.col("a_sharpness") - F.col("b_sharpness")) / F.greatest("a_sharpness", F.lit(1e-6))
    colour = F.array_max(F.zip_with("a_color_balance", "b_color_balance", lambda x, y: F.abs(y - x)))
    clip = F.greatest(F.col("b_clipped_bright_frac") - F.col("a_clipped_bright_frac"), F.col("b_clipped_dark_frac") - F.col("a_clipped_dark_frac"))
    g = lambda k, v: grade(v, *CELL_TOLERANCE[k])
    luma = F.col("b_mean_luma") - F.col("a_mean_luma")
    marks = [("mean_luma", luma, g("mean_luma", luma)), ("sharpness", lost, F.when(lost > 0, g("sharpness", lost)).otherwise("ok")), ("color_balance", colour, g("color_balance", colour)), ("clipping", clip, F.when(clip > 0, g("clipping", clip)).otherwise("ok"))]
    rows = F.array(*[F.struct(F.lit(k).alias("stat"), v.alias("delta"), m.alias("grade")) for k, v, m in marks])
    return j.select(key, F.explode(rows).alias("r")).select(key, "r.*")
