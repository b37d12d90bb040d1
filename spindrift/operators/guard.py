"""The guard: hard limits, fitted scorers, and the level state machine as a fold over each episode's steps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.expressions import norm, row_steps
from spindrift.functions.taxonomy import GUARD_LEVELS


@dataclass(frozen=True)
class HardLimits:
    """Limits that stop at once; those that are None or empty do not hold."""

    joint_low: list[float] = field(default_factory=list)
    joint_high: list[float] = field(default_factory=list)
    box_low: list[float] = field(default_factory=list)
    box_high: list[float] = field(default_factory=list)
    max_norm: float | None = None
    max_abs: float | None = None
    max_step: float | None = None

    def violated(self, chunk="chunk", state="state") -> Column:
        """Whether a step's chunk or state breaks any limit; null vectors break none."""
        chunk, state = F.col(chunk), F.col(state)
        rules = []

        def outside(low, high):
            def rule(v):
                parts = [F.element_at(v, k + 1) < x for k, x in enumerate(low)] + [F.element_at(v, k + 1) > x for k, x in enumerate(high)]
                return F.coalesce(F.greatest(*[p.cast("int") for p in parts], F.lit(0)), F.lit(0)) == 1

            return rule

        if self.joint_low or self.joint_high:
            joint = outside(self.joint_low, self.joint_high)
            rules += [F.exists(chunk, joint), joint(state)]
        if self.box_low or self.box_high:
            rules.append(F.exists(chunk, outside(self.box_low, self.box_high)))
        if self.max_norm is not None:
            rules.append(F.exists(chunk, lambda v: norm(v) > self.max_norm))
        if self.max_abs is not None:
            rules.append(F.exists(chunk, lambda v: F.exists(v, lambda x: F.abs(x) > self.max_abs)))
        if self.max_step is not None:
            rules.append(F.when(F.size(chunk) > 1, F.array_max(row_steps(chunk)) > self.max_step))
        return F.greatest(*[F.coalesce(r, F.lit(False)).cast("int") for r in rules], F.lit(0), F.lit(0)) == 1


@dataclass
class Levels:
    """State of one episode's guard; `step` is shared by the batch fold and the stream."""

    patience: int = 3
    hysteresis: float = 0.1
    level: int = 0
    above: int = 0
    below: int = 0
    stopped: bool = False

    def step(self, score: float | None, threshold: float, violation: bool) -> str:
        if violation:
            self.stopped = True
        elif not self.stopped and score is not None and score == score:
            if score > threshold:
                self.above, self.below = self.above + 1, 0
                if self.above >= self.patience and self.level < 2:
                    self.level, self.above = self.level + 1, 0
            elif score < threshold - self.hysteresis * abs(threshold):
                self.above, self.below = 0, self.below + 1
                if self.below >= self.patience and self.level > 0:
                    self.level, self.below = self.level - 1, 0
            else:
                self.above = self.below = 0
        return GUARD_LEVELS[3] if self.stopped else GUARD_LEVELS[self.level]


def levels(steps: DataFrame, patience: int = 3, hysteresis: float = 0.1, keep: tuple[str, ...] = ()) -> DataFrame:
    """episode_id, step, the columns to keep, and level of (episode_id, step, score, threshold, violation), by one ordered pass over each episode.

    The steps of an episode are sorted into one partition and stream through the
    state in Arrow batches, so an episode costs time in proportion to its steps
    and memory of a batch, however long it is.  A null score holds everything, a
    violation stops for good.
    """
    order = ["episode_id", "step", "score", "threshold", "violation"]
    rows = steps.select("episode_id", F.col("step").cast("int").alias("step"), F.col("score").cast("double").alias("score"), F.col("threshold").cast("double").alias("threshold"), F.coalesce("violation", F.lit(False)).alias("violation"), *keep)
    out = ["episode_id", "step", *keep]
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = Levels(patience, hysteresis), None
        for b in batches:
            ids = b["episode_id"].to_pylist()
            got = []
            for episode, score, threshold, violation in zip(ids, b["score"].to_pylist(), b["threshold"].to_pylist(), b["violation"].to_pylist(), strict=True):
                if (episode,) != last:
                    state, last = Levels(patience, hysteresis), (episode,)
                got.append(state.step(score, threshold, violation))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in out), pa.array(got, pa.string())], names=[*out, "level"])

    return rows.repartition("episode_id").sortWithinPartitions(*order).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in out) + ", level string")


LEVELS_DDL = "episode_id string, step int, level string"


def levels_by_group(steps: DataFrame, patience: int = 3, hysteresis: float = 0.1) -> DataFrame:
    """The same through the stream's own state class, for episodes too long for an array per row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        state = Levels(patience, hysteresis)
        out = [state.step(None if pd.isna(s) else float(s), float(t), bool(v)) for s, t, v in zip(pdf["score"], pdf["threshold"], pdf["violation"], strict=True)]
        return pd.DataFrame({"episode_id": pdf["episode_id"].astype(str), "step": pdf["step"].astype("int32"), "level": out})

    return steps.select("episode_id", "step", "score", "threshold", "violation").groupBy("episode_id").applyInPandas(run, LEVELS_DDL)


def episodes_of(levelled: DataFrame, dt: float = 1.0) -> DataFrame:
    """One row per episode of (episode_id, step, t, level): onsets, first alert after the start, highest level, duration."""
    w, order = Window.partitionBy("episode_id").orderBy("step"), {n: k for k, n in enumerate(GUARD_LEVELS)}
    onset = (F.col("level") != "ok") & (F.coalesce(F.lag("level").over(w), F.lit("ok")) == "ok")
    df = levelled.withColumn("onset", onset).withColumn("rank", F.coalesce(*[F.when(F.col("level") == n, k) for n, k in order.items()]))
    got = df.groupBy("episode_id").agg(
        F.count("*").alias("n_steps"),
        F.min("t").alias("t0"),
        F.max("t").alias("t1"),
        F.sum(F.col("onset").cast("int")).cast("long").alias("n_alert_onsets"),
        F.min(F.when(F.col("onset"), F.col("t"))).alias("alert_t"),
        F.max("rank").alias("rank"),
    )
    span = F.col("t1") - F.col("t0")
    duration = F.when(F.col("n_steps") > 1, span + span / (F.col("n_steps") - 1)).otherwise(F.lit(dt))
    return got.select(
        "episode_id",
        "n_steps",
        duration.alias("duration_s"),
        "n_alert_onsets",
        (F.col("alert_t") - F.col("t0")).alias("first_alert_s"),
        F.element_at(F.array(*map(F.lit, GUARD_LEVELS)), F.col("rank") + 1).alias("max_level"),
        (F.col("rank") == 3).alias("stopped"),
        (F.col("n_alert_onsets") > 0).alias("detected"),
        F.when(F.col("n_alert_onsets") > 0, duration - (F.col("alert_t") - F.col("t0"))).alias("lead_time_s"),
    )


def covariance_sums(vectors: DataFrame, vector: str, centre: list[float]) -> DataFrame:
    """One row: n, the flattened sum of outer products and the sum of fourth powers of the norm, about a centre; summed in the tasks first."""
    p = len(centre)

    def run(batches):
        n, outer, fourth = 0, np.zeros((p, p)), 0.0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vector].to_numpy()).astype(float) - np.array(centre)
                n, outer, fourth = n + len(x), outer + x.T @ x, fourth + float(((x * x).sum(axis=1) ** 2).sum())
        yield pd.DataFrame([(n, outer.ravel().tolist(), fourth)], columns=["n", "outer", "fourth"])

    parts = vectors.select(vector).mapInPandas(run, "n long, outer array<double>, fourth double")
    total = F.aggregate(F.collect_list("outer"), F.array_repeat(F.lit(0.0), p * p), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return parts.agg(F.sum("n").alias("n"), total.alias("outer"), F.sum("fourth").alias("fourth"))


def ledoit_wolf(vectors: DataFrame, vector: str = "features") -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance shrunk toward a multiple of the identity, and the shrinkage; two passes over the rows, p x p work on the driver."""
    p = vectors.select(F.size(vector)).first()[0]
    centre = vectors.agg(*[F.avg(F.element_at(vector, k + 1)) for k in range(p)]).first()
    mean = np.array([float(x) for x in centre])
    row = covariance_sums(vectors, vector, mean.tolist()).first()
    n, s = row.n, np.array(row.outer).reshape(p, p) / row.n
    mu = np.trace(s) / p
    spread = ((s - mu * np.eye(p)) ** 2).sum()
    noise = min(max((row.fourth / n - (s * s).sum()) / n, 0.0), spread)
    share = noise / spread if spread > 0 else 0.0
    return mean, (1 - share) * s + share * mu * np.eye(p), float(share)


def mahalanobis(mean: np.ndarray, covariance: np.ndarray):
    """A pandas UDF of the squared Mahalanobis distance of a vector column, at least 0."""
    precision, centre = np.linalg.inv(covariance), mean

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        ok = v.notna()
        out = pd.Series(np.nan, index=v.index)
        if ok.any():
            x = np.stack(v[ok].to_numpy()).astype(float)
            if x.shape[1] != len(centre):
                raise ValueError(f"vectors of width {x.shape[1]}, fitted on {len(centre)}")
            x = x - centre
            out[ok] = np.maximum(np.einsum("ij,jk,ik->i", x, precision, x), 0.0)
        return out

    return run


def alert_after_onset(levelled: DataFrame, onsets: DataFrame, tolerance: float) -> DataFrame:
    """Per episode with a fault onset_t: whether the first alert at or after onset - tolerance exists, and its latency."""
    df = levelled.join(onsets, "episode_id")
    hit = F.min(F.when((F.col("level") != "ok") & (F.col("t") >= F.col("onset_t") - tolerance), F.col("t")))
    return df.groupBy("episode_id").agg(F.first("onset_t").alias("onset_t"), hit.alias("alert_t")).withColumn("hit", F.col("alert_t").isNotNull()).withColumn("latency_s", F.col("alert_t") - F.col("onset_t"))
