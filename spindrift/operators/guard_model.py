"""The guard end to end: fit scorers on nominal episodes, calibrate on held-out ones, score and replay, save and load."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.expressions import head_excess, weighted_composite
from spindrift.operators import guard, planning, steps
from spindrift.operators.conformal import sequential_thresholds


@dataclass
class GuardModel:
    """Everything that scoring needs, as plain numbers."""

    consistency: tuple[float, float] | None = None  # mean and deviation of the raw score after the first step
    mean: list[float] = field(default_factory=list)
    covariance: list[list[float]] = field(default_factory=list)
    stagnation: tuple[float, float, float] | None = None  # floor, mean and deviation of the logs
    components: dict[str, tuple[float, float]] = field(default_factory=dict)  # each one's mean and deviation over the fitted steps
    thresholds: list[tuple[int, float]] = field(default_factory=list)  # (first step, threshold) of the composite
    stall_threshold: float | None = None
    alpha: float = 0.05
    saturated: bool = False
    achievable_alpha: float = 0.05
    kind: str = "guard"

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> GuardModel:
        got = json.loads(text)
        if got.get("kind") != "guard":
            raise ValueError("not a guard")
        pair = lambda x: None if x is None else tuple(x)
        got |= {"consistency": pair(got["consistency"]), "stagnation": pair(got["stagnation"]), "components": {k: tuple(v) for k, v in got["components"].items()}, "thresholds": [tuple(t) for t in got["thresholds"]]}
        return cls(**got)

    def _components(self, df: DataFrame) -> DataFrame:
        df = steps.chunk_consistency(df)
        mid, sd = self.consistency
        df = df.withColumn("c_consistency", F.when(F.col("step") == 0, 0.0).otherwise((F.col("raw") - mid) / sd)).drop("raw")
        if self.mean:
            df = df.withColumn("c_distance", guard.mahalanobis(np.array(self.mean), np.array(self.covariance))("features"))
        return df

    def score(self, df: DataFrame) -> DataFrame:
        """Adds composite, stall, score and threshold to (episode_id, step, t, chunk, features); score is the largest excess of a head, its threshold 0."""
        df = self._components(df)
        names = sorted(self.components)
        z = [(F.col(f"c_{n}") - self.components[n][0]) / self.components[n][1] for n in names]
        df = df.withColumn("composite", weighted_composite(z, [1.0] * len(names)))
        df = steps.stagnation_raw(df)
        df = df.withColumn("stall", steps.stagnation_score(df, *self.stagnation)).drop("raw", *[f"c_{n}" for n in names])
        held = F.lit(self.thresholds[0][1])
        for start, value in self.thresholds[1:]:
            held = F.when(F.col("step") >= start, F.lit(value)).otherwise(held)
        return df.withColumn("score", head_excess(["composite", "stall"], [held, F.lit(self.stall_threshold)])).withColumn("threshold", F.lit(0.0))

    def replay(self, df: DataFrame, limits: guard.HardLimits | None = None, patience: int = 3, hysteresis: float = 0.1) -> DataFrame:
        """(episode_id, step, t, level) of recorded steps; a step that breaks a hard limit is not scored, as it would not be live.

        The violating step is left out of the scorers' history and stops the
        episode; later steps stay stopped whatever they score.
        """
        bad = limits.violated() if limits else F.lit(False)
        marked = df.withColumn("violation", bad)
        good = self.score(marked.where(~F.col("violation")).drop("violation")).select("episode_id", "step", "t", "score", "threshold", F.lit(False).alias("violation"))
        rest = marked.where("violation").select("episode_id", "step", "t", F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("threshold"), "violation")
        both = good.unionByName(rest)
        return guard.levels(both, patience, hysteresis, keep=("t",))


def fit(nominal: DataFrame, alpha: float = 0.05, method: str = "max", bins: int = 4, fit_share: float = 0.6, stall_share: float = 0.5, seed: int = 0, benign: DataFrame | None = None) -> GuardModel:
    """A guard whose chance of ever alarming in a nominal episode is bounded by alpha.

    Scorers are fitted on one part of the episodes and calibrated on the other,
    with benign variations added to the calibration if given; alpha is shared
    between the composite head and the stall head.
    """
    ids = planning.split(nominal.select("episode_id").distinct(), "episode_id", [("fit", fit_share), ("cal", 1 - fit_share)], seed=seed)
    parts = nominal.join(ids, "episode_id")
    fitted, held = parts.where("part = 'fit'").drop("part"), parts.where("part = 'cal'").drop("part")
    if benign is not None:
        held = held.unionByName(benign)
    m = GuardModel(alpha=alpha)
    c = steps.moments(steps.chunk_consistency(fitted).where("step > 0"), ["raw"]).first()
    m.consistency = (c.raw_mean, c.raw_std)
    if "features" in nominal.columns and fitted.where("features is not null").limit(1).count():
        mean, covariance, _ = guard.ledoit_wolf(fitted.where("features is not null"))
        m.mean, m.covariance = mean.tolist(), covariance.tolist()
    s = steps.stagnation_fit(steps.stagnation_raw(fitted)).first()
    m.stagnation = (s["floor"], s.log_mean, s.log_std)
    names = ["consistency"] + ["distance"] * bool(m.mean)
    got = steps.moments(m._components(fitted), [f"c_{n}" for n in names]).first()
    m.components = {n: (got[f"c_{n}_mean"], got[f"c_{n}_std"]) for n in names}
    m.thresholds, m.stall_threshold = [(0, 0.0)], 0.0
    scored = m.score(held)
    main = sequential_thresholds(scored.select("episode_id", "step", F.col("composite").alias("score")), alpha * (1 - stall_share), method, bins).orderBy("from_step").collect()
    stall = sequential_thresholds(scored.select("episode_id", "step", F.col("stall").alias("score")), alpha * stall_share, "max").first()
    m.thresholds, m.stall_threshold = [(r.from_step, r.threshold) for r in main], stall.threshold
    m.saturated = stall.saturated or any(r.saturated for r in main)
    m.achievable_alpha = sum(r.achievable_alpha for r in main) + stall.achievable_alpha
    return m
