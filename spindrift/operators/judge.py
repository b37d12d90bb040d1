"""Episode judging: fusion of a judge model's reply with action features, decisions with abstention, failure guesses."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.expressions import sigmoid
from spindrift.operators.steps import FEATURES

INPUTS = ["success_prob", "progress", "parse_error", *FEATURES]


def inputs(has_verdict: Column, names: list[str] = INPUTS) -> list[Column]:
    """The fusion inputs as doubles; without a verdict one half, one half and a parse error."""
    missing = {"success_prob": 0.5, "progress": 0.5, "parse_error": 1.0}
    return [F.when(has_verdict, F.coalesce(F.col(n).cast("double"), F.lit(missing[n]))).otherwise(missing[n]).alias(n) if n in missing else F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]


@dataclass
class Fusion:
    """A ridge-logistic model on standardised inputs."""

    names: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # intercept first

    def probability(self) -> Column:
        z = F.lit(float(self.weights[0]))
        for n, m, s, w in zip(self.names, self.mean, self.scale, self.weights[1:], strict=True):
            z = z + float(w) * (F.col(n) - float(m)) / float(s)
        return sigmoid(z)

    def ranking(self) -> list[tuple[str, float]]:
        order = np.argsort(-np.abs(self.weights[1:]), kind="stable")
        return [(self.names[k], float(self.weights[k + 1])) for k in order]


def fit_fusion(rows: DataFrame, names: list[str], label: str = "y", l2: float = 1.0, rounds: int = 50, tolerance: float = 1e-9) -> Fusion:
    """Newton's method; every step sums gradient and Hessian in the tasks, and solves for a handful of numbers on the driver."""
    facts = rows.agg(*[F.avg(n).alias(f"m{k}") for k, n in enumerate(names)], *[F.stddev_pop(n).alias(f"s{k}") for k, n in enumerate(names)]).first()
    mean = np.array([facts[f"m{k}"] for k in range(len(names))], float)
    scale = np.array([facts[f"s{k}"] for k in range(len(names))], float)
    scale[scale < 1e-12] = 1.0
    w, p = np.zeros(len(names) + 1), len(names) + 1
    ridge = np.full(p, l2)
    ridge[0] = 1e-8
    data = rows.select(*[F.col(n).cast("double").alias(n) for n in names], F.col(label).cast("double").alias("__y")).cache()

    def step(current):
        def run(batches):
            g, h = np.zeros(p), np.zeros((p, p))
            for pdf in batches:
                x = np.column_stack([np.ones(len(pdf)), (pdf[names].to_numpy(float) - mean) / scale])
                q = 1 / (1 + np.exp(-np.clip(x @ current, -35, 35)))
                g += x.T @ (q - pdf["__y"].to_numpy(float))
                h += (x * np.maximum(q * (1 - q), 1e-12)[:, None]).T @ x
            import pandas as pd

            yield pd.DataFrame({"v": [np.concatenate([g, h.ravel()]).tolist()]})

        parts = data.mapInPandas(run, "v array<double>")
        total = parts.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()
        flat = np.array([r.x for r in total])
        return flat[:p], flat[p:].reshape(p, p)

    try:
        for _ in range(rounds):
            g, h = step(w)
            delta = np.linalg.solve(h + np.diag(ridge), g + ridge * w)
            w = w - delta
            if np.abs(delta).max() < tolerance:
                break
    finally:
        data.unpersist()
    return Fusion(names, mean, scale, w)


def failure_guess(verdict_class: str = "failure_class") -> Column:
    """struct(failure_class, subclass): the judge's own class first, then the first action signature that fits."""
    pair = lambda a, b: F.struct(F.lit(a).alias("failure_class"), F.lit(b).cast("string").alias("subclass"))
    c = F.col
    mixed = (c("temporal_inconsistency") > 0) & (c("chunk_variance") > 0) & (c("temporal_inconsistency") > 2 * F.sqrt("chunk_variance"))
    return (
        F.when(c(verdict_class).isNotNull(), F.struct(c(verdict_class).alias("failure_class"), F.lit(None).cast("string").alias("subclass")))
        .when(F.coalesce(c("has_actions"), F.lit(0.0)) == 0, pair("unknown", None))
        .when(c("stagnation_fraction") >= 0.5, pair("action", "freeze"))
        .when(c("gripper_toggles") >= 4, pair("grasp", "missed_grasp"))
        .when(c("gripper_closed_no_motion_fraction") >= 0.3, pair("grasp", "unstable_grasp"))
        .when(mixed, pair("action", "inconsistent_chunks"))
        .otherwise(pair("unknown", None))
    )
