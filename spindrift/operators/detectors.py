"""Baseline anomaly detectors over per-step vectors; an episode's score is its largest step score."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.expressions import chunk_variance
from spindrift.operators import guard


def episode_scores(scored: DataFrame) -> DataFrame:
    """(episode_id, score): the largest finite step score; an episode without one has none."""
    ok = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    return scored.groupBy("episode_id").agg(F.max(F.when(ok, F.col("score"))).alias("score"))


def action_variance() -> Column:
    """How much the actions of one chunk vary."""
    return chunk_variance("chunk")


def _vector_udf(fn):
    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        ok = v.notna()
        out = pd.Series(np.nan, index=v.index)
        if ok.any():
            out[ok] = fn(np.stack(v[ok].to_numpy()).astype(float))
        return out

    return run


def pca(vectors: DataFrame, vector: str = "features", most: int = 8):
    """Reconstruction error outside the leading components; the covariance is summed on the cluster."""
    p = vectors.select(F.size(vector)).first()[0]
    row = vectors.agg(*[F.avg(F.element_at(vector, k + 1)) for k in range(p)]).first()
    mean = np.array([float(x) for x in row])
    sums = guard.covariance_sums(vectors, vector, mean.tolist()).first()
    _, basis = np.linalg.eigh(np.array(sums.outer).reshape(p, p) / sums.n)
    lead = basis[:, ::-1][:, : min(most, p)]
    return _vector_udf(lambda x: np.sqrt((((x - mean) - (x - mean) @ lead @ lead.T) ** 2).sum(axis=1)))


def mixture_density(vectors: DataFrame, vector: str = "features", parts: int = 5, rounds: int = 30, seed: int = 0):
    """Negative log density under a diagonal Gaussian mixture.

    Each step of the expectation-maximisation sums responsibilities, means and
    squares in the tasks; starting means are vectors of least hash.
    """
    start = vectors.select(vector).orderBy(F.xxhash64(F.lit(seed), vector)).limit(parts).collect()
    means = np.array([r[0] for r in start], float)
    k, p = means.shape
    facts = vectors.agg(*[F.var_pop(F.element_at(vector, i + 1)) for i in range(p)]).first()
    spread = np.maximum(np.array([float(x or 0) for x in facts]), 1e-6)
    variances, weights = np.tile(spread, (k, 1)), np.full(k, 1 / k)
    data = vectors.select(vector).cache()

    def log_parts(x, w, m, v):
        return np.log(w) - 0.5 * (np.log(2 * math.pi * v).sum(axis=1) + ((x[:, None, :] - m) ** 2 / v).sum(axis=2))

    def total(x, w, m, v):
        lp = log_parts(x, w, m, v)
        top = lp.max(axis=1, keepdims=True)
        return (top + np.log(np.exp(lp - top).sum(axis=1, keepdims=True)))[:, 0], lp

    try:
        last = -np.inf
        for _ in range(rounds):
            state = (weights, means, variances)

            def run(batches, state=state):
                r, s, q, ll = np.zeros(k), np.zeros((k, p)), np.zeros((k, p)), 0.0
                for pdf in batches:
                    if len(pdf):
                        x = np.stack(pdf[vector].to_numpy()).astype(float)
                        t, lp = total(x, *state)
                        g = np.exp(lp - t[:, None])
                        r, s, q, ll = r + g.sum(axis=0), s + g.T @ x, q + g.T @ (x * x), ll + float(t.sum())
                yield pd.DataFrame({"v": [np.concatenate([r, s.ravel(), q.ravel(), [ll]]).tolist()]})

            got = data.mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
            flat = np.array([g.x for g in got])
            r, s, q = np.maximum(flat[:k], 1e-9), flat[k : k + k * p].reshape(k, p), flat[k + k * p : -1].reshape(k, p)
            weights, means = r / r.sum(), s / r[:, None]
            variances = np.maximum(q / r[:, None] - means**2, 1e-6)
            if flat[-1] - last < 1e-6 * abs(flat[-1]):
                break
            last = flat[-1]
    finally:
        data.unpersist()
    return _vector_udf(lambda x: -total(x, weights, means, variances)[0])


def isolation_forest(vectors: DataFrame, vector: str = "features", trees: int = 100, size: int = 256, seed: int = 0):
    """Isolation score; every tree grows on `size` vectors, as the method has it, so trees x size vectors are drawn by hash."""
    share = min(1.0, 1.5 * trees * size / max(vectors.count(), 1))
    drawn = vectors.where(F.pmod(F.xxhash64(F.lit(seed), vector), F.lit(1 << 30)) < share * (1 << 30)).select(vector).limit(trees * size).collect()
    x = np.array([r[0] for r in drawn], float)
    rng = np.random.Generator(np.random.PCG64(seed))

    def depth_of(n):
        return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def grow(rows, depth, limit):
        low, high = rows.min(axis=0), rows.max(axis=0)
        wide = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or not len(wide):
            return depth + depth_of(len(rows))
        d = int(rng.choice(wide))
        cut = float(rng.uniform(low[d], high[d]))
        left = rows[:, d] < cut
        return d, cut, grow(rows[left], depth + 1, limit), grow(rows[~left], depth + 1, limit)

    m = min(size, len(x))
    forest = [grow(x[rng.choice(len(x), m, replace=False)], 0, math.ceil(math.log2(max(m, 2)))) for _ in range(trees)]
    norm = max(depth_of(m), 1e-9)

    def walk(node, rows, at, out):
        if not isinstance(node, tuple):
            out[at] += node
        elif len(at):
            left = rows[at, node[0]] < node[1]
            walk(node[2], rows, at[left], out)
            walk(node[3], rows, at[~left], out)

    def score(rows):
        out = np.zeros(len(rows))
        for tree in forest:
            walk(tree, rows, np.arange(len(rows)), out)
        return 2 ** (-out / trees / norm)

    return _vector_udf(score)
