"""Ranking and separation: Bradley-Terry strengths and areas under ROC curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def win_table(comparisons: DataFrame) -> DataFrame:
    """(policy, rival, wins, games): wins count 1, ties one half, from (policy_i, policy_j, outcome)."""
    both = comparisons.select(F.col("policy_i").alias("policy"), F.col("policy_j").alias("rival"), F.col("outcome").alias("won")).unionByName(
        comparisons.select(F.col("policy_j").alias("policy"), F.col("policy_i").alias("rival"), (1 - F.col("outcome")).alias("won"))
    )
    return both.groupBy("policy", "rival").agg(F.sum("won").alias("wins"), F.count("*").alias("games"))


def strengths(wins: np.ndarray, rounds: int = 2000, tolerance: float = 1e-8) -> tuple[np.ndarray, bool]:
    """Log strengths of mean zero by minorise-maximise steps on a square table of wins."""
    games, total = wins + wins.T, wins.sum(axis=1)
    p = np.ones(len(wins))
    for _ in range(rounds):
        weight = (games / (p[:, None] + p[None, :])).sum(axis=1)
        q = np.maximum(np.divide(total, weight, out=p.copy(), where=weight > 0), 1e-9)
        q /= np.exp(np.log(q).mean())
        done = np.abs(np.log(q / p)).max() < tolerance
        p = q
        if done:
            return np.log(p), True
    return np.log(p), False


def bradley_terry(comparisons: DataFrame, rounds: int = 200, seed: int = 0) -> DataFrame:
    """(policy, strength, se, games, place).  The cluster reduces the games to a policies x policies table; the fit and its bootstrap run on that.

    A bootstrap sample of games only matters through how often each (pair,
    outcome) occurs, so a round draws one multinomial over those counts.
    """
    spark = comparisons.sparkSession
    seen = comparisons.groupBy("policy_i", "policy_j", "outcome").agg(F.count("*").alias("n")).orderBy("policy_i", "policy_j", "outcome").collect()
    names = sorted({r.policy_i for r in seen} | {r.policy_j for r in seen})
    if not names:
        return spark.createDataFrame([], "policy string, strength double, se double, games long, place int")
    at = {n: k for k, n in enumerate(names)}
    i, j, won, n = np.array([at[r.policy_i] for r in seen]), np.array([at[r.policy_j] for r in seen]), np.array([r.outcome for r in seen]), np.array([r.n for r in seen])

    def table(counts):
        w = np.zeros((len(names), len(names)))
        np.add.at(w, (i, j), won * counts)
        np.add.at(w, (j, i), (1 - won) * counts)
        return w

    best, _ = strengths(table(n))
    rng = np.random.Generator(np.random.PCG64(seed))
    draws = [strengths(table(c), 500, 1e-7)[0] for c in rng.multinomial(n.sum(), n / n.sum(), size=rounds)]
    se = np.std(draws, axis=0) if draws else np.zeros(len(names))
    games = table(n).sum(axis=1) + table(n).sum(axis=0)
    order = np.argsort(-best, kind="stable")
    return spark.createDataFrame([(names[k], float(best[k]), float(se[k]), int(games[k]), place + 1) for place, k in enumerate(order)], "policy string, strength double, se double, games long, place int")


def auroc(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(auroc, n_pos, n_neg) of (score, y) per group, ties by average rank; from counts of distinct scores, never by pairing rows."""
    counts = scored.groupBy(*keys, "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    below = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    part = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + 0.5 * F.col("neg"))
    got = counts.withColumn("part", part).groupBy(*keys).agg(F.sum("part").alias("u"), F.sum("pos").cast("long").alias("n_pos"), F.sum("neg").cast("long").alias("n_neg"))
    return got.select(*keys, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"), "n_pos", "n_neg")


def auroc_bootstrap(scored: DataFrame, rounds: int = 400, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(auroc, lower, upper): every round reweighs the rows by Poisson(1) counts drawn from hashes, and all rounds are one grouped pass."""
    n = F.lit(rounds)
    u = F.pmod(F.xxhash64("score", "y", "row", "round", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    # Poisson(1) by its distribution function: P(0), P(<=1), ... up to 6
    weight, total, mass = F.lit(0), 0.0, 0.36787944117144233
    for k in range(7):
        total += mass
        weight = weight + F.when(u > total, 1).otherwise(0)
        mass /= k + 1
    rows = scored.withColumn("row", F.monotonically_increasing_id()).withColumn("round", F.explode(F.sequence(F.lit(1), n))).withColumn("w", weight).where("w > 0")
    weighted = rows.groupBy("round", "score").agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum(F.col("w") * (1 - F.col("y"))).alias("neg"))
    below = Window.partitionBy("round").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    part = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + 0.5 * F.col("neg"))
    each = weighted.withColumn("part", part).groupBy("round").agg((F.sum("part") / (F.sum("pos") * F.sum("neg"))).alias("a"))
    bounds = each.agg(F.percentile("a", [alpha / 2, 1 - alpha / 2]).alias("p"))
    return auroc(scored).join(F.broadcast(bounds), F.lit(True)).select("auroc", "n_pos", "n_neg", F.col("p")[0].alias("lower"), F.col("p")[1].alias("upper"))
