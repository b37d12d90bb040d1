"""Cases that larger tables brought up."""

import numpy as np
from pyspark.sql import functions as F

from spindrift.functions import expressions as X
from spindrift.operators import scenarios


def test_leading_bits_do_not_round(spark):
    # sha1 of 1076591 starts with bed0999d fffffd12, whose fraction rounds up to the next multiple of 2**-32
    row = spark.createDataFrame([("1076591",)], "t string").select(X.leading_bits("t").alias("b"), X.unit_float("t").alias("u")).first()
    assert row.b == 0xBED0999D and row.u == 0xBED0999DFFFFFD12 / 2**64


def test_quantiles_equal_linear_interpolation(spark, monkeypatch):
    monkeypatch.setattr(scenarios, "STRIPES", 7)
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=301), "b": rng.integers(0, 5, 200).astype(float), "c": np.array([4.0])}
    long = spark.createDataFrame([(str(i), f, float(v), False) for f, vs in values.items() for i, v in enumerate(vs)], "scenario_hash string, factor string, value double, broken boolean")
    shares = [0.1, 0.25, 0.5, 0.9]
    got = {(r.factor, r.share): r.cut for r in scenarios.quantiles(scenarios.value_counts(scenarios.gathered(long)), shares).collect()}
    assert len(got) == 12
    for f, vs in values.items():
        for s in shares:
            assert abs(got[f, s] - np.quantile(vs, s)) < 1e-12


def test_conjunctions_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    n = 300
    x = {"u": rng.random(n), "v": rng.uniform(-1, 1, n), "w": rng.integers(0, 9, n).astype(float)}
    bad = (x["u"] < 0.4) & (np.abs(x["v"]) > 0.5) & (rng.random(n) < 0.9) | (rng.random(n) < 0.05)
    long = spark.createDataFrame([(f"h{i}", f, float(v[i]), bool(bad[i])) for f, v in x.items() for i in range(n)] + [(f"h{i}", "hole", None, bool(bad[i])) for i in range(n)], "scenario_hash string, factor string, value double, broken boolean")
    top = scenarios.hotspots(scenarios.gathered(long.repartition(5))).collect()
    x["abs_v"] = np.abs(x["v"])
    assert set(top[0].factors) == {"u", "abs_v"}
    for r in top:
        inside = np.ones(n, bool)
        for cond in r.rule.split(" and "):
            f, op, cut = cond.split()
            inside &= x[f] > float(cut) if op == ">" else x[f] <= float(cut) + 1e-6
        assert abs(int(inside.sum()) - r.n_in) <= 1 and abs(int(bad[inside].sum()) - r.b_in) <= 1
        assert r.n_in + r.n_out == n and r.b_in + r.b_out == bad.sum()


def test_hotspots_without_scenarios(spark):
    empty = spark.createDataFrame([], "scenario_hash string, factor string, value double, broken boolean")
    assert scenarios.hotspots(scenarios.gathered(empty)).count() == 0 and scenarios.single_hotspots(scenarios.gathered(empty)).count() == 0
    assert scenarios.quantiles(scenarios.value_counts(scenarios.gathered(empty)), [0.5]).where(F.col("cut").isNotNull()).count() == 0


def test_levels_of_a_very_long_episode(spark):
    import time

    from spindrift.operators import guard

    t = F.col("id").cast("double")
    steps = spark.range(200_000).select(F.lit("e").alias("episode_id"), F.col("id").alias("step"), t.alias("t"), F.when(F.col("id") % 1000 < 6, 2.0).otherwise(0.1).alias("score"), F.lit(1.0).alias("threshold"), (F.col("id") == 199_990).alias("violation"))
    start = time.time()
    got = {r.level: r.n for r in guard.levels(steps.repartition(4), keep=("t",)).groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert got["stop"] == 10 and got["handover"] == 200 * 3 and got["slow"] == 200 * 6 and sum(got.values()) == 200_000
    assert time.time() - start < 60
