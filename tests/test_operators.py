"""Known answers, guarantees and round trips of the operators on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import expressions as X
from spindrift.functions import special
from spindrift.functions.hashing import combined_hash, content_hash, content_hash_udf, stable_hash
from spindrift.functions.verdicts import verdict
from spindrift.operators import conformal, contract, fingerprint, guard, judge, pairs, planning, ranking, rates, scenarios, steps, survival


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# ---- intervals and tails


def test_quantiles_invert_their_distributions():
    assert special.chi2_ppf(0.95, 1) == pytest.approx(3.841458820694124, rel=1e-9)
    assert special.chi2_ppf(0.025, 8) == pytest.approx(2.179730747252650, rel=1e-9)
    assert special.beta_ppf(0.025, 5, 6) == pytest.approx(0.18708602844739855, rel=1e-9)
    assert special.chi2_sf1(3.841458820694124) == pytest.approx(0.05, rel=1e-9)
    for p in (0.001, 0.3, 0.99):
        assert special.beta_i(special.beta_ppf(p, 2.5, 7), 2.5, 7) == pytest.approx(p, rel=1e-9)
        assert special.gamma_p(3.5, special.chi2_ppf(p, 7) / 2) == pytest.approx(p, rel=1e-9)


def test_fisher_by_enumeration():
    for a, b, c, d in [(3, 1, 1, 3), (8, 2, 1, 5), (0, 5, 5, 0), (10, 10, 10, 10)]:
        n, row, col = a + b + c + d, a + b, a + c
        p = {x: math.comb(row, x) * math.comb(n - row, col - x) / math.comb(n, col) for x in range(max(0, col - n + row), min(row, col) + 1)}
        assert special.fisher(a, b, c, d) == pytest.approx(sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)))
        assert special.fisher(a, b, c, d, "greater") == pytest.approx(sum(v for x, v in p.items() if x >= a))


def test_wilson_edges_and_coverage(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (5, 10), (0, 0)], "k int, n int").select("k", "n", X.wilson("k", "n").alias("w")).collect()
    assert df[0].w.lower == 0 and df[1].w.upper == 1 and df[3].w is None
    assert (round(df[2].w.lower, 4), round(df[2].w.upper, 4)) == (0.2366, 0.7634)
    rng = np.random.default_rng(0)
    k = rng.binomial(20, 0.3, 4000)
    bounds = {r.k: (r.w.lower, r.w.upper) for r in spark.createDataFrame([(i, 20) for i in range(21)], "k int, n int").select("k", X.wilson("k", "n").alias("w")).collect()}
    assert np.mean([bounds[x][0] <= 0.3 <= bounds[x][1] for x in k.tolist()]) > 0.93


def test_clopper_pearson_contains_wilson_centre():
    low, high = special.clopper_pearson(7, 20)
    assert (round(low, 4), round(high, 4)) == (0.1539, 0.5922)
    assert special.poisson_rate(0, 2.0)[0] == 0 and special.poisson_rate(0, 2.0)[1] == pytest.approx(3.688879454113936 / 2)


# ---- pairs and sequences


def test_last_duplicate_of_a_pair_counts(spark):
    rows = [("A", "p1", "t", 0, 1), ("A", "p1", "t", 1, 2), ("B", "p1", "t", 0, 3), ("A", "", "t", 1, 4), ("B", "", "t", 1, 5), ("A", "p2", "t", 1, 6), ("B", "p2", "u", 1, 7)]
    got = pairs.pair_trials(spark.createDataFrame(rows, "policy string, pair_id string, task string, success int, pos int"), "A", "B").collect()
    assert [(r.pair_id, r.task, r.a, r.b) for r in got] == [("p1", "t", 1.0, 0.0)]


def reference_sequence(ds, alpha=0.05):
    n, s1, s2, slx, sl, sv, out = 0, 0.0, 0.0, 0.0, 0.0, 0.0, []
    for d in ds:
        x, mu = (d + 1) / 2, (0.5 + s1) / (n + 1)
        var = max((0.25 + s2 - 2 * mu * s1 + n * mu * mu) / (n + 1), 1e-12)
        n += 1
        lam = min(math.sqrt(2 * math.log(2 / alpha) / (var * n * math.log(n + 1))), 0.5)
        sv += 4 * (x - mu) ** 2 * (-math.log1p(-lam) - lam) / 4
        slx, sl, s1, s2 = slx + lam * x, sl + lam, s1 + x, s2 + x * x
        c, r = slx / sl, (math.log(2 / alpha) + sv) / sl
        out.append((2 * c - 1, 2 * max(0, c - r) - 1, 2 * min(1, c + r) - 1))
    return out


def test_sequence_equals_a_loop_and_labels_stick(spark):
    rnd = random.Random(1)
    ds = [(rnd.random() < 0.3, rnd.random() < 0.8) for _ in range(200)]
    df = spark.createDataFrame([("t", f"{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(ds)], "task string, pair_id string, a double, b double")
    got = pairs.confidence_sequence(df, ["task"], ["pair_id"]).orderBy("t").collect()
    want = reference_sequence([b - a for a, b in ds])
    assert np.allclose([(r.estimate, r.lower, r.upper) for r in got], want, atol=1e-9)
    first = next(i for i, w in enumerate(want, 1) if i >= 5 and w[1] > 0)
    r = one(pairs.sequential_test(df, ["task"], ["pair_id"]))
    assert (r.decision, r.n) == ("B_better", first)
    assert one(pairs.sequential_test(df, ["task"], ["pair_id"], stop_early=False)).n == 200


def test_sequence_misses_rarely(spark):
    rng = np.random.default_rng(2)
    rows = [(f"r{i}", j, float(a), float(b)) for i in range(100) for j, (a, b) in enumerate(rng.random((120, 2)) < 0.5)]
    got = pairs.confidence_sequence(spark.createDataFrame(rows, "task string, j int, a double, b double"), ["task"], ["j"])
    missed = got.groupBy("task").agg(F.bool_or((F.col("lower") > 0) | (F.col("upper") < 0)).alias("m")).agg(F.avg(F.col("m").cast("double"))).first()[0]
    assert missed <= 0.07


def test_bootstrap_agrees_with_the_normal_interval(spark):
    rng = np.random.default_rng(3)
    rows = [("t", f"{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(rng.random(400) < 0.4, rng.random(400) < 0.6))]
    df = spark.createDataFrame(rows, "task string, pair_id string, a double, b double")
    b, w = one(pairs.bootstrap_interval(df, "task")), one(pairs.paired_interval(df, ["task"]))
    assert b.estimate == pytest.approx(w.estimate) and b.lower == pytest.approx(w.lower, abs=0.01) and b.upper == pytest.approx(w.upper, abs=0.01)


def test_survival_known_case(spark):
    rows = [("A", float(t), e) for t, e in zip((10, 12, 15, 30, 30, 30), (1, 1, 1, 0, 0, 0))] + [("B", float(t), e) for t, e in zip((5, 6, 7, 8, 9, 30), (1, 1, 1, 1, 1, 0))]
    df = spark.createDataFrame(rows, "policy string, time double, event int").withColumn("task", F.lit("t"))
    km = {(r.policy, r.time): r.survival for r in survival.kaplan_meier(df, ["policy"]).collect()}
    assert km["A", 15.0] == pytest.approx(0.5) and km["B", 9.0] == pytest.approx(1 / 6)
    med = {r.policy: r.median_time for r in survival.median_time(survival.kaplan_meier(df, ["policy"]), ["policy"]).collect()}
    assert med == {"A": 15.0, "B": 7.0}
    lr = one(survival.log_rank(df, ["task"], "policy", "A", "B"))
    assert lr.p_value == pytest.approx(math.erfc(math.sqrt(lr.statistic / 2))) and lr.p_value < 0.05
    assert one(survival.ks_distance(df, ["task"], "policy", "A", "B")).distance == pytest.approx(5 / 6)


# ---- conformal


def test_conformal_known_ranks_and_saturation(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 20)], "v double")
    a, b = one(conformal.guard_quantile(df, [], "v", 0.1)), one(conformal.guard_quantile(df, [], "v", 0.01))
    assert (a.threshold, a.saturated) == (18.0, False) and (b.threshold, b.saturated, b.achievable_alpha) == (19.0, True, 1 / 20)
    assert one(conformal.judge_quantile(df, [], "v", 0.01)).threshold == 1.0


def test_false_alarms_stay_under_alpha(spark):
    rng = np.random.default_rng(4)
    walk = lambda n, tag: [(f"{tag}{i}", s, float(x)) for i in range(n) for s, x in enumerate(np.abs(rng.normal(size=40)).cumsum() / 40)]
    schema = "episode_id string, step int, score double"
    cal, new = spark.createDataFrame(walk(99, "c"), schema), spark.createDataFrame(walk(300, "n"), schema)
    for method in ("max", "bonferroni"):
        th = conformal.sequential_thresholds(cal, 0.1, method)
        assert conformal.alarms(new, th).agg(F.avg(F.col("alarmed").cast("double"))).first()[0] <= 0.15


def test_edges_round_half_to_even_and_steps_clamp(spark):
    assert conformal.bin_edges(10, 4) == [0, 2, 5, 8, 10]
    got = spark.range(0, 14).select(conformal.bin_of(F.col("id"), [0, 2, 5, 8, 10]).alias("b")).collect()
    assert [r.b for r in got] == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 3, 3, 3]


def test_calibration_meets_its_target_and_abstains_on_noise(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 600)
    good = spark.createDataFrame([(float(s), int(v)) for s, v in zip(np.clip(rng.normal(0.3 + 0.4 * y, 0.12), 0, 1), y)], "score double, y int")
    c = one(conformal.calibrate(good, 0.05))
    assert c.selective_error <= 0.05
    noise = spark.createDataFrame([(float(s), int(v)) for s, v in zip(rng.random(600), y)], "score double, y int")
    c = one(conformal.calibrate(noise, 0.05))
    share = noise.select(X.abstain_decision("score", F.lit(c.t_fail), F.lit(c.t_succ)).alias("d")).where("d = 'abstain'").count() / 600
    assert share > 0.8
    few = spark.createDataFrame([(0.5, 1)] * 3, "score double, y int")
    assert conformal.calibrate(few).count() == 0
    by = {r.task for r in conformal.calibrate_by_task(good.withColumn("task", F.when(F.rand(1) < 0.1, "rare").otherwise("often")).withColumn("task", F.when(F.col("score") < 0, "none").otherwise(F.col("task")))).collect()}
    assert {"often", "__default__"} <= by


# ---- guard


def trace(spark, scores, violation=()):
    rows = [("e", i, float(i), s, 1.0, i in violation) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "episode_id string, step int, t double, score double, threshold double, violation boolean")


@pytest.mark.parametrize("scores,violation", [([1.2, 0.95] * 10 + [0.3] * 8, ()), ([2.0] * 9 + [0.1] * 9, ()), ([2.0, None, 2.0, 2.0] * 3, (7,)), ([0.95] * 5, (0,)), ([float("nan"), 2.0, 2.0, 2.0], ())])
def test_both_folds_agree_with_the_state_machine(spark, scores, violation):
    state = guard.Levels(3, 0.1)
    want = [state.step(s, 1.0, i in violation) for i, s in enumerate(scores)]
    for fold in (guard.levels, guard.levels_by_group):
        got = fold(trace(spark, scores, violation)).orderBy("step").collect()
        assert [r.level for r in got] == want
    if violation:
        assert want[-1] == "stop"


def test_levels_rise_and_fall_by_patience(spark):
    got = [r.level for r in guard.levels(trace(spark, [2.0] * 6 + [0.95] * 3 + [0.1] * 6)).orderBy("step").collect()]
    assert got == ["ok", "ok", "slow", "slow", "slow", "handover"] + ["handover"] * 3 + ["handover"] * 2 + ["slow"] * 3 + ["ok"]
    e = one(guard.episodes_of(guard.levels(trace(spark, [2.0] * 6)).join(trace(spark, [2.0] * 6).select("episode_id", "step", "t"), ["episode_id", "step"])))
    assert (e.n_alert_onsets, e.first_alert_s, e.duration_s, e.max_level, e.lead_time_s) == (1, 2.0, 6.0, "handover", 4.0)


def test_shrunk_covariance(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4)) @ np.diag([1, 2, 3, 4.0])
    mean, cov, share = guard.ledoit_wolf(spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>"))
    c = x - x.mean(axis=0)
    s = c.T @ c / 300
    mu = np.trace(s) / 4
    d2 = ((s - mu * np.eye(4)) ** 2).sum()
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / 300**2, d2)
    assert share == pytest.approx(b2 / d2) and np.allclose(cov, (1 - share) * s + share * mu * np.eye(4)) and np.allclose(mean, x.mean(axis=0))
    got = spark.createDataFrame([([0.0] * 4,), (None,)], "features array<double>").select(guard.mahalanobis(mean, cov)("features").alias("d")).collect()
    assert got[0].d == pytest.approx(mean @ np.linalg.inv(cov) @ mean)


# ---- step features


def reference_features(t, a, g):
    mags = np.linalg.norm(a, axis=1)
    d = np.linalg.norm(np.diff(a, axis=0), axis=1)
    motion = np.concatenate([d[:1], d])
    stagnant = motion < max(1e-4, 0.1 * np.percentile(motion, 95))
    dt = (t[-1] - t[0]) / (len(t) - 1)
    runs, n = [0], 0
    for s in stagnant:
        n = n + 1 if s else 0
        runs.append(n)
    closed = g < (g.min() + g.max()) / 2
    flips = int((closed[1:] != closed[:-1]).sum())
    late = motion[t >= t[-1] - 2.0].mean()
    return [1.0, t[-1] - t[0], len(t), 1 / dt, mags.mean(), mags.max(), 0.0, 0.0, motion.mean(), stagnant.mean(), max(runs) * dt, flips, flips / ((t[-1] - t[0]) / 60), (closed & stagnant).mean(), late, late / (motion.mean() + 1e-12)]


def test_action_features_and_windows(spark):
    rng = np.random.default_rng(7)
    t = np.arange(90) * 0.1
    a = rng.normal(size=(90, 3)).cumsum(axis=0)
    a[40:60] = a[40]
    g = (np.sin(t * 3) > 0).astype(float)
    rows = [("e", i, float(t[i]), a[i].tolist(), [a[i].tolist()], float(g[i])) for i in range(90)]
    df = spark.createDataFrame(rows, "episode_id string, step int, t double, action array<double>, chunk array<array<double>>, gripper double")
    r = one(steps.action_features(df))
    assert np.allclose([r[c] for c in steps.FEATURES], reference_features(t, a, g), atol=1e-9)
    got = steps.windowed(df, 2.0)
    ends = sorted({round(x.t_end, 6) for x in got.select("t_end").distinct().collect()})
    want = [2.0 + k for k in range(100) if 2.0 + k < t[-1]] + [round(float(t[-1]), 6)]
    assert ends == pytest.approx(want)
    counts = {round(x.t_end, 6): x["count"] for x in got.groupBy("t_end").count().collect()}
    for e in want:
        assert counts[round(e, 6)] == int(((t > e - 2.0) & (t <= e)).sum())


def test_chunks_and_consistency(spark):
    rng = np.random.default_rng(8)
    c = rng.normal(size=(12, 6, 2))
    rows = [("e", i, c[i].tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "episode_id string, step int, chunk array<array<double>>")
    got = [r.raw for r in steps.chunk_consistency(df).orderBy("step").collect()]
    assert got[0] == 0 and got[1:] == pytest.approx([np.linalg.norm(c[i - 1, 3:] - c[i, :3], axis=1).mean() for i in range(1, 12)])
    far = [r.raw for r in steps.chunk_consistency(df, stride=6).orderBy("step").collect()]
    assert far[1] == pytest.approx(np.linalg.norm(c[0, -1] - c[1, 0]))
    t = one(steps.temporal_inconsistency(df))
    assert t.temporal_inconsistency == pytest.approx(np.linalg.norm(c[:-1, 1:] - c[1:, :-1], axis=-1).mean()) and t.chunk_variance == pytest.approx(c.var(axis=1).sum(axis=-1).mean())
    raw = [r.raw for r in steps.stagnation_raw(df, window=4).orderBy("step").collect()]
    move = np.linalg.norm(np.diff(c.mean(axis=1), axis=0), axis=1)
    assert raw[0] is None and raw[1:] == pytest.approx([move[max(0, i - 3) : i + 1].mean() for i in range(11)])


def test_runs_end_at_the_next_step_or_the_last(spark):
    flags = [0, 1, 1, 0, 1]
    df = spark.createDataFrame([("e", i, i * 0.5, bool(f)) for i, f in enumerate(flags)], "episode_id string, step int, t double, flag boolean")
    got = sorted((r.first_step, r.last_step, r.t_start, r.t_end) for r in steps.runs(df, "flag").collect())
    assert got == [(1, 2, 0.5, 1.5), (4, 4, 2.0, 2.0)]


# ---- fingerprints, contract, scenarios, ranking, judge


def test_fingerprint_recovers_what_was_injected(spark):
    t = np.arange(2000) * 0.01
    rows = []
    for unit, lag, back, gain in (("u1", 0.08, 0.005, 0.97), ("u2", 0.0, 0.0, 1.0)):
        cmd = 0.5 * np.sin(t) + 0.2 * np.sin(2.3 * t)
        late = np.interp(t - lag, t, cmd)
        meas = gain * late - back / 2 * np.sign(np.gradient(late)) + 0.002
        rows += [(unit, "j1", float(a), float(b), float(c)) for a, b, c in zip(t, cmd, meas)]
    got = {r.unit_id: r for r in fingerprint.unit_fingerprint(spark.createDataFrame(rows, "unit_id string, joint string, t double, cmd double, meas double")).collect()}
    assert got["u1"].lag_s == pytest.approx(0.08, abs=0.011) and 0.002 < got["u1"].backlash < 0.008 and got["u1"].gain == pytest.approx(0.97, abs=0.03)
    assert got["u2"].rmse == pytest.approx(0.002, abs=1e-3) and got["u2"].gain == pytest.approx(1.0, abs=1e-6)


def test_drift_detector_rarely_alarms_on_nominal_units(spark):
    rng = np.random.default_rng(9)
    rows = [(f"u{i}", "fit" if i < 60 else "cal" if i < 120 else "new", f"s{k}", float(rng.normal() + 5 * (i == 239 and k == 2))) for i in range(240) for k in range(4)]
    got = fingerprint.drift_alarms(spark.createDataFrame(rows, "unit_id string, part string, stat string, value double"), "fit", "cal", 0.05)
    new = {r.unit_id: r for r in got.where("part = 'new'").collect()}
    assert new["u239"].alarm and new["u239"].worst == "s2" and sum(r.alarm for r in new.values()) / 120 <= 0.13


def test_photometrics_and_cell_difference(spark):
    rng = np.random.default_rng(10)
    image = rng.integers(0, 256, (20, 30, 3), dtype=np.uint8)
    df = spark.createDataFrame([("a", 30, 20, bytearray(image.tobytes())), ("b", 30, 20, bytearray((image // 2).tobytes()))], "cam string, width int, height int, bgr binary")
    p = fingerprint.photometrics(df, ["cam"])
    got = {r.cam: r for r in p.collect()}
    luma = image.astype(float) @ [0.114, 0.587, 0.299]
    assert got["a"].mean_luma == pytest.approx(luma.mean()) and got["a"].std_luma == pytest.approx(luma.std())
    a, b = p.where("cam = 'a'").withColumn("cam", F.lit("x")), p.where("cam = 'b'").withColumn("cam", F.lit("x"))
    assert {r.stat: r.grade for r in fingerprint.photometric_difference(a, b, "cam").collect()}["mean_luma"] == "fail"
    schema = "marker int, center_px array<double>, size_px double, tvec_m array<double>, rvec array<double>"
    m = spark.createDataFrame([(1, [10.0, 10.0], 20.0, [0.0, 0.0, 1.0], [0.0, 0.0, 0.0]), (2, [1.0, 1.0], 5.0, None, None)], schema)
    n = spark.createDataFrame([(1, [13.0, 14.0], 20.0, [0.0, 0.0, 1.0], [0.0, 0.0, math.radians(2)])], schema)
    got = {(r.marker, r.stat): (r.delta, r.grade) for r in fingerprint.marker_difference(m, n).collect()}
    assert got[1, "shift_px"] == (5.0, "warn") and got[1, "rot_deg"][0] == pytest.approx(2.0) and got[2, "missing"][1] == "fail"


def test_contract_fails_closed(spark):
    full = {f: "x" for f in contract.FATAL + contract.WARN + contract.INFO}
    m = lambda d: spark.createDataFrame(list(d.items()), "field string, value string")
    r = contract.rules(spark)
    assert one(contract.verdict(contract.check(m(full), m(full), r))).worst == "ok"
    broken = full | {"action.dim": "7", "runtime.dtype": "fp16", "policy.name": "unknown"}
    got = {x.field: x.finding for x in contract.check(m(full), m(broken), r).collect()}
    assert (got["action.dim"], got["runtime.dtype"], got["policy.name"]) == ("fatal", "warn", "info")
    lost = {k: v for k, v in full.items() if k != "action.dim"}
    assert {x.field: x.finding for x in contract.check(m(full), m(lost), r).collect()}["action.dim"] == "fatal"
    assert {x.field: x.finding for x in contract.check(m(full), m(lost), r, allow_unknown=True).collect()}["action.dim"] == "warn"
    assert contract.check(m(full), m(lost), r, ignore=["action.dim"]).where("field = 'action.dim'").count() == 0
    cam = "name string, width int, height int, intrinsics_sha256 string, extrinsics_sha256 string"
    a, b = spark.createDataFrame([("top", 640, 480, "i", "e")], cam), spark.createDataFrame([("top", 320, 480, "i", None)], cam)
    assert {x.finding for x in contract.check_cameras(a, b).collect()} == {"warn"} and contract.check_cameras(a, a).count() == 0
    assert [x.finding for x in contract.check_cameras(a, b.withColumn("name", F.lit("side"))).collect()] == ["fatal"]


def test_hotspot_is_found_and_silence_kept(spark):
    rng = np.random.default_rng(11)
    n = 256
    size, yaw = rng.random(n), rng.uniform(-20, 20, n)
    hit = (size < 0.3) & (np.abs(yaw) > 13)
    fail = np.where(hit, rng.random(n) < 0.9, rng.random(n) < 0.08)
    rows = [(f"h{i}", f, float(v), bool(fail[i])) for i in range(n) for f, v in (("size", size[i]), ("yaw", yaw[i]))]
    schema = "scenario_hash string, factor string, value double, broken boolean"
    top = scenarios.hotspots(scenarios.gathered(spark.createDataFrame(rows, schema))).collect()
    assert set(top[0].factors) == {"size", "abs_yaw"} and top[0].lift > 2 and len(top) <= 5
    spread = [(h, f, v, bool(rng.random() < 0.2)) for h, f, v, _ in rows]
    even = {h: b for h, _, _, b in spread}
    found = scenarios.hotspots(scenarios.gathered(spark.createDataFrame([(h, f, v, even[h]) for h, f, v, _ in spread], schema)), alpha=0.001)
    assert found.count() <= 1


def test_alignment_is_total_and_decisions(spark):
    run = lambda d: spark.createDataFrame([(h, i, s) for i, (h, s) in enumerate(d.items())], "scenario_hash string, index int, success boolean")
    with pytest.raises(Exception, match="one run only"):
        scenarios.aligned(run({"a": True, "b": True}), run({"a": True})).collect()
    table = [("A_better", 1, 1, False), ("B_better", 2, 1, False), ("B_better", 0, 1, False), ("undecided", 0, 1, False), ("A_better", 0, None, False), ("A_better", 0, None, True), ("no_difference_within_margin", 0, 0, False)]
    df = spark.createDataFrame(table, "d string, b int, f int, w boolean")
    got = [r[0] for r in df.select(scenarios.recommendation(F.col("d"), F.col("b"), F.col("f"), F.col("w"))).collect()]
    assert got == ["block", "approve_with_review", "approve", "insufficient_evidence", "insufficient_evidence", "block", "no_change"]


def test_ranking_orders_policies(spark):
    rng = np.random.default_rng(12)
    power = {"a": 1.0, "b": 0.0, "c": -1.0}
    rows = []
    for _ in range(600):
        i, j = rng.choice(list(power), 2, replace=False)
        rows.append((str(i), str(j), 0.5 if rng.random() < 0.1 else float(rng.random() < 1 / (1 + math.exp(power[j] - power[i])))))
    got = ranking.bradley_terry(spark.createDataFrame(rows, "policy_i string, policy_j string, outcome double"), rounds=50).orderBy("place").collect()
    assert [r.policy for r in got] == ["a", "b", "c"] and abs(sum(r.strength for r in got)) < 1e-6 and all(0 < r.se < 0.5 for r in got)
    s = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "score double, y int")
    assert one(ranking.auroc(s)).auroc == pytest.approx((1 + 0 + 1 + 1 + 1 + 0.5) / 6)
    b = one(ranking.auroc_bootstrap(spark.createDataFrame([(float(x), int(x + rng.normal(0, 0.5) > 0)) for x in rng.normal(size=300)], "score double, y int"), rounds=100))
    assert b.lower < b.auroc < b.upper


def test_fusion_matches_a_direct_newton_solution(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.1]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1])))).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double").repartition(3)
    m = judge.fit_fusion(df, ["a", "b", "c"])
    z = np.column_stack([np.ones(400), (x - x.mean(0)) / x.std(0)])
    w, ridge = np.zeros(4), np.array([1e-8, 1, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
    assert np.allclose(m.weights, w, atol=1e-7) and m.ranking()[0][0] in ("a", "b")
    got = df.select(m.probability().alias("p")).agg(F.avg("p")).first()[0]
    assert got == pytest.approx(y.mean(), abs=0.01)


def test_verdicts(spark):
    texts = ['{"success_prob": 1.7, "failure_class": " Grasp ", "final_state_evidence": "cup up", "rationale": "held"}', 'ok ```json\n{"success_prob": 0.2}\n``` {"success_prob": 0.9}', "nothing", None, '{"success_prob": NaN}', '{"success_prob": 0.4, "progress": "far"}', '{"progress": 1}', "{broken"]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(verdict(F.col("t")).alias("v")).collect()]
    assert (got[0].success_prob, got[0].failure_class, got[0].rationale) == (1.0, "grasp", "cup up held")
    assert (got[1].success_prob, got[1].progress) == (0.2, 0.2)
    assert all(v.parse_error and v.success_prob == 0.5 for v in got[2:])


def test_hashes(spark):
    assert content_hash({"b": 1, "a": [1.5, "é"]}) == content_hash({"a": [1.5, "é"], "b": 1}) != stable_hash({"b": 1, "a": [1.5, "é"]})
    df = spark.createDataFrame([('{"b": 1, "a": 2}',), ("{",), (None,)], "t string").select(content_hash_udf("t").alias("h")).collect()
    assert [r.h for r in df] == [content_hash({"a": 2, "b": 1}), None, None]
    import hashlib

    files = [("x/b.bin", b"2"), ("x/a.bin", b"1")]
    want = hashlib.sha256(b"".join(p.split("/")[-1].encode() + hashlib.sha256(c).digest() for p, c in sorted(files))).hexdigest()
    got = spark.createDataFrame([([(p, hashlib.sha256(c).hexdigest()) for p, c in files],)], "f array<struct<path:string,sha256:string>>").select(combined_hash(F.col("f")).alias("h")).first().h
    assert got == want


def test_labels_and_plans(spark):
    with pytest.raises(Exception, match="unrecognised label"):
        spark.createDataFrame([("maybe",)], "l string").select(X.binary_label("l")).collect()
    assert planning.trials_needed(0.7, 0.9) == 59 and planning.trials_needed(0.7, 0.9, rho=0.4) < 59
    s = planning.schedule(spark, ["p", "q"], ["c1", "c2", "c3"], repeats=2, seed=4).orderBy("slot").collect()
    assert len(s) == 12 and all({x.policy for x in s if x.block == b} == {"p", "q"} and len({x.pair_id for x in s if x.block == b}) == 1 for b in range(6))
    assert len({(x.policy, x.label) for x in s}) == 2
    lhs = scenarios.lhs_battery(spark, [("x", 0.0, 10.0)], 10, 1).collect()
    assert sorted(int(r.params["x"]) for r in lhs) == list(range(10))


def test_rate_known_case(spark):
    eps = [(f"e{i}", "p", None, True, 600.0, [(0.0, 30.0, "teleop")] if i % 3 == 0 else []) for i in range(12)]
    df = spark.createDataFrame(eps, "episode_id string, policy string, unit_id string, success boolean, duration_s double, interventions array<struct<t_start:double,t_end:double,source:string>>")
    r = rates.fleet_metrics(df).where("level = 'all'").first()
    assert (r.hours, r.n_interventions, r.per_hour, r.mean_s_between, round(r.autonomous_rate * 12)) == (2.0, 4, 2.0, 1800.0, 8)
    assert rates.fleet_metrics(df).where("level = 'unit' and name = 'unknown'").count() == 1


def steps_of(rng, n, tag, fault=None):
    rows = []
    for i in range(n):
        x = rng.normal(size=(60, 4))
        a = np.cumsum(rng.normal(size=(60, 8, 2)) * 0.1, axis=0) + np.arange(8)[None, :, None] * 0.05
        if fault == "drift":
            x[30:] += 6
        if fault == "freeze":
            a[30:] = a[30]
        rows += [(f"{tag}{i}", s, s * 0.1, x[s].tolist(), a[s].tolist(), None) for s in range(60)]
    return rows


def test_guard_model_end_to_end(spark):
    from spindrift.operators import guard_model

    rng = np.random.default_rng(14)
    schema = "episode_id string, step int, t double, features array<double>, chunk array<array<double>>, state array<double>"
    m = guard_model.fit(spark.createDataFrame(steps_of(rng, 100, "n"), schema), alpha=0.2)
    again = guard_model.GuardModel.from_json(m.to_json())
    assert again == m
    with pytest.raises(ValueError):
        guard_model.GuardModel.from_json('{"kind": "judge"}')
    alarmed = lambda rows: guard.episodes_of(again.replay(spark.createDataFrame(rows, schema), patience=1)).agg(F.avg(F.col("detected").cast("double"))).first()[0]
    assert alarmed(steps_of(rng, 40, "c")) <= 0.35
    assert alarmed(steps_of(rng, 10, "d", "drift")) == 1.0 and alarmed(steps_of(rng, 10, "f", "freeze")) >= 0.8
    lv = again.replay(spark.createDataFrame(steps_of(rng, 2, "h"), schema), guard.HardLimits(max_abs=1e-9))
    assert {r.level for r in lv.collect()} == {"stop"}


def test_detectors_tell_outliers(spark):
    from spindrift.operators import detectors

    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(size=(400, 3)), rng.normal(5, 1, size=(400, 3))]) @ np.array([[1, 0, 0.5], [0, 1, 0.5], [0, 0, 0.01]])
    train = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>")
    odd = np.array([[2.0, 9.0, -9.0], [20.0, 20.0, 20.0], [2.5, -6.0, 4.0]])
    test = spark.createDataFrame([("ok", r.tolist()) for r in x[:50]] + [("odd", r.tolist()) for r in odd] + [("none", None)], "episode_id string, features array<double>")
    for make in (lambda: detectors.pca(train, most=2), lambda: detectors.mixture_density(train, parts=3), lambda: detectors.isolation_forest(train, trees=40, size=128)):
        scored = test.withColumn("score", make()("features"))
        got = {r.episode_id: r.score for r in detectors.episode_scores(scored).collect()}
        assert got["odd"] > got["ok"] and got["none"] is None
