import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import guard_model, passports, planning, ranking, scenarios
from spindrift.plans import pipelines
from spindrift.sources import imports


def frames_of(spark, n=48, steps=60):
    rng = np.random.default_rng(0)
    rows = []
    for e in range(n):
        t = np.arange(steps) / 30
        a = np.stack([np.sin(3 * t + e), np.cos(2 * t + e), 0.3 * np.sin(5 * t)], axis=1) + rng.normal(0, 0.01, (steps, 3))
        if e % 3 == 0:
            a[steps // 2 :] = a[steps // 2]
        s = np.vstack([a[:1], a[:-1]])
        for f in range(steps):
            rows.append((e, f, float(t[f]), a[f].tolist(), s[f].tolist(), (e % 3 != 0) if f == steps - 1 else None, None, False, 0))
    return spark.createDataFrame(rows, "episode_index long, frame_index long, t double, action array<double>, state array<double>, success boolean, reward double, intervention boolean, task_index long")


def test_validation_finds_the_frozen_episodes(spark):
    from spindrift.sources.tables import episodes_from_frames

    frames = frames_of(spark).cache()
    report = pipelines.validate(frames, episodes_from_frames(frames, None, "r/x"), "r/x")
    got = {s.title: s for s in report.sections}
    assert set(got) == {"Fleet", "Joints", "Judge thresholds", "Judge", "Guard"}
    everything = dict(zip(got["Judge"].columns, next(r for r in got["Judge"].rows if r[0] == "ALL"), strict=True))
    assert everything["balanced_accuracy"] is None or everything["balanced_accuracy"] > 0.8
    guard = dict(zip(got["Guard"].columns, got["Guard"].rows[0], strict=True))
    assert guard["n_failures"] == 16 and guard["detection_rate"] > 0.8
    good = pipelines.steps_of_frames(frames.where("episode_index % 3 <> 0"))
    model = guard_model.fit(good, alpha=0.1)
    hits = pipelines.faults(model, good, [("freeze", 0.0), ("offset", 5.0)]).collect()
    assert all(r.n == 32 and r.hits >= 20 for r in hits)
    truth = frames.select(F.col("episode_index").cast("string").alias("episode_id"), (F.col("episode_index") % 3 == 0).cast("int").alias("y")).distinct()
    auc = {r.detector: r.auroc for r in pipelines.compare_detectors(good, pipelines.steps_of_frames(frames), truth).collect()}
    assert len(auc) == 5 and all(0 <= v <= 1 for v in auc.values())


def test_imports(spark, tmp_path):
    for i, (pref, a, b) in enumerate([("A", 0.2, 0.9), (None, 0.7, 0.4), (None, 0.5, 0.5)]):
        d = tmp_path / "evaluation_sessions" / f"s{i}"
        d.mkdir(parents=True)
        (d / "metadata.yaml").write_text(json.dumps({"policies": {"A": {"policy_name": "x", "partial_success": a}, "B": {"policy_name": "y", "partial_success": b, "binary_success": 1}}, "preference": pref, "language_instruction": "pick", "evaluation_location": "lab"}))
    (tmp_path / "evaluation_sessions" / "s9").mkdir()
    (tmp_path / "evaluation_sessions" / "s9" / "metadata.yaml").write_text("- a list")
    s = imports.read_arena_sessions(spark, str(tmp_path))
    assert sorted(r.outcome for r in imports.arena_comparisons(s).collect()) == [0.5, 1.0, 1.0]
    trials = imports.arena_trials(s)
    assert {(r.policy, r.successes, r.trials) for r in imports.claims_of(trials).collect()} == {("x", 2, 3), ("y", 3, 3)}
    assert ranking.bradley_terry(imports.arena_comparisons(s), rounds=5).first().policy == "x"
    (tmp_path / "logs" / "m1").mkdir(parents=True)
    (tmp_path / "logs" / "m1" / "trial_log.csv").write_text("trial_id,checkpoint_step,outcome,time_to_completion_sec\n1,500,Full_Success,20\n2,500,timeout_success_slow,190\n")
    got = imports.read_trial_logs(spark, str(tmp_path / "logs"))
    assert sorted((r.policy, r.success, r.time_to_success) for r in got.collect()) == [("m1@500", 0, None), ("m1@500", 1, 20.0)]
    assert imports.outcome_table(got, ["full_success", "timeout_success_slow"]).first().full_success == 1
    (tmp_path / "j.jsonl").write_text('{"episode_id": "e", "label": "Success", "frames": ["a.png", "/x/b.png"]}\n')
    r = imports.read_judge_inputs(spark, str(tmp_path / "j.jsonl")).first()
    assert r.y == 1 and r.frames[1] == "/x/b.png" and r.frames[0].endswith("/a.png")
    (tmp_path / "k.jsonl").write_text('{"episode_id": "e", "label": "pass"}\n')
    with pytest.raises(Exception, match="label of e"):
        imports.read_judge_inputs(spark, str(tmp_path / "k.jsonl")).collect()
    assert imports.match_columns(["Episode_ID", "img"], {"episode": "episode", "frame": "image|img", "label": "outcome"}) == {"episode": "Episode_ID", "frame": "img"}


def test_documents(spark, tmp_path):
    a = passports.policy_contract("a", "m", 6, "joint", 50.0, ["top"], "w")
    b = passports.policy_contract("b", "m", 6, "joint", 50.0, ["top"], "w")
    assert passports.same_policy(a, b) and a["hash"] != b["hash"] and not passports.same_policy(a, {k: v for k, v in b.items() if k != "variant"})
    m = {"policy": {"name": "x", "source_path": "/1"}, "action": {"dim": 6}, "notes": "n"}
    assert passports.configuration_fingerprint(m) == passports.configuration_fingerprint(m | {"notes": "o", "policy": {"name": "x", "source_path": "/2"}})
    run = lambda f: spark.createDataFrame([(f"s{i}", i, f(i)) for i in range(120)], "scenario_hash string, index int, success boolean")
    base, worse = run(lambda i: True), run(lambda i: i % 2 == 0)
    p = passports.passport(base, worse, scenarios.noise_floor(base.withColumns({"max_reward": F.lit(1.0), "steps": F.lit(1)}), base.withColumns({"max_reward": F.lit(1.0), "steps": F.lit(1)})))
    assert p["recommendation"] == "block" and len(p["broken"]) == 60 and passports.verify(p) and not passports.verify(p | {"recommendation": "approve"})
    assert passports.passport(base, worse)["recommendation"] == "insufficient_evidence"
    with pytest.raises(ValueError, match="missing"):
        passports.merged(base.where("index < 100"), base)
    doc = passports.run_manifest(base, "r", "h", a, passports.environment_pins(python="3"))
    assert passports.verify(doc, "manifest_hash")
    with pytest.raises(ValueError, match="pins"):
        passports.check_comparable(doc, doc | {"pins": {"python": "4"}})
    assert passports.check_comparable(doc, doc | {"pins": {"python": "4"}}, allow_pins=True) == ["pin python differs"]
    passports.write_schedule(planning.schedule(spark, ["p", "q"], ["c"]), str(tmp_path / "s"), str(tmp_path / "k"))
    assert "policy" not in spark.read.csv(str(tmp_path / "s"), header=True).columns and spark.read.json(str(tmp_path / "k")).count() == 2
