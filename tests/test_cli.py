import json
import random

import pytest

from spindrift.cli import main


@pytest.fixture
def results(tmp_path):
    rnd = random.Random(0)
    lines = ["episode_id,policy,task,success,time_to_success,timeout,pair_id"]
    for i in range(80):
        for p, rate in (("A", 0.5), ("B", 0.9)):
            s = int(rnd.random() < rate)
            lines.append(f"{i}{p},{p},t{i % 3},{s},{rnd.randint(1, 20) if s else ''},30,p{i}")
    (tmp_path / "r.csv").write_text("\n".join(lines))
    return str(tmp_path / "r.csv")


def test_compare_says_which_way(spark, results, tmp_path, capsys):
    assert main(["stats-compare", results, "A", "B", "--html", str(tmp_path / "r.html")], spark) == 0
    out = capsys.readouterr().out
    assert "PASS" in out and "Sequential test" in out and "B_better" in out and (tmp_path / "r.html").exists()
    assert main(["stats-compare", results, "B", "A"], spark) == 1


def test_small_commands(spark, tmp_path, capsys):
    assert main(["stats-interval", "5", "10"], spark) == 0 and "0.500 [0.237, 0.763]" in capsys.readouterr().out
    assert main(["stats-plan", "0.7", "0.9"], spark) == 0 and capsys.readouterr().out.strip() == "59"
    assert main(["episodes-taxonomy"], spark) == 0 and "missed_grasp" in capsys.readouterr().out
    (tmp_path / "c.csv").write_text("policy,task,successes,trials\nA,t,95,100\nB,t,10,100\n")
    assert main(["stats-audit", str(tmp_path / "c.csv")], spark) == 0
    (tmp_path / "log.jsonl").write_text('{"episode_id": "bad"}\n')
    assert main(["episodes-validate", str(tmp_path / "log.jsonl")], spark) == 1
    good = {"episode_id": "e", "task": "t", "policy": "p", "outcome": {"success": True}, "timing": {"duration_s": 3600.0}, "interventions": []}
    (tmp_path / "good.jsonl").write_text(json.dumps(good))
    assert main(["episodes-validate", str(tmp_path / "good.jsonl")], spark) == 0 and main(["episodes-metrics", str(tmp_path / "good.jsonl")], spark) == 0
    (tmp_path / "s.csv").write_text("score,label\n0.1,fail\n0.9,success\n")
    assert main(["judge-calibrate", str(tmp_path / "s.csv")], spark) == 2


def test_runs_of_different_batteries_are_refused(spark, tmp_path):
    for name, battery, ok in (("a", "h", True), ("b", "h", False), ("c", "other", True)):
        doc = {"kind": "run_manifest", "run_id": name, "battery_hash": battery, "results": {f"s{i}": {"index": i, "success": ok, "steps": 1} for i in range(60)}}
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    assert main(["scenarios-diff", str(tmp_path / "a.json"), str(tmp_path / "b.json")], spark) == 1
    assert main(["scenarios-diff", str(tmp_path / "a.json"), str(tmp_path / "c.json")], spark) == 2
