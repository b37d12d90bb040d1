import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions.hashing import content_hash
from spindrift.operators import rates
from spindrift.sources import arrays, report, tables


def test_results_and_claims(spark, tmp_path):
    (tmp_path / "r.csv").write_text("episode_id,policy,task,success,time_to_success,extra\n1,A,t,1.0,3.5,x\n2,A,t,0,,y\n")
    rows = tables.read_results(spark, str(tmp_path / "r.csv")).orderBy("episode_id").collect()
    assert [(r.success, r.time_to_success, r.score, r.extra, r.pair_id) for r in rows] == [(1, 3.5, 1.0, "x", None), (0, None, 0.0, "y", None)]
    (tmp_path / "bad.csv").write_text("policy,task\nA,t\n")
    with pytest.raises(ValueError, match="lack"):
        tables.read_results(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "c.csv").write_text("policy,task,successes,trials\n A , ,7,10\nB,t,1,2\n")
    assert {(r.policy, r.task, r.trials) for r in tables.read_claims(spark, str(tmp_path / "c.csv")).collect()} == {("A", "ALL", 10), ("B", "t", 2)}


def episode(i, **more):
    return {"episode_id": f"e{i}", "task": "t", "policy": "p", "outcome": {"success": i % 2 == 0}, "timing": {"duration_s": 10.0, "time_to_success_s": 4.0}, "interventions": []} | more


def test_episode_log(spark, tmp_path):
    lines = [json.dumps(episode(0)), "", '{"episode_id": "bad"}', "{oops", json.dumps(episode(1, outcome={"success": True, "score": 2.0})), json.dumps(episode(2, failure={"failure_class": "grasp", "subclass": "jam"})), json.dumps(episode(3, outcome={}))]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    got = {r.line: r.error for r in tables.validate_episodes(spark, str(tmp_path / "log.jsonl")).collect()}
    assert set(got) == {3, 4, 5, 6} and "score" in got[5] and "jam" in got[6] and got[4] == "malformed JSON"
    (tmp_path / "good.jsonl").write_text("\n".join([json.dumps(episode(0)), "", json.dumps(episode(3, outcome={}))]))
    eps = tables.read_episodes(spark, str(tmp_path / "good.jsonl"))
    assert eps.count() == 2 and tables.result_rows(eps).count() == 1
    tables.write_results(eps, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True).first()
    assert (back.episode_id, back.success, back.pair_id) == ("e0", "1", None)
    tables.append_episodes(eps, str(tmp_path / "more"))
    tables.append_episodes(eps, str(tmp_path / "more"))
    assert tables.read_episodes(spark, str(tmp_path / "more")).count() == 4


def test_frame_dataset(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "info.json").write_text(json.dumps({"fps": 30, "robot_type": "arm", "repo_id": "r/x", "features": {"action": {"shape": [6], "dtype": "float32"}, "observation.images.top": {"dtype": "video"}}}))
    (tmp_path / "meta" / "tasks.jsonl").write_text('{"task_index": 0, "task": "pick"}\n')
    rows = [(e, f, f / 30, [float(e)] * 6, 0, (e != 1) if f == 59 else None, e == 2 and 20 <= f < 30) for e in range(4) for f in range(60)]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, timestamp double, action array<double>, task_index long, `next.success` boolean, is_intervention boolean")
    df.repartition(3).write.parquet(str(tmp_path / "data" / "chunk-000"))
    info = tables.read_dataset_info(spark, str(tmp_path))
    assert info["action_dim"] == 6 and info["cameras"] == ["observation.images.top"]
    eps = tables.episodes_from_frames(tables.read_frames(spark, str(tmp_path)), tables.read_tasks(spark, str(tmp_path)), info["repo_id"], info["fps"])
    got = {r.episode_id: r for r in eps.collect()}
    assert sum(r.success for r in got.values()) == 3 and got["r/x#0"].task == "pick"
    assert len(got["r/x#2"].interventions) == 1 and got["r/x#2"].interventions[0].t_end == pytest.approx(1.0)
    assert rates.fleet_metrics(eps).where("level = 'all'").first().n_interventions == 1


def test_excitation_and_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("t,cmd_j1,meas_j1,cmd_j2,other\n0,1,2,3,4\n0.1,1.5,2.5,3,4\n")
    got = tables.read_excitation(spark, str(tmp_path / "x.csv"), "u").collect()
    assert {(r.joint, r.t, r.cmd, r.meas) for r in got} == {("j1", 0.0, 1.0, 2.0), ("j1", 0.1, 1.5, 2.5)}
    (tmp_path / "ck" / "sub").mkdir(parents=True)
    head = b'{"w": 1}'
    (tmp_path / "ck" / "sub" / "m.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + b"data")
    r = tables.list_files(spark, str(tmp_path / "ck")).first()
    assert (r.name, r["size"], r.sha256) == ("sub/m.safetensors", 20, hashlib.sha256((tmp_path / "ck" / "sub" / "m.safetensors").read_bytes()).hexdigest())
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "ck"))
    assert raw.select(tables.safetensors_header("content").alias("h")).first().h == '{"w": 1}'
    names = spark.createDataFrame([(["10_a.png", "end.png", "2_b.png"],)], "n array<string>").select(tables.numeric_prefix_order(F.col("n")).alias("n")).first().n
    assert names == ["2_b.png", "10_a.png", "end.png"]


def test_npz_and_mcap(spark, tmp_path):
    a = np.arange(24, dtype=float).reshape(4, 3, 2)
    (tmp_path / "ep1.npz").write_bytes(arrays.npz_bytes(actions=a, truth=np.array("success")))
    got = arrays.read_npz(spark, str(tmp_path), duration=6.0).orderBy("step").collect()
    assert [r.t for r in got] == [0.0, 2.0, 4.0, 6.0] and got[1].chunk == a[1].tolist() and got[0].truth == "success" and got[0].features is None
    (tmp_path / "log.mcap").write_bytes(arrays.mcap_bytes([(5, json.dumps(episode(0))), (7, json.dumps(episode(1)))]))
    assert sorted(r.log_time for r in arrays.read_mcap(spark, str(tmp_path)).collect()) == [5, 7]
    assert {r.episode_id for r in arrays.episodes_from_mcap(spark, str(tmp_path)).collect()} == {"e0", "e1"}
    with pytest.raises(ValueError):
        list(arrays.mcap_messages(b"nope"))


def test_battery_and_run_tampering(spark, tmp_path):
    lines = arrays.battery_lines("b", [{"x": float(i)} for i in range(5)])
    (tmp_path / "b.jsonl").write_text("\n".join(lines))
    assert arrays.read_battery(spark, str(tmp_path / "b.jsonl")).count() == 5
    (tmp_path / "t.jsonl").write_text("\n".join(lines).replace('"x": 3.0', '"x": 4.0'))
    with pytest.raises(Exception, match="were changed|does not match"):
        arrays.read_battery(spark, str(tmp_path / "t.jsonl")).count()
    (tmp_path / "d.jsonl").write_text("\n".join(lines[:-1]))
    with pytest.raises(ValueError):
        arrays.read_battery(spark, str(tmp_path / "d.jsonl"))
    doc = {"a": 1}
    assert arrays.verify_hash(doc | {"h": content_hash(doc)}, "h") and not arrays.verify_hash({"a": 2, "h": content_hash(doc)}, "h")
    (tmp_path / "run.json").write_text(json.dumps({"kind": "run_manifest", "run_id": "r", "battery_hash": "h", "results": {"s1": {"index": 0, "success": True, "steps": 5}}}))
    assert tables.read_run(spark, str(tmp_path / "run.json")).first().scenario_hash == "s1"
    (tmp_path / "odd.json").write_text('{"kind": "x", "results": {"s": {"index": 0}}}')
    with pytest.raises(Exception, match="not a run manifest"):
        tables.read_run(spark, str(tmp_path / "odd.json")).collect()


def test_report(spark):
    r = report.Report("Title", "PASS", [report.Section.of("Some rates", spark.createDataFrame([("a|b", 0.12345, None)], "policy_name string, rate double, x int"), "why <b>")])
    assert "| Policy name | Rate | X |" in r.markdown() and "a\\|b | 0.123 | - |" in r.markdown()
    assert 'href="#some-rates"' in r.html() and "why &lt;b&gt;" in r.html()
    assert (report.roll_up(["PASS", "FAIL"]), report.roll_up(["PASS"]), report.roll_up(["PASS", "WARN"])) == ("FAIL", "PASS", "WARN")
