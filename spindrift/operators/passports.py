"""Documents that travel with a comparison: policy contracts, environment pins, run manifests, passports, schedules' keys."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.hashing import content_hash
from spindrift.operators import scenarios

SAME = ("model_id", "weights_sha256", "action_dim", "action_semantics", "control_hz", "variant")  # fixed values: what makes two policies one


def policy_contract(name: str, model_id: str, action_dim: int, action_semantics: str, control_hz: float, obs_keys: list[str], weights_sha256: str | None = None, variant: dict | None = None, iface_version: str = "1") -> dict:
    """A policy's declaration with its hash."""
    body = {"name": name, "model_id": model_id, "action_dim": action_dim, "action_semantics": action_semantics, "control_hz": control_hz, "obs_keys": list(obs_keys), "weights_sha256": weights_sha256, "variant": variant or {}, "iface_version": iface_version}
    return body | {"hash": content_hash(body)}


def same_policy(a: dict, b: dict) -> bool:
    """Whether two declarations agree in all that is executed; a part that either lacks is no agreement."""
    return all(k in a and k in b and a[k] == b[k] for k in SAME)


def configuration_fingerprint(manifest: dict) -> str:
    """Hash of a configuration's behaviour: times, notes, paths and the runtime do not count."""
    policy = {k: v for k, v in (manifest.get("policy") or {}).items() if k != "source_path"}
    return content_hash({"policy": policy, **{k: manifest.get(k) or {} for k in ("action", "observation", "embodiment")}})


def environment_pins(**pins: str) -> dict:
    """Named versions and their hash; nothing is read from the machine but what the caller gives."""
    return {"pins": dict(sorted(pins.items())), "pins_hash": content_hash(pins)}


def run_manifest(run: DataFrame, run_id: str, battery_hash: str, policy: dict, pins: dict) -> dict:
    """A run's results with its header and hash; a battery is a few thousand scenarios, so they come to the driver."""
    rows = run.orderBy("index").collect()
    body = {"kind": "run_manifest", "run_id": run_id, "battery_hash": battery_hash, "policy": policy, **pins, "results": {r.scenario_hash: {k: r[k] for k in ("index", "success", "max_reward", "steps") if k in run.columns} for r in rows}}
    return body | {"manifest_hash": content_hash(body)}


def merged(shards: DataFrame, battery: DataFrame) -> DataFrame:
    """The shards' results as one run; a scenario twice, unknown or missing raises."""
    bad = scenarios.merge_check(shards.select("scenario_hash"), battery.select("scenario_hash")).limit(5).collect()
    if bad:
        raise ValueError("shards do not make up the battery: " + ", ".join(f"{r.problem} {r.scenario_hash[:12]}" for r in bad))
    return shards


def passport(a: DataFrame, b: DataFrame, floor: DataFrame | None = None, warnings: list[str] = (), alpha: float = 0.05) -> dict:
    """What a comparison of two runs amounts to, with its hash."""
    d = scenarios.diff(a, b, alpha).first().asDict()
    flips = floor.first()["broken"] if floor is not None else None
    changed = scenarios.changed(a, b).orderBy("index").collect()
    spark = a.sparkSession
    row = spark.createDataFrame([(d["decision"], d["broken"], flips, bool(warnings))], "d string, b long, f long, w boolean")
    advice = row.select(scenarios.recommendation(F.col("d"), F.col("b"), F.col("f"), F.col("w"))).first()[0]
    body = {"kind": "passport", "summary": d, "noise_flips": flips, "warnings": list(warnings), "broken": [r.scenario_hash for r in changed if r.change == "broken"], "fixed": [r.scenario_hash for r in changed if r.change == "fixed"], "recommendation": advice}
    return body | {"passport_hash": content_hash(body)}


def verify(document: dict, field: str = "passport_hash") -> bool:
    """Whether the document still is what its hash says."""
    return document.get(field) == content_hash({k: v for k, v in document.items() if k != field})


def check_comparable(a: dict, b: dict, allow_pins: bool = False) -> list[str]:
    """Warnings about two run manifests; different batteries or evaluators, or pins unless allowed, raise."""
    for k in ("battery_hash", "evaluator_version", "backend_id"):
        if a.get(k) != b.get(k):
            raise ValueError(f"the runs differ in {k}")
    pins = sorted(k for k in {**a.get("pins", {}), **b.get("pins", {})} if a.get("pins", {}).get(k) != b.get("pins", {}).get(k))
    if pins and not allow_pins:
        raise ValueError(f"the runs differ in the pins {pins}")
    return [f"pin {k} differs" for k in pins]


def write_schedule(slots: DataFrame, schedule_path: str, key_path: str) -> None:
    """The blinded schedule as CSV without the policies, and the key to its labels apart."""
    slots.select("slot", "block", "condition", "label", "pair_id").orderBy("slot").coalesce(1).write.mode("overwrite").option("header", True).csv(schedule_path)
    slots.select("label", "policy").distinct().coalesce(1).write.mode("overwrite").json(key_path)


def to_json(document: dict) -> str:
    return json.dumps(document, sort_keys=True, indent=1)
