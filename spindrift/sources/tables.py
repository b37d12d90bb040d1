"""Readers and writers of trial tables, claims, episode logs, frame datasets, runs and checkpoint folders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spindrift.functions.taxonomy import CLASSES, SUBCLASSES

RESULT_COLUMNS = ["episode_id", "policy", "task", "success"]


def _blank(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A trial table from CSV: required columns are checked, empty fields are null, score falls back to success; further columns stay."""
    raw = spark.read.csv(path, header=True)
    lacking = [c for c in RESULT_COLUMNS if c not in raw.columns]
    if lacking:
        raise ValueError(f"results lack the columns {lacking}")
    has = lambda c: _blank(c) if c in raw.columns else F.lit(None).cast("string")
    success = _blank("success").cast("double").cast("int")
    known = {
        "success": success,
        "time_to_success": has("time_to_success").cast("double"),
        "timeout": has("timeout").cast("double"),
        "score": F.coalesce(has("score").cast("double"), success.cast("double")),
        **{c: has(c) for c in ("pair_id", "unit_id", "session_id")},
    }
    return raw.select(*[known.pop(c).alias(c) if c in known else F.col(c) for c in raw.columns], *[v.alias(k) for k, v in known.items()], F.monotonically_increasing_id().alias("pos"))


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """(policy, task, successes, trials, pos) from CSV; a blank or missing task is ALL."""
    raw = spark.read.csv(path, header=True)
    task = _blank("task") if "task" in raw.columns else F.lit(None).cast("string")
    return raw.select(F.trim("policy").alias("policy"), F.coalesce(task, F.lit("ALL")).alias("task"), F.trim("successes").cast("int").alias("successes"), F.trim("trials").cast("int").alias("trials"), F.monotonically_increasing_id().alias("pos"))


EPISODE = """schema_version string, episode_id string, task string, instruction string, policy string, robot string, unit_id string, site_id string, session_id string, condition string, pair_id string,
    outcome struct<success:boolean,score:double,judged_by:string,judge_confidence:double,judge_model:string,abstained:boolean,notes:string>,
    failure struct<failure_class:string,subclass:string,t_first_evidence:double,evidence:array<string>,recovered:boolean,t_recovered:double>,
    interventions array<struct<t_start:double,t_end:double,source:string,reason:string,operator_id:string,failure_class:string>>,
    timing struct<t_start_utc:string,duration_s:double,time_to_success_s:double,timeout_s:double,control_hz:double,inference_hz_mean:double,inference_latency_p95_ms:double>,
    provenance struct<policy_fingerprint:string,policy_name:string,policy_weights_sha256:string,cell_fingerprint:string,unit_fingerprint:string,raw_log_uri:string,raw_log_sha256:string,dataset_repo_id:string,dataset_episode_index:int,logger:string,logger_version:string>,
    tags array<string>, created_at string"""
REQUIRED = ["episode_id", "task", "policy"]


def _faults() -> Column:
    """The first rule an episode breaks, or null."""
    subclasses = F.create_map(*[x for c, s in SUBCLASSES.items() for x in (F.lit(c), F.array(*map(F.lit, s)))])
    kind, sub = F.col("failure.failure_class"), F.col("failure.subclass")
    outside = lambda c: (F.col(c) < 0) | (F.col(c) > 1)
    faults = [F.when(F.col(c).isNull(), f"{c} is missing") for c in REQUIRED]
    faults += [F.when(outside(c), f"{c} is not in [0, 1]") for c in ("outcome.score", "outcome.judge_confidence")]
    faults += [F.when(kind.isNotNull() & ~kind.isin(CLASSES), F.concat(F.lit("unknown failure class "), kind)), F.when(sub.isNotNull() & kind.isin(CLASSES) & ~F.array_contains(F.try_element_at(subclasses, kind), sub), F.concat(F.lit("subclass "), sub, F.lit(" is not of "), kind))]
    return F.coalesce(*faults)


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """An episode log from JSON lines; blank lines are skipped, a malformed line fails the job."""
    return spark.read.schema(EPISODE).option("mode", "FAILFAST").json(path)


def validate_episodes(spark: SparkSession, path: str) -> DataFrame:
    """(line, error) of each line of a log that is no valid episode: its number in its file, from 1, and what is wrong."""
    text = spark.read.text(path, wholetext=False).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    numbered = text.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("at"))).where(F.trim("value") != "")
    parsed = numbered.withColumn("e", F.from_json("value", EPISODE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    judged = parsed.select("file", "line", "e.*").withColumn("error", F.when(F.col("_bad").isNotNull(), "malformed JSON").otherwise(_faults()))
    return judged.where("error is not null").select("file", "line", F.substring("error", 1, 200).alias("error"))


def result_rows(episodes: DataFrame) -> DataFrame:
    """Episodes with an outcome as trial rows; the score falls back to the outcome."""
    s = F.col("outcome.success").cast("int")
    return episodes.where("outcome.success is not null").select(
        "episode_id", "policy", "task", s.alias("success"), F.col("timing.time_to_success_s").alias("time_to_success"), F.col("timing.timeout_s").alias("timeout"), "pair_id", "unit_id", "session_id", F.coalesce("outcome.score", s.cast("double")).alias("score")
    )


def write_results(episodes: DataFrame, path: str) -> None:
    """The trial rows as CSV with a header; nulls are empty fields."""
    result_rows(episodes).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def append_episodes(episodes: DataFrame, path: str) -> None:
    episodes.write.mode("append").json(path)


ALIASES = {  # fixed values: names under which datasets hold the same column, in order of preference
    "action": ["action", "action.joint_position", "action.cartesian_position"],
    "state": ["observation.state", "observation.state.joint_position", "observation.state.cartesian_position"],
    "success": ["next.success", "is_episode_successful", "success", "episode_success"],
    "reward": ["next.reward"],
    "t": ["timestamp"],
}


def frame_columns(names: list[str]) -> dict[str, str]:
    """Which of a dataset's columns stands for what."""
    return {k: next(c for c in options if c in names) for k, options in ALIASES.items() if any(c in names for c in options)}


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(episode_index, frame_index, t, action, state, success, reward, intervention, task_index) of a frame dataset's Parquet shards.

    Shards are merged by name, only the needed columns are read, a frame counts as
    an intervention if any column named so is set.
    """
    raw = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(f"{path}/data")
    got, flags = frame_columns(raw.columns), [c for c in raw.columns if "intervention" in c.lower()]
    column = lambda k, kind: (F.col(f"`{got[k]}`").cast(kind) if k in got else F.lit(None).cast(kind)).alias(k)
    flag = F.lit(False)
    for c in flags:
        flag = flag | F.coalesce(F.col(f"`{c}`").cast("boolean"), F.lit(False))
    task = F.col("task_index") if "task_index" in raw.columns else F.lit(None)
    return raw.select(F.col("episode_index").cast("long").alias("episode_index"), F.col("frame_index").cast("long").alias("frame_index"), column("t", "double"), column("action", "array<double>"), column("state", "array<double>"), column("success", "boolean"), column("reward", "double"), flag.alias("intervention"), task.cast("long").alias("task_index"))


def read_dataset_info(spark: SparkSession, path: str) -> dict:
    """fps, robot, repository, dimensions and camera keys of a frame dataset's description."""
    import json

    text = "\n".join(r.value for r in spark.read.text(f"{path}/meta/info.json").collect())
    info = json.loads(text)
    features = info.get("features") or {}
    dim = lambda *names: next((int(features[n]["shape"][0]) for n in names if n in features and features[n].get("shape")), None)
    return {
        "fps": float(info.get("fps") or 30),
        "robot": info.get("robot_type"),
        "repo_id": info.get("repo_id"),
        "action_dim": dim(*ALIASES["action"]),
        "state_dim": dim(*ALIASES["state"]),
        "cameras": sorted(k for k, v in features.items() if v.get("dtype") in ("video", "image")),
    }


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("task_index long, task string").json(f"{path}/meta/tasks.jsonl")


def episodes_from_frames(frames: DataFrame, tasks: DataFrame | None, repo_id: str, fps: float = 30.0, policy: str = "unknown") -> DataFrame:
    """One row per episode: outcome, duration, spans of intervention, task.

    An episode succeeded if any recorded success flag is set; without flags, if its
    last reward is 1.  Times are frame numbers over fps where none are recorded.
    """
    w = Window.partitionBy("episode_index").orderBy("frame_index")
    df = frames.withColumn("step", F.row_number().over(w) - 1).withColumn("t", F.coalesce("t", F.col("step") / float(fps)))
    own = Window.partitionBy("episode_index", "intervention").orderBy("frame_index")
    df = df.withColumn("island", F.col("step") - F.row_number().over(own)).withColumn("next_t", F.lead("t").over(w))
    spans = df.where("intervention").groupBy("episode_index", "island").agg(F.min("t").alias("t_start"), F.max_by(F.coalesce("next_t", "t"), "step").alias("t_end"))
    spans = spans.groupBy("episode_index").agg(F.array_sort(F.collect_list(F.struct("t_start", "t_end", F.lit("teleop").alias("source")))).alias("interventions"))
    last_reward = F.max_by("reward", F.when(F.col("reward").isNotNull(), F.col("step")))
    eps = df.groupBy("episode_index").agg(
        F.coalesce(F.bool_or("success"), last_reward >= 1 - 1e-6).alias("success"), (F.max("t") - F.min("t")).alias("duration_s"), F.count("*").alias("n_frames"), F.min_by("task_index", "step").alias("task_index")
    )
    out = eps.join(spans, "episode_index", "left")
    if tasks is not None:
        out = out.join(F.broadcast(tasks), "task_index", "left")  # a dataset's own task list, a handful of rows
    else:
        out = out.withColumn("task", F.lit(None).cast("string"))
    none = F.array().cast("array<struct<t_start:double,t_end:double,source:string>>")
    return out.select(
        F.concat(F.lit(f"{repo_id}#"), "episode_index").alias("episode_id"),
        F.coalesce("task", F.col("task_index").cast("string"), F.lit("unknown")).alias("task"),
        F.lit(policy).alias("policy"),
        F.lit(None).cast("string").alias("unit_id"),
        "success",
        F.col("success").cast("double").alias("score"),
        "duration_s",
        F.when(F.col("success"), F.col("duration_s")).alias("time_to_success"),
        F.coalesce("interventions", none).alias("interventions"),
        "n_frames",
    )


def read_excitation(spark: SparkSession, path: str, unit_id: str = "unknown") -> DataFrame:
    """(unit_id, joint, t, cmd, meas) of a wide CSV with columns t, cmd_<joint>, meas_<joint>."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    joints = sorted(c[4:] for c in raw.columns if c.startswith("cmd_") and f"meas_{c[4:]}" in raw.columns)
    if not joints:
        raise ValueError("no pairs of cmd_ and meas_ columns")
    entries = F.array(*[F.struct(F.lit(j).alias("joint"), F.col(f"`cmd_{j}`").cast("double").alias("cmd"), F.col(f"`meas_{j}`").cast("double").alias("meas")) for j in joints])
    return raw.select(F.col("t").cast("double").alias("t"), F.explode(entries).alias("e")).select(F.lit(unit_id).alias("unit_id"), "e.joint", "t", "e.cmd", "e.meas")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, sha256) of every file under a folder, hashed on the executors."""
    base = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    return files.select(F.regexp_replace("path", f"^.*{re.escape(base.split('://')[-1])}/", "").alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


@F.pandas_udf(T.StringType())
def safetensors_header(prefix):
    """The JSON header of a tensor file's first bytes: 8 bytes of length, little-endian, then the text; null if it is none."""

    def one(data):
        n = int.from_bytes(data[:8], "little") if data is not None and len(data) >= 8 else -1
        try:
            return bytes(data[8 : 8 + n]).decode() if 0 < n <= len(data) - 8 else None
        except UnicodeDecodeError:
            return None

    return prefix.map(one)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, scenario_hash, index, success, max_reward, steps, failure) of a run's JSON manifest; another kind of file raises."""
    schema = "kind string, run_id string, battery_hash string, results map<string,struct<index:int,success:boolean,max_reward:double,steps:int,failure:string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    kind = F.when(F.coalesce("kind", F.lit("")) == "run_manifest", F.lit(True)).otherwise(F.raise_error("not a run manifest").cast("boolean"))
    return raw.where(kind).select("run_id", "battery_hash", F.explode("results").alias("scenario_hash", "r")).select("run_id", "battery_hash", "scenario_hash", "r.*")


def numeric_prefix_order(names: Column) -> Column:
    """File names in the order of their leading number; names without one, such as 'end', come last."""
    number = lambda n: F.split(n, "[_.]")[0].try_cast("int")
    keyed = F.transform(names, lambda n: F.struct(F.coalesce(number(n), F.lit(2**31 - 1)).alias("k"), n.alias("n")))
    return F.transform(F.array_sort(keyed), lambda e: e["n"])


def label_from_path(path: Column) -> Column:
    """False for a path that names an anomaly, true for an expert's, else null."""
    p = F.lower(path)
    return F.when(p.contains("anomaly"), False).when(p.contains("expert"), True)
