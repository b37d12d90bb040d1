"""Conversions of other projects' evaluation dumps into trials, comparisons and judge inputs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.expressions import binary_label

SESSION = "session string, location string, task string, slot string, policy string, partial double, binary_ double, duration double, preference string"


def read_arena_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """A row per session and policy slot of an arena dump (a YAML file per session); files that are no YAML mapping are skipped."""

    def number(x):
        try:
            return float(x)
        except (TypeError, ValueError):
            return None

    def run(batches):
        import yaml

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    doc = yaml.safe_load(bytes(content).decode())
                except (yaml.YAMLError, UnicodeDecodeError):
                    continue
                slots = doc.get("policies") if isinstance(doc, dict) else None
                for slot, p in sorted((slots or {}).items()) if isinstance(slots, dict) else ():
                    p = p if isinstance(p, dict) else {}
                    rows.append((path.rsplit("/", 2)[-2], str(doc.get("evaluation_location") or "unknown"), str(doc.get("language_instruction") or doc.get("task") or "unknown"), slot, str(p.get("policy_name") or slot), number(p.get("partial_success")), number(p.get("binary_success")), number(p.get("duration")), doc.get("preference")))
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SESSION.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.yaml").load(folder)
    return files.select("path", "content").mapInPandas(run, SESSION)


def arena_trials(sessions: DataFrame) -> DataFrame:
    """Trials of the first two slots that have a result: the score is the partial success, success its half where no binary one is given."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("partial", "binary_")))
    own = sessions.where(F.col("slot").isin("A", "B") & F.coalesce("partial", "binary_").isNotNull())
    success = F.coalesce(F.col("binary_").cast("int"), (score >= 0.5).cast("int"))
    return own.select(F.concat_ws(":", "session", "policy").alias("episode_id"), "policy", F.col("location").alias("task"), success.alias("success"), F.lit(None).cast("double").alias("time_to_success"), F.lit(None).cast("double").alias("timeout"), F.col("session").alias("pair_id"), F.col("location").alias("unit_id"), F.col("session").alias("session_id"), F.round(score, 4).alias("score"))


def arena_comparisons(sessions: DataFrame) -> DataFrame:
    """(policy_i, policy_j, outcome, bucket) of sessions with two slots: the evaluator's preference, else the better partial success, else a tie."""
    side = lambda s, c: F.max(F.when(F.col("slot") == s, F.col(c)))
    both = sessions.groupBy("session").agg(side("A", "policy").alias("policy_i"), side("B", "policy").alias("policy_j"), side("A", "partial").alias("a"), side("B", "partial").alias("b"), F.upper(F.trim(F.max("preference"))).alias("preference"), F.max("location").alias("bucket"))
    better = F.when(F.col("a") > F.col("b"), 1.0).when(F.col("a") < F.col("b"), 0.0).otherwise(0.5)
    outcome = F.when(F.col("preference") == "A", 1.0).when(F.col("preference") == "B", 0.0).otherwise(better)
    return both.where("policy_i is not null and policy_j is not null").select("policy_i", "policy_j", outcome.alias("outcome"), "bucket")


def read_trial_logs(spark: SparkSession, folder: str, timeout: float = 180.0) -> DataFrame:
    """Trials of every trial_log.csv below a folder; only success and full_success count, and only they have a time."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "trial_log.csv").csv(folder, header=True)
    raw = raw.where(~F.col("_metadata.file_path").contains("/.cache/")).withColumn("__parent", F.element_at(F.split("_metadata.file_path", "/"), -2))
    has = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in raw.columns else F.lit(None).cast("string")
    config = F.coalesce(has("model_config"), F.col("__parent"))
    outcome = F.coalesce(F.lower(has("outcome")), F.lit(""))
    success = outcome.isin("success", "full_success")
    return raw.select(
        F.concat_ws("-", config, has("trial_id")).alias("episode_id"), F.concat(config, F.lit("@"), F.coalesce(has("checkpoint_step"), F.lit(""))).alias("policy"), F.lit("ALL").alias("task"), success.cast("int").alias("success"),
        F.when(success, has("time_to_completion_sec").cast("double")).alias("time_to_success"), F.lit(timeout).alias("timeout"), config.alias("session_id"), success.cast("double").alias("score"), outcome.alias("outcome_class"),
    )


def claims_of(trials: DataFrame) -> DataFrame:
    """(policy, task, successes, trials): what a table of trials claims."""
    return trials.groupBy("policy", "task").agg(F.sum("success").cast("long").alias("successes"), F.count("success").alias("trials"))


def outcome_table(trials: DataFrame, classes: list[str]) -> DataFrame:
    """Counts of the named outcome classes of each policy, a column each."""
    return trials.groupBy("policy").pivot("outcome_class", classes).count().na.fill(0)


JUDGE_INPUT = "episode_id string, task string, instruction string, label string, frames array<string>, duration_s double, actions_npz string"


def read_judge_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled episodes from JSON lines; a label that is neither success nor failure fails the job, relative paths are taken from the file's folder."""
    raw = spark.read.schema(JUDGE_INPUT).option("mode", "FAILFAST").json(path).withColumn("__base", F.regexp_replace("_metadata.file_path", "/[^/]*$", ""))
    full = lambda p: F.when(p.rlike("^(/|[a-zA-Z][a-zA-Z0-9+.-]*:)"), p).otherwise(F.concat_ws("/", "__base", p))
    y = binary_label(F.when(F.lower(F.trim("label")).isin("success", "failure"), F.col("label")).otherwise(F.concat(F.lit("label of "), F.coalesce("episode_id", F.lit("?")))))
    return raw.select("episode_id", F.coalesce("task", F.lit("unknown")).alias("task"), F.coalesce("instruction", F.lit("")).alias("instruction"), y.alias("y"), F.transform("frames", full).alias("frames"), "duration_s", full(F.col("actions_npz")).alias("actions_npz"))


def match_columns(names: list[str], patterns: dict[str, str]) -> dict[str, str]:
    """The first column that each pattern finds; a pattern that finds none is left out."""
    import re

    found = {k: next((n for n in names if re.search(p, n, re.IGNORECASE)), None) for k, p in patterns.items()}
    return {k: v for k, v in found.items() if v is not None}


def read_labelled_frames(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """(episode_id, y, frames) of a Parquet set whose columns are found by pattern: episode, label, frame and, where there is one, order."""
    raw = spark.read.parquet(path)
    c = match_columns(raw.columns, patterns)
    order = F.col(c["order"]) if "order" in c else F.monotonically_increasing_id()
    rows = raw.select(F.col(c["episode"]).cast("string").alias("episode_id"), binary_label(c["label"]).alias("y"), F.struct(order.alias("k"), F.col(c["frame"]).alias("f")).alias("e"))
    got = rows.groupBy("episode_id").agg(F.max("y").alias("y"), F.array_sort(F.collect_list("e")).alias("e"))
    return got.select("episode_id", "y", F.transform("e", lambda x: x["f"]).alias("frames"))


def folder_label(path: Column) -> Column:
    """The label that a file's folder names, or null."""
    return F.nullif(F.lower(F.regexp_extract(path, "/(success|succeeded|fail|failed|failure)[^/]*/[^/]*$", 1)), F.lit(""))


def successful_pool(steps: DataFrame, most: int | None = None) -> DataFrame:
    """Steps of the episodes labelled successful, of the first `most` of them by id."""
    ids = steps.where(F.lower("truth").isin("success", "true", "1")).select("episode_id").distinct()
    if most is not None:
        ids = ids.orderBy("episode_id").limit(most)
    return steps.join(ids, "episode_id", "left_semi")


def excitation_of(frames: DataFrame, least: int = 20) -> DataFrame:
    """(unit_id, joint, t, cmd, meas) of the episodes with states as wide as their actions and at least so many steps."""
    facts = frames.groupBy("episode_index").agg(F.count("*").alias("n"), F.bool_and(F.col("state").isNotNull() & (F.size("state") == F.size("action"))).alias("ok"), F.min("t").alias("t0"))
    own = frames.join(facts.where((F.col("n") >= least) & F.col("ok")), "episode_index")
    return own.select("episode_index", (F.col("t") - F.col("t0")).alias("t"), "state", F.posexplode("action").alias("k", "cmd")).select(F.col("episode_index").cast("string").alias("unit_id"), F.concat(F.lit("j"), F.col("k")).alias("joint"), "t", "cmd", F.element_at("state", F.col("k") + 1).alias("meas"))
