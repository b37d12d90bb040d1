"""Composed analyses: a dataset validated end to end, injected faults replayed, detectors compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.expressions import abstain_decision
from spindrift.operators import conformal, detectors, fingerprint, guard, guard_model, judge, planning, ranking, rates, steps
from spindrift.sources.imports import excitation_of
from spindrift.sources.report import Report, Section


def steps_of_frames(frames: DataFrame, chunk: int = 8) -> DataFrame:
    """Guard steps of recorded frames: features are the state and the action, chunks the actions up to each step."""
    long = steps.numbered(frames.withColumn("episode_id", F.col("episode_index").cast("string")), "episode_id", ["frame_index"])
    state = F.coalesce("state", F.array().cast("array<double>"))
    return steps.trailing_chunks(long, chunk).select("episode_id", F.col("step").cast("int").alias("step"), "t", F.concat(state, "action").alias("features"), "chunk", "state", "action", F.lit(None).cast("double").alias("gripper"))


def motion_summary(fingerprints: DataFrame) -> DataFrame:
    """(joint, stat, q25, q50, q75) over units."""
    long = fingerprint.long_fields(fingerprints).withColumn("joint", F.substring_index("stat", ".", 1)).withColumn("field", F.substring_index("stat", ".", -1))
    q = long.groupBy("joint", "field").agg(F.percentile("value", [0.25, 0.5, 0.75]).alias("q"))
    return q.select("joint", "field", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))


def judge_by_actions(features: DataFrame, labels: DataFrame, target: float = 0.1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(thresholds, predictions on held-out episodes) of a judge that sees action features alone: 40/30/30 by label."""
    rows = planning.split(features.join(labels, "episode_id"), "episode_id", [("train", 0.4), ("cal", 0.3), ("test", 0.3)], ["y"], seed)
    model = judge.fit_fusion(rows.where("part = 'train'"), steps.FEATURES)
    scored = rows.withColumn("score", model.probability())
    cuts = conformal.calibrate(scored.where("part = 'cal'").select("score", "y"), target)
    test = scored.where("part = 'test'").join(F.broadcast(cuts.select("t_fail", "t_succ")), F.lit(True))  # the cuts are one row
    return cuts, test.select("episode_id", "y", "score", "duration_s", F.lit("ALL").alias("task"), abstain_decision("score", "t_fail", "t_succ").alias("decision"))


def validate(frames: DataFrame, episodes: DataFrame, name: str, alpha: float = 0.1, least_per_class: int = 6) -> Report:
    """A dataset's fleet numbers, fingerprints, action judge and guard, as far as its labels allow.

    frames as read_frames gives them, episodes as episodes_from_frames does.
    """
    sections = [Section.of("Fleet", rates.fleet_metrics(episodes))]
    prints = fingerprint.unit_fingerprint(excitation_of(frames))
    sections.append(Section.of("Joints", motion_summary(prints).orderBy("joint", "field")))
    guarded = steps_of_frames(frames).cache()
    try:
        labels = episodes.where("success is not null").select(F.element_at(F.split("episode_id", "#"), -1).alias("episode_id"), F.col("success").cast("int").alias("y"), "duration_s")
        counts = {r.y: r["count"] for r in labels.groupBy("y").count().collect()}
        if min(counts.get(0, 0), counts.get(1, 0)) >= least_per_class:
            features = steps.action_features(guarded).drop("duration_s")
            features = features.join(labels.select("episode_id", "duration_s"), "episode_id")
            cuts, predictions = judge_by_actions(features, labels.select("episode_id", "y"))
            sections += [Section.of("Judge thresholds", cuts), Section.of("Judge", rates.judge_metrics(predictions))]
        good = guarded.join(labels.where("y = 1").select("episode_id"), "episode_id", "left_semi")
        if counts.get(1, 0) >= 10:
            parts = planning.split(labels.where("y = 1").select("episode_id"), "episode_id", [("fit", 0.6), ("test", 0.4)])
            model = guard_model.fit(good.join(parts.where("part = 'fit'"), "episode_id", "left_semi"), alpha)
            watched = guarded.join(labels, "episode_id").join(parts.where("part = 'fit'"), "episode_id", "left_anti")
            levels = model.replay(watched.drop("y", "duration_s"))
            eps = guard.episodes_of(levels).drop("duration_s").join(labels, "episode_id").withColumn("truth", F.col("y") == 1)
            sections.append(Section.of("Guard", rates.guard_metrics(eps)))
    finally:
        guarded.unpersist()
    return Report(name, "", sections)


def faults(model: guard_model.GuardModel, recorded: DataFrame, kinds: list[tuple[str, float]], tolerance: float = 1.0) -> DataFrame:
    """(kind, size, n, hits, median latency) of faults injected at each episode's middle and replayed through the guard."""
    whole = Window.partitionBy("episode_id")
    middle = F.floor(F.max("step").over(whole) / 2)
    onsets = recorded.withColumn("m", middle).where("step = m").select("episode_id", F.col("t").alias("onset_t"))
    out = []
    for kind, size in kinds:  # a handful of named faults
        broken = steps.inject_fault(recorded.drop("chunk"), middle, kind, size)
        broken = steps.trailing_chunks(broken, recorded.select(F.size("chunk")).first()[0])
        levels = model.replay(broken.select("episode_id", "step", "t", "features", "chunk", "state"))
        hit = guard.alert_after_onset(levels, onsets, tolerance)
        out.append(hit.agg(F.lit(kind).alias("kind"), F.lit(float(size)).alias("size"), F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"), F.percentile("latency_s", 0.5).alias("latency_s")))
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first


def compare_detectors(fitted: DataFrame, judged: DataFrame, truth: DataFrame) -> DataFrame:
    """(detector, auroc, n_pos, n_neg) of detectors fitted on nominal steps against episodes whose y is 1 where they failed."""
    mean, covariance, _ = guard.ledoit_wolf(fitted)
    made = {"mahalanobis": guard.mahalanobis(mean, covariance)("features"), "pca": detectors.pca(fitted)("features"), "density": detectors.mixture_density(fitted)("features"), "isolation": detectors.isolation_forest(fitted)("features"), "action_variance": detectors.action_variance()}
    scored = judged.select("episode_id", F.explode(F.array(*[F.struct(F.lit(k).alias("detector"), v.alias("score")) for k, v in made.items()])).alias("e")).select("episode_id", "e.*")
    top = scored.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("detector", "episode_id").agg(F.max("score").alias("score"))
    return ranking.auroc(top.join(truth, "episode_id"), ["detector"])
