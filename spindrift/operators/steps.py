"""Per-step sequence operators over (episode_id, step, t, ...): motion, runs, chunks and windowed features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.expressions import chunk_variance, distance, mean_vector, norm


def _episode():
    return Window.partitionBy("episode_id").orderBy("step")


def numbered(frames: DataFrame, key: str, order: list, fps: float = 30.0, most_episodes: int | None = None) -> DataFrame:
    """step from 0 in each episode, t = step / fps where no time is recorded, and the first episodes by id if limited."""
    w = Window.partitionBy(key).orderBy(*order)
    out = frames.withColumn("step", F.row_number().over(w) - 1)
    t = F.col("step") / float(fps)
    out = out.withColumn("t", F.coalesce("t", t) if "t" in frames.columns else t)
    if most_episodes is not None:
        ids = frames.select(key).distinct().orderBy(key).limit(most_episodes)
        out = out.join(ids, key, "left_semi")
    return out


def motion(steps: DataFrame, vector: str = "action", name: str = "motion") -> DataFrame:
    """Distance to the step before; the first step takes the second's, a lone one 0."""
    back = distance(vector, F.lag(vector).over(_episode()))
    ahead = distance(F.lead(vector).over(_episode()), vector)
    return steps.withColumn(name, F.coalesce(back, ahead, F.lit(0.0)))


def runs(flags: DataFrame, flag: str) -> DataFrame:
    """Maximal runs of set flags: (episode_id, first_step, last_step, n, t_start, t_end).

    t_end is the time of the first step after the run, or the run's last step if
    the episode ends with it.
    """
    own = Window.partitionBy("episode_id", flag).orderBy("step")
    marked = flags.withColumn("island", F.row_number().over(_episode()) - F.row_number().over(own)).withColumn("next_t", F.lead("t").over(_episode())).where(F.col(flag))
    return marked.groupBy("episode_id", "island").agg(
        F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count("*").alias("n"), F.min("t").alias("t_start"), F.max_by(F.coalesce("next_t", "t"), "step").alias("t_end")
    ).drop("island")


def toggles(steps: DataFrame, flag: str) -> DataFrame:
    """How often the flag changes in each episode."""
    before = F.lag(flag).over(_episode())
    return steps.withColumn("__c", (F.col(flag) != before).cast("int")).groupBy("episode_id").agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("toggles"))


def forward_chunks(steps: DataFrame, size: int, vector: str = "action") -> DataFrame:
    """chunk: the vectors of this step and the next ones; steps too near the end are left out."""
    w = _episode().rowsBetween(0, size - 1)
    return steps.withColumn("chunk", F.collect_list(vector).over(w)).where(F.size("chunk") == size)


def trailing_chunks(steps: DataFrame, size: int, vector: str = "action") -> DataFrame:
    """chunk: the vectors up to this step, padded at the front with the episode's first."""
    w = _episode().rowsBetween(-(size - 1), 0)
    seen = F.collect_list(vector).over(w)
    return steps.withColumn("chunk", F.concat(F.array_repeat(F.element_at(seen, 1), F.greatest(F.lit(0), F.lit(size) - F.size(seen))), seen))


def chunk_consistency(steps: DataFrame, stride: int | None = None) -> DataFrame:
    """raw: mean distance of the overlap of this chunk with the one before; the first step's is 0.

    The stride is half a chunk unless given; chunks that do not overlap are
    compared at their ends.
    """
    before, size = F.lag("chunk").over(_episode()), F.size("chunk")
    s = F.lit(stride) if stride is not None else F.greatest(F.lit(1), F.floor(size / 2).cast("int"))
    pairs = F.when(s < size, F.zip_with(F.slice(F.col("before"), s + 1, size - s), F.slice(F.col("chunk"), F.lit(1), size - s), distance)).otherwise(
        F.array(distance(F.element_at("before", -1), F.element_at("chunk", 1)))
    )
    mean = F.aggregate(F.col("gaps"), F.lit(0.0), lambda a, x: a + x) / F.size("gaps")
    return steps.withColumn("before", before).withColumn("gaps", F.when(F.col("before").isNotNull(), pairs)).withColumn("raw", F.when(F.col("before").isNull(), 0.0).otherwise(mean)).drop("before", "gaps")


def temporal_inconsistency(steps: DataFrame) -> DataFrame:
    """Per episode: mean distance of every chunk's overlap (by one step) with the next, and mean chunk variance."""
    before, size = F.lag("chunk").over(_episode()), F.size("chunk")
    gaps = F.zip_with(F.slice(F.col("before"), F.lit(2), size - 1), F.slice(F.col("chunk"), F.lit(1), size - 1), distance)
    got = steps.withColumn("before", before).select("episode_id", F.explode_outer(F.when((size > 1) & F.col("before").isNotNull(), gaps)).alias("gap"))
    gap = got.groupBy("episode_id").agg(F.coalesce(F.avg("gap"), F.lit(0.0)).alias("temporal_inconsistency"))
    spread = steps.groupBy("episode_id").agg(F.avg(F.when(size > 1, chunk_variance("chunk")).otherwise(0.0)).alias("chunk_variance"))
    return gap.join(spread, "episode_id")


def stagnation_raw(steps: DataFrame, window: int = 25) -> DataFrame:
    """raw: mean motion of the chunk means over the last `window` moves; null at the first step."""
    mid = mean_vector("chunk")
    moved = steps.withColumn("mid", mid).withColumn("move", distance("mid", F.lag("mid").over(_episode())))
    return moved.withColumn("raw", F.avg("move").over(_episode().rowsBetween(-(window - 1), 0))).drop("mid", "move")


def stagnation_score(steps: DataFrame, floor: float, log_mean: float, log_std: float) -> Column:
    """How far below nominal the log of raw lies, in standard deviations, at least 0; a first step is 0."""
    z = (F.lit(log_mean) - F.log(F.col("raw") + floor)) / log_std
    return F.coalesce(F.greatest(F.lit(0.0), z), F.lit(0.0))


def stagnation_fit(steps: DataFrame, floor_fraction: float = 0.05) -> DataFrame:
    """floor, log_mean, log_std of raw over nominal steps: the floor first, then the logs' moments."""
    raw = steps.where("raw is not null")
    floor = raw.agg(F.greatest(F.percentile("raw", 0.5) * floor_fraction, F.lit(1e-12)).alias("floor"))
    logs = raw.join(F.broadcast(floor), F.lit(True)).withColumn("l", F.log(F.col("raw") + F.col("floor")))  # the floor is one row
    return logs.agg(F.first("floor").alias("floor"), F.avg("l").alias("log_mean"), F.greatest(F.stddev_samp("l"), F.lit(1e-12)).alias("log_std"))


def moments(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """Mean and sample deviation (at least 1e-12) of the columns."""
    out = []
    for c in columns:
        out += [F.avg(c).alias(f"{c}_mean"), F.greatest(F.stddev_samp(c), F.lit(1e-12)).alias(f"{c}_std")]
    return df.groupBy(*keys).agg(*out)


def raw_motion(steps: DataFrame, vector: str = "action") -> DataFrame:
    """Per episode: steps, mean and total motion, and the spread of the vectors about their mean."""
    back = distance(vector, F.lag(vector).over(_episode()))
    long = steps.withColumn("m", back)
    sums = long.groupBy("episode_id").agg(F.count("*").alias("n_steps"), F.coalesce(F.avg("m"), F.lit(0.0)).alias("motion"), F.coalesce(F.sum("m"), F.lit(0.0)).alias("total"))
    flat = steps.select("episode_id", F.posexplode(vector).alias("dim", "x")).groupBy("episode_id", "dim").agg(F.stddev_pop("x").alias("sd"))
    return sums.join(flat.groupBy("episode_id").agg(F.avg("sd").alias("spread")), "episode_id")


FEATURES = [
    "has_actions", "duration_s", "n_steps", "control_hz", "action_mag_mean", "action_mag_max", "chunk_variance", "temporal_inconsistency", "motion_mean", "stagnation_fraction",
    "longest_stagnation_s", "gripper_toggles", "gripper_toggles_per_min", "gripper_closed_no_motion_fraction", "final_window_motion", "final_window_motion_ratio",
]


def action_features(steps: DataFrame, stagnation_abs: float = 1e-4, stagnation_rel: float = 0.1, final_window_s: float = 2.0, closed_is_high: bool = False, key: str = "episode_id") -> DataFrame:
    """The sixteen action-stream features of each episode, from (key, step, t, action, chunk, gripper).

    chunk may be an array of one vector, gripper may be null; windows and grouped
    aggregates over the long table do all of it.
    """
    by, whole = Window.partitionBy(key).orderBy("step"), Window.partitionBy(key)
    size = F.size("chunk")
    back, ahead = distance("action", F.lag("action").over(by)), distance(F.lead("action").over(by), F.col("action"))
    df = steps.withColumn("mag", norm("action")).withColumn("motion", F.coalesce(back, ahead, F.lit(0.0))).withColumn("before", F.lag("chunk").over(by))
    gaps = F.zip_with(F.slice(F.col("before"), F.lit(2), size - 1), F.slice(F.col("chunk"), F.lit(1), size - 1), distance)
    overlap = F.when((size > 1) & F.col("before").isNotNull(), F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x))
    df = df.withColumn("overlap", overlap).withColumn("variance", F.when(size > 1, chunk_variance("chunk")).otherwise(0.0)).withColumn("width", F.when(size > 1, size - 1)).drop("before")
    stats = df.groupBy(key).agg(F.percentile("motion", 0.95).alias("p95"), F.min("gripper").alias("g_lo"), F.max("gripper").alias("g_hi"), F.max("t").alias("t_last"))
    df = df.join(stats, key)
    mid = (F.col("g_lo") + F.col("g_hi")) / 2
    closed = F.when(F.col("g_hi") - F.col("g_lo") > 1e-9, F.col("gripper") > mid if closed_is_high else F.col("gripper") < mid)
    df = df.withColumn("stagnant", F.col("motion") < F.greatest(F.lit(stagnation_abs), stagnation_rel * F.col("p95"))).withColumn("closed", closed)
    own = Window.partitionBy(key, "stagnant").orderBy("step")
    df = df.withColumn("island", F.row_number().over(by) - F.row_number().over(own)).withColumn("toggled", (F.col("closed") != F.lag("closed").over(by)).cast("int"))
    df = df.withColumn("run", F.when(F.col("stagnant"), F.count("*").over(Window.partitionBy(key, "stagnant", "island"))).otherwise(0))
    late = F.col("t") >= F.col("t_last") - final_window_s
    got = df.groupBy(key).agg(
        (F.max("t") - F.min("t")).alias("duration_s"),
        F.count("*").cast("double").alias("n_steps"),
        F.avg("mag").alias("action_mag_mean"),
        F.max("mag").alias("action_mag_max"),
        F.avg("variance").alias("chunk_variance"),
        F.coalesce(F.sum("overlap") / F.sum(F.when(F.col("overlap").isNotNull(), F.col("width"))), F.lit(0.0)).alias("temporal_inconsistency"),
        F.avg("motion").alias("motion_mean"),
        F.avg(F.col("stagnant").cast("double")).alias("stagnation_fraction"),
        F.max("run").alias("longest"),
        F.coalesce(F.sum("toggled"), F.lit(0)).cast("double").alias("gripper_toggles"),
        F.avg(F.when(F.col("closed") & F.col("stagnant"), 1.0).otherwise(0.0)).alias("gripper_closed_no_motion_fraction"),
        F.avg(F.when(late, F.col("motion"))).alias("final_window_motion"),
    )
    dt = F.when((F.col("n_steps") >= 2) & (F.col("duration_s") > 0), F.col("duration_s") / (F.col("n_steps") - 1)).otherwise(1.0)
    minutes = F.col("duration_s") / 60
    return got.select(
        key,
        F.lit(1.0).alias("has_actions"),
        *[F.col(c) for c in ("duration_s", "n_steps")],
        (1 / dt).alias("control_hz"),
        *[F.col(c) for c in ("action_mag_mean", "action_mag_max", "chunk_variance", "temporal_inconsistency", "motion_mean", "stagnation_fraction")],
        (F.col("longest") * dt).alias("longest_stagnation_s"),
        "gripper_toggles",
        F.when(minutes > 0, F.col("gripper_toggles") / minutes).otherwise(F.col("gripper_toggles")).alias("gripper_toggles_per_min"),
        "gripper_closed_no_motion_fraction",
        "final_window_motion",
        F.when(F.col("motion_mean") > 0, F.col("final_window_motion") / (F.col("motion_mean") + 1e-12)).otherwise(0.0).alias("final_window_motion_ratio"),
    )


def windowed(steps: DataFrame, window_s: float, stride_s: float | None = None) -> DataFrame:
    """Steps dealt to overlapping windows (t_end - window_s, t_end]: adds window, t_start, t_end.

    Windows end every stride (half a window unless given) after the first full
    one, and once at the last step; a window of fewer than two steps is left out.
    A step's windows are computed from its own time, so there is no range join.
    """
    stride = stride_s or window_s / 2
    whole = Window.partitionBy("episode_id")
    df = steps.withColumn("t0", F.min("t").over(whole)).withColumn("t_last", F.max("t").over(whole))
    # ends t0 + window + k * stride < t_last
    count = F.greatest(F.lit(0), F.ceil((F.col("t_last") - F.col("t0") - window_s) / stride)).cast("int")
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - F.col("t0") - window_s) / stride - 1e-9)).cast("int") - 1
    last = F.floor((F.col("t") - F.col("t0")) / stride + 1e-9).cast("int") + 1
    inner = F.when(F.least(last, count - 1) >= F.greatest(F.lit(0), first), F.sequence(F.greatest(F.lit(0), first), F.least(last, count - 1)))
    df = df.withColumn("count", count).withColumn("k", F.explode(F.concat(F.coalesce(inner, F.array().cast("array<int>")), F.array(count))))
    end = F.when(F.col("k") == F.col("count"), F.col("t_last")).otherwise(F.col("t0") + window_s + F.col("k") * stride)
    df = df.withColumn("t_end", end).withColumn("t_start", F.col("t_end") - window_s).where((F.col("t") > F.col("t_start")) & (F.col("t") <= F.col("t_end")))
    df = df.withColumn("members", F.count("*").over(Window.partitionBy("episode_id", "k"))).where("members >= 2")
    return df.withColumn("window", F.concat_ws("#", F.col("episode_id").cast("string"), F.col("k").cast("string"))).drop("t0", "t_last", "count", "members")


def inject_fault(steps: DataFrame, onset: Column, kind: str, size: float = 1.0, seed: int = 0) -> DataFrame:
    """The action vector changed from the onset step on: freeze holds the onset's vector, offset and noise add multiples of the deviation before it."""
    whole = Window.partitionBy("episode_id")
    df = steps.withColumn("onset", onset)
    if kind == "freeze":
        held = F.max(F.when(F.col("step") == F.col("onset"), F.col("action"))).over(whole)
        return df.withColumn("action", F.when(F.col("step") >= F.col("onset"), held).otherwise(F.col("action")))
    long = df.select("episode_id", "step", "onset", F.posexplode("action").alias("dim", "x"))
    sd = F.stddev_pop(F.when(F.col("step") < F.col("onset"), F.col("x"))).over(Window.partitionBy("episode_id", "dim")) + 1e-9
    unit = F.lit(1.0)
    if kind == "noise":  # a normal deviate from two hashes of the place, the same on every run
        u = lambda salt: (F.pmod(F.xxhash64("episode_id", "step", "dim", F.lit(seed), F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        unit = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * 3.141592653589793 * u(2))
    moved = long.withColumn("x", F.when(F.col("step") >= F.col("onset"), F.col("x") + size * sd * unit).otherwise(F.col("x")))
    back = moved.groupBy("episode_id", "step").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("a")).select("episode_id", "step", F.transform("a", lambda e: e["x"]).alias("action"))
    return df.drop("action").join(back, ["episode_id", "step"])
