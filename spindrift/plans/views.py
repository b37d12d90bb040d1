"""Robot-evaluation tables derived from the test tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _micros():
    """Microseconds since 1970 of the wall-clock time ts, whatever the session's zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


def trials(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    success = (F.col("o_totalprice") > 250000).cast("int")
    time = (1 + F.col("o_orderkey") % 29).cast("double")
    return o.select(
        F.col("o_orderkey").cast("string").alias("episode_id"),
        F.col("o_orderpriority").alias("policy"),
        F.col("o_orderstatus").alias("task"),
        success.alias("success"),
        F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0).alias("score"),
        F.lit(30.0).alias("timeout"),
        F.when(success == 1, time).alias("time_to_success"),
        F.when(F.col("o_custkey") % 17 == 0, F.lit("")).otherwise(F.col("o_custkey").cast("string")).alias("pair_id"),
        F.col("o_orderkey").alias("pos"),
    )


TRIALS = """trials AS (SELECT cast(o_orderkey AS VARCHAR) AS episode_id, o_orderpriority AS policy, o_orderstatus AS task, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS success,
    least(1.0::DOUBLE, o_totalprice / 500000.0) AS score, 30.0::DOUBLE AS timeout, CASE WHEN o_totalprice > 250000 THEN (1 + o_orderkey % 29)::DOUBLE END AS time_to_success,
    CASE WHEN o_custkey % 17 = 0 THEN '' ELSE cast(o_custkey AS VARCHAR) END AS pair_id, o_orderkey AS pos FROM orders)"""
TIMES = """times AS (SELECT policy, task, CASE WHEN success = 1 THEN time_to_success ELSE timeout END AS time, success AS event FROM trials)"""


def times(spark, d) -> DataFrame:
    from spindrift.operators.survival import censored_time

    time, event = censored_time()
    return trials(spark, d).select("policy", "task", time.alias("time"), event.alias("event"))


def claims(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_discount")
    got = li.groupBy(F.col("l_returnflag").alias("policy"), F.col("l_linestatus").alias("task")).agg(F.sum((F.col("l_discount") >= 0.05).cast("long")).alias("successes"), F.count("*").alias("trials"))
    return got.withColumn("pos", F.row_number().over(Window.orderBy("policy", "task")))  # at most six claims


CLAIMS = """claims AS (SELECT *, row_number() OVER (ORDER BY policy, task) AS pos FROM (SELECT l_returnflag AS policy, l_linestatus AS task,
    sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END)::BIGINT AS successes, count(*) AS trials FROM lineitem GROUP BY ALL))"""


def episodes(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_type", "value")
    t = _micros() / 1e6
    start = F.col("t")
    source = F.when(F.col("event_type") == "error", "teleop").when(F.col("event_type") == "signup", "verbal")
    e = e.withColumn("t", t).withColumn("day", F.to_date("ts"))
    own = F.when(source.isNotNull(), F.struct(start.alias("t_start"), F.when(F.col("value") > 20, start + F.col("value") / 10).alias("t_end"), source.alias("source")))
    got = e.groupBy("user_id", "day").agg((F.max("t") - F.min("t") + 60).alias("duration_s"), F.sort_array(F.collect_list(own)).alias("interventions"), F.max_by("event_type", "t").alias("last"), F.count("*").alias("n"))
    return got.select(
        F.concat_ws("@", F.col("user_id").cast("string"), F.date_format("day", "yyyy-MM-dd")).alias("episode_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("policy"),
        F.when(F.col("user_id") % 7 == 0, None).otherwise(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string"))).alias("unit_id"),
        F.when(F.col("n") % 5 == 0, None).otherwise(F.col("last") != "error").alias("success"),
        "duration_s",
        "interventions",
        F.when(F.col("last") == "error", "grasp").when(F.col("last") == "view", "timeout").alias("failure_class"),
        F.col("last"),
    )


EPISODES = """raw AS (SELECT user_id, CAST(ts AS DATE) AS day, epoch_us(ts) / 1e6 AS t, event_type, value FROM events),
    iv AS (SELECT user_id, day, count(*) AS n_int, count(*) FILTER (event_type = 'error') AS manual, sum(CASE WHEN value > 20 THEN (t + value / 10) - t ELSE 0 END) AS int_s FROM raw WHERE event_type IN ('error', 'signup') GROUP BY ALL),
    ep AS (SELECT user_id, day, max(t) - min(t) + 60 AS duration_s, max_by(event_type, t) AS last, count(*) AS n FROM raw GROUP BY ALL),
    episodes AS (SELECT cast(user_id AS VARCHAR) || '@' || strftime(day, '%Y-%m-%d') AS episode_id, 'p' || (user_id % 3) AS policy, CASE WHEN user_id % 7 = 0 THEN 'unknown' ELSE 'u' || (user_id % 7) END AS unit_id,
        CASE WHEN n % 5 = 0 THEN NULL WHEN last <> 'error' THEN 1 ELSE 0 END AS success, duration_s, coalesce(n_int, 0) AS n_int, coalesce(manual, 0) = 0 AS autonomous, coalesce(int_s, 0) AS int_s,
        CASE last WHEN 'error' THEN 'grasp' WHEN 'view' THEN 'timeout' END AS failure_class, last FROM ep LEFT JOIN iv USING (user_id, day))"""


def steps(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_type", "value", "props")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id") if "event_id" in e.columns else Window.partitionBy("user_id").orderBy("ts")
    t = _micros()
    e = e.withColumn("step", (F.row_number().over(w) - 1).cast("int")).withColumn("t", (t - F.min(t).over(Window.partitionBy("user_id"))) / 1e6 / 3600)
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("user_id").cast("string").alias("episode_id"), "step", "t", F.array(F.col("value") / 10, k).alias("action"), (F.col("value") / 100).alias("gripper"), "event_type")


STEPS = """steps AS (SELECT cast(user_id AS VARCHAR) AS episode_id, (row_number() OVER w - 1)::INTEGER AS step, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 / 3600 AS t,
    value / 10 AS x, cast(json_extract_string(props, '$.k') AS DOUBLE) AS y, value / 100 AS gripper, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    moved AS (SELECT *, coalesce(sqrt((x - lag(x) OVER e) ** 2 + (y - lag(y) OVER e) ** 2), sqrt((lead(x) OVER e - x) ** 2 + (lead(y) OVER e - y) ** 2), 0) AS motion FROM steps WINDOW e AS (PARTITION BY episode_id ORDER BY step))"""


def scores(spark, d) -> DataFrame:
    """Judge scores of labelled documents: y is the quality label, task the language."""
    j = table(spark, d, "labels").select("doc_id", "quality").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    noise = F.col("doc_id") * 37 % 101 / 101.0
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.35 * F.col("quality") + 0.65 * noise)), 4)
    return j.select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), score.alias("score"), F.coalesce("lang", F.lit("none")).alias("task"), (F.col("n_chars") / 100.0).alias("duration_s"))


SCORES = """scores AS (SELECT doc_id AS id, quality AS y, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.35::DOUBLE * quality + 0.65::DOUBLE * (doc_id * 37 % 101 / 101.0::DOUBLE))), 4) AS score,
    coalesce(lang, 'none') AS task, n_chars / 100.0::DOUBLE AS duration_s FROM labels JOIN documents USING (doc_id))"""


def guard_episodes(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    detected = p > 300000
    return o.select(
        k.alias("id"), F.when(k % 11 == 0, None).otherwise(k % 3 != 0).alias("truth"), detected.alias("detected"), F.when(detected, (p % 97).cast("double")).alias("lead_time_s"), (10 + k % 50).cast("double").alias("duration_s"), F.when(detected, 1 + k % 3).otherwise(0).alias("n_alert_onsets"), (p > 480000).alias("stopped")
    )


GUARD = """g AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 3 <> 0 END AS truth, o_totalprice > 300000 AS detected, CASE WHEN o_totalprice > 300000 THEN o_totalprice % 97 END AS lead_time_s,
    (10 + o_orderkey % 50)::DOUBLE AS duration_s, CASE WHEN o_totalprice > 300000 THEN 1 + o_orderkey % 3 ELSE 0 END AS n_alert_onsets, o_totalprice > 480000 AS stopped FROM orders)"""


def run(spark, d, which: str) -> DataFrame:
    """A run over the battery of parts: success, reward and steps from hashes of the part's own numbers."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    k, size = F.col("p_partkey"), F.col("p_size")
    base = (k * 7919 % 100) >= 30
    passed = {"a": base, "b": base & ~((size > 35) & (k % 2 == 0)) | (~base & (k % 13 == 0)), "a2": F.when(k % 29 == 0, ~base).otherwise(base)}[which]
    steps_ = {"a": k % 400, "b": k % 397, "a2": F.when(k % 31 == 0, k % 400 + 1).otherwise(k % 400)}[which]
    return p.select(F.sha2(k.cast("string").cast("binary"), 256).alias("scenario_hash"), k.alias("index"), passed.alias("success"), (k % 5).cast("double").alias("max_reward"), steps_.cast("int").alias("steps"))


def _run_sql(which: str) -> str:
    base = "(p_partkey * 7919 % 100) >= 30"
    passed = {"a": base, "b": f"({base} AND NOT (p_size > 35 AND p_partkey % 2 = 0)) OR (NOT {base} AND p_partkey % 13 = 0)", "a2": f"CASE WHEN p_partkey % 29 = 0 THEN NOT ({base}) ELSE {base} END"}[which]
    steps_ = {"a": "p_partkey % 400", "b": "p_partkey % 397", "a2": "CASE WHEN p_partkey % 31 = 0 THEN p_partkey % 400 + 1 ELSE p_partkey % 400 END"}[which]
    return f"run_{which} AS (SELECT sha256(cast(p_partkey AS VARCHAR)) AS scenario_hash, p_partkey AS index, {passed} AS success, (p_partkey % 5)::DOUBLE AS max_reward, ({steps_})::INTEGER AS steps FROM part)"


RUN_A, RUN_B, RUN_A2 = _run_sql("a"), _run_sql("b"), _run_sql("a2")


def factors(spark, d) -> DataFrame:
    """(scenario_hash, broken, factors) of the parts: size, and price about its middle."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    broken = ((F.col("p_size") > 35) & (k % 2 == 0)) | (k % 19 == 0)
    entries = F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), F.col("p_retailprice") - 950)
    return p.select(F.sha2(k.cast("string").cast("binary"), 256).alias("scenario_hash"), broken.alias("broken"), entries.alias("factors"))


FACTORS = """long AS (SELECT sha256(cast(p_partkey AS VARCHAR)) AS scenario_hash, factor, CASE factor WHEN 'size' THEN p_size::DOUBLE WHEN 'price' THEN p_retailprice - 950 WHEN 'abs_price' THEN abs(p_retailprice - 950) END AS value,
    (p_size > 35 AND p_partkey % 2 = 0) OR p_partkey % 19 = 0 AS broken FROM part, (VALUES ('size'), ('price'), ('abs_price')) AS f(factor) WHERE factor <> 'abs_price' OR (SELECT min(p_retailprice) < 950 AND max(p_retailprice) > 950 FROM part))"""


def comparisons(spark, d) -> DataFrame:
    """Games between the priorities of a customer's consecutive orders; the dearer order wins, near prices tie."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    nxt, price = F.lead("o_orderpriority").over(w), F.lead("o_totalprice").over(w)
    gap = F.col("o_totalprice") - F.col("price")
    games = o.withColumn("policy_j", nxt).withColumn("price", price).where(F.col("policy_j").isNotNull() & (F.col("policy_j") != F.col("o_orderpriority")))
    return games.select(F.col("o_orderpriority").alias("policy_i"), "policy_j", F.when(F.abs(gap) < 10000, 0.5).when(gap > 0, 1.0).otherwise(0.0).alias("outcome"))


COMPARISONS = """games AS (SELECT o_orderpriority AS policy_i, lead(o_orderpriority) OVER w AS policy_j, o_totalprice - lead(o_totalprice) OVER w AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    comparisons AS (SELECT policy_i, policy_j, CASE WHEN abs(gap) < 10000 THEN 0.5 WHEN gap > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS outcome FROM games WHERE policy_j <> policy_i)"""


def manifests(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two long manifests per nation: the values of the first supplier and of the last one."""
    s = table(spark, d, "supplier")
    pick = lambda order: s.groupBy("s_nationkey").agg(F.min_by(F.struct("s_suppkey", "s_acctbal"), order).alias("s")).select("s_nationkey", "s.*")

    def long(df):
        k = F.col("s_suppkey")
        values = {"action.dim": (k % 3).cast("string"), "action.mode": F.when(k % 5 == 0, "unknown").otherwise("delta"), "embodiment.robot": F.lit("arm"), "runtime.dtype": F.when(k % 2 == 0, "fp16").otherwise("bf16"), "policy.name": k.cast("string"), "action.units": F.when(k % 7 == 0, None).otherwise(F.lit("rad"))}
        return df.select(F.col("s_nationkey").alias("site"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in values.items()])).alias("e")).select("site", "e.*")

    return long(pick(F.col("s_suppkey"))), long(pick(-F.col("s_suppkey")))


_FIELDS = [("action.dim", "cast(k % 3 AS VARCHAR)"), ("action.mode", "CASE WHEN k % 5 = 0 THEN 'unknown' ELSE 'delta' END"), ("embodiment.robot", "'arm'"), ("runtime.dtype", "CASE WHEN k % 2 = 0 THEN 'fp16' ELSE 'bf16' END"), ("policy.name", "cast(k AS VARCHAR)"), ("action.units", "CASE WHEN k % 7 = 0 THEN NULL ELSE 'rad' END")]
MANIFESTS = "ends AS (SELECT s_nationkey AS site, min(s_suppkey) AS first, max(s_suppkey) AS last FROM supplier GROUP BY ALL), " + ", ".join(
    f"{name} AS (" + " UNION ALL ".join(f"SELECT site, '{f}' AS field, {v.replace('k ', col + ' ').replace('(k ', '(' + col + ' ')} AS value FROM ends" for f, v in _FIELDS) + ")" for name, col in (("evaluated", "first"), ("deployed", "last"))
)


def excitation(spark, d) -> DataFrame:
    """Commands and what followed, per user as a unit and event parity as a joint: a lagging, scaled and offset copy."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    w = Window.partitionBy("user_id", "joint").orderBy("ts")
    e = e.withColumn("joint", F.concat(F.lit("j"), (F.col("event_id") % 2).cast("string"))).withColumn("k", F.row_number().over(w))
    cmd = F.sin(F.col("k") / 7.0 + F.col("user_id"))
    meas = 0.95 * F.sin((F.col("k") - 1) / 7.0 + F.col("user_id")) + 0.01 * (F.col("user_id") % 4) + 0.0001 * F.col("value")
    return e.select(F.col("user_id").cast("string").alias("unit_id"), "joint", (F.col("k") * 0.1).alias("t"), cmd.alias("cmd"), meas.alias("meas"))


def embeddings(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")


def verdict_texts(spark, d) -> DataFrame:
    """Judge replies made of conversations: valid, fenced, out of range and garbage."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    k = F.col("conv_id") * 3 + F.col("turn")
    p = (k % 140 / 100.0).cast("string")
    body = F.concat(F.lit('{"success_prob": '), p, F.lit(', "failure_class": "'), F.when(k % 3 == 0, "Grasp").when(k % 3 == 1, "nonsense").otherwise("timeout"), F.lit('", "rationale": "saw it"}'))
    text = F.when(k % 7 == 0, "no verdict here").when(k % 7 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone"))).when(k % 7 == 2, F.concat(F.lit("I think "), body, F.lit(" ok"))).when(k % 7 == 3, '{"success_prob": "high"}').otherwise(body)
    return c.select("conv_id", "turn", k.alias("k"), text.alias("text"))
