import random

from pyspark.sql import functions as F

from spindrift.operators import guard, pairs
from spindrift.streaming.guard import guard_levels, running_comparison

STEPS = "episode_id string, step int, t double, score double, threshold double, violation boolean, ts timestamp"


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_stream_folds_out_of_order_steps_as_the_batch_does(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(f"e{e}", s, float(s), rnd.choice([None, 0.1, 0.95, 2.0, 2.0]), 1.0, e == 2 and s == 20) for e in range(3) for s in range(40)]
    batch = spark.createDataFrame(rows, STEPS.rsplit(",", 1)[0])
    want = {(r.episode_id, r.step): r.level for r in guard.levels(batch).collect()}
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    stamped = spark.createDataFrame(shuffled + shuffled[:5], STEPS.rsplit(",", 1)[0]).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("step")))
    for k, part in enumerate(stamped.randomSplit([1.0, 1.0, 1.0], 3)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = guard_levels(stream).writeStream.format("memory").queryName("guard_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    drain(q)
    got = spark.table("guard_out").collect()
    assert len(got) == len(want) and {(r.episode_id, r.step): r.level for r in got} == want


def test_stream_comparison_ends_where_the_batch_does(spark, tmp_path):
    rnd = random.Random(2)
    rows = [("c", i, float(rnd.random() < 0.3), float(rnd.random() < 0.7)) for i in range(60)]
    df = spark.createDataFrame(rows, "comparison string, i int, a double, b double")
    want = pairs.confidence_sequence(df, ["comparison"], ["i"]).orderBy(F.desc("t")).first()
    for lo in (0, 20, 40):
        df.where((F.col("i") >= lo) & (F.col("i") < lo + 20)).orderBy("i").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("comparison string, i int, a double, b double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_comparison(stream).writeStream.format("memory").queryName("cmp_out").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    drain(q)
    last = spark.table("cmp_out").orderBy(F.desc("n")).first()
    assert last.n == 60 and abs(last.estimate - want.estimate) < 0.05 and last.decision in ("B_better", "undecided")
