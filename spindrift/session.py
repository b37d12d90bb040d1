"""Session helpers for tests, the bench and notebooks; on a cluster the caller's own session is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "spindrift", cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "6g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
