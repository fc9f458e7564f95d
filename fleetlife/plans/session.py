"""Session settings the plans count on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# What a cluster session should have; all of it is adaptive, so nothing here depends on the size of the data.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Shuffle joins against a dimension hash its (evenly spread) side instead of sorting the facts.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    # Start wide and let adaptive execution coalesce: about 128 MB per partition at the largest shuffles.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(name: str = "fleetlife", cpus: str = "*", memory: str | None = None) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.driver.memory", memory or os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
