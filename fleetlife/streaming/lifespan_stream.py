"""Lifespans and daily failure counts kept current as telemetry arrives."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.lifespan import lifespans


def telemetry_stream(
    spark: SparkSession, path: str, schema: T.StructType, file_glob: str | None = None, files_per_batch: int = 1000,
) -> DataFrame:
    """Parquet files as they land below ``path``."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    return reader.parquet(path)


def keep_lifespans(facts: DataFrame, table: str, checkpoint: str, device: str = "drive_id") -> StreamingQuery:
    """Start the job that keeps per-device lifespans current and run it over everything available.

    State is one row per device (first, last and failure day). Minimum and maximum do not depend on order, so late
    files need no watermark and a repeated file changes nothing. Every micro-batch overwrites its own folder of a change
    table with the devices it touched, so a retried batch leaves no trace. The folder carries a name that is kept with the
    checkpoint: a job that starts anew with another checkpoint does not overwrite what earlier ones found.
    """
    spark = facts.sparkSession
    run = _run_name(spark, checkpoint)

    def save(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table}/run={run}/batch={batch}")

    return (
        lifespans(facts, device=device).writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _run_name(spark: SparkSession, checkpoint: str) -> str:
    """A name stored below the checkpoint when a job starts there for the first time."""
    folder = f"{checkpoint}/run-name"
    try:
        return spark.read.schema("name string").text(folder).first()["name"]
    except AnalysisException:
        name = uuid.uuid4().hex
        spark.createDataFrame([(name,)], "name string").coalesce(1).write.text(folder)
        return name


def current_lifespans(spark: SparkSession, table: str, device: str = "drive_id") -> DataFrame:
    """The latest state per device out of snapshot and changes; extremes make their order irrelevant."""
    return spark.read.option("basePath", table).parquet(table).groupBy(device).agg(
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
        F.max("failure_day").alias("failure_day"))


def compact_changes(spark: SparkSession, table: str, device: str = "drive_id") -> None:
    """Replace the many small change files by one snapshot, which ``current_lifespans`` reads like any change.

    The snapshot is written before the files it covers are deleted; a crash in between leaves rows twice, which changes
    no minimum or maximum. Files that a running job adds meanwhile stay.
    """
    covered = spark.read.option("basePath", table).parquet(table)
    old = covered.inputFiles()
    covered.groupBy(device).agg(
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
        F.max("failure_day").alias("failure_day"),
    ).write.mode("errorifexists").parquet(f"{table}/run=snapshot-{uuid.uuid4().hex}/batch=0")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in old:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, False)


def daily_failures(events: DataFrame, ts: str = "ts", failure: str = "failure", lateness: str = "1 day") -> DataFrame:
    """Failures and records per calendar day; a day closes when the watermark passes its end, later rows drop.

    Days enter the window as midnights in UTC, where windows are aligned, so the session time zone plays no part.
    """
    midnight = F.timestamp_seconds(F.unix_date(F.to_date(ts)).cast("bigint") * 86400)
    days = events.select(midnight.alias("_day"), F.col(failure)).withWatermark("_day", lateness)
    return days.groupBy(F.window("_day", "1 day")).agg(
        F.sum(failure).cast("bigint").alias("failures"), F.count("*").alias("records")).select(
        F.floor(F.unix_seconds("window.start") / 86400).cast("int").alias("day"), "failures", "records")


def write_daily_failures(counts: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    return (
        counts.writeStream.outputMode("append").format("parquet").option("path", table)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
