"""Facts on disk: a folder per year, files sorted by device and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_facts(
    facts: DataFrame, path: str, device: str = "drive_id", day: str = "day", mode: str = "append",
    rows_per_file: int = 20_000_000,
) -> None:
    """Range-partitioned by (year, device, day), so one device's rows lie together and the row-group statistics prune
    device and day filters, while a device with a third of all rows is still cut into several files by its days."""
    dated = facts.withColumn("year", F.year(F.date_from_unix_date(day)))
    spread = dated.repartitionByRange("year", device, day).sortWithinPartitions("year", device, day)
    spread.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("year").parquet(path)


def read_facts(
    spark: SparkSession, path: str, first_day: int | None = None, last_day: int | None = None, day: str = "day",
) -> DataFrame:
    """Facts of a span of days: year folders are pruned, the day filter reaches the scan."""
    facts = spark.read.parquet(path)
    if first_day is not None:
        facts = facts.where((F.col("year") >= F.year(F.date_from_unix_date(F.lit(first_day)))) & (F.col(day) >= first_day))
    if last_day is not None:
        facts = facts.where((F.col("year") <= F.year(F.date_from_unix_date(F.lit(last_day)))) & (F.col(day) <= last_day))
    return facts.drop("year")
