"""Devices whose history cannot be trusted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lifespan import used_after_failure


def multiple_failures(failures: DataFrame, device: str = "drive_id", day: str = "failure_day") -> DataFrame:
    """Devices with several failure days, with the sorted list of days.

    Days are made distinct while combining on the map side, so the list is bounded by the calendar, whatever number of
    rows one device has.
    """
    days = F.array_sort(F.collect_set(day))
    return failures.groupBy(device).agg(days.alias("failure_days")).where(F.size("failure_days") > 1)


def anomaly_report(
    lifespans_: DataFrame, failures: DataFrame, unknown_drives: DataFrame, device: str = "drive_id",
) -> DataFrame:
    """One row per anomalous device with every reason: ``overshoot``, ``failure_days``, ``unknown``.

    The three parts hold one row per device each, and are combined by one aggregation on the device instead of two
    outer joins.
    """
    late = used_after_failure(lifespans_, device).select(
        device, "overshoot", F.lit(None).cast("array<int>").alias("failure_days"), F.lit(None).cast("boolean").alias("unknown"))
    many = multiple_failures(failures, device).select(
        device, F.lit(None).cast("int").alias("overshoot"), "failure_days", F.lit(None).cast("boolean").alias("unknown"))
    strange = unknown_drives.select(
        F.col("id").alias(device), F.lit(None).cast("int").alias("overshoot"),
        F.lit(None).cast("array<int>").alias("failure_days"), F.lit(True).alias("unknown"))
    parts = late.unionByName(many).unionByName(strange)
    return parts.groupBy(device).agg(
        F.max("overshoot").alias("overshoot"), F.max("failure_days").alias("failure_days"),
        F.coalesce(F.bool_or("unknown"), F.lit(False)).alias("unknown"))


def report_from_histories(histories: DataFrame, unknown_drives: DataFrame, device: str = "drive_id") -> DataFrame:
    """The same report out of one row per device (``lifespan.histories``), so the facts are read once."""
    late = F.when(F.col("last_day") > F.col("failure_day"), F.col("last_day") - F.col("failure_day"))
    many = F.when(F.size("failure_days") > 1, F.col("failure_days"))
    known = histories.select(device, late.alias("overshoot"), many.alias("failure_days"), F.lit(False).alias("unknown")).where(
        F.col("overshoot").isNotNull() | F.col("failure_days").isNotNull())
    strange = unknown_drives.select(
        F.col("id").alias(device), F.lit(None).cast("int").alias("overshoot"), F.lit(None).cast("array<int>").alias("failure_days"),
        F.lit(True).alias("unknown"))
    return known.unionByName(strange).groupBy(device).agg(
        F.max("overshoot").alias("overshoot"), F.max("failure_days").alias("failure_days"), F.bool_or("unknown").alias("unknown"))
