"""Lifespans: first, last and failure day per device, and the measures derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_and_last(facts: DataFrame, device: str = "drive_id", day: str = "day") -> DataFrame:
    """One hash aggregation with map-side combining: a device with a third of all rows costs one row per task."""
    return facts.groupBy(device).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def lifespans(facts: DataFrame, device: str = "drive_id", day: str = "day", failure: str = "failure") -> DataFrame:
    """First, last and (latest) failure day per device in a single pass."""
    return facts.groupBy(device).agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        F.max(F.when(F.col(failure) == 1, F.col(day))).alias("failure_day"),
    )


def histories(facts: DataFrame, device: str = "drive_id", day: str = "day", failure: str = "failure") -> DataFrame:
    """Lifespans with the sorted list of all failure days, in the same single pass.

    Days are made distinct while combining on the map side, so a list is bounded by the calendar.
    """
    failed_on = F.when(F.col(failure) == 1, F.col(day).cast("int"))
    return facts.groupBy(device).agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.max(failed_on).alias("failure_day"),
        F.array_sort(F.collect_set(failed_on)).alias("failure_days"))


def merge_histories(old: DataFrame, fresh: DataFrame, device: str = "drive_id") -> DataFrame:
    """Stored histories brought up to date: one row per device on either side, safe to repeat."""
    cols = [device, "first_day", "last_day", "failure_day", "failure_days"]
    return old.select(cols).unionByName(fresh.select(cols)).groupBy(device).agg(
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.max("failure_day").alias("failure_day"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("failure_days")))).alias("failure_days"))


def lifespans_with_hours(
    facts: DataFrame, device: str = "drive_id", day: str = "day", failure: str = "failure",
    hours: str = "power_on_hours_raw",
) -> DataFrame:
    """Lifespans and the power-on hours on the first, last and failure days.

    Three look-ups by exact day become ``min_by`` / ``max_by`` in the aggregation that finds those days, so the facts
    are read once and never joined to themselves. Facts hold one row per (device, day).
    """
    failed_on = F.when(F.col(failure) == 1, F.col(day))
    return facts.groupBy(device).agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.max(failed_on).alias("failure_day"),
        F.min_by(hours, day).alias("first_hours"), F.max_by(hours, day).alias("last_hours"),
        F.max_by(F.col(hours), failed_on).alias("failure_hours"),
    )


def merge_lifespans(old: DataFrame, fresh: DataFrame, device: str = "drive_id") -> DataFrame:
    """Known lifespans brought up to date with those of new records: order-free, safe to repeat."""
    cols = [device, "first_day", "last_day", "failure_day"]
    return old.select(cols).unionByName(fresh.select(cols)).groupBy(device).agg(
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
        F.max("failure_day").alias("failure_day"))


def refreshed_last_days(known: DataFrame, new_facts: DataFrame, device: str = "drive_id", day: str = "day") -> DataFrame:
    """Known devices only: last day becomes the later of the stored one and the new records' maximum.

    New records are aggregated before the join, so it meets one row per device on both sides.
    """
    seen = new_facts.groupBy(device).agg(F.max(day).alias("_seen"))
    return known.join(seen, device, "left").withColumn(
        "last_day", F.greatest("last_day", F.coalesce("_seen", "last_day"))).drop("_seen")


def newest_day(lifespans_: DataFrame) -> DataFrame:
    return lifespans_.agg(F.max("last_day").alias("last_day"))


def used_after_failure(lifespans_: DataFrame, device: str = "drive_id") -> DataFrame:
    return lifespans_.where(F.col("last_day") > F.col("failure_day")).select(
        device, (F.col("last_day") - F.col("failure_day")).alias("overshoot"))


def outdated_candidates(lifespans_: DataFrame) -> DataFrame:
    """No failure, and last seen before the newest day of the whole table (a scalar subquery)."""
    newest = newest_day(lifespans_).scalar()
    return lifespans_.where(F.col("failure_day").isNull() & (F.col("last_day") < newest))


def censored_devices(lifespans_: DataFrame, device: str = "drive_id") -> DataFrame:
    """Devices that have not failed so far."""
    return lifespans_.where(F.col("failure_day").isNull()).select(device)


def without_stats(drives: DataFrame, lifespans_: DataFrame, device: str = "drive_id") -> DataFrame:
    """Drives that have no lifespan row yet."""
    return drives.join(lifespans_.select(F.col(device).alias("id")), "id", "left_anti").select("id")


def exclude(df: DataFrame, anomalies: DataFrame, device: str = "drive_id") -> DataFrame:
    """Rows of devices that are not reported as anomalous."""
    return df.join(anomalies.select(device), device, "left_anti")


def failed_summary(facts: DataFrame, device: str = "drive_id", day: str = "day", failure: str = "failure") -> DataFrame:
    """Failed devices with their first failure day and the days they span: one conditional aggregation."""
    return facts.groupBy(device).agg(
        F.min(F.when(F.col(failure) == 1, F.col(day))).alias("first_failure_day"),
        F.min(day).alias("first_day"), F.max(day).alias("last_day"),
    ).where(F.col("first_failure_day").isNotNull())


def worked_days(spans: DataFrame, reduced: bool = True, keep: str = "all") -> DataFrame:
    """Durations per device. ``keep`` is ``all``, ``failed`` or ``surviving``.

    Reduced mode needs only the lifespan days. Full mode adds measures from the power-on hours (``lifespans_with_hours``
    gives them). All rows keep their device, so the union of the failed and the surviving branch is one projection and
    needs no duplicate removal.
    """
    failed = F.col("failure_day").isNotNull()
    if keep == "failed":
        spans = spans.where(failed)
    elif keep == "surviving":
        spans = spans.where(~failed)
    elif keep != "all":
        raise ValueError(f"unknown branch {keep!r}")
    in_dataset = F.col("last_day") - F.col("first_day")
    out = {
        "days_in_dataset_failure": F.when(failed, F.col("failure_day") - F.col("first_day")),
        "days_in_dataset": in_dataset,
    }
    if not reduced:
        out |= {
            "days_in_dataset_failure_smart": F.when(failed, F.expr("(failure_hours - first_hours) div 24")),
            "failure_worked_days_smart": F.when(failed, F.expr("failure_hours div 24")),
            "failure_worked_days_synthetic": F.expr("first_hours div 24") + in_dataset,
            "days_in_dataset_smart": F.expr("(last_hours - first_hours) div 24"),
            "total_worked_days_smart": F.expr("last_hours div 24"),
        }
    return spans.withColumns(out)


def duration_and_event(worked: DataFrame, reduced: bool = True) -> DataFrame:
    """Survival subjects: ``duration_worked`` and ``failed``, by dataset days or by power-on days.

    In full mode a failed device without hours at its failure counts as censored (see ``lost_failures``).
    """
    at_failure, total = (
        ("days_in_dataset_failure", "days_in_dataset") if reduced
        else ("failure_worked_days_smart", "total_worked_days_smart"))
    failed = F.col(at_failure).isNotNull()
    return worked.withColumns({
        "failed": failed,
        "duration_worked": F.when(failed, F.col(at_failure)).otherwise(F.col(total)).cast("double"),
    })


def lost_failures(worked: DataFrame) -> DataFrame:
    """How many failed devices full mode turns into censored ones, for want of hours at the failure."""
    lost = F.col("failure_day").isNotNull() & F.col("failure_worked_days_smart").isNull()
    return worked.agg(F.count_if(lost).alias("lost_failures"), F.count("*").alias("devices"))
