"""Normalised facts: one row per device and day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import epoch_day


def normalize_records(
    staging: DataFrame, drives: DataFrame, carry: Sequence[str], serial: str = "serial_number", date: str = "date",
) -> DataFrame:
    """Staging rows with their drive's id and epoch day instead of serial and date text; unknown serials drop.

    No broadcast is forced: the drive list grows with the fleet, so Catalyst takes a broadcast only below its size
    threshold, and beyond it the adaptive skew join splits a serial that dominates the staging side.
    """
    ids = drives.select(serial, F.col("id").alias("drive_id"))
    return staging.select(serial, epoch_day(F.col(date)).alias("day"), *carry).join(ids, serial).drop(serial)


def one_per_day(facts: DataFrame, device: str = "drive_id", day: str = "day") -> DataFrame:
    """Collapse repeated (device, day) rows: every other column takes its maximum."""
    rest = [c for c in facts.columns if c not in (device, day)]
    return facts.groupBy(device, day).agg(*[F.max(c).alias(c) for c in rest])


def normalize_and_collapse(
    staging: DataFrame, drives: DataFrame, carry: Sequence[str], serial: str = "serial_number", date: str = "date",
) -> DataFrame:
    """``one_per_day`` of ``normalize_records`` with one shuffle of the facts instead of two: the join by serial leaves
    them where the collapse by (serial, drive, day) wants them."""
    ids = drives.select(serial, F.col("id").alias("drive_id"))
    joined = staging.select(serial, epoch_day(F.col(date)).alias("day"), *carry).join(ids, serial)
    return joined.groupBy(serial, "drive_id", "day").agg(*[F.max(c).alias(c) for c in carry]).drop(serial)


def failure_records(facts: DataFrame, device: str = "drive_id", day: str = "day", failure: str = "failure") -> DataFrame:
    """(device, day) of every failure record; the filter reaches the scan."""
    return facts.where(F.col(failure) == 1).select(device, F.col(day).alias("failure_day"))


def records_within_lifespan(
    facts: DataFrame, lifespans: DataFrame, device: str = "drive_id", day: str = "day", only: Column | None = None,
) -> DataFrame:
    """Records of drives known to have failed that lie inside the drive's [first, last] days."""
    spans = lifespans.where(F.col("failure_day").isNotNull()).select(device, "first_day", "last_day")
    rows = facts if only is None else facts.where(only)
    inside = F.col(day).between(F.col("first_day"), F.col("last_day"))
    return rows.join(spans, device).where(inside).drop("first_day", "last_day")


def count_and_bounds(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def last_record(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The row with the largest key: every task sends one row."""
    return df.orderBy(*[F.col(k).desc() for k in key]).limit(1)


def every_nth_device(facts: DataFrame, drives: DataFrame, n: int, device: str = "drive_id") -> DataFrame:
    """Toy subset: all records of every n-th drive. Facts are filtered before they meet the drives."""
    keep = drives.where(F.pmod(F.col("id"), F.lit(n)) == 0).select(F.col("id").alias(device))
    return facts.where(F.pmod(F.col(device), F.lit(n)) == 0).join(keep, device, "left_semi")


def toy_subset(
    facts: DataFrame, dimensions: Mapping[str, DataFrame], target_rows: int, device: str = "drive_id",
) -> dict[str, DataFrame]:
    """About ``target_rows`` facts, all of every n-th drive, with the dimension rows they refer to.

    ``dimensions`` are drives, models, brands and vendors; n follows from one count.
    """
    n = max(1, -(-facts.count() // target_rows))
    keep = dimensions["drives"].where(F.pmod(F.col("id"), F.lit(n)) == 0)
    out = {"facts": every_nth_device(facts, dimensions["drives"], n, device), "drives": keep}
    for name, above, key in (("models", "drives", "model_id"), ("brands", "models", "brand_id"), ("vendors", "brands", "vendor_id")):
        out[name] = dimensions[name].join(out[above].select(F.col(key).alias("id")), "id", "left_semi")
    return out
