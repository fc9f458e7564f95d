"""Survival curves that a load of new records brings up to date without reading the other devices.

Two tables lie below one root: the lifespans in hash buckets (``sources/buckets``) and, for each of their generations, the
survival axis (strata, duration, n, d). A load reads the buckets its devices fall into, takes each device's old subject off
the axis, adds its new one, and stores the next axis before the next generation of buckets. The manifest of that generation
is the one file that puts both in force, so a load that breaks off anywhere changes nothing and may be repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging_area import delete_folder, forget, stage
from ..operators.lifespan import duration_and_event, worked_days
from ..sources import buckets
from .km import curve_from_axis, survival_axis

SPAN = ["first_day", "last_day", "failure_day"]
Subjects = Callable[[DataFrame], DataFrame]


def reduced_subjects(spans: DataFrame) -> DataFrame:
    """Adds ``duration_worked`` and ``failed`` by the days in the dataset."""
    return duration_and_event(worked_days(spans))


def _spans(root: str) -> str:
    return f"{root}/spans"


def _axis(root: str, generation: int) -> str:
    return f"{root}/axis/{generation}"


def create_live_axis(
    spark: SparkSession, root: str, schema: T.StructType, device: str = "drive_id", strata: Sequence[str] = (), n_buckets: int = 64,
) -> None:
    """An empty store. ``schema`` has the types of the device, the days of a lifespan and the strata."""
    empty = spark.createDataFrame([], T.StructType([schema[c] for c in [device, *SPAN, *strata]]))
    axis_of(empty, strata).write.mode("overwrite").parquet(_axis(root, 0))
    buckets.create_buckets(empty, _spans(root), device, n_buckets)


def axis_of(spans: DataFrame, strata: Sequence[str] = (), subjects: Subjects = reduced_subjects, sign: str | None = None) -> DataFrame:
    """The survival axis of lifespans; ``sign`` is a column of 1 and -1 that subjects count with."""
    axis = survival_axis(subjects(spans), strata, weight=sign)
    return axis.select(*strata, "duration", F.col("n").cast("bigint").alias("n"), F.col("d").cast("bigint").alias("d"))


def changes(old: DataFrame, fresh: DataFrame, device: str = "drive_id", strata: Sequence[str] = ()) -> DataFrame:
    """(device, before, after) of every device in ``fresh``: its stored lifespan, null where it is new, and the merged one.

    Both sides hold one row per device. Strata are those of the load, so a device that moves to another stratum leaves the
    old one. Both states come out of one aggregation; a null device is a device like any other.
    """
    state = F.struct(*SPAN, *strata)
    rows = old.select(F.col(device), F.lit(False).alias("_new"), state.alias("_state")).unionByName(
        fresh.select(F.col(device), F.lit(True).alias("_new"), state.alias("_state")))
    days = [F.min("_state.first_day").alias("first_day"), F.max("_state.last_day").alias("last_day"),
            F.max("_state.failure_day").alias("failure_day")]
    places = [F.max(F.when(F.col("_new"), F.col("_state")))[s].alias(s) for s in strata]
    return rows.groupBy(device).agg(
        F.max(F.when(~F.col("_new"), F.col("_state"))).alias("before"), F.struct(*days, *places).alias("after"),
        F.bool_or("_new").alias("_in_load")).where("_in_load").drop("_in_load")


def signed_axis(
    changed: DataFrame, device: str = "drive_id", strata: Sequence[str] = (), subjects: Subjects = reduced_subjects,
) -> DataFrame:
    """What ``changes`` do to the axis: counts taken off and added, already summed per (strata, duration)."""
    state = F.explode(F.array(F.struct(F.lit(-1).alias("_sign"), F.col("before").alias("s")),
                              F.struct(F.lit(1).alias("_sign"), F.col("after").alias("s")))).alias("_row")
    rows = changed.where(~F.col("before").eqNullSafe(F.col("after"))).select(device, state)
    rows = rows.where(F.col("_row.s").isNotNull()).select(device, "_row.s.*", "_row._sign")
    return axis_of(rows, strata, subjects, "_sign")


def add_axes(axis: DataFrame, delta: DataFrame, strata: Sequence[str] = ()) -> DataFrame:
    """Sums of two axes; points that nobody is left at go."""
    return axis.unionByName(delta).groupBy(*strata, "duration").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).where(
        (F.col("n") != 0) | (F.col("d") != 0))


def load_lifespans(
    spark: SparkSession, root: str, fresh: DataFrame, strata: Sequence[str] = (), subjects: Subjects = reduced_subjects,
) -> list[int]:
    """Bring the store up to date with the lifespans of new records (one row per device, with its strata) and return the
    buckets that were written. Loading the same records again changes nothing. One writer at a time.

    ``subjects`` turns lifespans into durations and events, row by row, and may leave rows out; a store keeps to one such rule.
    """
    now = buckets.latest(spark, _spans(root))
    device = now.key
    new = stage(fresh.select([F.col(c).cast(now.schema[c].dataType) for c in [device, *SPAN, *strata]]), "new-spans")
    touched = buckets.touched_buckets(new, now)
    if not touched:
        forget(new)
        return []
    changed = stage(changes(buckets.read_buckets(spark, _spans(root), touched), new, device, strata), "span-changes")
    following = add_axes(read_axis(spark, root), signed_axis(changed, device, strata, subjects), strata)
    following.write.mode("overwrite").parquet(_axis(root, now.generation + 1))
    moved = changed.where(~F.col("before").eqNullSafe(F.col("after"))).select(device, "after.*")
    written = buckets.upsert_buckets(spark, _spans(root), moved)
    forget(changed)
    forget(new)
    return written


def read_axis(spark: SparkSession, root: str) -> DataFrame:
    """The axis of the newest generation."""
    return spark.read.parquet(_axis(root, buckets.latest(spark, _spans(root)).generation))


def read_spans(spark: SparkSession, root: str) -> DataFrame:
    return buckets.read_buckets(spark, _spans(root))


def live_curve(spark: SparkSession, root: str, strata: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    """Kaplan-Meier curves from the stored axis: no lifespan is read."""
    return curve_from_axis(read_axis(spark, root), strata, confidence)


def drop_superseded(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete axes and buckets that only generations before the last ``keep`` use."""
    for g in sorted(buckets.snapshots(spark, _spans(root)))[:-max(1, keep)]:
        delete_folder(spark, _axis(root, g))
    buckets.drop_superseded(spark, _spans(root), keep)
