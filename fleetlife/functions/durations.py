"""Durations, survival labels and human-readable spans."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a zero duration is counted as a quarter of a day.
ZERO_DURATION_DAYS = 0.25


def fix_zero(duration: Column, fix: float = ZERO_DURATION_DAYS) -> Column:
    duration = duration.cast("double")
    return F.when(duration == 0, F.lit(fix)).otherwise(duration)


def signed_label(duration: Column, event: Column) -> Column:
    """Positive for an observed failure, negative for a censored subject."""
    return duration * (event.cast("int") * 2 - 1)


def with_human_span(df: DataFrame, days: str, out: str, anchor: datetime.date) -> DataFrame:
    """Adds days as "Y y, M m, D d" counted from an explicit anchor date; null, NaN and zero give null.

    Zero years and zero months are left out. The number of whole months is the calendar difference, less one when the
    anchor moved by that many months passes the end. Each step is a column of its own, so none is computed twice.
    """
    start = F.lit(anchor)
    known = F.col(days).isNotNull() & ~F.isnan(F.col(days).cast("double")) & (F.col(days) != 0)
    df = df.withColumn("_end", F.when(known, F.date_add(start, F.floor(days).try_cast("int"))))
    df = df.withColumn("_m", (F.year("_end") - anchor.year) * 12 + (F.month("_end") - anchor.month))
    df = df.withColumn("_m", F.when(F.add_months(start, F.col("_m")) > F.col("_end"), F.col("_m") - 1).otherwise(F.col("_m")))
    df = df.withColumn("_d", F.datediff("_end", F.add_months(start, F.col("_m"))))
    years, months = F.expr("_m div 12"), F.col("_m") % 12
    text = F.concat(
        F.when(years != 0, F.concat(years.cast("string"), F.lit(" y, "))).otherwise(""),
        F.when(months != 0, F.concat(months.cast("string"), F.lit(" m, "))).otherwise(""),
        F.col("_d").cast("string"), F.lit(" d"))
    return df.withColumn(out, text).drop("_end", "_m", "_d")
