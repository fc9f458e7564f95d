"""Samples of survival subjects, and ordering of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import smallest_by_hash


def keep_failures_sample(
    subjects: DataFrame, key: Sequence[str], fraction: float, seed: int = 0, failed: str = "failed",
) -> DataFrame:
    """``floor(n * fraction)`` subjects: all failures and a sample of survivors, or a sample of failures alone.

    The sizes come from a scalar subquery, so the plan stays lazy, and the chosen rows are exact and repeatable.
    """
    if not 0.0 < fraction <= 1.0:
        raise ValueError("fraction must be in (0, 1]")
    if fraction == 1.0:
        return subjects
    quota = F.floor(F.count("*") * F.lit(fraction))
    failures = F.count_if(F.col(failed))
    sizes = subjects.agg(F.struct(
        F.least(quota, failures).alias("failed"), F.greatest(quota - failures, F.lit(0)).alias("alive")).alias("sizes")).scalar()
    how_many = F.when(F.col(failed), sizes["failed"]).otherwise(sizes["alive"])
    return smallest_by_hash(subjects, key, how_many, seed, parts=[failed])


def sorted_by_duration(subjects: DataFrame, key: Sequence[str], duration: str = "duration_worked") -> DataFrame:
    return subjects.orderBy(duration, *key)


def sorted_by_prediction(predictions: DataFrame, key: Sequence[str], prediction: str = "predicted_survival") -> DataFrame:
    return predictions.orderBy(F.col(prediction).desc(), *key)
