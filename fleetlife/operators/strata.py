"""Group aggregations over survival subjects and models."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durations import fix_zero

WEIGHT = "aggregate_weight"
# An aggregator maps (duration, failed) to the columns it computes.
Aggregator = Callable[[Column, Column], Mapping[str, Column]]


def mean_duration(duration: Column, failed: Column) -> Mapping[str, Column]:
    return {"duration_worked": F.avg(fix_zero(duration))}


def geometric_mean_duration(duration: Column, failed: Column) -> Mapping[str, Column]:
    return {"duration_worked": F.exp(F.avg(F.ln(fix_zero(duration))))}


def aggregate_groups(
    subjects: DataFrame, group_by: Sequence[str], aggregator: Aggregator, valid: Column | None = None,
    duration: str = "duration_worked", failed: str = "failed",
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) groups with the group size as weight; ``valid`` may use any computed column."""
    computed = aggregator(F.col(duration), F.col(failed))
    out = subjects.groupBy(*group_by).agg(
        *[c.alias(name) for name, c in computed.items()], F.count("*").alias(WEIGHT))
    if valid is None:
        return out, out.where(F.lit(False))
    accepted = F.coalesce(valid, F.lit(False))
    return out.where(accepted), out.where(~accepted)


def known_stratum(subjects: DataFrame, stratum: str) -> DataFrame:
    return subjects.where(F.col(stratum).isNotNull())


def lifespan_histogram(subjects: DataFrame, levels: Sequence[str], days: str) -> DataFrame:
    """Counts per lifespan at every level of the hierarchy: all levels, without the innermost, ..., overall.

    The finest level is counted once; the coarser ones are sums of those counts, so the fact rows are not multiplied.
    """
    finest = subjects.groupBy(*levels, days).agg(F.count("*").alias("n"))
    sets = [[*levels[:k], days] for k in range(len(levels), -1, -1)]
    return finest.groupingSets(sets, *levels, days).agg(F.sum("n").alias("n"), F.grouping_id().alias("_gid")) \
        .withColumn("level", F.lit(len(levels)) - F.bit_count("_gid")).drop("_gid")


def attribute_domain(models: DataFrame, attribute: str) -> DataFrame:
    """Distinct non-null values in order."""
    return models.where(F.col(attribute).isNotNull()).select(attribute).distinct().orderBy(attribute)


def id_domain(dimension: DataFrame) -> DataFrame:
    """The range an id runs through, instead of a list of ids."""
    return dimension.agg(F.min("id").alias("low"), F.max("id").alias("high"))


def available_attributes(models: DataFrame) -> DataFrame:
    """Attributes that at least one model has, with the number of models: one pass over all columns."""
    counts = models.agg(*[F.count(c).alias(c) for c in models.columns])
    return counts.unpivot([], models.columns, "attribute", "models").where(F.col("models") > 0)
