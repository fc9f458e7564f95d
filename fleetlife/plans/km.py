"""Kaplan-Meier curves for all strata in one job.

Subjects are first compacted to the duration axis (one row per stratum and day, combined on the map side), so the
ordered part works on a few thousand rows per stratum, whatever the number of subjects in it.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import axis_bounds, backwards, running_sum
from ..functions.staging_area import stage


def survival_axis(
    subjects: DataFrame, strata: Sequence[str] = (), duration: str = "duration_worked", event: str = "failed",
    weight: str | None = None,
) -> DataFrame:
    """(strata, duration, n leaving, d failing). Subjects without a duration say nothing about survival and are left out
    (``without_duration`` counts them); an unknown event counts as none."""
    w = F.lit(1) if weight is None else F.col(weight)
    return subjects.where(F.col(duration).isNotNull() & ~F.isnan(F.col(duration).cast("double"))).groupBy(*strata, F.col(duration).cast("double").alias("duration")).agg(
        F.sum(w).alias("n"), F.sum(F.when(F.col(event).cast("boolean"), w).otherwise(F.lit(0))).alias("d"))


def without_duration(subjects: DataFrame, strata: Sequence[str] = (), duration: str = "duration_worked") -> DataFrame:
    """How many subjects per stratum a curve leaves out for want of a duration."""
    lost = F.col(duration).isNull() | F.isnan(F.col(duration).cast("double"))
    return subjects.groupBy(*strata).agg(F.count_if(lost).alias("left_out"), F.count("*").alias("subjects"))


def curve_from_axis(
    axis: DataFrame, strata: Sequence[str] = (), confidence: float = 0.95, block_width: float | None = None,
) -> DataFrame:
    """Product-limit curve with a log-log Greenwood band; a row at duration 0 opens every curve. It comes out of the first
    row of the stratum, so the subjects are read once.

    ``block_width`` (a width, or the bounds of ``axis_bounds``) cuts axes that may hold very many distinct durations. The
    functions below find the bounds themselves where durations are not whole days.
    """
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    axis = axis.withColumn("_neg", -F.col("duration"))
    axis = running_sum(axis, strata, "_neg", {"at_risk": "n"}, backwards(block_width)).drop("_neg")
    d, r = F.col("d"), F.col("at_risk").cast("double")
    axis = axis.withColumns({
        "_ln": F.when(d < r, F.ln(1 - d / r)).otherwise(F.lit(0.0)),
        "_gw": F.when(d < r, d / (r * (r - d))).otherwise(F.lit(0.0)),
        "_end": F.when((d == r) & (d > 0), 1).otherwise(0), "_one": F.lit(1),
    })
    axis = running_sum(axis, strata, "duration", {"_log": "_ln", "_var": "_gw", "_out": "_end", "_nth": "_one"}, block_width)
    survival = F.when(F.col("_out") > 0, F.lit(0.0)).otherwise(F.exp("_log"))
    theta = z * F.sqrt("_var") / F.col("_log")
    bound = [F.pow(F.exp("_log"), F.exp(sign * theta)) for sign in (-1, 1)]
    flat = F.col("_log") == 0

    def band(pick) -> Column:
        return F.when(F.col("_out") == 0, F.when(flat, F.lit(1.0)).otherwise(pick(*bound)))

    row = F.struct("duration", "at_risk", F.col("d").alias("events"), survival.alias("survival"),
                   band(F.least).alias("lower"), band(F.greatest).alias("upper"))
    one = F.lit(1.0)
    opening = F.struct(F.lit(0.0).alias("duration"), "at_risk", (F.col("d") * 0).alias("events"), one.alias("survival"),
                       one.alias("lower"), one.alias("upper"))
    opens = (F.col("_nth") == 1) & (F.col("duration") > 0)
    return axis.select(*strata, F.inline(F.when(opens, F.array(opening, row)).otherwise(F.array(row))))


def survival_curve(
    subjects: DataFrame, strata: Sequence[str] = (), duration: str = "duration_worked", event: str = "failed",
    weight: str | None = None, confidence: float = 0.95, block_width: float | None = None,
) -> DataFrame:
    block_width = axis_bounds(subjects, duration) if block_width is None else block_width
    return curve_from_axis(survival_axis(subjects, strata, duration, event, weight), strata, confidence, block_width)


def curve_and_left_out(
    subjects: DataFrame, strata: Sequence[str] = (), duration: str = "duration_worked", event: str = "failed",
    weight: str | None = None, confidence: float = 0.95, block_width: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``survival_curve`` and ``without_duration`` out of one pass over the subjects.

    Subjects without a duration are a point of their own on the stored axis, which both results are read from. (Metrics that
    are observed on the side would count the rows of a repeated task twice.)
    """
    w = F.lit(1) if weight is None else F.col(weight)
    known = F.col(duration).cast("double")
    failing = F.when(F.col(event).cast("boolean"), w).otherwise(F.lit(0))
    axis = stage(subjects.groupBy(*strata, F.when(~F.isnan(known), known).alias("duration")).agg(
        F.sum(w).alias("n"), F.sum(failing).alias("d"), F.count("*").alias("subjects")), "axis")
    lost = F.coalesce(F.sum(F.when(F.col("duration").isNull(), F.col("subjects"))), F.lit(0))
    left_out = axis.groupBy(*strata).agg(lost.alias("left_out"), F.sum("subjects").alias("subjects"))
    points = axis.where(F.col("duration").isNotNull()).drop("subjects")
    block_width = axis_bounds(points, "duration") if block_width is None else block_width
    return curve_from_axis(points, strata, confidence, block_width), left_out


def nested_curves(
    subjects: DataFrame, primary: str, secondary: str, duration: str = "duration_worked", event: str = "failed",
    overall: bool = True, confidence: float = 0.95, block_width: float | None = None,
) -> DataFrame:
    """Curves per (primary, secondary), and per primary alone (secondary null, ``level`` = ``primary``).

    Subjects without a secondary value are left out of both. The coarse axis is summed from the fine one.
    """
    block_width = axis_bounds(subjects, duration) if block_width is None else block_width
    fine = survival_axis(
        subjects.where(F.col(primary).isNotNull() & F.col(secondary).isNotNull()), [primary, secondary], duration, event)
    return curve_from_axis(_with_levels(fine, [primary], secondary, overall), ["level", primary, secondary], confidence,
                           block_width)


def _with_levels(fine: DataFrame, primary: Sequence[str], secondary: str, overall: bool) -> DataFrame:
    """The axis per secondary value, and, when ``overall``, its sums over them."""
    if not overall:
        return fine.withColumn("level", F.lit("secondary"))
    keys = [F.col(c) for c in [*primary, secondary, "duration"]]
    level = F.when(F.grouping(secondary) == 1, "primary").otherwise("secondary")
    return fine.groupingSets([keys, [k for k, c in zip(keys, [*primary, secondary, "duration"]) if c != secondary]], *keys).agg(
        F.sum("n").alias("n"), F.sum("d").alias("d"), level.alias("level"))


def doane_bins(values: DataFrame, column: str) -> DataFrame:
    """One row: low, high and the number of equal bins by Doane's rule (population skewness)."""
    moments = values.agg(
        F.count(column).cast("double").alias("n"), F.min(column).cast("double").alias("low"),
        F.max(column).cast("double").alias("high"), F.skewness(column).alias("skew"))
    n, skew = F.col("n"), F.col("skew")
    spread = F.sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))
    wanted = F.ceil(1 + F.log2(n) + F.log2(1 + F.abs(skew) / spread))
    bins = F.when((n > 2) & (F.col("high") > F.col("low")), wanted).otherwise(1)
    return moments.select("low", "high", bins.cast("int").alias("bins"))


def with_bins(df: DataFrame, column: str, rule: DataFrame) -> DataFrame:
    """Adds ``bin`` by the one-row ``rule`` (taken as a scalar subquery): half-open bins, the last one closed."""
    r = rule.select(F.struct("*").alias("rule")).scalar()
    df = df.withColumn("_rule", r)
    low, high, bins = (F.col(f"_rule.{c}") for c in ("low", "high", "bins"))
    at = F.floor((F.col(column) - low) / (high - low) * bins).cast("int")
    at = F.when(high > low, F.least(at, bins - 1)).otherwise(0)
    return df.withColumns({"bin": at, "bin_left": low + at * (high - low) / bins, "bin_top": high}).drop("_rule")


def binned_curves(
    subjects: DataFrame, primary: str, secondary: str | None = None, duration: str = "duration_worked",
    event: str = "failed", confidence: float = 0.95, overall: bool = False, block_width: float | None = None,
) -> DataFrame:
    """Curves per bin of a numeric attribute (and per secondary value inside it).

    Bin numbers come from arithmetic on two global aggregates, in the same pass that compacts to the duration axis.
    Empty bins join the bin before them; ``label`` is ``[low, high)``. With a secondary attribute, ``overall`` adds one
    curve per bin, as in ``nested_curves``.
    """
    block_width = axis_bounds(subjects, duration) if block_width is None else block_width
    known = subjects.where(F.col(primary).isNotNull())
    if secondary is not None:
        known = known.where(F.col(secondary).isNotNull())
    strata = [secondary] if secondary else []
    binned = with_bins(known, primary, doane_bins(known, primary))
    axis = survival_axis(binned, ["bin", "bin_left", "bin_top", *strata], duration, event)
    following = Window.orderBy("bin")
    bins = axis.select("bin", "bin_left", "bin_top").distinct()  # a few dozen rows by Doane's rule
    edges = bins.select("bin", F.coalesce(F.lead("bin_left").over(following), "bin_top").alias("bin_right"))
    axis = axis.join(edges, "bin").drop("bin_top", "bin")
    if secondary is not None and overall:
        axis, strata = _with_levels(axis, ["bin_left", "bin_right"], secondary, True), ["level", *strata]
    label = F.concat(F.lit("["), F.col("bin_left").cast("string"), F.lit(", "), F.col("bin_right").cast("string"), F.lit(")"))
    return curve_from_axis(axis, ["bin_left", "bin_right", *strata], confidence, block_width).withColumn("label", label)


# The named views of a fleet: name -> (primary, secondary, overall curve per primary value).
NAMED_VIEWS = {
    "vendor": ("vendor_id", None, False), "model": ("model_id", None, False), "brand": ("brand_id", "model_id", True),
    "series": ("brand_id", "series", True), "family": ("brand_id", "family", False),
    "capacity": ("capacity", "model_id", True),
}


def named_view(subjects: DataFrame, name: str, block_width: float | None = None) -> DataFrame:
    """One of the usual views over subjects joined with their model attributes; any other name is an attribute."""
    primary, secondary, overall = NAMED_VIEWS.get(name, (name, None, False))
    if name == "capacity":
        return binned_curves(subjects, primary, secondary, overall=overall, block_width=block_width)
    if secondary is not None:
        return nested_curves(subjects, primary, secondary, overall=overall, block_width=block_width)
    return survival_curve(subjects.where(F.col(primary).isNotNull()), [primary], block_width=block_width)
