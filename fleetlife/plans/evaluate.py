"""Concordance, cross-validation and hyper-parameter search."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Mapping, Sequence
from statistics import fmean, pstdev
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordering import axis_bounds, running_sum
from ..functions.staging_area import forget, stage
from .cox import fit_cox_folds

WIDE = "decimal(38,0)"
BLOCK_ROWS = 20_000  # distinct (time, score) pairs of a score block


def concordance_counts(
    scored: DataFrame, duration: str = "duration_worked", event: str = "failed", score: str = "score", blocks: int | None = None,
    block_width: float | None = None, by: Sequence[str] = (), weight: str | None = None,
) -> DataFrame:
    """One row: concordant, discordant, tied and comparable pairs (Harrell); a high score means a long life. With ``by`` one
    row for each of its values, pairs being formed inside them. With ``weight`` a row stands for that many equal subjects.

    A pair is comparable when the earlier time is a failure, or both times are equal and only one of them is a
    failure. No pair is ever formed: two different time ranks differ first, from the top, in exactly one bit, so for
    every bit the subjects with equal higher bits and a 1 are counted against the failures with a 0, by running totals
    in score order. Each subject appears once per bit. Totals run inside score blocks (by approximate quantiles; they
    only balance the work) and the blocks' own totals are added, so no bit, rank or score has to fit in one task.
    Times are ranked in blocks too where they are not whole days (of ``block_width``, or of quantiles).
    """
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    compact = scored.groupBy(*by, F.col(duration).alias("t"), F.col(score).cast("double").alias("s")).agg(
        F.sum(w).alias("n"), F.sum(F.col(event).cast("bigint") * w).alias("d"))
    compact = stage(compact, "scored")  # read four times below, and scoring may be expensive
    if blocks is None:
        blocks = max(1, -(-compact.count() // BLOCK_ROWS))
    block_width = axis_bounds(compact, "t") if block_width is None else block_width
    times = compact.select(F.col("t").alias("_t")).distinct()
    ranks = running_sum(times.withColumn("_one", F.lit(1)), [], "_t", {"_up_to": "_one"}, block_width).select(
        "_t", (F.col("_up_to") - 1).cast("int").alias("rank"))
    ranked = compact.join(ranks, F.col("t") == F.col("_t"))
    top_bit = times.agg(F.floor(F.log2(F.greatest(F.count("*"), F.lit(1)))).cast("int")).scalar()
    cuts = [i / blocks for i in range(1, blocks)]
    bounds = compact.agg(F.percentile_approx("s", cuts, 1000)).scalar() if cuts else F.array().cast("array<double>")
    placed = ranked.withColumn("_bounds", bounds).withColumn(
        "block", F.size(F.filter("_bounds", lambda b: b < F.col("s")))).drop("_bounds")

    # Bit -1 stands for equal times: the censored subjects of a time against its failures.
    exploded = placed.withColumn("bit", F.explode(F.sequence(F.lit(-1), top_bit)))
    equal = F.col("bit") == -1
    one = F.expr("shiftright(rank, greatest(bit, 0)) & 1") == 1
    rows = exploded.select(
        *by, "bit", F.when(equal, F.col("rank")).otherwise(F.expr("shiftright(rank, bit + 1)")).alias("prefix"), "block", "s",
        F.when(equal, F.col("n") - F.col("d")).when(one, F.col("n")).otherwise(0).alias("longer"),
        F.when(equal | ~one, F.col("d")).otherwise(0).alias("failed"),
    ).where((F.col("longer") > 0) | (F.col("failed") > 0))

    group = [*by, "bit", "prefix"]
    per_score = rows.groupBy(*group, "block", "s").agg(F.sum("longer").alias("longer"), F.sum("failed").alias("failed"))
    inside = Window.partitionBy(*group, "block").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("longer").over(inside), F.lit(0))
    per_block = per_score.withColumn("below", lower).groupBy(*group, "block").agg(
        F.sum("longer").alias("longer"), F.sum("failed").alias("failed"),
        F.sum((F.col("failed") * F.col("below")).cast(WIDE)).alias("below_pairs"),
        F.sum((F.col("failed") * F.col("longer")).cast(WIDE)).alias("tied"))
    earlier = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*group)
    failed = F.col("failed")
    per_group = per_block.select(
        *by, "tied", (F.col("below_pairs") + (failed * F.coalesce(F.sum("longer").over(earlier), F.lit(0))).cast(WIDE)).alias("discordant"),
        (failed * F.sum("longer").over(everything)).cast(WIDE).alias("comparable"))
    out = per_group.groupBy(*by).agg(*[F.coalesce(F.sum(c).cast(WIDE), F.lit(0).cast(WIDE)).alias(c)
                          for c in ("tied", "discordant", "comparable")])
    return out.select(
        *by, (F.col("comparable") - F.col("discordant") - F.col("tied")).cast(WIDE).alias("concordant"), "discordant", "tied",
        "comparable")


def concordance(
    scored: DataFrame, duration: str = "duration_worked", event: str = "failed", score: str = "score", blocks: int | None = None,
    block_width: float | None = None, by: Sequence[str] = (), weight: str | None = None,
) -> DataFrame:
    """Harrell's index: concordant pairs plus half of the tied ones over comparable ones."""
    c = concordance_counts(scored, duration, event, score, blocks, block_width, by, weight)
    index = (F.col("concordant").cast("double") + F.col("tied").cast("double") / 2) / F.nullif(
        F.col("comparable").cast("double"), F.lit(0.0))
    return c.withColumn("concordance", index)


def fold_of(key: Sequence[str], folds: int, seed: int = 0) -> Column:
    """Fold number by a seeded hash of the key: the same on every run and every partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), F.lit(folds)).cast("int")


# Fits on the first frame and returns the second one with a ``score`` column (high = long life).
FitAndScore = Callable[[DataFrame, DataFrame], DataFrame]

FOLD = "_fold"  # number of the fold that a subject is held out in
COUNT = "_equal_subjects"  # how many subjects a row of ``cross_validate`` with ``features`` stands for


def cross_validate(
    subjects: DataFrame, key: Sequence[str], fit_and_score: FitAndScore, folds: int = 2, seed: int = 0,
    duration: str = "duration_worked", event: str = "failed", features: Sequence[str] | None = None,
    together: bool = False,
) -> dict[str, Any]:
    """Concordance on each held-out fold, their mean and standard deviation.

    With ``features``, all that the fit reads beside duration and event, equal subjects of a fold become one stored row with
    their number in ``COUNT``, which the fit has to use as a weight: the subjects are read once, and what the folds read has
    no more rows than there are values of features, duration and event. ``together`` makes one call for all folds: both
    frames are all subjects with their fold in ``FOLD``, each scored by a fit that has not seen its fold, and one concordance
    takes all folds.
    """
    numbered = subjects.withColumn(FOLD, fold_of(key, folds, seed))
    if features is not None:
        numbered = stage(numbered.groupBy(FOLD, *features, duration, event).agg(F.count("*").alias(COUNT)), "folds")
    weight = None if features is None else COUNT
    if together:
        found = concordance(fit_and_score(numbered, numbered), duration, event, by=[FOLD], weight=weight)
        by_fold = {r[FOLD]: r["concordance"] for r in found.select(FOLD, "concordance").collect()}
        values = [by_fold.get(k) for k in range(folds)]
    else:
        values = []
        for k in range(folds):
            train = numbered.where(F.col(FOLD) != k).drop(FOLD)
            held_out = numbered.where(F.col(FOLD) == k).drop(FOLD)
            row = concordance(fit_and_score(train, held_out), duration, event, weight=weight).select("concordance").first()
            values.append(row["concordance"])
    if features is not None:
        forget(numbered)
    known = [v for v in values if v is not None]
    if not known:
        raise ValueError("no comparable pairs in any fold")
    return {"folds": values, "mean": fmean(known), "std": pstdev(known)}


def cross_validate_cox(
    subjects: DataFrame, features: Sequence[str], fold: Column, folds: int, duration: str = "duration_worked",
    event: str = "failed", **options: Any,
) -> dict[str, Any]:
    """``cross_validate`` of linear Cox models, all folds at once: one job per Newton step and one concordance for all.

    ``fold`` numbers each subject's fold from 0; ``options`` go to ``fit_cox_folds``. A fold without comparable pairs has no
    value.
    """
    numbered = subjects.withColumn("fold", fold.cast("int"))
    models = fit_cox_folds(numbered, features, F.col("fold"), folds, duration, event, **options)
    score = F.lit(None).cast("double")
    for k, model in enumerate(models):
        score = F.when(F.col("fold") == k, -model.log_hazard()).otherwise(score)
    found = concordance(numbered.withColumn("score", score).where("score is not null"), duration, event, by=["fold"])
    by_fold = {r["fold"]: r["concordance"] for r in found.select("fold", "concordance").collect()}
    values = [by_fold.get(k) for k in range(folds)]
    known = [v for v in values if v is not None]
    if not known:
        raise ValueError("no comparable pairs in any fold")
    return {"folds": values, "mean": fmean(known), "std": pstdev(known), "models": models}


def random_points(space: Mapping[str, tuple[float, float] | Sequence[Any]], trials: int, seed: int) -> list[dict[str, Any]]:
    """Seeded random points: a pair of numbers is a range, any longer sequence (or of other types) is a choice."""
    rng = random.Random(seed)
    points = []
    for _ in range(trials):
        point = {}
        for name, values in space.items():
            if isinstance(values, tuple) and len(values) == 2 and all(isinstance(v, (int, float)) for v in values):
                low, high = values
                whole = isinstance(low, int) and isinstance(high, int)
                point[name] = rng.randint(low, high) if whole else rng.uniform(low, high)
            else:
                point[name] = rng.choice(list(values))
        points.append(point)
    return points


TRIAL_SCHEMA = "trial int, point string, value double"


def logged_trials(spark: SparkSession, log: str) -> dict[int, tuple[str, float]]:
    """Trials of a search so far; none when the log does not exist yet."""
    try:
        rows = spark.read.schema(TRIAL_SCHEMA).json(log).collect()  # one row per trial
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r["trial"]: (r["point"], r["value"]) for r in rows}


def best_point(spark: SparkSession, log: str) -> dict[str, Any]:
    """Hyper-parameters of the best logged trial."""
    text, _value = max(logged_trials(spark, log).values(), key=lambda t: t[1])
    return json.loads(text)


def search_hyperparameters(
    spark: SparkSession, space: Mapping[str, Any], evaluate: Callable[[dict[str, Any]], float], trials: int, log: str,
    seed: int = 0,
) -> dict[str, Any]:
    """Random search for the largest value. Every trial is appended to ``log`` (JSON, in the shared folder) at once,
    so an interrupted search goes on where it stopped; returns the best point and its value."""
    done = logged_trials(spark, log)
    results = []
    for k, point in enumerate(random_points(space, trials, seed)):
        text = json.dumps(point, sort_keys=True)
        if k in done and done[k][0] == text:
            results.append((done[k][1], point))
            continue
        value = float(evaluate(point))
        spark.createDataFrame([(k, text, value)], TRIAL_SCHEMA).coalesce(1).write.mode("append").json(log)
        results.append((value, point))
    value, point = max(results, key=lambda r: r[0])
    return {"value": value, "point": point, "trials": len(results)}


def reject_nan(predictions: DataFrame, column: str) -> DataFrame:
    """Fails the job that reads the predictions when one of them is NaN or null."""
    bad = F.col(column).isNull() | F.isnan(F.col(column).cast("double"))
    return predictions.withColumn(column, F.when(bad, F.raise_error(F.lit(f"NaN in {column}"))).otherwise(F.col(column)))


def count_nan(predictions: DataFrame, columns: Sequence[str]) -> DataFrame:
    return predictions.agg(*[
        F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns])
