"""Weibull fits with right censoring: per group, from attributes, and on raw rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durations import fix_zero
from ..functions.staging_area import cut_lineage, forget, stage
from ..functions.weibull_math import expectation
from ..operators.strata import WEIGHT
from .trees import BoostedRegression, fit_boosted_regression

# A group needs more than two subjects, and a shape below this has no finite expectation.
MIN_SUBJECTS = 3
MIN_SHAPE = 1e-2

SHAPE_RANGE = (1e-3, 1e3)
NEWTON_STEPS = 30
SETTLED = 1e-6  # convergence is quadratic: after such a step the error is its square


def fit_weibull_groups(
    subjects: DataFrame, groups: Sequence[str], duration: str = "duration_worked", event: str = "failed",
    steps: int = NEWTON_STEPS, weight: str | None = None,
) -> DataFrame:
    """Maximum-likelihood ``weibull_shape`` and ``weibull_scale`` per group, with ``rejected`` naming why not.

    The score equation in the shape is monotone. Every step is one join of the compacted axis with one row of state
    per group and one aggregation that combines on the map side: no group is ever gathered in a task, so a group with
    a third of all subjects, or with durations that are not whole days, costs no more than any other. Steps are Newton
    steps on the log shape, replaced by bisection when they would leave the bracket, and end when all groups stand
    still. The result is stored, and superseded steps are deleted. A null group key is a group of its own. With
    ``weight`` a row stands for that many equal subjects.
    """
    keys = ["_group"]  # one struct: its nulls compare as equal
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    subjects = subjects.select(F.struct(*groups).alias("_group"), duration, event, w.alias("_w")).where(F.col(duration).isNotNull())
    compact = stage(subjects.groupBy(*keys, fix_zero(F.col(duration)).alias("_t")).agg(
        F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col(event).cast("double")).alias("_d")), "weibull-axis")
    log_t = F.ln("_t")
    start = compact.groupBy(*keys).agg(
        F.sum("_n").alias("_subjects"), F.sum("_d").alias("_events"), F.max(log_t).alias("_top"),
        F.sum(F.col("_d") * log_t).alias("_dl"), F.sum(F.col("_d") * log_t * log_t).alias("_dl2"))
    mean = F.col("_dl") / F.col("_events")
    spread = F.sqrt(F.greatest(F.col("_dl2") / F.col("_events") - mean * mean, F.lit(1e-4)))
    low, high = SHAPE_RANGE
    # With every failure at the group's largest duration the likelihood grows with the shape for ever: no fit.
    fittable = (F.col("_events") > 0) & (F.col("_subjects") >= MIN_SUBJECTS) & (mean - F.col("_top") < -1e-12)
    state = start.where(fittable).select(
        *keys, "_events", "_top", (mean - F.col("_top")).alias("_mean"), F.lit(low).alias("_lo"),
        F.lit(high).alias("_hi"), F.least(F.lit(50.0), F.greatest(F.lit(0.05), 1.2 / spread)).alias("_shape"))
    carried = ["_events", "_top", "_mean", "_lo", "_hi", "_shape"]

    def sums(current: DataFrame) -> DataFrame:
        rel = F.ln("_t") - F.col("_top")
        power = F.col("_n") * F.exp(F.col("_shape") * rel)
        return compact.join(current.select(*keys, *carried), keys).groupBy(*keys).agg(
            *[F.max(c).alias(c) for c in carried], F.sum(power).alias("_s0"),
            F.sum(power * rel).alias("_s1"), F.sum(power * rel * rel).alias("_s2"))

    shape, s0, s1, s2 = (F.col(c) for c in ("_shape", "_s0", "_s1", "_s2"))
    score = s1 / s0 - 1 / shape - F.col("_mean")
    slope = (s2 * s0 - s1 * s1) / (s0 * s0) + 1 / (shape * shape)
    newton = shape * F.exp(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), -score / (shape * slope))))
    stored = False
    for _ in range(steps):
        stepped = sums(state).withColumns({
            "_lo": F.when(score < 0, shape).otherwise(F.col("_lo")), "_hi": F.when(score < 0, F.col("_hi")).otherwise(shape),
            "_try": newton})
        inside = F.col("_try").between(F.col("_lo"), F.col("_hi"))
        stepped = stepped.withColumn("_next", F.when(inside, F.col("_try")).otherwise(F.sqrt(F.col("_lo") * F.col("_hi"))))
        # One row per group goes to the shared folder: lineage stays short and the next join knows its size.
        before, state = state, stage(stepped.select(
            *keys, "_events", "_top", "_mean", "_lo", "_hi", F.col("_next").alias("_shape"),
            F.abs(F.ln(F.col("_next") / shape)).alias("_moved")), "weibull-step")
        if stored:
            forget(before)
        stored = True
        moved = state.agg(F.max("_moved")).first()[0]
        if moved is None or moved < SETTLED:
            break
    fitted = sums(state).select(
        *keys, shape.alias("weibull_shape"),
        (F.exp("_top") * F.pow(s0 / F.col("_events"), 1 / shape)).alias("weibull_scale"),
        (F.abs(score) > 1e-6 * (1 + 1 / shape)).alias("_off"))
    sizes = start.select(*keys, F.col("_subjects").cast("bigint").alias(WEIGHT), "_events")
    reason = (
        F.when(F.col(WEIGHT) < MIN_SUBJECTS, "fewer than three subjects")
        .when(F.col("_events") == 0, "no failures")
        .when(F.coalesce(F.col("_off"), F.lit(True)), "no convergence")
        .when(F.col("weibull_shape") < MIN_SHAPE, "shape too small"))
    out = sizes.join(fitted, keys, "left").withColumn("rejected", reason)
    out = cut_lineage(out.select("_group.*", WEIGHT, "rejected", *[
        F.when(F.col("rejected").isNull(), F.col(c)).alias(c) for c in ("weibull_shape", "weibull_scale")]))
    forget(compact)
    if stored:
        forget(state)
    return out


def accepted_fits(fits: DataFrame) -> DataFrame:
    return fits.where(F.col("rejected").isNull()).drop("rejected")


@dataclass
class WeibullAttributeModel:
    """Boosted trees from attributes to the logarithms of shape and scale; null attributes take part."""

    model: BoostedRegression

    def predict(self, models: DataFrame) -> DataFrame:
        shape, scale = F.exp(self.model.predict(0)), F.exp(self.model.predict(1))
        out = models.withColumns({"predicted_shape": shape, "predicted_scale": scale})
        return out.withColumn("predicted_survival", expectation(F.col("predicted_scale"), F.col("predicted_shape")))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.model.to_json(),)], "model string").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> WeibullAttributeModel:
        return WeibullAttributeModel(BoostedRegression.of_json(spark.read.parquet(path).first()["model"]))


def fit_weibull_from_attributes(
    fits: DataFrame, features: Sequence[str], rounds: int = 20, max_depth: int = 4, rate: float = 0.2, ridge: float = 0.0,
) -> WeibullAttributeModel:
    """``fits`` is the result of ``fit_weibull_groups`` joined with numeric attributes; sizes are the weights. Both targets are
    boosted side by side."""
    targets = [F.ln("weibull_shape"), F.ln("weibull_scale")]
    return WeibullAttributeModel(fit_boosted_regression(fits, features, targets, F.col(WEIGHT), rounds, max_depth, rate, ridge))


def fit_weibull_rows(
    subjects: DataFrame, features: Sequence[str], duration: str = "duration_worked", event: str = "failed",
    max_iter: int = 50,
) -> PipelineModel:
    """Accelerated failure time regression on censored rows: ``prediction`` is the scale of each row's law."""
    rows = subjects.withColumns({"_label": fix_zero(F.col(duration)), "_event": F.col(event).cast("double")})
    assemble = VectorAssembler(inputCols=list(features), outputCol="_features")
    aft = AFTSurvivalRegression(
        featuresCol="_features", labelCol="_label", censorCol="_event", predictionCol="prediction", maxIter=max_iter)
    return Pipeline(stages=[assemble, aft]).fit(rows.select("_label", "_event", *features))


def expected_lifetime(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``predicted_survival`` of the row-level regression."""
    shape = 1.0 / model.stages[-1].scale
    return model.transform(rows).withColumn(
        "predicted_survival", expectation(F.col("prediction"), F.lit(shape))).drop("_features", "prediction")
