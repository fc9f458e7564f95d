"""Missing model attributes predicted from the other attributes."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .evaluate import fold_of


@dataclass
class Imputers:
    """One fitted pipeline per target column, applied to the nulls of that column only."""

    roles: Mapping[str, str]
    fills: dict[str, float]
    pipelines: dict[str, PipelineModel] = field(default_factory=dict)

    def apply(self, models: DataFrame) -> DataFrame:
        """Every target's gaps (null or NaN) replaced; features are the original values, as in training. Columns that nothing
        was learned for keep their gaps (``leftovers`` counts them)."""
        models = with_gaps_null(models, self.roles)
        out = _feature_columns(models, self.roles, self.fills)
        for target, pipeline in self.pipelines.items():
            out = pipeline.transform(out).drop(f"_vector_{target}", f"_raw_{target}", f"_prob_{target}", f"_index_{target}")
        kind = models.schema
        return out.select(*[
            F.coalesce(F.col(c), F.col(f"_pred_{c}").cast(kind[c].dataType)).alias(c) if c in self.pipelines else F.col(c)
            for c in models.columns])

    def save(self, spark: SparkSession, path: str) -> None:
        """All of it: roles, fills and one pipeline per target."""
        info = json.dumps({"roles": dict(self.roles), "fills": self.fills, "targets": list(self.pipelines)})
        spark.createDataFrame([(info,)], "imputers string").write.mode("overwrite").parquet(f"{path}/info")
        for target, pipeline in self.pipelines.items():
            pipeline.write().overwrite().save(f"{path}/{target}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Imputers:
        info = json.loads(spark.read.parquet(f"{path}/info").first()["imputers"])
        return Imputers(info["roles"], info["fills"], {t: PipelineModel.load(f"{path}/{t}") for t in info["targets"]})


def with_gaps_null(models: DataFrame, columns: Iterable[str]) -> DataFrame:
    """NaN is a gap like null."""
    gaps = {f.name: F.when(~F.isnan(F.col(f.name)), F.col(f.name)) for f in models.schema
            if f.name in set(columns) and isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return models.withColumns(gaps) if gaps else models


def leftovers(models: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(attribute, known, left): how many models still lack each attribute after imputation, in one pass."""
    models = with_gaps_null(models, columns)
    counts = models.agg(F.count("*").alias("_all"), *[F.count(F.col(c)).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).alias("known"), (F.col("_all") - F.col(c)).alias("left"))
                     for c in columns])
    return counts.select(F.inline(rows))


def known_attributes(models: DataFrame, columns: Sequence[str]) -> Column:
    """A model's attributes as JSON text; what it still lacks is left out of its record."""
    kinds = models.schema
    values = [F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if isinstance(kinds[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c)
              for c in columns]
    return F.to_json(F.struct(*values))


def _feature_columns(models: DataFrame, roles: Mapping[str, str], fills: Mapping[str, float]) -> DataFrame:
    new = {}
    for c in models.columns:
        role = roles.get(c)
        if role in ("numerical", "binary"):
            new[f"_f_{c}"] = F.coalesce(F.col(c).cast("double"), F.lit(fills.get(c, 0.0)))
            new[f"_m_{c}"] = F.col(c).isNull().cast("double")
        elif role == "categorical":
            new[f"_c_{c}"] = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return models.withColumns(new)


def train_imputers(
    models: DataFrame, roles: Mapping[str, str], targets: Sequence[str], max_iter: int = 10, max_depth: int = 5,
    trees: int = 20, seed: int = 0,
) -> Imputers:
    """Per target: numbers by boosted trees, flags and categories by a forest, trained where the target is known. A target
    that no model knows is left out."""
    models = with_gaps_null(models, roles)
    numbers = [c for c in models.columns if roles.get(c) in ("numerical", "binary")]
    categories = [c for c in models.columns if roles.get(c) == "categorical"]
    row = models.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in numbers]).first() if numbers else {}
    fills = {c: float(row[c]) if row[c] is not None else 0.0 for c in numbers}
    featured = _feature_columns(models, roles, fills)
    imputers = Imputers(roles, fills)
    learnable = models.agg(F.lit(0), *[F.count(F.col(t)).alias(t) for t in targets]).first()
    for target in [t for t in targets if learnable[t] > 0]:
        known = featured.where(F.col(target).isNotNull())
        cats = [c for c in categories if c != target]
        stages = [StringIndexer(inputCol=f"_c_{c}", outputCol=f"_i_{target}_{c}", handleInvalid="keep") for c in cats]
        inputs = [f"{p}{c}" for c in numbers if c != target for p in ("_f_", "_m_")] + [f"_i_{target}_{c}" for c in cats]
        stages.append(VectorAssembler(inputCols=inputs, outputCol=f"_vector_{target}"))
        values = known.agg(F.lit(0), *[F.count_distinct(f"_c_{c}") for c in cats]).first()
        # A tree needs a bin for every category; the indexer adds one for values that training has not seen.
        common = dict(featuresCol=f"_vector_{target}", seed=seed, maxDepth=max_depth, maxBins=max(256, *(n + 1 for n in values)))
        if roles[target] == "numerical":
            known = known.withColumn(f"_label_{target}", F.col(target).cast("double"))
            stages.append(GBTRegressor(
                labelCol=f"_label_{target}", predictionCol=f"_pred_{target}", maxIter=max_iter, **common))
            pipeline = Pipeline(stages=stages).fit(known)
        else:
            known = known.withColumn(f"_label_{target}", F.col(target).cast("string"))
            labels = StringIndexer(inputCol=f"_label_{target}", outputCol=f"_y_{target}").fit(known)
            stages.append(RandomForestClassifier(
                labelCol=f"_y_{target}", predictionCol=f"_index_{target}", rawPredictionCol=f"_raw_{target}",
                probabilityCol=f"_prob_{target}", numTrees=trees, **common))
            stages.append(IndexToString(
                inputCol=f"_index_{target}", outputCol=f"_pred_{target}", labels=labels.labels))
            pipeline = Pipeline(stages=stages).fit(labels.transform(known))
        imputers.pipelines[target] = pipeline
    return imputers


def score_imputers(
    models: DataFrame, roles: Mapping[str, str], targets: Sequence[str], key: Sequence[str], folds: int = 4,
    seed: int = 0, **options,
) -> dict[str, float]:
    """Hold-out quality: R squared for numbers, accuracy for flags and categories, of the targets that can be learned."""
    models = with_gaps_null(models, roles)
    fold = fold_of(key, folds, seed)
    train, held_out = models.where(fold != 0), models.where(fold == 0)
    imputers = train_imputers(train, roles, targets, seed=seed, **options)
    scores = {}
    for target in imputers.pipelines:
        truth = held_out.where(F.col(target).isNotNull()).withColumn("_truth", F.col(target))
        featured = _feature_columns(truth, roles, imputers.fills)
        out = imputers.pipelines[target].transform(featured)
        if roles[target] == "numerical":
            out = out.withColumn("_truth", F.col("_truth").cast("double"))
            scores[target] = RegressionEvaluator(
                labelCol="_truth", predictionCol=f"_pred_{target}", metricName="r2").evaluate(out)
        else:
            out = out.select(
                F.lit(0.0).alias("y"), F.when(F.col(f"_pred_{target}") == F.col("_truth").cast("string"), 0.0)
                .otherwise(1.0).alias("p"))
            scores[target] = MulticlassClassificationEvaluator(
                labelCol="y", predictionCol="p", metricName="accuracy").evaluate(out)
    return scores


def load_scores(spark: SparkSession, scores: Mapping[str, float]) -> DataFrame:
    return spark.createDataFrame(sorted(scores.items()), "target string, score double")
