"""Proportional hazards: linear and boosted predictors, baseline hazard, expected lifetime."""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordering import axis_bounds, axis_sketch, backwards, bounds_from, running_sum
from ..functions.staging_area import forget, stage
from .trees import BINS, Tree, bin_edges_of, bin_of, binned, grow_by_fit, total


def compact_subjects(
    subjects: DataFrame, features: Sequence[str], duration: str, event: str, weight: str | None = None,
    merge: bool = True,
) -> DataFrame:
    """Equal subjects become one row with their summed weight ``w``; model-level attributes compact best.

    With features that differ from row to row, ``merge=False`` saves a shuffle that would not make the data smaller.
    Subjects that lack a feature, the duration or the event are left out (``incomplete_subjects`` counts them);
    ``roles.numeric_features`` turns gaps into indicators beforehand.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    columns = [*[F.col(f).cast("double").alias(f) for f in features], F.col(duration).cast("double").alias("t"),
               F.col(event).cast("double").alias("e")]
    subjects = subjects.where(~_incomplete([*features, duration, event]))
    if not merge:
        return subjects.select(*columns, w.alias("w"))
    return subjects.groupBy(*columns).agg(F.sum(w).alias("w"))


def _incomplete(columns: Sequence[str]) -> Column:
    gaps = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in columns]
    return reduce(lambda a, b: a | b, gaps, F.lit(False))


def incomplete_subjects(
    subjects: DataFrame, features: Sequence[str], duration: str = "duration_worked", event: str = "failed",
) -> DataFrame:
    """One row: how many subjects a fit leaves out because of a gap, and how many there are."""
    return subjects.agg(
        F.count_if(_incomplete([*features, duration, event])).alias("left_out"), F.count("*").alias("subjects"))


def _at_risk(axis: DataFrame, sums: Mapping[str, str], block_width: float | None, keys: Sequence[str] = ()) -> DataFrame:
    """Totals over subjects that live at least as long, along the compacted duration axis (of each of ``keys``)."""
    return running_sum(axis.withColumn("_neg", -F.col("t")), keys, "_neg", dict(sums), backwards(block_width)).drop("_neg")


@dataclass
class CoxModel:
    """Linear predictor ``sum(coefficients * (x - means))``."""

    features: list[str]
    coefficients: list[float]
    means: list[float]
    log_likelihood: float
    steps: int
    converged: bool
    covariance: list[list[float]] = field(default_factory=list)

    def log_hazard(self) -> Column:
        terms = [F.lit(b) * (F.col(f) - F.lit(m)) for f, b, m in zip(self.features, self.coefficients, self.means)]
        return reduce(lambda a, b: a + b, terms)

    def contributions(self) -> dict[str, Column]:
        """Exact additive contributions of a linear predictor."""
        return {f: F.lit(b) * (F.col(f) - F.lit(m)) for f, b, m in zip(self.features, self.coefficients, self.means)}

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(self.__dict__),)], "model string").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> CoxModel:
        return CoxModel(**json.loads(spark.read.parquet(path).first()["model"]))


def fit_cox(
    subjects: DataFrame, features: Sequence[str], duration: str = "duration_worked", event: str = "failed",
    weight: str | None = None, max_steps: int = 20, tolerance: float = 1e-6, ridge: float = 0.0,
    block_width: float | None = None, merge: bool = True,
) -> CoxModel:
    """Newton's method for the Breslow partial likelihood.

    A step is one job: an aggregation to the duration axis, totals along that axis, and one row of 1 + p + p(p+1)/2
    numbers that reaches the driver, where the p x p system is solved. Features are standardised inside.
    """
    data = compact_subjects(subjects, features, duration, event, weight, merge)
    return _newton_fits(data, features, [None], max_steps, tolerance, ridge, block_width)[0]


def fit_cox_folds(
    subjects: DataFrame, features: Sequence[str], fold: Column, folds: int, duration: str = "duration_worked",
    event: str = "failed", weight: str | None = None, max_steps: int = 20, tolerance: float = 1e-6, ridge: float = 0.0,
    block_width: float | None = None, merge: bool = True,
) -> list[CoxModel]:
    """The fits of a cross-validation, side by side: model k is fitted on all folds but k.

    Subjects are compacted once, with their fold. A Newton step is one job for all folds: each row adds to the sums of the
    folds it does not belong to, under that fold's coefficients; counts and moments of a fold are the totals without its
    own. A fold that has converged drops out of the sums.
    """
    tagged = subjects.withColumn("fold_", fold.cast("double"))
    data = compact_subjects(tagged, [*features, "fold_"], duration, event, weight, merge)
    return _newton_fits(data, features, list(range(folds)), max_steps, tolerance, ridge, block_width)


def _newton_fits(
    data: DataFrame, features: Sequence[str], without: Sequence[int | None], max_steps: int, tolerance: float, ridge: float,
    block_width: float | None,
) -> list[CoxModel]:
    """One fit per entry of ``without``, on the rows of other folds (all rows, where it is None)."""
    features = list(features)
    p, fits = len(features), len(without)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    kept = [F.lit(True) if k is None else F.col("fold_") != k for k in without]
    try:
        mine = [F.when(keep, F.col("w")).otherwise(0.0) for keep in kept]
        stats = data.agg(*[x for k in range(fits) for x in (
            F.sum(mine[k]).alias(f"w_{k}"),
            *[F.sum(mine[k] * F.col(f)).alias(f"m_{k}_{i}") for i, f in enumerate(features)],
            *[F.sum(mine[k] * F.col(f) * F.col(f)).alias(f"q_{k}_{i}") for i, f in enumerate(features)])],
            *axis_sketch("t", "axis_")).first()
        block_width = bounds_from(stats, "axis_") if block_width is None else block_width
        if any(not stats[f"w_{k}"] for k in range(fits)):
            raise ValueError("no failures among the subjects")
        means = np.array([[stats[f"m_{k}_{i}"] / stats[f"w_{k}"] for i in range(p)] for k in range(fits)])
        squares = np.array([[stats[f"q_{k}_{i}"] / stats[f"w_{k}"] for i in range(p)] for k in range(fits)])
        scales = np.sqrt(np.maximum(squares - means ** 2, 0.0))
        scales[scales < 1e-12] = 1.0
        pairs = [(i, j) for i in range(p) for j in range(i, p)]

        def derivatives(trials: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
            columns, sums, named = ["t"], [], []
            for k, beta in trials.items():
                x = [(F.col(f) - F.lit(float(m))) / F.lit(float(s)) for f, m, s in zip(features, means[k], scales[k])]
                eta = reduce(lambda a, b: a + b, [F.lit(float(b)) * c for b, c in zip(beta, x)])
                columns += [F.when(kept[k], F.col("w") * F.col("e")).otherwise(0.0).alias(f"d_{k}"), eta.alias(f"eta_{k}"),
                            F.when(kept[k], F.col("w") * F.exp(eta)).otherwise(0.0).alias(f"r_{k}"),
                            *[c.alias(f"x_{k}_{i}") for i, c in enumerate(x)]]
                r, d, xs = F.col(f"r_{k}"), F.col(f"d_{k}"), [F.col(f"x_{k}_{i}") for i in range(p)]
                sums += [F.sum(r).alias(f"r0_{k}"), F.sum(d).alias(f"d_{k}"), F.sum(d * F.col(f"eta_{k}")).alias(f"de_{k}"),
                         *[F.sum(r * c).alias(f"r1_{k}_{i}") for i, c in enumerate(xs)],
                         *[F.sum(r * xs[i] * xs[j]).alias(f"r2_{k}_{i}_{j}") for i, j in pairs],
                         *[F.sum(d * c).alias(f"dx_{k}_{i}") for i, c in enumerate(xs)]]
                named += [f"r0_{k}", *[f"r1_{k}_{i}" for i in range(p)], *[f"r2_{k}_{i}_{j}" for i, j in pairs]]
            axis = data.select(*columns).groupBy("t").agg(*sums)
            axis = _at_risk(axis, {f"s_{n}": n for n in named}, block_width).where(
                reduce(lambda a, b: a | b, [F.col(f"d_{k}") > 0 for k in trials]))

            def over(d: Column, numerator: Column) -> Column:  # times without failures of this fit add nothing
                return F.sum(F.when(d > 0, d * numerator).otherwise(0.0))

            numbers = []
            for k in trials:
                s0, d = F.col(f"s_r0_{k}"), F.col(f"d_{k}")
                s1 = [F.col(f"s_r1_{k}_{i}") for i in range(p)]
                numbers += [
                    F.sum(d).alias(f"n_{k}"), (F.sum(f"de_{k}") - over(d, F.ln(s0))).alias(f"ll_{k}"),
                    *[(F.sum(f"dx_{k}_{i}") - over(d, s1[i] / s0)).alias(f"g_{k}_{i}") for i in range(p)],
                    *[over(d, F.col(f"s_r2_{k}_{i}_{j}") / s0 - s1[i] * s1[j] / (s0 * s0)).alias(f"h_{k}_{i}_{j}") for i, j in pairs]]
            row = axis.agg(*numbers).first()
            out = {}
            for k, beta in trials.items():
                if not row[f"n_{k}"]:
                    raise ValueError("no failures among the subjects")
                grad = np.array([row[f"g_{k}_{i}"] for i in range(p)]) - ridge * beta
                hess = np.zeros((p, p))
                for i, j in pairs:
                    hess[i, j] = hess[j, i] = row[f"h_{k}_{i}_{j}"]
                out[k] = row[f"ll_{k}"] - 0.5 * ridge * float(beta @ beta), grad, hess + ridge * np.eye(p)
            return out

        beta = {k: np.zeros(p) for k in range(fits)}
        at = derivatives(beta)
        steps, halvings = [0] * fits, [0] * fits
        converged, open_fits = [False] * fits, set(range(fits)) if max_steps > 0 else set()
        move = {k: np.linalg.lstsq(at[k][2], at[k][1], rcond=None)[0] for k in open_fits}
        while open_fits:
            trials = {k: beta[k] + move[k] / 2 ** halvings[k] for k in sorted(open_fits)}
            for k, found in derivatives(trials).items():
                if not (math.isfinite(found[0]) and found[0] >= at[k][0] - 1e-12 * abs(at[k][0])):
                    halvings[k] += 1
                    if halvings[k] == 30:
                        open_fits.discard(k)  # no better point on the way: the old one stays, without convergence
                    continue
                # The step itself is the measure: convergence is quadratic, so the error left is about its square.
                converged[k] = float(np.max(np.abs(trials[k] - beta[k]))) <= tolerance
                beta[k], at[k], halvings[k] = trials[k], found, 0
                steps[k] += 1
                if converged[k] or steps[k] >= max_steps:
                    open_fits.discard(k)
                else:
                    move[k] = np.linalg.lstsq(found[2], found[1], rcond=None)[0]
        if not all(converged):
            warnings.warn(f"the fit has not converged after {max(steps)} steps", stacklevel=3)
        return [CoxModel(
            features, (beta[k] / scales[k]).tolist(), means[k].tolist(), float(at[k][0]), steps[k], converged[k],
            (np.linalg.pinv(at[k][2]) / np.outer(scales[k], scales[k])).tolist()) for k in range(fits)]
    finally:
        data.unpersist()


def baseline_hazard(
    scored: DataFrame, log_hazard: Column, duration: str = "duration_worked", event: str = "failed",
    weight: str | None = None, block_width: float | None = None,
) -> DataFrame:
    """Breslow: hazard per duration (failures over the hazard-weighted risk set) and its running sum.

    Subjects without a duration, event or log hazard belong to no risk set and are left out.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    known = F.col(duration).isNotNull() & F.col(event).isNotNull() & log_hazard.isNotNull() & ~F.isnan(log_hazard)
    block_width = axis_bounds(scored, duration) if block_width is None else block_width
    axis = scored.where(known).groupBy(F.col(duration).cast("double").alias("t")).agg(
        F.sum(w * F.exp(log_hazard)).alias("_r"), F.sum(w * F.col(event).cast("double")).alias("_d"))
    axis = _at_risk(axis, {"_s": "_r"}, block_width).select("t", (F.col("_d") / F.col("_s")).alias("hazard"))
    return running_sum(axis, [], "t", {"cumulative_hazard": "hazard"}, block_width)


def expected_survival(
    rows: DataFrame, log_hazard: Column, baseline: DataFrame, from_zero: bool = True, block_width: float = 512.0,
) -> DataFrame:
    """Adds ``predicted_survival``: the area under ``exp(-cumulative_hazard * e^eta)`` by trapezoids.

    The area is taken once per distinct predictor value: partial areas of every (value, block of the axis) are added up, so
    no row holds the whole baseline, and models that share attributes are integrated once. Every row comes back; one
    without a predictor value has a null prediction.
    """
    axis = baseline.where(F.col("t").isNotNull()).select(
        F.col("t"), F.col("cumulative_hazard").alias("h"), F.floor(F.col("t") / block_width).cast("long").alias("_block"))
    blocks = axis.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("t", "h"))).alias("_points"))
    # What a block needs of the one before it is that one's last point. There are as many rows as blocks.
    w = Window.orderBy("_block")
    last = F.element_at("_points", -1)
    start = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("h")) if from_zero else F.element_at("_points", 1)
    blocks = blocks.withColumn("_from", F.coalesce(F.lag(last).over(w), start))
    scored = rows.withColumn("_eta", log_hazard)
    distinct = scored.select("_eta").where(F.col("_eta").isNotNull() & ~F.isnan("_eta")).distinct()
    risk = F.exp("_eta")

    def survival(p: Column) -> Column:
        return F.exp(-p["h"] * risk)

    zero = F.struct(F.col("_from")["t"].alias("t"), survival(F.col("_from")).alias("s"), F.lit(0.0).alias("area"))

    def advance(acc: Column, p: Column) -> Column:
        s = survival(p)
        area = acc["area"] + (p["t"] - acc["t"]) * (acc["s"] + s) / 2
        return F.struct(p["t"].alias("t"), s.alias("s"), area.alias("area"))

    # Every predictor value is integrated over every block: that is the integral itself, cut into pieces.
    keyed = blocks.agg(F.sort_array(F.collect_list("_block")).alias("b")).scalar()
    pieces = distinct.withColumn("_block", F.explode(keyed)).join(blocks, "_block").select(
        "_eta", F.aggregate("_points", zero, advance, lambda acc: acc["area"]).alias("piece"))
    areas = pieces.groupBy(F.col("_eta").alias("_of")).agg(F.sum("piece").alias("predicted_survival"))
    return scored.join(areas, F.col("_eta") == F.col("_of"), "left").drop("_eta", "_of")


@dataclass
class BoostedCoxModel:
    """Log hazard as a sum of regression trees; null features follow the direction that the trees have learned."""

    features: list[str]
    trees: list[Tree]
    rate: float

    def log_hazard(self) -> Column:
        return total(self.trees, [F.col(f).cast("double") for f in self.features], self.rate)

    def with_log_hazard(self, df: DataFrame, out: str = "log_hazard") -> DataFrame:
        return df.withColumn(out, self.log_hazard())

    def save(self, spark: SparkSession, path: str) -> None:
        info = json.dumps({"features": self.features, "rate": self.rate, "trees": [t.to_list() for t in self.trees]})
        spark.createDataFrame([(info,)], "model string").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedCoxModel:
        info = json.loads(spark.read.parquet(path).first()["model"])
        return BoostedCoxModel(info["features"], [Tree.of_list(t) for t in info["trees"]], info["rate"])


def fit_boosted_cox(
    subjects: DataFrame, features: Sequence[str], duration: str = "duration_worked", event: str = "failed",
    weight: str | None = None, rounds: int = 10, max_depth: int = 3, rate: float = 0.3, checkpoint_every: int = 3,
    min_node_weight: float = 0.0, block_width: float | None = None, merge: bool = True, ridge: float = 0.0, bins: int = BINS,
) -> BoostedCoxModel:
    """Second-order boosting of the Breslow partial likelihood.

    Features are cut into bins once, and equal subjects become one row. A round takes two totals along the duration axis,
    joins them back to the rows (the axis has one row per distinct duration; it is broadcast where durations are whole days,
    else Catalyst decides by size), and grows one tree from histograms of first and second derivatives, one aggregation per level.
    Subjects without duration or event are left out; null features are a bin of their own. The predictor is an expression of
    the trees over the stored bins, and is stored itself every ``checkpoint_every`` rounds, so plans stay short.
    """
    return _boosted_fits(subjects, features, None, [None], duration, event, weight, rounds, max_depth, rate, checkpoint_every,
                         min_node_weight, block_width, merge, ridge, bins)[0]


def fit_boosted_cox_folds(
    subjects: DataFrame, features: Sequence[str], fold: Column, folds: int, duration: str = "duration_worked",
    event: str = "failed", weight: str | None = None, rounds: int = 10, max_depth: int = 3, rate: float = 0.3,
    checkpoint_every: int = 3, min_node_weight: float = 0.0, block_width: float | None = None, merge: bool = True,
    ridge: float = 0.0, bins: int = BINS,
) -> list[BoostedCoxModel]:
    """The fits of a cross-validation, side by side: model k is fitted on all folds but k, with bins of its own.

    A subject is stored once for each fit that it trains, under that fit's number. Rounds and levels are those of one fit:
    a round takes one axis, one join and one aggregation per level for all folds. Subjects without a fold train none.
    """
    return _boosted_fits(subjects, features, fold, list(range(folds)), duration, event, weight, rounds, max_depth, rate,
                         checkpoint_every, min_node_weight, block_width, merge, ridge, bins)


def log_hazard_of_fold(models: Sequence[BoostedCoxModel], fold: Column) -> Column:
    """The predictor of the model that has not seen the row's fold."""
    return reduce(lambda rest, k: F.when(fold == k, models[k].log_hazard()).otherwise(rest), range(len(models)), F.lit(None).cast("double"))


def _boosted_fits(
    subjects: DataFrame, features: Sequence[str], fold: Column | None, without: Sequence[int | None], duration: str, event: str,
    weight: str | None, rounds: int, max_depth: int, rate: float, checkpoint_every: int, min_node_weight: float,
    block_width: float | None, merge: bool, ridge: float, bins: int,
) -> list[BoostedCoxModel]:
    """One fit per entry of ``without``, on the rows of other folds (all rows, where it is None)."""
    features, fits = list(features), len(without)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    known = subjects.where(~_incomplete([duration, event])).select(
        *features, F.col(duration).cast("double").alias("t_"), F.col(event).cast("double").alias("e_"), w.alias("w_"),
        *([] if fold is None else [fold.alias("fold_")]))
    known = stage(known, "boosted-subjects")
    block_width = axis_bounds(known, "t_") if block_width is None else block_width
    kept = [F.lit(True) if k is None else F.col("fold_") != k for k in without]
    edges = bin_edges_of(known, features, kept, bins)
    columns = [f"bin_{i}" for i in range(len(features))]
    subject = [F.col("t_").alias("t"), F.col("e_").alias("e"), F.col("w_").alias("w")]
    if fits == 1:
        data = binned(known.where(kept[0]), features, edges[0], F.lit(0).alias("fit"), *subject)
    else:
        each = [F.when(keep, F.struct(F.lit(k).alias("fit"), *[
            bin_of(F.col(f).cast("double"), e).alias(c) for f, e, c in zip(features, edges[k], columns, strict=True)]))
            for k, keep in enumerate(kept)]
        data = known.select(F.explode(F.array_compact(F.array(*each))).alias("b"), *subject).select("b.*", "t", "e", "w")
    if merge:
        data = data.groupBy("fit", *columns, "t", "e").agg(F.sum("w").alias("w"))
    stored = stage(data.withColumn("start", F.lit(0.0)), "boosted-rows")
    forget(known)
    grown: list[list[Tree]] = []  # by round: a tree of each fit
    fresh: list[list[Tree]] = []  # rounds that the stored start does not hold yet: an expression over the bins
    cells = [F.col(c) for c in columns]

    def value(trees: list[Tree]) -> Column:
        out = trees[0].value_of(cells, binned=True)
        for k in range(1, fits):
            out = F.when(F.col("fit") == k, trees[k].value_of(cells, binned=True)).otherwise(out)
        return out

    def so_far() -> Column:
        return reduce(lambda a, trees: a + F.lit(rate) * value(trees), fresh, F.col("start"))

    for _ in range(rounds):
        if len(fresh) == checkpoint_every:
            before, stored = stored, stage(stored.withColumn("start", so_far()), "boosted-rows")
            forget(before)
            fresh = []
        data = stored.withColumn("eta", so_far())
        axis = data.groupBy("fit", "t").agg(
            F.sum(F.col("w") * F.exp("eta")).alias("_r"), F.sum(F.col("w") * F.col("e")).alias("_d"))
        axis = _at_risk(axis, {"_s": "_r"}, block_width, ["fit"]).select(
            "fit", "t", (F.col("_d") / F.col("_s")).alias("_h1"), (F.col("_d") / (F.col("_s") * F.col("_s"))).alias("_h2"))
        axis = running_sum(axis, ["fit"], "t", {"_a": "_h1", "_b": "_h2"}, block_width).select("fit", "t", "_a", "_b")
        if block_width is None:  # whole days: ``AXIS_ROWS`` points of each fit at most, so the rows stay where they are
            axis = F.broadcast(axis)
        risk = F.exp("eta")
        rows = data.join(axis, ["fit", "t"]).select(
            "fit", *columns, (F.col("w") * (risk * F.col("_a") - F.col("e"))).alias("g"),
            (F.col("w") * F.greatest(risk * F.col("_a") - risk * risk * F.col("_b"), F.lit(1e-9))).alias("h"))
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)  # every level reads them
        try:
            fresh.append(grow_by_fit(rows, edges, max_depth, ridge, min_node_weight))
        finally:
            rows.unpersist()
        grown.append(fresh[-1])
    forget(stored)
    return [BoostedCoxModel(features, [trees[k] for trees in grown], rate) for k in range(fits)]
