"""Regressions, cross-validation, imputation, scoring, streams and writable forms."""

from __future__ import annotations

import datetime

from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import durations, schema_tools, stage_store
from ..functions.staging_area import new_folder, stage
from ..operators import enrich, lifespan, sampling
from ..plans import cox, evaluate, explain, impute, roles, score, search, trees, weibull
from ..sources import store
from ..streaming import lifespan_stream
from . import fleet_queries as fleet
from . import views as v
from .registry import query

W = "WITH "
PAIR = ["l_quantity", "l_tax"]


PAIR_ROWS = """c AS (SELECT duration_worked AS t, l_quantity AS x, l_tax AS y, count(*)::DOUBLE AS w, sum(failed::INT)::DOUBLE AS d FROM sv GROUP BY ALL)"""


def _newton_ctes(rows: str, steps: int) -> str:
    """Unrolled Newton steps of the two-feature Breslow likelihood over ``c(t, x, y, w, d)``; ends in ``b<steps>``."""
    text = f"""{rows}, mu AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM c),
b0 AS (SELECT 0.0e0 AS bx, 0.0e0 AS byy)"""
    for k in range(steps):
        text += f""",
a{k} AS (SELECT t, sum(d) AS d, sum(d * x) AS dx, sum(d * y) AS dy, sum(w * e) AS s, sum(w * e * x) AS sx, sum(w * e * y) AS sy,
  sum(w * e * x * x) AS sxx, sum(w * e * x * y) AS sxy, sum(w * e * y * y) AS syy
  FROM (SELECT t, w, d, x - mx AS x, y - my AS y, exp(bx * (x - mx) + byy * (y - my)) AS e FROM c, b{k}, mu) GROUP BY t),
r{k} AS (SELECT t, d, dx, dy, sum(s) OVER w AS s, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx,
  sum(sxy) OVER w AS sxy, sum(syy) OVER w AS syy FROM a{k} WINDOW w AS (ORDER BY t DESC)),
g{k} AS (SELECT sum(dx) - sum(d * sx / s) AS gx, sum(dy) - sum(d * sy / s) AS gy, sum(d * (sxx / s - (sx / s) ** 2)) AS hxx,
  sum(d * (sxy / s - sx * sy / (s * s))) AS hxy, sum(d * (syy / s - (sy / s) ** 2)) AS hyy FROM r{k}),
b{k + 1} AS (SELECT bx + (hyy * gx - hxy * gy) / (hxx * hyy - hxy * hxy) AS bx, byy + (hxx * gy - hxy * gx) / (hxx * hyy - hxy * hxy) AS byy FROM b{k}, g{k})"""
    return text


def _newton_sql(steps: int) -> str:
    return W + v.SV + ", " + _newton_ctes(PAIR_ROWS, steps) + f"""
SELECT 'l_quantity' AS feature, round(bx, 6) + 0 AS coefficient FROM b{steps} UNION ALL SELECT 'l_tax', round(byy, 6) + 0 FROM b{steps}"""


@query("cox_coefficients", "F6", sql=_newton_sql(6))
def cox_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    model = cox.fit_cox(v.subjects(spark, sf, *PAIR), PAIR)
    rows = [(f, float(b)) for f, b in zip(model.features, model.coefficients)]
    return spark.createDataFrame(rows, "feature string, coefficient double").select(
        "feature", (F.round("coefficient", 6) + 0).alias("coefficient"))


def pairs_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return v.subjects(spark, sf, *PAIR).withColumns({
        "duration_worked": F.when(F.col("l_orderkey") % 5 != 0, F.col("duration_worked")),
        "l_quantity": F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity"))})


GAP_ROWS = """c AS (SELECT duration_worked AS t, l_quantity AS x, l_tax AS y, count(*)::DOUBLE AS w, sum(failed::INT)::DOUBLE AS d FROM sv
  WHERE l_orderkey % 5 <> 0 AND l_partkey % 7 <> 0 GROUP BY ALL)"""


@query("cox_with_gaps", "F6 F22", sql=W + v.SV + ", " + _newton_ctes(GAP_ROWS, 6) + """
SELECT 'l_quantity' AS feature, round(bx, 6) + 0 AS coefficient, (SELECT count(*) FROM sv WHERE l_orderkey % 5 = 0 OR l_partkey % 7 = 0) AS left_out FROM b6
UNION ALL SELECT 'l_tax', round(byy, 6) + 0, (SELECT count(*) FROM sv WHERE l_orderkey % 5 = 0 OR l_partkey % 7 = 0) FROM b6""")
def cox_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects with gaps are in neither the failures nor the risk sets, and are counted."""
    rows = pairs_with_gaps(spark, sf)
    model = cox.fit_cox(rows, PAIR)
    lost = cox.incomplete_subjects(rows, PAIR).first()["left_out"]
    out = [(f, float(b), lost) for f, b in zip(model.features, model.coefficients)]
    return spark.createDataFrame(out, "feature string, coefficient double, left_out bigint").withColumn(
        "coefficient", F.round("coefficient", 6) + 0)


@query("expected_survival_with_gaps", "F9 F8", sql=W + v.SV + """,
h AS (SELECT t, d / sum(r) OVER (ORDER BY t DESC) AS hazard FROM (SELECT duration_worked AS t, sum(failed::INT)::DOUBLE AS d,
  sum(exp(0.01e0 * l_quantity)) AS r FROM sv WHERE l_orderkey % 5 <> 0 AND l_partkey % 7 <> 0 GROUP BY 1)),
base AS (SELECT t, sum(hazard) OVER (ORDER BY t) AS ch FROM h UNION ALL SELECT 0.0e0, 0.0e0),
cells AS (SELECT DISTINCT l_quantity AS q FROM sv),
lines AS (SELECT q, t, exp(-ch * exp(0.01e0 * q)) AS s FROM base, cells),
legs AS (SELECT *, lead(t) OVER (PARTITION BY q ORDER BY t) AS t2, lead(s) OVER (PARTITION BY q ORDER BY t) AS s2 FROM lines),
areas AS (SELECT q, sum((t2 - t) * (s + s2) / 2) AS area FROM legs GROUP BY q)
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 <> 0 THEN round(area, 4) END AS predicted_survival FROM sv JOIN areas ON q = l_quantity""")
def expected_survival_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Every subject comes back; without the feature its prediction is null."""
    rows = pairs_with_gaps(spark, sf)
    hazard = F.lit(0.01) * F.col("l_quantity")
    baseline = cox.baseline_hazard(rows, hazard)
    return cox.expected_survival(rows, hazard, baseline).select(
        "l_orderkey", "l_linenumber", F.round("predicted_survival", 4).alias("predicted_survival"))


@query("lost_failures_with_gaps", "F1", sql=W + v.LIFESPANS + """,
hours_at AS (SELECT l.drive_id, failure_day, max(CASE WHEN l.drive_id % 3 <> 0 THEN power_on_hours_raw END) AS hours FROM lifespans l
  LEFT JOIN t1 ON t1.drive_id = l.drive_id AND t1.day = l.failure_day GROUP BY ALL)
SELECT count(*) FILTER (failure_day IS NOT NULL AND hours IS NULL) AS lost_failures, count(*) AS devices FROM hours_at""")
def lost_failures_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the drives reports no hours, so their failures count as censored in full mode."""
    rows = v.telemetry(spark, sf).withColumn("power_on_hours_raw", F.when(F.col("drive_id") % 3 != 0, F.col("power_on_hours_raw")))
    spans = lifespan.lifespans_with_hours(rows)
    return lifespan.lost_failures(lifespan.worked_days(spans, reduced=False))


def drive_subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Drives as subjects, with numeric features of their telemetry and place."""
    hours = fleet.hours_at_key_days(spark, sf)
    c = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("drive_id"), "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    return lifespan.duration_and_event(lifespan.worked_days(hours)).select(
        "drive_id", "failed", "duration_worked", (F.col("first_hours") / 1000).alias("first_hours")).join(c, "drive_id")


DRIVE_FEATURES = ["first_hours", "c_acctbal", "nation"]


@query("boosted_cox", "F7 F21")
def boosted_cox(spark: SparkSession, sf: str) -> DataFrame:
    rows = drive_subjects(spark, sf)
    model = cox.fit_boosted_cox(rows, DRIVE_FEATURES)
    path = new_folder(spark, "boosted")
    model.save(spark, path)
    return cox.BoostedCoxModel.load(spark, path).with_log_hazard(rows).select("drive_id", "failed", "duration_worked", "log_hazard")


@query("boosted_contributions", "F15")
def boosted_contributions(spark: SparkSession, sf: str) -> DataFrame:
    rows = drive_subjects(spark, sf)
    model = cox.fit_boosted_cox(rows, DRIVE_FEATURES)
    explained, base = explain.tree_contributions(model.with_log_hazard(rows), model, interactions=True)
    phi = [c for c in explained.columns if c.startswith("phi_")]
    return explained.select("drive_id", "log_hazard", F.lit(base).alias("base"), *phi)


def _split_ctes(name: str, cells: str) -> str:
    """The best split of each node of ``cells`` (x, y, g, h, node): sums by value, both sides for nulls, all gains; ends in
    ``<name>s``, the cells with the side they go to."""
    x = "CASE f WHEN 0 THEN x ELSE y END"
    return f"""
{name}u AS (SELECT node, 0 AS f, x AS v, g, h FROM {cells} UNION ALL SELECT node, 1, y, g, h FROM {cells}),
{name}v AS (SELECT node, f, v, sum(g) AS g, sum(h) AS h FROM {name}u GROUP BY ALL),
{name}n AS (SELECT node, f, sum(g) AS g, sum(h) AS h, coalesce(sum(g) FILTER (v IS NULL), 0) AS gn,
  coalesce(sum(h) FILTER (v IS NULL), 0) AS hn, count(*) FILTER (v IS NULL) AS nn, count(v) AS nv FROM {name}v GROUP BY ALL),
{name}c AS (SELECT node, f, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, row_number() OVER w AS nth FROM {name}v WHERE v IS NOT NULL
  WINDOW w AS (PARTITION BY node, f ORDER BY v)),
{name}d AS (SELECT c.node, c.f, c.v, k.side, c.gl + k.side * n.gn AS gl, c.hl + k.side * n.hn AS hl, n.g, n.h, n.nn
  FROM {name}c c JOIN {name}n n USING (node, f), (VALUES (0), (1)) k(side)
  WHERE (k.side = 0 OR n.nn > 0) AND (c.nth < n.nv OR (k.side = 0 AND n.nn > 0))),
{name}b AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gl * gl / hl + (g - gl) * (g - gl) / (h - hl) DESC, f, v, side) AS best FROM {name}d),
{name}s AS (SELECT e.x, e.y, e.g, e.h, e.node, CASE WHEN ({x}) IS NULL THEN (CASE WHEN nn > 0 THEN side = 1 ELSE b.hl > b.h - b.hl END)
  ELSE ({x}) <= v END AS goes FROM {cells} e JOIN {name}b b ON e.node = b.node AND best = 1)"""


def _boosted_sql(rounds: int) -> str:
    """Unrolled boosting of depth two on ``l_quantity``, which has gaps, and ``l_tax``."""
    text = W + v.SV + """,
c0 AS (SELECT duration_worked AS t, CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS x, l_tax AS y, count(*)::DOUBLE AS w,
  sum(failed::INT)::DOUBLE AS d, 0.0e0 AS eta FROM sv GROUP BY ALL)"""
    for r in range(rounds):
        text += f""",
ax{r} AS (SELECT t, sum(d) AS d, sum(sum(w * exp(eta))) OVER (ORDER BY t DESC) AS s FROM c{r} GROUP BY t),
sm{r} AS (SELECT t, sum(d / s) OVER (ORDER BY t) AS a, sum(d / (s * s)) OVER (ORDER BY t) AS b FROM ax{r}),
gh{r} AS (SELECT x, y, 0 AS node, sum(w * exp(eta) * a - d) AS g, sum(w * greatest(exp(eta) * a - exp(2 * eta) * b, 1e-9)) AS h
  FROM c{r} JOIN sm{r} USING (t) GROUP BY x, y),{_split_ctes(f"p{r}", f"gh{r}")},
lv{r} AS (SELECT x, y, g, h, goes::INT AS node FROM p{r}s),{_split_ctes(f"q{r}", f"lv{r}")},
lf{r} AS (SELECT x, y, -sum(g) OVER w / sum(h) OVER w AS value FROM q{r}s WINDOW w AS (PARTITION BY node, goes)),
c{r + 1} AS (SELECT c.t, c.x, c.y, c.w, c.d, c.eta + 0.3e0 * value AS eta FROM c{r} c JOIN lf{r} l ON c.y = l.y AND c.x IS NOT DISTINCT FROM l.x)"""
    return text + f"""
SELECT x AS l_quantity, y AS l_tax, round(any_value(eta), 6) + 0 AS log_hazard, CAST(sum(w) AS BIGINT) AS subjects FROM c{rounds} GROUP BY x, y"""


@query("boosted_rounds", "F7 F21", sql=_boosted_sql(3))
def boosted_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Three rounds of depth two on a feature with gaps, written, read again and applied."""
    rows = v.subjects(spark, sf, *PAIR).withColumn("l_quantity", F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")))
    path = new_folder(spark, "boosted")
    cox.fit_boosted_cox(rows, PAIR, rounds=3, max_depth=2).save(spark, path)
    cells = rows.groupBy(*PAIR).agg(F.count("*").alias("subjects"))
    out = cox.BoostedCoxModel.load(spark, path).with_log_hazard(cells)
    return out.withColumn("log_hazard", F.round("log_hazard", 6) + 0)


STUMP = v.SV + """, c AS (SELECT duration_worked AS t, CASE WHEN l_quantity > 25 THEN 1.0e0 ELSE 0.0e0 END AS large, count(*)::DOUBLE AS w,
  sum(failed::INT)::DOUBLE AS d FROM sv GROUP BY ALL),
axis AS (SELECT t, sum(d) AS d, sum(sum(w)) OVER (ORDER BY t DESC) AS s FROM c GROUP BY t),
sums AS (SELECT t, sum(d / s) OVER (ORDER BY t) AS a, sum(d / (s * s)) OVER (ORDER BY t) AS b FROM axis),
leaf AS (SELECT large, sum(d - w * a) / sum(w * greatest(a - b, 1e-9)) AS value, sum(w * greatest(a - b, 1e-9)) AS cover FROM c JOIN sums USING (t) GROUP BY large),
base AS (SELECT 0.3e0 * sum(value * cover) / sum(cover) AS base FROM leaf)"""


@query("boosted_stump", "F7 F15", sql=W + STUMP + """
SELECT large, round(0.3e0 * value, 6) + 0 AS log_hazard, round(0.3e0 * value - base, 6) + 0 AS phi_large, round(base, 6) + 0 AS base FROM leaf, base""")
def boosted_stump(spark: SparkSession, sf: str) -> DataFrame:
    """One round with one split on a flag, and what it says of either value."""
    rows = v.subjects(spark, sf, "l_quantity").withColumn("large", (F.col("l_quantity") > 25).cast("double"))
    model = cox.fit_boosted_cox(rows, ["large"], rounds=1, max_depth=1, rate=0.3)
    explained, base = explain.tree_contributions(model.with_log_hazard(rows.select("large").distinct()), model)
    return explained.select("large", *[(F.round(c, 6) + 0).alias(n) for c, n in (
        ("log_hazard", "log_hazard"), ("phi_large", "phi_large"))], (F.round(F.lit(base), 6) + 0).alias("base"))


def _fold_sql(k: int) -> str:
    """Concordance of fold k under the coefficients of the other fold."""
    rows = f"""c AS (SELECT duration_worked AS t, l_quantity AS x, l_tax AS y, count(*)::DOUBLE AS w, sum(failed::INT)::DOUBLE AS d FROM sv
  WHERE l_orderkey % 2 <> {k} GROUP BY ALL)"""
    return f"""SELECT {k} AS fold, round((concordant + tied / 2.0e0) / comparable, 6) AS concordance FROM (
WITH {_newton_ctes(rows, 6)},
o AS (SELECT duration_worked AS t, -(bx * (l_quantity - mx) + byy * (l_tax - my)) AS s, count(*) AS n, sum(failed::INT) AS d
  FROM sv, b6, mu WHERE l_orderkey % 2 = {k} GROUP BY ALL),
later AS (SELECT t, s, sum(n) OVER (PARTITION BY s ORDER BY t RANGE UNBOUNDED PRECEDING) AS upto FROM o),
totals AS (SELECT s, sum(n) AS total FROM o GROUP BY s),
grid AS (SELECT a.t, a.s, a.d, z.s AS s2, z.total FROM o a, totals z WHERE a.d > 0),
pairs AS (SELECT g.*, g.total - coalesce(u.upto, 0) + coalesce(e.n - e.d, 0) AS longer FROM grid g
  ASOF LEFT JOIN later u ON u.s = g.s2 AND u.t <= g.t LEFT JOIN o e ON e.s = g.s2 AND e.t = g.t)
SELECT sum(CASE WHEN s2 > s THEN d * longer ELSE 0 END) AS concordant, sum(CASE WHEN s2 = s THEN d * longer ELSE 0 END) AS tied,
  sum(d * longer) AS comparable FROM pairs)"""


@query("cross_validated_cox", "F13", sql=W + v.SV + " " + _fold_sql(0) + " UNION ALL " + _fold_sql(1))
def cross_validated_cox(spark: SparkSession, sf: str) -> DataFrame:
    """All folds in one fit and one concordance."""
    out = evaluate.cross_validate_cox(v.subjects(spark, sf, *PAIR), PAIR, F.pmod("l_orderkey", F.lit(2)), folds=2)
    return spark.createDataFrame([(k, x) for k, x in enumerate(out["folds"])], "fold int, concordance double").select(
        "fold", F.round("concordance", 6).alias("concordance"))


@query("cross_validated_weibull", "F13 F10")
def cross_validated_weibull(spark: SparkSession, sf: str) -> DataFrame:
    """Expected lifetimes from attributes, learned on the other folds' groups, against the held-out subjects."""
    rows = v.subjects_with_brand(spark, sf).withColumn("size", F.col("p_size").cast("double"))

    def fit(train: DataFrame, held_out: DataFrame) -> DataFrame:
        fits = weibull.accepted_fits(weibull.fit_weibull_groups(train, ["size"], weight=evaluate.COUNT))
        model = weibull.fit_weibull_from_attributes(fits, ["size"])
        return model.predict(held_out).withColumn("score", F.col("predicted_survival"))

    out = evaluate.cross_validate(rows, ["l_orderkey", "l_linenumber"], fit, folds=2, features=["size"])
    return spark.createDataFrame([(k, x) for k, x in enumerate(out["folds"])], "fold int, concordance double")


@query("hyperparameter_search", "F14")
def hyperparameter_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(drive_subjects(spark, sf), "search")

    def evaluate_point(point: dict) -> float:
        def fit(train: DataFrame, held_out: DataFrame) -> DataFrame:
            fold = F.col(evaluate.FOLD)
            models = cox.fit_boosted_cox_folds(train, DRIVE_FEATURES, fold, 2, max_depth=point["max_depth"], rate=point["rate"])
            return held_out.withColumn("score", -cox.log_hazard_of_fold(models, fold))

        return evaluate.cross_validate(rows, ["drive_id"], fit, folds=2, together=True)["mean"]

    log = new_folder(spark, "trials")
    space = {"max_depth": (1, 3), "rate": (0.1, 0.5)}
    evaluate.search_hyperparameters(spark, space, evaluate_point, trials=2, log=log)
    return spark.read.schema("trial int, point string, value double").json(log)


HALVING = {"trials": 9, "eta": 3, "least": 1, "greatest": 9}
HALVING_SPACE = {"shape": (0.5, 3.0), "cut": (5.0, 45.0)}
HALVING_SEED = 4


def _halving_sql() -> str:
    """The first wave: its random points, every rung's likelihoods on the rung's share, and who goes on."""
    points = evaluate.random_points(HALVING_SPACE, HALVING["trials"], HALVING_SEED * 1_000_003)
    listed = ", ".join(f"({k}, {p['shape']!r}::DOUBLE, {p['cut']!r}::DOUBLE)" for k, p in enumerate(points))
    text = W + v.SV + f""", p(trial, shape, cut) AS (VALUES {listed}),
c AS (SELECT duration_worked AS t, l_quantity AS q, l_orderkey % 9 AS part, count(*) AS n, sum(failed::INT) AS d FROM sv
  WHERE duration_worked > 0 GROUP BY ALL)"""
    plan = search.rungs(**HALVING)
    for r, (_, budget) in enumerate(plan):
        keep = plan[r + 1][0] if r + 1 < len(plan) else 1
        text += f""",
s{r} AS (SELECT trial, shape, cut, q > cut AS large, sum(n) AS n, sum(d) AS d, sum(d * ln(t)) AS l, sum(n * pow(t, shape)) AS m
  FROM c, {f"(SELECT * FROM k{r - 1} WHERE kept)" if r else "p"} WHERE part < {budget} GROUP BY ALL),
k{r} AS (SELECT {r} AS rung, trial, shape, cut, value, row_number() OVER (ORDER BY value DESC, trial) <= {keep} AS kept FROM (
  SELECT trial, shape, cut, sum(d * (ln(shape) - ln(m / d)) + (shape - 1) * l - d) / sum(n) AS value FROM s{r} GROUP BY trial, shape, cut))"""
    return text + " UNION ALL ".join(
        f"\nSELECT rung, trial, round(shape, 6) AS shape, round(cut, 6) AS cut, round(value, 6) AS value, kept FROM k{r}" for r in range(len(plan)))


@query("halving_search", "F14", sql=_halving_sql())
def halving_search(spark: SparkSession, sf: str) -> DataFrame:
    """Shape of a Weibull curve, and the quantity at which subjects get a scale of their own, by the likelihood per subject.
    The budget is the number of ninths of the orders; every trial is one aggregation of a compacted table."""
    cells = stage(v.subjects(spark, sf, "l_quantity").where("duration_worked > 0").groupBy(
        F.col("duration_worked").alias("t"), F.col("l_quantity").alias("q"), F.pmod("l_orderkey", F.lit(9)).alias("part")).agg(
        F.count("*").alias("n"), F.sum(F.col("failed").cast("int")).alias("d")), "cells")

    def likelihood(point: dict, budget: float) -> float | None:
        shape = F.lit(point["shape"])
        sides = cells.where(F.col("part") < budget).groupBy(F.col("q") > point["cut"]).agg(
            F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum(F.col("d") * F.log("t")).alias("l"),
            F.sum(F.col("n") * F.pow("t", shape)).alias("m"))
        value = F.sum(F.col("d") * (F.log(shape) - F.log(F.col("m") / F.col("d"))) + (shape - 1) * F.col("l") - F.col("d"))
        return sides.agg(value / F.sum("n")).first()[0]

    log = new_folder(spark, "trials")
    search.halving_search(spark, HALVING_SPACE, likelihood, log, waves=1, seed=HALVING_SEED, parallel=3, **HALVING)
    trace = search.search_trace(spark, log, **HALVING)
    point = F.from_json("point", "shape double, cut double")
    return trace.select("rung", "trial", F.round(point["shape"], 6).alias("shape"), F.round(point["cut"], 6).alias("cut"),
                        F.round("value", 6).alias("value"), "kept")


def _weibull_table(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Fits per (type, size) with numeric attributes."""
    fits = weibull.accepted_fits(weibull.fit_weibull_groups(v.subjects_with_brand(spark, sf), ["p_type", "p_size"]))
    fits = stage(fits, "weibull")  # one row per group
    codes = StringIndexer(inputCol="p_type", outputCol="type_code", handleInvalid="keep").fit(fits)
    return codes.transform(fits), ["p_size", "type_code"]


@query("weibull_from_attributes", "F10")
def weibull_from_attributes(spark: SparkSession, sf: str) -> DataFrame:
    table, features = _weibull_table(spark, sf)
    model = weibull.fit_weibull_from_attributes(table, features)
    return model.predict(table).select("p_type", "p_size", "predicted_shape", "predicted_scale", "predicted_survival")


def _regression_sql(rounds: int) -> str:
    """Unrolled least-squares boosting of depth two on two attributes, one of them with gaps, with sizes as weights."""
    text = """
WITH k AS (SELECT p_type, p_size, count(*)::DOUBLE AS w, ln(avg(p_retailprice)) AS target FROM part GROUP BY ALL),
c0 AS (SELECT CASE WHEN p_size % 5 <> 0 THEN p_size::DOUBLE END AS x, length(p_type)::DOUBLE AS y, w, target,
  sum(w * target) OVER () / sum(w) OVER () AS p FROM k)"""
    for r in range(rounds):
        text += f""",
gh{r} AS (SELECT x, y, 0 AS node, sum(w * (p - target)) AS g, sum(w) AS h FROM c{r} GROUP BY x, y),{_split_ctes(f"p{r}", f"gh{r}")},
lv{r} AS (SELECT x, y, g, h, goes::INT AS node FROM p{r}s),{_split_ctes(f"q{r}", f"lv{r}")},
lf{r} AS (SELECT x, y, -sum(g) OVER w / sum(h) OVER w AS value FROM q{r}s WINDOW w AS (PARTITION BY node, goes)),
c{r + 1} AS (SELECT c.x, c.y, c.w, c.target, c.p + 0.2e0 * value AS p FROM c{r} c JOIN lf{r} l ON c.y = l.y AND c.x IS NOT DISTINCT FROM l.x)"""
    return text + f" SELECT x, y, round(any_value(p), 6) AS predicted FROM c{rounds} GROUP BY x, y"


@query("boosted_regression_rounds", "F10 F21", sql=_regression_sql(4))
def boosted_regression_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The regression behind ``weibull_from_attributes`` on the log price of each (type, size), written and read again."""
    groups = v.table(spark, sf, "part").groupBy("p_type", "p_size").agg(
        F.count("*").alias("w"), F.log(F.avg("p_retailprice")).alias("target"))
    rows = groups.select(F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double")).alias("x"),
                         F.length("p_type").cast("double").alias("y"), "w", "target")
    model = trees.fit_boosted_regression(rows, ["x", "y"], [F.col("target")], F.col("w"), rounds=4, max_depth=2)
    model = trees.BoostedRegression.of_json(model.to_json())
    return rows.select("x", "y").distinct().withColumn("predicted", F.round(model.predict(0), 6))


@query("weibull_rows", "F11")
def weibull_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.subjects(spark, sf, *PAIR)
    model = weibull.fit_weibull_rows(rows, PAIR)
    return weibull.expected_lifetime(model, rows).select("l_orderkey", "l_linenumber", "predicted_survival")


M_ROLES = {
    "p_partkey": "stop", "brand": "categorical", "p_type": "categorical", "p_size": "numerical",
    "p_retailprice": "numerical", "price_group": "categorical",
}


def incomplete_models(spark: SparkSession, sf: str) -> DataFrame:
    """Model attributes with gaps in a number and in a category; the number follows the key's last digits."""
    known = F.pmod("p_partkey", F.lit(7)) != 0
    group = F.when(F.col("p_size") > 25, "large").otherwise("small")
    return v.table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("brand"), "p_type", "p_size",
        F.when(known, F.col("p_retailprice")).alias("p_retailprice"), F.when(known, group).alias("price_group"))


@query("imputed_attributes", "F18 F19")
def imputed_attributes(spark: SparkSession, sf: str) -> DataFrame:
    rows = incomplete_models(spark, sf)
    imputers = impute.train_imputers(rows, M_ROLES, ["p_retailprice", "price_group"])
    return imputers.apply(rows)


@query("imputation_keeps_known_values", "F18 F19", sql="""
SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS known_price,
  CASE WHEN p_partkey % 7 <> 0 THEN CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END END AS known_group, true AS complete FROM part""")
def imputation_keeps_known_values(spark: SparkSession, sf: str) -> DataFrame:
    """Imputers written and read again leave known values as they are, and no gap."""
    rows = incomplete_models(spark, sf)
    path = new_folder(spark, "imputers")
    impute.train_imputers(rows, M_ROLES, ["p_retailprice", "price_group"]).save(spark, path)
    known = F.col("p_partkey") % 7 != 0
    return impute.Imputers.load(spark, path).apply(rows).select(
        "p_partkey", F.when(known, F.col("p_retailprice")).alias("known_price"), F.when(known, F.col("price_group")).alias("known_group"),
        (F.col("p_retailprice").isNotNull() & F.col("price_group").isin("large", "small")).alias("complete"))


@query("imputation_recovers", "F18 F19", sql="""
SELECT p_partkey, length(p_type) * 1.5e0 AS tier, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'cheap' ELSE 'dear' END AS kind,
  'kind,tier' AS attributes, (SELECT count(*) FROM part) AS never_known FROM part""")
def imputation_recovers(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes that follow from the type come back exactly; one that no model knows is left out of the records."""
    kind = F.when(F.col("p_type").isin("PROMO", "ECONOMY"), "cheap").otherwise("dear")
    rows = v.table(spark, sf, "part").select(
        "p_partkey", "p_type", "p_size", F.when(F.col("p_partkey") % 7 != 0, F.length("p_type") * F.lit(1.5)).otherwise(F.lit(float("nan"))).alias("tier"),
        F.when(F.col("p_partkey") % 5 != 0, kind).alias("kind"), F.lit(None).cast("double").alias("never"))
    columns = ["tier", "kind", "never"]
    spec = {"p_type": "categorical", "p_size": "numerical", "tier": "numerical", "kind": "categorical", "never": "numerical"}
    full = impute.train_imputers(rows, spec, columns).apply(rows)
    left = impute.leftovers(full, columns).where("attribute = 'never'").select("left").scalar()
    record = F.json_object_keys(impute.known_attributes(full, columns))
    return full.select("p_partkey", F.round("tier", 6).alias("tier"), "kind", F.array_join(F.array_sort(record), ",").alias("attributes"),
                       left.alias("never_known"))


@query("imputer_scores", "F20")
def imputer_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = incomplete_models(spark, sf)
    scores = impute.score_imputers(
        rows, M_ROLES, ["p_retailprice", "price_group"], ["p_partkey"])
    return impute.load_scores(spark, scores)


@query("weibull_rows_scores", "F11", sql="""
SELECT unnest(['intercept', 'l_quantity', 'l_tax', 'scale']) AS parameter, true AS settled, (SELECT count(*) FROM lineitem) AS subjects""")
def weibull_rows_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The derivatives of the log-likelihood vanish at the fit of all subjects, beside what they are one step off it."""
    rows = v.subjects(spark, sf, *PAIR)
    fitted = weibull.fit_weibull_rows(rows, PAIR)
    aft = fitted.stages[-1]
    center = [aft.intercept, *map(float, aft.coefficients)]

    def scores(mu: list[float], sigma: float) -> list:
        x = [F.lit(1.0), *[F.col(f).cast("double") for f in PAIR]]
        eta = sum((F.lit(b) * c for b, c in zip(mu, x, strict=True)), F.lit(0.0))
        z = (F.ln(durations.fix_zero(F.col("duration_worked"))) - eta) / F.lit(sigma)
        e = F.col("failed").cast("double")
        residual = F.exp(z) - e
        return [*[F.sum(residual * c) for c in x], F.sum(residual * z - e)]

    off = 0.05 * aft.scale
    here = scores(center, aft.scale)
    there = scores([center[0] + off, *center[1:]], 1.05 * aft.scale)
    row = rows.agg(F.count("*").alias("n"), *[c.alias(f"a{i}") for i, c in enumerate(here)], *[c.alias(f"b{i}") for i, c in enumerate(there)]).first()
    out = [(p, abs(row[f"a{i}"]) < 0.1 * abs(row[f"b{i}"]), row["n"]) for i, p in enumerate(["intercept", *PAIR, "scale"])]
    return spark.createDataFrame(out, "parameter string, settled boolean, subjects bigint")


@query("introspection", "A19", sql="""
SELECT 'column' AS kind, column_name AS name FROM (DESCRIBE lineitem) UNION ALL SELECT 'table', 'fleet_facts_view' UNION ALL SELECT 'reduced', 'false' UNION ALL SELECT 'reduced without facts', 'true'""")
def introspection(spark: SparkSession, sf: str) -> DataFrame:
    """Tables and columns as the catalogue knows them, and whether the facts are there."""
    v.table(spark, sf, "lineitem").createOrReplaceTempView("fleet_facts_view")
    found = [("column", c) for c in store.column_names(spark, "fleet_facts_view")]
    found += [("table", t) for t in store.table_names(spark) if t == "fleet_facts_view"]
    found += [("reduced", str(store.is_reduced(spark, "fleet_facts_view")).lower()),
              ("reduced without facts", str(store.is_reduced(spark, "fleet_facts_that_are_not_there")).lower())]
    return spark.createDataFrame(found, "kind string, name string")


@query("feature_vectors", "F23", sql="""
WITH k AS (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS i FROM part GROUP BY p_type)
SELECT p_partkey, p_size::DOUBLE AS f0, CASE WHEN p_retailprice > 1000 THEN 1.0e0 ELSE 0.0e0 END AS f1, i::DOUBLE AS f2 FROM part JOIN k USING (p_type)""")
def feature_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.table(spark, sf, "part").select(
        "p_partkey", "p_type", "p_size", (F.col("p_retailprice") > 1000).alias("dear"), "p_name")
    spec = {"p_partkey": "stop", "p_name": "stop", "p_type": "categorical", "p_size": "numerical", "dear": "binary"}
    out = roles.feature_pipeline(rows, spec, one_hot=False).fit(rows).transform(rows)
    f = vector_to_array("features")
    return out.select("p_partkey", *[f[i].alias(f"f{i}") for i in range(3)])


@query("nan_report", "F22", sql=W + v.SV + """
SELECT count(*) FILTER (l_discount = 0) AS ratio, 0::BIGINT AS l_quantity FROM sv""")
def nan_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.subjects(spark, sf, "l_quantity", "l_discount").withColumn("ratio", F.try_divide("l_quantity", "l_discount"))
    return evaluate.count_nan(rows, ["ratio", "l_quantity"])


SCORED = W + v.SV + ", " + _newton_ctes("""c AS (SELECT duration_worked AS t, p_size::DOUBLE AS x, length(p_name)::DOUBLE AS y, count(*)::DOUBLE AS w,
  sum(failed::INT)::DOUBLE AS d FROM sv GROUP BY ALL)""", 6) + """,
beta AS (SELECT * FROM b6, mu),
haz AS (SELECT t, sum(w * exp(bx * (x - mx) + byy * (y - my))) AS r, sum(d) AS d FROM c, beta GROUP BY t),
h AS (SELECT t, d / sum(r) OVER (ORDER BY t DESC) AS hazard FROM haz),
base AS (SELECT t, sum(hazard) OVER (ORDER BY t) AS ch FROM h UNION ALL SELECT 0.0e0, 0.0e0),
cells AS (SELECT DISTINCT p_size AS sx, length(p_name) AS sy FROM part),
lines AS (SELECT sx, sy, t, exp(-ch * exp(bx * (sx - mx) + byy * (sy - my))) AS s FROM base, cells, beta),
legs AS (SELECT *, lead(t) OVER (PARTITION BY sx, sy ORDER BY t) AS t2, lead(s) OVER (PARTITION BY sx, sy ORDER BY t) AS s2 FROM lines),
areas AS (SELECT sx, sy, sum((t2 - t) * (s + s2) / 2) AS area FROM legs GROUP BY sx, sy),
phi AS (SELECT part.*, area, bx * (p_size - mx) AS f1, byy * (length(p_name) - my) AS f2 FROM part JOIN areas ON sx = p_size AND sy = length(p_name), beta),
share AS (SELECT *, f1 / (f1 + f2) AS s1, f2 / (f1 + f2) AS s2, greatest(abs(f1 / (f1 + f2)), abs(f2 / (f1 + f2))) / 50 AS lim,
  DATE '2020-01-01' AS a, DATE '2020-01-01' + CAST(floor(area) AS INTEGER) AS z FROM phi),
months AS (SELECT *, (year(z) - year(a)) * 12 + month(z) - month(a) - CASE WHEN day(z) < day(a) THEN 1 ELSE 0 END AS mm FROM share)
SELECT p_name || '-' || p_partkey AS name, p_brand AS vendor, p_size::DOUBLE AS size, length(p_name)::DOUBLE AS name_length,
  nullif(regexp_extract(p_name, '\\b(red|blue|green|black)\\b', 1), '') AS colour,
  CAST(CASE WHEN regexp_matches(p_name, '\\b(red|blue|green|black)\\b') THEN 0 ELSE 1 END AS INTEGER) AS missed, round(area, 3) AS predicted_survival,
  CASE WHEN mm // 12 <> 0 THEN (mm // 12) || ' y, ' ELSE '' END || CASE WHEN mm % 12 <> 0 THEN (mm % 12) || ' m, ' ELSE '' END
  || date_diff('day', CAST(a + to_months(CAST(mm AS INTEGER)) AS DATE), CAST(z AS DATE)) || ' d' AS fancy_time,
  CASE WHEN abs(s1) > lim THEN round(s1, 6) END AS by_size, CASE WHEN abs(s2) > lim THEN round(s2, 6) END AS by_name_length,
  round(CASE WHEN abs(s1) > lim THEN 0 ELSE s1 END + CASE WHEN abs(s2) > lim THEN 0 ELSE s2 END, 6) + 0 AS by_other FROM months"""


@query("scored_models", "F17", sql=SCORED)
def scored_models(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as unseen models: attributes by rules, expected lifetime by a Cox model, explained and sorted."""
    p = v.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("size"),
                                          F.length("p_name").cast("double").alias("name_length"))
    train = v.subjects(spark, sf).join(p, "l_partkey")
    features = ["size", "name_length"]
    model = cox.fit_cox(train, features)
    baseline = cox.baseline_hazard(train, model.log_hazard())

    def predict(rows: DataFrame) -> DataFrame:
        rows = explain.linear_contributions(rows, model.contributions())
        return cox.expected_survival(rows, model.log_hazard(), baseline)

    requests = v.table(spark, sf, "part").select(
        F.concat_ws("-", F.col("p_name"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("vendor"),
        F.col("p_size").cast("double").alias("size"), F.length("p_name").cast("double").alias("name_length"))
    enrichers = {"rules": enrich.rule_enricher([enrich.Rule("colour", r"\b(red|blue|green|black)\b")])}
    out = score.score_models(requests, enrichers, predict, features, datetime.date(2020, 1, 1))
    why = F.col("explanation")
    return out.withColumns({
        "predicted_survival": F.round("predicted_survival", 3), "by_size": F.round(why["size"], 6),
        "by_name_length": F.round(why["name_length"], 6), "by_other": F.round(why[explain.OTHER], 6) + 0}).drop("explanation")


@query("streamed_lifespans", "S1", sql=W + v.T2 + """
SELECT drive_id, min(day) AS first_day, max(day) AS last_day, max(CASE WHEN failure = 1 THEN day END) AS failure_day FROM t2 GROUP BY drive_id""")
def streamed_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    source = v.table(spark, sf, "events")
    stream = lifespan_stream.telemetry_stream(spark, sf, source.schema, "events.parquet")
    rows = stream.select(
        F.col("user_id").alias("drive_id"), v.day_of("ts").alias("day"), (F.col("event_type") == "error").cast("int").alias("failure"))
    table, checkpoint = new_folder(spark, "lifespans"), new_folder(spark, "lifespans-state")
    lifespan_stream.keep_lifespans(rows, table, checkpoint).awaitTermination()
    return lifespan_stream.current_lifespans(spark, table)


@query("streamed_daily_failures", "S2", sql=W + v.T2 + """
SELECT day, CAST(sum(failure) AS BIGINT) AS failures, count(*) AS records FROM t2 WHERE day <= (SELECT max(day) FROM t2) - 2 GROUP BY day""")
def streamed_daily_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Days the watermark has closed: all but the last two."""
    source = v.table(spark, sf, "events")
    stream = lifespan_stream.telemetry_stream(spark, sf, source.schema, "events.parquet")
    rows = stream.select("ts", (F.col("event_type") == "error").cast("int").alias("failure"))
    table, checkpoint = new_folder(spark, "daily"), new_folder(spark, "daily-state")
    counts = lifespan_stream.daily_failures(rows)
    lifespan_stream.write_daily_failures(counts, table, checkpoint).awaitTermination()
    return spark.read.parquet(table)


def nested_parts(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "part").select(
        "p_partkey", F.struct(
            F.col("p_size").alias("size"), F.struct(F.col("p_brand").alias("code"), F.col("p_type").alias("brand")).alias("brand"),
        ).alias("interface"), F.struct(F.col("p_retailprice").alias("price")).alias("price"))


@query("flattened_attributes", "B9", sql="""
SELECT p_partkey, p_size AS interface_size, p_brand AS interface_brand_code, p_type AS interface_brand, p_retailprice AS price FROM part""")
def flattened_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return schema_tools.flatten(nested_parts(spark, sf))


@query("text_safe_columns", "B21 B19", sql="""
SELECT '[' || p_size || ',' || p_partkey || ']' AS pair, CAST(DATE '2000-01-01' + p_size AS VARCHAR) AS date, p_name AS name, p_size FROM part""")
def text_safe_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.table(spark, sf, "part").select(
        F.array(F.col("p_size").cast("bigint"), F.col("p_partkey")).alias("pair"),
        F.date_add(F.lit(datetime.date(2000, 1, 1)), F.col("p_size")).alias("date"), F.col("p_name").alias("name"), "p_size")
    return schema_tools.reorder(schema_tools.text_safe(rows), ["name", "vendor", "p_size"])


@query("written_predictions", "A16", sql="""
SELECT format, p_partkey, p_name AS name, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS predicted_survival
FROM part, (SELECT unnest(['json', 'csv', 'tsv']) AS format)""")
def written_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.when(F.pmod("p_partkey", F.lit(7)) != 0, F.col("p_size")).alias("predicted_survival"))
    out = None
    for kind in ("json", "csv", "tsv"):
        path = new_folder(spark, f"predictions-{kind}")
        store.write_predictions(rows, path, kind)
        reader = spark.read.schema(rows.schema)
        back = reader.json(path) if kind == "json" else reader.option("header", True).option(
            "sep", "," if kind == "csv" else "\t").csv(path)
        back = back.withColumn("format", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out


@query("staged_lifespans", "A21", sql=W + v.LIFESPANS + """
SELECT failure_day IS NOT NULL AS failed, count(*) AS drives, CAST(sum(last_day - first_day) AS BIGINT) AS days FROM lifespans GROUP BY 1""")
def staged_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    """An expensive stage written once and read by what follows."""
    spans = stage(fleet.lifespans(spark, sf), "spans")
    return spans.groupBy(F.col("failure_day").isNotNull().alias("failed")).agg(
        F.count("*").alias("drives"), F.sum(F.col("last_day") - F.col("first_day")).alias("days"))


@query("reused_stage", "A21", sql=W + v.LIFESPANS + """
SELECT failure_day IS NOT NULL AS failed, count(*) AS drives, CAST(sum(last_day - first_day) AS BIGINT) AS days, CAST(2 AS INTEGER) AS computed
FROM lifespans GROUP BY 1""")
def reused_stage(spark: SparkSession, sf: str) -> DataFrame:
    """Lifespans asked for three times: the same files and parameters are computed once, other parameters once more."""
    root, runs = new_folder(spark, "store"), []

    def make() -> DataFrame:
        runs.append(1)
        return fleet.lifespans(spark, sf)

    for version in (1, 1, 2):
        spans = stage_store.stored_stage(spark, root, "lifespans", {"orders": f"{sf}/orders.parquet"}, make, {"version": version})
    stage_store.drop_stages(spark, root, "lifespans")
    return spans.groupBy(F.col("failure_day").isNotNull().alias("failed")).agg(
        F.count("*").alias("drives"), F.sum(F.col("last_day") - F.col("first_day")).alias("days")).withColumn("computed", F.lit(len(runs)))


def _fitted_sql(steps: int) -> str:
    """Unrolled Newton steps for one feature, then baseline and areas."""
    text = W + v.SV + """,
c AS (SELECT duration_worked AS t, l_quantity AS x, count(*)::DOUBLE AS w, sum(failed::INT)::DOUBLE AS d FROM sv GROUP BY ALL),
mu AS (SELECT sum(w * x) / sum(w) AS m FROM c), b0 AS (SELECT 0.0e0 AS b)"""
    for k in range(steps):
        text += f""",
a{k} AS (SELECT t, sum(d) AS d, sum(d * x) AS dx, sum(w * e) AS s, sum(w * e * x) AS sx, sum(w * e * x * x) AS sxx
  FROM (SELECT c.*, exp(b * (x - m)) AS e FROM c, b{k}, mu) GROUP BY t),
r{k} AS (SELECT t, d, dx, sum(s) OVER w AS s, sum(sx) OVER w AS sx, sum(sxx) OVER w AS sxx FROM a{k} WINDOW w AS (ORDER BY t DESC)),
b{k + 1} AS (SELECT any_value(b) + (sum(dx) - sum(d * sx / s)) / sum(d * (sxx / s - (sx / s) ** 2)) AS b FROM r{k}, b{k})"""
    return text + f""",
haz AS (SELECT t, sum(w * exp(b * (x - m))) AS r, sum(d) AS d FROM c, b{steps}, mu GROUP BY t),
h AS (SELECT t, d / sum(r) OVER (ORDER BY t DESC) AS hazard FROM haz),
base AS (SELECT t, sum(hazard) OVER (ORDER BY t) AS ch FROM h UNION ALL SELECT 0.0e0, 0.0e0),
lines AS (SELECT x, t, exp(-ch * exp(b * (x - m))) AS s FROM base, (SELECT DISTINCT x FROM c), b{steps}, mu),
legs AS (SELECT x, t, s, lead(t) OVER (PARTITION BY x ORDER BY t) AS t2, lead(s) OVER (PARTITION BY x ORDER BY t) AS s2 FROM lines),
areas AS (SELECT x, sum((t2 - t) * (s + s2) / 2) AS area FROM legs GROUP BY x)
SELECT l_orderkey, l_linenumber, round(area, 3) AS predicted_survival FROM sv JOIN areas ON x = l_quantity"""


@query("fitted_survival", "F6 F8 F9", sql=_fitted_sql(6))
def fitted_survival(spark: SparkSession, sf: str) -> DataFrame:
    """Cox fit, baseline and expected lifetime on the same subjects."""
    rows = v.subjects(spark, sf, "l_quantity")
    model = cox.fit_cox(rows, ["l_quantity"])
    eta = model.log_hazard()
    out = cox.expected_survival(rows, eta, cox.baseline_hazard(rows, eta))
    out = out.select("l_orderkey", "l_linenumber", F.round("predicted_survival", 3).alias("predicted_survival"))
    return sampling.sorted_by_prediction(out, ["l_orderkey", "l_linenumber"])
