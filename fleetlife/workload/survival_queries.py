"""Durations, samples, survival curves, fits, concordance and explanations."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import durations
from ..functions.staging_area import new_folder
from ..operators import lifespan, sampling, strata
from ..plans import cox, evaluate, explain, km, live_axis, weibull
from . import fleet_queries as fleet
from . import views as v
from .registry import query

W = "WITH "


def curve_sql(ctes: str, source: str, keys: list[str]) -> str:
    """Check of a survival curve: the same formulas over a CTE with the keys, duration_worked and failed."""
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    return f"""WITH {ctes}, axis0 AS (SELECT {k}duration_worked AS duration, count(*) AS n, sum(failed::INT) AS d FROM {source}
  GROUP BY {k}duration_worked),
axis AS (SELECT * FROM axis0 UNION ALL SELECT {k}0.0e0, 0, 0 FROM axis0{group} HAVING min(duration) > 0),
risk AS (SELECT *, sum(n) OVER ({part}ORDER BY duration DESC) AS r FROM axis),
steps AS (SELECT *, CASE WHEN d < r THEN ln(1 - d / CAST(r AS DOUBLE)) ELSE 0 END AS l, CASE WHEN d < r THEN d / (CAST(r AS DOUBLE) * (r - d)) ELSE 0 END AS g,
  CASE WHEN d = r AND d > 0 THEN 1 ELSE 0 END AS e FROM risk),
run AS (SELECT *, sum(l) OVER ({part}ORDER BY duration) AS ls, sum(g) OVER ({part}ORDER BY duration) AS vs,
  sum(e) OVER ({part}ORDER BY duration) AS o FROM steps),
band AS (SELECT *, exp(ls) ** exp(1.959963984540054e0 * sqrt(vs) / nullif(ls, 0)) AS b1, exp(ls) ** exp(-1.959963984540054e0 * sqrt(vs) / nullif(ls, 0)) AS b2 FROM run)
SELECT {k}duration, CAST(r AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, round(CASE WHEN o > 0 THEN 0 ELSE exp(ls) END, 6) AS survival,
  round(CASE WHEN o = 0 THEN CASE WHEN ls = 0 THEN 1 ELSE least(b1, b2) END END, 6) AS lower,
  round(CASE WHEN o = 0 THEN CASE WHEN ls = 0 THEN 1 ELSE greatest(b1, b2) END END, 6) AS upper FROM band"""


def rounded(curve: DataFrame) -> DataFrame:
    return curve.withColumns({c: F.round(c, 6) for c in ("survival", "lower", "upper")})


@query("survival_overall", "F2 G5", sql=curve_sql(v.SV, "sv", []))
def survival_overall(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(km.survival_curve(v.subjects(spark, sf)))


GAPS = v.SV + """, gaps AS (SELECT l_linestatus, CASE WHEN l_orderkey % 5 <> 0 THEN duration_worked END AS duration_worked, failed,
  CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS l_quantity, l_tax FROM sv)"""


def subjects_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects of which a fifth has no duration and a seventh lacks a feature."""
    return v.subjects(spark, sf, "l_quantity", "l_tax").withColumns({
        "duration_worked": F.when(F.col("l_orderkey") % 5 != 0, F.col("duration_worked")),
        "l_quantity": F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity"))})


@query("survival_with_gaps", "F2 F3 F1", sql=curve_sql(GAPS, "(SELECT * FROM gaps WHERE duration_worked IS NOT NULL)", ["l_linestatus"]))
def survival_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(km.survival_curve(subjects_with_gaps(spark, sf), ["l_linestatus"]))


@query("subjects_left_out", "F1 F2", sql=W + GAPS + """
SELECT l_linestatus, count(*) FILTER (duration_worked IS NULL) AS left_out, count(*) AS subjects FROM gaps GROUP BY l_linestatus""")
def subjects_left_out(spark: SparkSession, sf: str) -> DataFrame:
    return km.without_duration(subjects_with_gaps(spark, sf), ["l_linestatus"])


@query("curve_with_left_out", "F1 F2 F3", sql=curve_sql(GAPS, "(SELECT * FROM gaps WHERE duration_worked IS NOT NULL)", ["l_linestatus"]).replace(
    "SELECT l_linestatus, duration, CAST(r AS BIGINT)", "SELECT l_linestatus, left_out, subjects, duration, CAST(r AS BIGINT)", 1)
    + """ JOIN (SELECT l_linestatus, count(*) FILTER (duration_worked IS NULL) AS left_out, count(*) AS subjects
  FROM gaps GROUP BY l_linestatus) USING (l_linestatus)""")
def curve_with_left_out(spark: SparkSession, sf: str) -> DataFrame:
    """Curves beside the subjects that they leave out, both from one pass."""
    curve, left_out = km.curve_and_left_out(subjects_with_gaps(spark, sf), ["l_linestatus"])
    return rounded(curve).join(left_out, "l_linestatus")


FRACTIONAL = v.SV + """, fractional AS (SELECT l_linestatus, duration_worked + (l_orderkey * 4 + l_linenumber) % 1000 / 1000.0e0 AS duration_worked, failed FROM sv)"""


@query("survival_fractional", "F3 G5", sql=curve_sql(FRACTIONAL, "fractional", ["l_linestatus"]))
def survival_fractional(spark: SparkSession, sf: str) -> DataFrame:
    """Durations with a fraction: about as many distinct ones as subjects, so the totals run in blocks of the axis."""
    part = F.pmod(F.col("l_orderkey") * 4 + F.col("l_linenumber"), F.lit(1000)) / 1000
    rows = v.subjects(spark, sf).withColumn("duration_worked", F.col("duration_worked") + part)
    return rounded(km.survival_curve(rows, ["l_linestatus"], block_width=64.0))


@query("survival_by_status", "F3", sql=curve_sql(v.SV, "sv", ["l_linestatus"]))
def survival_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(km.survival_curve(v.subjects(spark, sf), ["l_linestatus"]))


@query("survival_by_brand", "F3 C6", sql=curve_sql(v.SV, "(SELECT * FROM sv WHERE p_brand IS NOT NULL)", ["p_brand"]))
def survival_by_brand(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(km.survival_curve(strata.known_stratum(v.subjects_with_brand(spark, sf), "p_brand"), ["p_brand"]))


@query("vendor_survival", "E3 E5 D8 F1 F3", sql=curve_sql(fleet.ANOMALIES + """,
clean AS (SELECT v.name AS vendor_name, failure_day IS NOT NULL AS failed, CAST(coalesce(failure_day, last_day) - first_day AS DOUBLE) AS duration_worked
  FROM lifespans l JOIN drives d ON d.id = l.drive_id JOIN models m ON m.id = d.model_id JOIN brands b ON b.id = m.brand_id
  JOIN vendors v ON v.id = b.vendor_id WHERE drive_id NOT IN (SELECT drive_id FROM anomalies))""", "clean", ["vendor_name"]))
def vendor_survival(spark: SparkSession, sf: str) -> DataFrame:
    """Telemetry to lifespans, anomalous drives out, survival curves per vendor."""
    clean = fleet.clean_lifespans(spark, sf)
    subjects = lifespan.duration_and_event(lifespan.worked_days(clean)).select("drive_id", "failed", "duration_worked")
    vendor = fleet.drives_with_lineage(spark, sf).where(F.col("vendor_name").isNotNull()).select(
        F.col("id").alias("drive_id"), "vendor_name")
    return rounded(km.survival_curve(subjects.join(vendor, "drive_id"), ["vendor_name"]))


@query("live_survival", "F1 F2 F3 E2", sql=curve_sql(v.LIFESPANS + ", " + v.DIMS + """,
placed AS (SELECT brand_id, CAST(coalesce(failure_day, last_day) - first_day AS DOUBLE) AS duration_worked,
  failure_day IS NOT NULL AS failed FROM lifespans l JOIN drives d ON d.id = l.drive_id JOIN models m ON m.id = d.model_id)""",
  "placed", ["brand_id"]))
def live_survival(spark: SparkSession, sf: str) -> DataFrame:
    """Curves per brand after three loads, each of which changes the stored axis by what its drives gained."""
    place = v.drives(spark, sf).select(F.col("id").alias("drive_id"), "model_id").join(
        v.models(spark, sf).select(F.col("id").alias("model_id"), "brand_id"), "model_id").drop("model_id")
    rows, root, strata_ = v.raw_telemetry(spark, sf), new_folder(spark, "live"), ["brand_id"]
    day = F.col("day")
    for i, part in enumerate((day < v.CUT, (day >= v.CUT) & (day < v.CUT + 120), day >= v.CUT + 120)):
        fresh = lifespan.lifespans(rows.where(part)).join(place, "drive_id")
        if i == 0:
            live_axis.create_live_axis(spark, root, fresh.schema, "drive_id", strata_, 16)
        live_axis.load_lifespans(spark, root, fresh, strata_)
    live_axis.drop_superseded(spark, root)
    return rounded(live_axis.live_curve(spark, root, strata_))


@query("nested_survival", "F4", sql=curve_sql(v.SV + """,
twofold AS (SELECT 'secondary' AS level, p_type, l_linestatus, duration_worked, failed FROM sv
  UNION ALL SELECT 'primary', p_type, NULL, duration_worked, failed FROM sv)""", "twofold", ["level", "p_type", "l_linestatus"]))
def nested_survival(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(km.nested_curves(v.subjects_with_brand(spark, sf), "p_type", "l_linestatus"))


@query("brand_view", "F4", sql=curve_sql(v.REDUCED_SUBJECTS + ", " + v.DIMS + """,
placed AS (SELECT brand_id, model_id, duration_worked, failed FROM subjects s JOIN drives d ON d.id = s.drive_id
  JOIN models m ON m.id = d.model_id WHERE brand_id IS NOT NULL),
twofold AS (SELECT 'secondary' AS level, brand_id, model_id, duration_worked, failed FROM placed
  UNION ALL SELECT 'primary', brand_id, NULL, duration_worked, failed FROM placed)""", "twofold", ["level", "brand_id", "model_id"]))
def brand_view(spark: SparkSession, sf: str) -> DataFrame:
    """The named view of brands: a curve per brand and one per model inside it."""
    place = v.drives(spark, sf).select(F.col("id").alias("drive_id"), "model_id").join(
        v.models(spark, sf).select(F.col("id").alias("model_id"), "brand_id"), "model_id")
    return rounded(km.named_view(fleet.survival_subjects(spark, sf).join(place, "drive_id"), "brand"))


ATTRIBUTED = v.SV + """, attributed AS (SELECT substr(p_name, 1, strpos(p_name, ' ') - 1) AS vendor_id, p_brand AS brand_id, p_type AS series,
  substr(p_name, strpos(p_name, ' ') + 1) AS family, p_size AS capacity, l_linestatus AS model_id, duration_worked, failed FROM sv
  WHERE p_partkey IS NOT NULL)"""


def attributed_subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects with the attributes that the named views go by."""
    name = F.split("p_name", " ", 2)
    p = v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), name[0].alias("vendor_id"), F.col("p_brand").alias("brand_id"),
        F.col("p_type").alias("series"), name[1].alias("family"), F.col("p_size").alias("capacity"))
    return v.subjects(spark, sf).withColumnRenamed("l_linestatus", "model_id").join(p, "l_partkey")


@query("vendor_view", "F4", sql=curve_sql(ATTRIBUTED, "attributed", ["vendor_id"]))
def vendor_view(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(km.named_view(attributed_subjects(spark, sf), "vendor"))


@query("series_view", "F4", sql=curve_sql(ATTRIBUTED + """,
twofold AS (SELECT 'secondary' AS level, brand_id, series, duration_worked, failed FROM attributed
  UNION ALL SELECT 'primary', brand_id, NULL, duration_worked, failed FROM attributed)""", "twofold", ["level", "brand_id", "series"]))
def series_view(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(km.named_view(attributed_subjects(spark, sf), "series"))


@query("family_view", "F4", sql=curve_sql(ATTRIBUTED + """,
inner_curves AS (SELECT 'secondary' AS level, * FROM attributed)""", "inner_curves", ["level", "brand_id", "family"]))
def family_view(spark: SparkSession, sf: str) -> DataFrame:
    """A curve per family inside each brand, without one per brand."""
    return rounded(km.named_view(attributed_subjects(spark, sf), "family"))


@query("capacity_view", "F4 F5", sql=curve_sql(ATTRIBUTED + """,
moments AS (SELECT count(*)::DOUBLE AS n, min(capacity)::DOUBLE AS low, max(capacity)::DOUBLE AS high, avg(capacity) AS mu FROM attributed),
shape AS (SELECT any_value(n) AS n, any_value(low) AS low, any_value(high) AS high,
  avg((capacity - mu) ** 3) / avg((capacity - mu) ** 2) ** 1.5 AS g1 FROM attributed, moments),
rule AS (SELECT low, high, CAST(ceil(1 + log2(n) + log2(1 + abs(g1) / sqrt(6 * (n - 2) / ((n + 1) * (n + 3))))) AS INTEGER) AS k FROM shape),
lefts AS (SELECT *, low + least(k - 1, CAST(floor((capacity - low) / (high - low) * k) AS INTEGER)) * (high - low) / k AS bin_left FROM attributed, rule),
edges AS (SELECT bin_left, coalesce(lead(bin_left) OVER (ORDER BY bin_left), high) AS bin_right FROM (SELECT DISTINCT bin_left, high FROM lefts)),
binned AS (SELECT round(bin_left, 6) AS bin_left, round(bin_right, 6) AS bin_right, model_id, duration_worked, failed FROM lefts JOIN edges USING (bin_left)),
twofold AS (SELECT 'secondary' AS level, * FROM binned UNION ALL SELECT 'primary', bin_left, bin_right, NULL, duration_worked, failed FROM binned)""",
  "twofold", ["level", "bin_left", "bin_right", "model_id"]))
def capacity_view(spark: SparkSession, sf: str) -> DataFrame:
    """Bins of the capacity, each with a curve of its own and one per model."""
    curve = km.named_view(attributed_subjects(spark, sf), "capacity")
    return rounded(curve.withColumns({c: F.round(c, 6) for c in ("bin_left", "bin_right")}).drop("label"))


BINNED = v.SV + """,
moments AS (SELECT count(*)::DOUBLE AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high, avg(l_extendedprice) AS mu FROM sv),
shape AS (SELECT any_value(n) AS n, any_value(low) AS low, any_value(high) AS high,
  avg((l_extendedprice - mu) ** 3) / avg((l_extendedprice - mu) ** 2) ** 1.5 AS g1 FROM sv, moments),
rule AS (SELECT low, high, CAST(ceil(1 + log2(n) + log2(1 + abs(g1) / sqrt(6 * (n - 2) / ((n + 1) * (n + 3))))) AS INTEGER) AS k FROM shape),
placed AS (SELECT sv.*, low, high, k, least(k - 1, CAST(floor((l_extendedprice - low) / (high - low) * k) AS INTEGER)) AS bin FROM sv, rule),
lefts AS (SELECT *, low + bin * (high - low) / k AS bin_left FROM placed),
edges AS (SELECT bin_left, coalesce(lead(bin_left) OVER (ORDER BY bin_left), high) AS bin_right FROM (SELECT DISTINCT bin_left, high FROM lefts)),
binned AS (SELECT round(bin_left, 6) AS bin_left, round(bin_right, 6) AS bin_right, l_linestatus, duration_worked, failed FROM lefts JOIN edges USING (bin_left))"""


@query("binned_survival", "F5", sql=curve_sql(BINNED, "binned", ["bin_left", "bin_right", "l_linestatus"]))
def binned_survival(spark: SparkSession, sf: str) -> DataFrame:
    curve = km.binned_curves(v.subjects(spark, sf, "l_extendedprice"), "l_extendedprice", "l_linestatus")
    return rounded(curve.withColumns({c: F.round(c, 6) for c in ("bin_left", "bin_right")}).drop("label"))


@query("fixed_and_signed_durations", "B12 B18 B13", sql=W + v.SV + """,
f AS (SELECT l_orderkey, l_linenumber, failed, CASE WHEN duration_worked - 1 = 0 THEN 0.25e0 ELSE duration_worked - 1 END AS fixed, duration_worked FROM sv),
m AS (SELECT *, DATE '2011-01-31' AS a, CAST(DATE '2011-01-31' + CAST(floor(fixed) AS INTEGER) AS DATE) AS z FROM f),
k0 AS (SELECT *, (year(z) - year(a)) * 12 + month(z) - month(a) AS k1 FROM m),
k AS (SELECT *, CASE WHEN CAST(a + to_months(CAST(k1 AS INTEGER)) AS DATE) > z THEN k1 - 1 ELSE k1 END AS mm FROM k0)
SELECT l_orderkey, l_linenumber, fixed, fixed * CASE WHEN failed THEN 1 ELSE -1 END AS label,
  CASE WHEN mm // 12 <> 0 THEN (mm // 12) || ' y, ' ELSE '' END || CASE WHEN mm % 12 <> 0 THEN (mm % 12) || ' m, ' ELSE '' END
  || date_diff('day', CAST(a + to_months(CAST(mm AS INTEGER)) AS DATE), z) || ' d' AS span FROM k""")
def fixed_and_signed_durations(spark: SparkSession, sf: str) -> DataFrame:
    fixed = durations.fix_zero(F.col("duration_worked") - 1)
    rows = v.subjects(spark, sf).withColumn("fixed", fixed)
    rows = durations.with_human_span(rows, "fixed", "span", datetime.date(2011, 1, 31))
    label = durations.signed_label(F.col("fixed"), F.col("failed"))
    return rows.select("l_orderkey", "l_linenumber", "fixed", label.alias("label"), "span")


@query("mean_durations", "E10 E11", sql=W + v.SV + """
SELECT p_brand, failed, round(avg(CASE WHEN duration_worked = 0 THEN 0.25 ELSE duration_worked END), 6) AS duration_worked,
  count(*) AS aggregate_weight FROM sv GROUP BY p_brand, failed""")
def mean_durations(spark: SparkSession, sf: str) -> DataFrame:
    out, _rejected = strata.aggregate_groups(v.subjects_with_brand(spark, sf), ["p_brand", "failed"], strata.mean_duration)
    return out.withColumn("duration_worked", F.round("duration_worked", 6))


@query("geometric_mean_durations", "E10 E12", sql=W + v.SV + """
SELECT p_brand, failed, round(exp(avg(ln(CASE WHEN duration_worked = 0 THEN 0.25 ELSE duration_worked END))), 6) AS duration_worked,
  count(*) AS aggregate_weight FROM sv GROUP BY p_brand, failed HAVING count(*) > 500""")
def geometric_mean_durations(spark: SparkSession, sf: str) -> DataFrame:
    out, _rejected = strata.aggregate_groups(
        v.subjects_with_brand(spark, sf), ["p_brand", "failed"], strata.geometric_mean_duration,
        valid=F.col(strata.WEIGHT) > 500)
    return out.withColumn("duration_worked", F.round("duration_worked", 6))


@query("rejected_groups", "E10", sql=W + v.SV + """
SELECT p_brand, failed, count(*) AS aggregate_weight FROM sv GROUP BY p_brand, failed HAVING count(*) <= 500""")
def rejected_groups(spark: SparkSession, sf: str) -> DataFrame:
    _accepted, rejected = strata.aggregate_groups(
        v.subjects_with_brand(spark, sf), ["p_brand", "failed"], strata.geometric_mean_duration,
        valid=F.col(strata.WEIGHT) > 500)
    return rejected.drop("duration_worked")


def _sample_sql(fraction: float) -> str:
    return W + v.REDUCED_SUBJECTS + f""",
quota AS (SELECT CAST(floor(count(*) * {fraction}) AS BIGINT) AS q, count(*) FILTER (failed) AS f FROM subjects),
ranked AS (SELECT *, row_number() OVER (PARTITION BY failed ORDER BY md5('7' || chr(9) || drive_id), drive_id) AS r FROM subjects)
SELECT drive_id, failed, duration_worked FROM ranked, quota
WHERE r <= CASE WHEN failed THEN least(q, f) ELSE greatest(q - f, 0) END"""


@query("failures_kept_sample", "C7 G3", sql=_sample_sql(0.6))
def failures_kept_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.keep_failures_sample(fleet.survival_subjects(spark, sf), ["drive_id"], 0.6, seed=7)


@query("failures_only_sample", "C7", sql=_sample_sql(0.2))
def failures_only_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.keep_failures_sample(fleet.survival_subjects(spark, sf), ["drive_id"], 0.2, seed=7)


@query("sorted_by_duration", "G4", sql=W + v.REDUCED_SUBJECTS + " SELECT drive_id, failed, duration_worked FROM subjects ORDER BY duration_worked, drive_id")
def sorted_by_duration(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sorted_by_duration(fleet.survival_subjects(spark, sf), ["drive_id"])


def scored_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return v.subjects(spark, sf, "l_quantity").withColumn("score", F.col("l_quantity"))


CONCORDANCE = v.SV + """,
c AS (SELECT duration_worked AS t, l_quantity AS s, count(*) AS n, sum(failed::INT) AS d FROM sv GROUP BY ALL),
later AS (SELECT t, s, sum(n) OVER (PARTITION BY s ORDER BY t RANGE UNBOUNDED PRECEDING) AS upto FROM c),
totals AS (SELECT s, sum(n) AS total FROM c GROUP BY s),
grid AS (SELECT a.t, a.s, a.d, z.s AS s2, z.total FROM c a, totals z WHERE a.d > 0),
pairs AS (SELECT g.*, z.total - coalesce(u.upto, 0) + coalesce(e.n - e.d, 0) AS longer FROM grid g JOIN totals z ON z.s = g.s2
  ASOF LEFT JOIN later u ON u.s = g.s2 AND u.t <= g.t LEFT JOIN c e ON e.s = g.s2 AND e.t = g.t),
k AS (SELECT sum(CASE WHEN s2 > s THEN d * longer ELSE 0 END) AS concordant, sum(CASE WHEN s2 < s THEN d * longer ELSE 0 END) AS discordant,
  sum(CASE WHEN s2 = s THEN d * longer ELSE 0 END) AS tied, sum(d * longer) AS comparable FROM pairs)
SELECT CAST(concordant AS BIGINT) AS concordant, CAST(discordant AS BIGINT) AS discordant, CAST(tied AS BIGINT) AS tied,
  CAST(comparable AS BIGINT) AS comparable, round((concordant + tied / 2.0e0) / comparable, 9) AS concordance FROM k"""


@query("concordance", "F12", sql=W + CONCORDANCE)
def concordance(spark: SparkSession, sf: str) -> DataFrame:
    c = evaluate.concordance(scored_subjects(spark, sf))
    return c.select(
        *[F.col(n).cast("bigint").alias(n) for n in ("concordant", "discordant", "tied", "comparable")],
        F.round("concordance", 9).alias("concordance"))


# A fixed linear predictor for the steps that follow a fit.
def fixed_predictor() -> cox.CoxModel:
    return cox.CoxModel(["l_quantity", "l_discount", "l_tax"], [0.02, -3.0, 1.5], [25.0, 0.05, 0.04], 0.0, 0, True)


ETA = "0.02e0 * (l_quantity - 25) + -3.0e0 * (l_discount - 0.05e0) + 1.5e0 * (l_tax - 0.04e0)"
BASELINE = v.SV + f""",
scored AS (SELECT *, {ETA} AS eta FROM sv),
haz AS (SELECT duration_worked AS t, sum(exp(eta)) AS r, sum(failed::INT) AS d FROM scored GROUP BY 1),
h AS (SELECT t, d / sum(r) OVER (ORDER BY t DESC) AS hazard FROM haz),
base AS (SELECT t, hazard, sum(hazard) OVER (ORDER BY t) AS cumulative_hazard FROM h)"""


@query("baseline_hazard", "F8 B18", sql=W + BASELINE + " SELECT t, round(hazard, 9) AS hazard, round(cumulative_hazard, 6) AS cumulative_hazard FROM base")
def baseline_hazard(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.subjects(spark, sf, "l_quantity", "l_discount", "l_tax")
    base = cox.baseline_hazard(rows, fixed_predictor().log_hazard())
    return base.select("t", F.round("hazard", 9).alias("hazard"), F.round("cumulative_hazard", 6).alias("cumulative_hazard"))


def quantity_predictor() -> cox.CoxModel:
    return cox.CoxModel(["l_quantity"], [0.02], [25.0], 0.0, 0, True)


@query("expected_survival", "F9", sql=W + v.SV + """,
scored AS (SELECT *, 0.02e0 * (l_quantity - 25) AS eta FROM sv),
haz AS (SELECT duration_worked AS t, sum(exp(eta)) AS r, sum(failed::INT) AS d FROM scored GROUP BY 1),
h AS (SELECT t, d / sum(r) OVER (ORDER BY t DESC) AS hazard FROM haz),
base AS (SELECT t, sum(hazard) OVER (ORDER BY t) AS ch FROM h UNION ALL SELECT 0.0e0, 0.0e0),
lines AS (SELECT eta, t, exp(-ch * exp(eta)) AS s FROM base, (SELECT DISTINCT eta FROM scored)),
steps AS (SELECT eta, t, s, lead(t) OVER (PARTITION BY eta ORDER BY t) AS t2, lead(s) OVER (PARTITION BY eta ORDER BY t) AS s2 FROM lines),
areas AS (SELECT eta, sum((t2 - t) * (s + s2) / 2) AS area FROM steps GROUP BY eta)
SELECT l_orderkey, l_linenumber, l_quantity, round(area, 4) AS predicted_survival FROM scored JOIN areas USING (eta)""")
def expected_survival(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.subjects(spark, sf, "l_quantity")
    eta = quantity_predictor().log_hazard()
    out = cox.expected_survival(rows, eta, cox.baseline_hazard(rows, eta))
    return out.select("l_orderkey", "l_linenumber", "l_quantity", F.round("predicted_survival", 4).alias("predicted_survival"))


@query("predictions_sorted", "G4", sql=W + v.SV + """
SELECT l_orderkey, l_linenumber, l_quantity * 2 AS predicted_survival FROM sv ORDER BY 3 DESC, 1, 2""")
def predictions_sorted(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.subjects(spark, sf, "l_quantity").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("predicted_survival"))
    return sampling.sorted_by_prediction(rows, ["l_orderkey", "l_linenumber"])


PHI = v.SV + """, phi AS (SELECT l_orderkey, l_linenumber, 0.02e0 * (l_quantity - 25) AS phi_l_quantity,
  -3.0e0 * (l_discount - 0.05e0) AS phi_l_discount, 1.5e0 * (l_tax - 0.04e0) AS phi_l_tax FROM sv)"""
FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _phi(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.subjects(spark, sf, *FEATURES).select("l_orderkey", "l_linenumber", *FEATURES)
    return explain.linear_contributions(rows, fixed_predictor().contributions())


@query("linear_contributions", "F15", sql=W + PHI + """
SELECT l_orderkey, l_linenumber, round(phi_l_quantity, 9) + 0 AS phi_l_quantity, round(phi_l_discount, 9) + 0 AS phi_l_discount,
  round(phi_l_tax, 9) + 0 AS phi_l_tax FROM phi""")
def linear_contributions(spark: SparkSession, sf: str) -> DataFrame:
    return _phi(spark, sf).select(
        "l_orderkey", "l_linenumber", *[(F.round(f"phi_{f}", 9) + 0).alias(f"phi_{f}") for f in FEATURES])


@query("mean_explanation", "E18", sql=W + PHI + """
SELECT round(sqrt(avg(phi_l_quantity ** 2)) * sign(avg(phi_l_quantity)), 9) AS phi_l_quantity,
  round(sqrt(avg(phi_l_discount ** 2)) * sign(avg(phi_l_discount)), 9) AS phi_l_discount,
  round(sqrt(avg(phi_l_tax ** 2)) * sign(avg(phi_l_tax)), 9) AS phi_l_tax FROM phi""")
def mean_explanation(spark: SparkSession, sf: str) -> DataFrame:
    means = explain.mean_explanation(_phi(spark, sf), [f"phi_{f}" for f in FEATURES])
    return means.select(*[F.round(c, 9).alias(c) for c in means.columns])


@query("compact_explanations", "F16", sql=W + v.SV + """,
q AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount * 40 AS b, l_tax * 10 AS c, l_quantity + l_discount * 40 + l_tax * 10 AS total FROM sv),
s AS (SELECT *, a / total AS sa, b / total AS sb, c / total AS sc, greatest(a / total, b / total, c / total) / 10.0e0 AS lim FROM q)
SELECT l_orderkey, l_linenumber, CASE WHEN sa > lim THEN round(sa, 9) END AS quantity, CASE WHEN sb > lim THEN round(sb, 9) END AS discount,
  CASE WHEN sc > lim THEN round(sc, 9) END AS tax,
  round(CASE WHEN sa > lim THEN 0 ELSE sa END + CASE WHEN sb > lim THEN 0 ELSE sb END + CASE WHEN sc > lim THEN 0 ELSE sc END, 9) + 0 AS other FROM s""")
def compact_explanations(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.subjects(spark, sf, *FEATURES).select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), (F.col("l_discount") * 40).alias("discount"),
        (F.col("l_tax") * 10).alias("tax"))
    out = explain.with_compact_explanation(rows, ["quantity", "discount", "tax"], "e", threshold_ratio=10.0)
    return out.select(
        "l_orderkey", "l_linenumber", *[F.round(F.col("e")[n], 9).alias(n) for n in ("quantity", "discount", "tax")],
        (F.round(F.col("e")[explain.OTHER], 9) + 0).alias("other"))


# Bisection of the score equation over each group's compacted axis.
WEIBULL = v.SV + """,
compact AS (SELECT p_brand, CASE WHEN duration_worked = 0 THEN 0.25 ELSE duration_worked END AS t, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS d
  FROM sv GROUP BY 1, 2),
top AS (SELECT p_brand, max(ln(t)) AS top, sum(n) AS size, sum(d) AS events FROM compact GROUP BY 1),
arrays AS (SELECT p_brand, any_value(top) AS top, any_value(size) AS size, any_value(events) AS events, sum(d * (ln(t) - top)) / any_value(events) AS mean,
  list({'n': n, 'l': ln(t) - top}) AS axis FROM compact JOIN top USING (p_brand) GROUP BY p_brand),
steps AS (WITH RECURSIVE it AS (SELECT p_brand, ln(0.001e0) AS lo, ln(1000.0e0) AS hi, 0 AS k FROM arrays
  UNION ALL
  SELECT p_brand, CASE WHEN low THEN (lo + hi) / 2 ELSE lo END, CASE WHEN low THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM (
    SELECT it.*, list_sum(list_transform(axis, lambda x: x.n * exp(exp((lo + hi) / 2) * x.l) * x.l))
      / list_sum(list_transform(axis, lambda x: x.n * exp(exp((lo + hi) / 2) * x.l))) - exp(-(lo + hi) / 2) - mean < 0 AS low
    FROM it JOIN arrays USING (p_brand)) WHERE k < 60)
  SELECT * FROM it WHERE k = 60)
SELECT p_brand, CAST(size AS BIGINT) AS aggregate_weight, round(exp((lo + hi) / 2), 5) AS weibull_shape,
  round(exp(top) * (list_sum(list_transform(axis, lambda x: x.n * exp(exp((lo + hi) / 2) * x.l))) / events) ** exp(-(lo + hi) / 2), 3) AS weibull_scale
FROM steps JOIN arrays USING (p_brand)"""


@query("weibull_by_brand", "E13", sql=W + WEIBULL)
def weibull_by_brand(spark: SparkSession, sf: str) -> DataFrame:
    fits = weibull.accepted_fits(weibull.fit_weibull_groups(v.subjects_with_brand(spark, sf), ["p_brand"]))
    return fits.withColumns({"weibull_shape": F.round("weibull_shape", 5), "weibull_scale": F.round("weibull_scale", 3)})
