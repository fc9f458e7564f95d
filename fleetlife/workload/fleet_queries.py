"""Keys, dimensions, facts, lifespans and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.staging_area import new_folder, stage
from ..operators import anomalies, dims, facts, lifespan, strata
from ..plans import fleet as fleet_jobs
from ..sources import buckets, facts_store, store
from . import views as v
from .registry import query

W = "WITH "


@query("day_and_key_codes", "B1 B2 B3 B4 B5 B6", sql=W + v.T1_RAW + """
SELECT drive_id, day, strftime(DATE '1970-01-01' + day, '%Y-%m-%d') AS iso,
  day - 9131 AS ordinal, day AS day_again, strftime(DATE '1970-01-01' + day, '%Y-%m-%d %H:%M:%S') AS midnight,
  (drive_id << 13) | (day - 9131) AS packed, drive_id AS drive_again, day - 9131 AS ordinal_again,
  TRUE AS mine, day - 9131 BETWEEN 100 AND 900 AS mine_in_range, FALSE AS others FROM t1_raw""")
def day_and_key_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.raw_telemetry(spark, sf).select("drive_id", "day")
    iso = keys.iso_date(F.col("day"))
    ordinal = keys.day_to_ordinal(keys.epoch_day(iso), v.BASE)
    key = keys.pack_key(F.col("drive_id"), F.col("ordinal"))
    packed = F.col("packed")
    return rows.withColumns({"iso": iso, "ordinal": ordinal}).withColumn("packed", key).withColumns({
        "day_again": keys.ordinal_to_day(F.col("ordinal"), v.BASE),
        "midnight": F.date_format(keys.ordinal_to_timestamp(F.col("ordinal"), v.BASE), "yyyy-MM-dd HH:mm:ss"),
        "drive_again": keys.unpack_device(packed), "ordinal_again": keys.unpack_ordinal(packed),
        "mine": keys.is_device(packed, F.col("drive_id")),
        "mine_in_range": keys.is_device(packed, F.col("drive_id"), F.lit(100), F.lit(900)),
        "others": keys.is_device(packed, F.col("drive_id") + 1),
    })


@query("first_and_last_days", "E1", sql=W + v.T1_RAW + """
SELECT drive_id, min(day) AS first_day, max(day) AS last_day FROM t1_raw GROUP BY drive_id""")
def first_and_last_days(spark: SparkSession, sf: str) -> DataFrame:
    return lifespan.first_and_last(v.raw_telemetry(spark, sf))


@query("lifespans", "E3", sql=W + v.LIFESPANS + " SELECT * FROM lifespans")
def lifespans(spark: SparkSession, sf: str) -> DataFrame:
    return lifespan.lifespans(v.raw_telemetry(spark, sf))


@query("refreshed_last_days", "E2", sql=W + v.T1_RAW + """,
known AS (SELECT drive_id, min(day) AS first_day, max(day) AS last_day,
  max(CASE WHEN failure = 1 THEN day END) AS failure_day FROM t1_raw WHERE day < 10227 GROUP BY drive_id),
seen AS (SELECT drive_id, max(day) AS seen FROM t1_raw WHERE day >= 10227 GROUP BY drive_id)
SELECT drive_id, first_day, greatest(last_day, coalesce(seen, last_day)) AS last_day, failure_day
FROM known LEFT JOIN seen USING (drive_id)""")
def refreshed_last_days(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.raw_telemetry(spark, sf)
    known = lifespan.lifespans(rows.where(F.col("day") < v.CUT))
    return lifespan.refreshed_last_days(known, rows.where(F.col("day") >= v.CUT))


@query("merged_lifespans", "E2 E3 A17", sql=W + v.LIFESPANS + " SELECT * FROM lifespans")
def merged_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.raw_telemetry(spark, sf)
    known = lifespan.lifespans(rows.where(F.col("day") < v.CUT))
    return lifespan.merge_lifespans(known, lifespan.lifespans(rows.where(F.col("day") >= v.CUT)))


@query("upserted_lifespans", "A17", sql=W + v.LIFESPANS + """,
known AS (SELECT drive_id, min(day) AS first_day, max(day) AS last_day,
  max(CASE WHEN failure = 1 THEN day END) AS failure_day FROM t1 WHERE day < 10227 GROUP BY drive_id),
fresh AS (SELECT drive_id, min(day) AS first_day, max(day) AS last_day,
  max(CASE WHEN failure = 1 THEN day END) AS failure_day FROM t1 WHERE day >= 10227 GROUP BY drive_id)
SELECT * FROM fresh UNION ALL SELECT * FROM known WHERE drive_id NOT IN (SELECT drive_id FROM fresh)""")
def upserted_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.raw_telemetry(spark, sf)
    known = lifespan.lifespans(rows.where(F.col("day") < v.CUT))
    return store.upsert(known, lifespan.lifespans(rows.where(F.col("day") >= v.CUT)), "drive_id")


@query("bucketed_lifespans", "A17 S1", sql=W + v.T1 + """,
s AS (SELECT drive_id, CASE WHEN day < 10227 THEN 0 WHEN day < 10347 THEN 1 ELSE 2 END AS load, min(day) AS first_day,
  max(day) AS last_day, max(CASE WHEN failure = 1 THEN day END) AS failure_day FROM t1 GROUP BY ALL)
SELECT drive_id, first_day, last_day, failure_day FROM s QUALIFY load = max(load) OVER (PARTITION BY drive_id)""")
def bucketed_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    """Three loads into a bucketed table; the lifespans of a drive's last load count."""
    rows, root = v.raw_telemetry(spark, sf), new_folder(spark, "bucketed")
    buckets.create_buckets(lifespan.lifespans(rows.where(F.col("day") < v.CUT)), root, "drive_id", 16)
    later = rows.where(F.col("day") >= v.CUT)
    for part in (F.col("day") < v.CUT + 120, F.col("day") >= v.CUT + 120):
        buckets.upsert_buckets(spark, root, lifespan.lifespans(later.where(part)))
    buckets.drop_superseded(spark, root)
    return buckets.read_buckets(spark, root)


@query("last_update_wins", "A17", sql=W + v.T1_RAW + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY drive_id ORDER BY day DESC, power_on_hours_raw DESC) AS r FROM
  (SELECT drive_id, day, max(power_on_hours_raw) AS power_on_hours_raw FROM t1_raw GROUP BY drive_id, day))
SELECT drive_id, power_on_hours_raw FROM ranked WHERE r = 1""")
def last_update_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.telemetry(spark, sf).select("drive_id", "power_on_hours_raw", "day")
    old = rows.where(F.col("day") < v.CUT).groupBy("drive_id").agg(F.max_by("power_on_hours_raw", "day").alias("power_on_hours_raw"))
    return store.upsert(old, rows.where(F.col("day") >= v.CUT), "drive_id", order="day")


@query("multiple_failures", "E4", sql=W + v.T1 + """
SELECT drive_id, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) AS failure_days, CAST(count(*) AS INTEGER) AS failures
FROM t1 WHERE failure = 1 GROUP BY drive_id HAVING count(*) > 1""")
def multiple_failures(spark: SparkSession, sf: str) -> DataFrame:
    many = anomalies.multiple_failures(facts.failure_records(v.raw_telemetry(spark, sf)))
    text = F.array_join(F.col("failure_days").cast("array<string>"), ",")
    return many.select("drive_id", text.alias("failure_days"), F.size("failure_days").alias("failures"))


ANOMALIES = v.LIFESPANS + ", " + v.DIMS + """,
late AS (SELECT drive_id, last_day - failure_day AS overshoot FROM lifespans WHERE last_day > failure_day),
many AS (SELECT drive_id, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) AS failure_days
  FROM t1 WHERE failure = 1 GROUP BY drive_id HAVING count(*) > 1),
strange AS (SELECT d.id AS drive_id FROM drives d JOIN models m ON m.id = d.model_id WHERE coalesce(m.brand_id, 0) = 0),
anomalies AS (SELECT drive_id, overshoot, failure_days, s.drive_id IS NOT NULL AS unknown
  FROM late FULL JOIN many USING (drive_id) FULL JOIN strange s USING (drive_id))"""


def _anomalies(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.raw_telemetry(spark, sf)
    unknown = dims.unknown_model_drives(v.drives(spark, sf), v.models(spark, sf))
    return anomalies.report_from_histories(lifespan.histories(rows), unknown)


@query("anomaly_report", "E5", sql=W + ANOMALIES + " SELECT * FROM anomalies")
def anomaly_report(spark: SparkSession, sf: str) -> DataFrame:
    days = F.array_join(F.col("failure_days").cast("array<string>"), ",")
    return _anomalies(spark, sf).withColumn("failure_days", days)


@query("saved_anomalies", "A18", sql=W + ANOMALIES + """
SELECT drive_id, '{' || concat_ws(',', '"overshoot":' || overshoot, '"failure_days":[' || failure_days || ']',
  '"unknown":' || CASE WHEN unknown THEN 'true' ELSE 'false' END) || '}' AS info FROM anomalies""")
def saved_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return store.with_json_info(_anomalies(spark, sf), "drive_id", F.struct("overshoot", "failure_days", "unknown"))


@query("new_models_and_drives", "E6 D9", sql=W + v.STAGING + """,
known_names AS (SELECT DISTINCT serial_number, model FROM staging WHERE date < '1995-07-01'),
known_models AS (SELECT row_number() OVER (ORDER BY md5(name), name) AS id, name FROM (SELECT DISTINCT model AS name FROM known_names)),
known_drives AS (SELECT row_number() OVER (ORDER BY md5(serial_number), serial_number) AS id, serial_number FROM known_names),
fresh AS (SELECT serial_number, min(model) AS model_name FROM staging
  WHERE serial_number NOT IN (SELECT serial_number FROM known_drives) GROUP BY serial_number),
fresh_models AS (SELECT (SELECT coalesce(max(id), 0) FROM known_models) + row_number() OVER (ORDER BY md5(name), name) AS id, name
  FROM (SELECT DISTINCT model_name AS name FROM fresh WHERE model_name NOT IN (SELECT name FROM known_models))),
all_models AS (SELECT * FROM known_models UNION ALL SELECT * FROM fresh_models)
SELECT 'model' AS kind, id, name, CAST(NULL AS BIGINT) AS model_id FROM fresh_models
UNION ALL
SELECT 'drive', (SELECT coalesce(max(id), 0) FROM known_drives) + row_number() OVER (ORDER BY md5(serial_number), serial_number),
  serial_number, m.id FROM fresh JOIN all_models m ON m.name = model_name""")
def new_models_and_drives(spark: SparkSession, sf: str) -> DataFrame:
    staged = v.staging(spark, sf).select("date", "serial_number", "model")
    empty_models = spark.createDataFrame([], "id bigint, name string")
    empty_drives = spark.createDataFrame([], "id bigint, serial_number string")
    known_models, known_drives = dims.new_models_and_drives(staged.where(F.col("date") < "1995-07-01"), empty_models, empty_drives)
    known_models, known_drives = stage(known_models, "models"), stage(known_drives, "drives")
    new_models, new_drives = dims.new_models_and_drives(staged, known_models, known_drives)
    return new_models.select(
        F.lit("model").alias("kind"), "id", "name", F.lit(None).cast("bigint").alias("model_id"),
    ).unionByName(new_drives.select(F.lit("drive").alias("kind"), "id", F.col("serial_number").alias("name"), "model_id"))


@query("model_conflicts", "E6", sql=W + v.STAGING + """,
named AS (SELECT DISTINCT serial_number, model || '-' || CAST(day(CAST(date AS DATE)) % 4 AS VARCHAR) AS model FROM staging),
kept AS (SELECT serial_number, min(model) AS kept_model FROM named GROUP BY serial_number)
SELECT serial_number, kept_model, model AS other_model FROM named JOIN kept USING (serial_number) WHERE model <> kept_model""")
def model_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Serials that appear under up to four names: the day of the month gives each record's name a suffix."""
    suffix = F.pmod(F.dayofmonth(F.to_date("date")), F.lit(4)).cast("string")
    return dims.model_conflicts(v.staging(spark, sf).withColumn("model", F.concat_ws("-", "model", suffix)))


@query("model_brands", "D4 B7", sql=W + v.DIMS + " SELECT id, name, brand_id FROM models")
def model_brands(spark: SparkSession, sf: str) -> DataFrame:
    return v.classified_models(spark, sf)


@query("brands_with_vendor", "D2", sql=W + v.DIMS + """
SELECT b.id, b.name, b.vendor_id, b.model_name_regex, v.name AS vendor_name FROM brands b JOIN vendors v ON v.id = b.vendor_id""")
def brands_with_vendor(spark: SparkSession, sf: str) -> DataFrame:
    return dims.brands_with_vendor(v.brands(spark, sf), v.vendors(spark, sf))


@query("models_with_brand", "D3", sql=W + v.DIMS + """
SELECT m.id, m.name, m.brand_id, b.name AS brand_name, b.vendor_id FROM models m JOIN brands b ON b.id = m.brand_id""")
def models_with_brand(spark: SparkSession, sf: str) -> DataFrame:
    return dims.models_with_brand(v.models(spark, sf), v.brands(spark, sf))


@query("drives_with_lineage", "D10", sql=W + v.DIMS + """
SELECT d.id, d.model_id, d.serial_number, m.name AS model_name, m.brand_id, b.name AS brand_name, b.vendor_id,
  v.name AS vendor_name FROM drives d JOIN models m ON m.id = d.model_id LEFT JOIN brands b ON b.id = m.brand_id
  LEFT JOIN vendors v ON v.id = b.vendor_id""")
def drives_with_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return dims.drives_with_lineage(v.drives(spark, sf), v.models(spark, sf), v.brands(spark, sf), v.vendors(spark, sf))


@query("unknown_model_drives", "C4", sql=W + v.DIMS + """
SELECT d.id, d.model_id, d.serial_number FROM drives d JOIN models m ON m.id = d.model_id WHERE coalesce(m.brand_id, 0) = 0""")
def unknown_model_drives(spark: SparkSession, sf: str) -> DataFrame:
    return dims.unknown_model_drives(v.drives(spark, sf), v.models(spark, sf)).select("id", "model_id", "serial_number")


@query("normalized_records", "D1", sql=W + v.STAGING + f""",
facts AS (SELECT d.id AS drive_id, CAST(date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) AS INTEGER) AS day, failure,
  power_on_hours_raw FROM staging s JOIN drive_names d ON d.serial_number = s.serial_number)
SELECT drive_id, day, max(failure) AS failure, max(power_on_hours_raw) AS power_on_hours_raw FROM facts GROUP BY drive_id, day""")
def normalized_records(spark: SparkSession, sf: str) -> DataFrame:
    drives = v.drive_names(spark, sf)
    return facts.normalize_and_collapse(v.staging(spark, sf), drives, ["failure", "power_on_hours_raw"])


@query("stored_facts", "D1 A20", sql=W + v.T1 + " SELECT drive_id, day, failure, power_on_hours_raw FROM t1 WHERE day BETWEEN 10227 AND 10956")
def stored_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts through their store, read back for the two years from 1998."""
    path = new_folder(spark, "facts")
    facts_store.write_facts(v.telemetry(spark, sf), path)
    return facts_store.read_facts(spark, path, v.CUT, v.CUT + 729)


@query("imported_facts", "D1 E6 D9 D4", sql=W + v.STAGING + """,
numbered AS (SELECT row_number() OVER (ORDER BY md5(serial_number), serial_number) AS id, serial_number FROM (SELECT DISTINCT serial_number FROM staging))
SELECT d.id AS drive_id, CAST(date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) AS INTEGER) AS day, max(failure) AS failure,
  max(power_on_hours_raw) AS power_on_hours_raw FROM staging s JOIN numbered d USING (serial_number) GROUP BY 1, 2""")
def imported_facts(spark: SparkSession, sf: str) -> DataFrame:
    """A first import into empty dimensions."""
    no_models = spark.createDataFrame([], "id bigint, name string")
    no_drives = spark.createDataFrame([], "id bigint, model_id bigint, serial_number string")
    imported = fleet_jobs.import_telemetry(
        v.staging(spark, sf), no_models, no_drives, v.brands(spark, sf), ["failure", "power_on_hours_raw"])
    return imported.facts


@query("learning_frame", "F1 D8 D10 D11 E11", sql=W + ANOMALIES + """,
clean AS (SELECT d.model_id, failure_day IS NOT NULL AS failed, CAST(coalesce(failure_day, last_day) - first_day AS DOUBLE) AS duration
  FROM lifespans l JOIN drives d ON d.id = l.drive_id WHERE drive_id NOT IN (SELECT drive_id FROM anomalies)),
means AS (SELECT model_id, failed, avg(CASE WHEN duration = 0 THEN 0.25 ELSE duration END) AS duration_worked, count(*) AS aggregate_weight
  FROM clean GROUP BY model_id, failed)
SELECT model_id, failed, round(duration_worked, 6) AS duration_worked, aggregate_weight, m.name, m.brand_id
FROM means JOIN models m ON m.id = model_id""")
def learning_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Mean durations per model and outcome, with model attributes."""
    rows = v.raw_telemetry(spark, sf)
    models, drives = v.models(spark, sf), v.drives(spark, sf)
    spans, reported = fleet_jobs.preprocess(rows, None, drives, models)
    task = fleet_jobs.learning_task(fleet_jobs.survival_stats(spans, reported, drives), models, ["name", "brand_id"], "aggregated")
    return task.frame.withColumn("duration_worked", F.round("duration_worked", 6))


@query("preprocessed_in_two_loads", "E2 E3 E4 E5 A17", sql=W + ANOMALIES + """
SELECT l.drive_id, first_day, last_day, failure_day, overshoot, failure_days, coalesce("unknown", false) AS "unknown"
FROM lifespans l LEFT JOIN anomalies USING (drive_id)""")
def preprocessed_in_two_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Telemetry before and after the cut, loaded one after the other: the same as one load."""
    rows, models, drives = v.raw_telemetry(spark, sf), v.models(spark, sf), v.drives(spark, sf)
    stored, _ = fleet_jobs.preprocess(rows.where(F.col("day") < v.CUT), None, drives, models)
    spans, reported = fleet_jobs.preprocess(rows.where(F.col("day") >= v.CUT), stored, drives, models)
    text = F.array_join(F.col("failure_days").cast("array<string>"), ",")
    return spans.drop("failure_days").join(reported.withColumn("failure_days", text), "drive_id", "left").withColumn(
        "unknown", F.coalesce("unknown", F.lit(False)))


@query("censored_drives", "E3", sql=W + v.LIFESPANS + " SELECT drive_id FROM lifespans WHERE failure_day IS NULL")
def censored_drives(spark: SparkSession, sf: str) -> DataFrame:
    return lifespan.censored_devices(lifespans(spark, sf))


@query("failure_records", "C1", sql=W + v.T1 + " SELECT drive_id, day AS failure_day FROM t1 WHERE failure = 1")
def failure_records(spark: SparkSession, sf: str) -> DataFrame:
    return facts.failure_records(v.raw_telemetry(spark, sf)).distinct()


@query("used_after_failure", "C2", sql=W + v.LIFESPANS + """
SELECT drive_id, last_day - failure_day AS overshoot FROM lifespans WHERE last_day > failure_day""")
def used_after_failure(spark: SparkSession, sf: str) -> DataFrame:
    return lifespan.used_after_failure(lifespans(spark, sf))


@query("outdated_candidates", "C3", sql=W + v.LIFESPANS + """
SELECT * FROM lifespans WHERE failure_day IS NULL AND last_day < (SELECT max(last_day) FROM lifespans)""")
def outdated_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return lifespan.outdated_candidates(lifespans(spark, sf))


@query("last_record", "C5", sql=W + v.T1 + " SELECT * FROM t1 ORDER BY drive_id DESC, day DESC LIMIT 1")
def last_record(spark: SparkSession, sf: str) -> DataFrame:
    return facts.last_record(v.telemetry(spark, sf), ["drive_id", "day"])


@query("records_within_lifespan", "D6", sql=W + v.LIFESPANS + """
SELECT t1.drive_id, t1.day, t1.failure FROM t1 JOIN lifespans l ON l.drive_id = t1.drive_id
WHERE l.failure_day IS NOT NULL AND t1.day BETWEEN l.first_day AND l.last_day""")
def records_within_lifespan(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.telemetry(spark, sf).select("drive_id", "day", "failure")
    return facts.records_within_lifespan(rows, lifespans(spark, sf))


@query("failures_within_lifespan", "D6", sql=W + v.LIFESPANS + """
SELECT t1.drive_id, t1.day FROM t1 JOIN lifespans l ON l.drive_id = t1.drive_id
WHERE l.failure_day IS NOT NULL AND t1.day BETWEEN l.first_day AND l.last_day AND failure = 1""")
def failures_within_lifespan(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.raw_telemetry(spark, sf).select("drive_id", "day", "failure")
    inside = facts.records_within_lifespan(rows, lifespans(spark, sf), only=F.col("failure") == 1)
    return inside.select("drive_id", "day").distinct()


@query("drives_without_stats", "D7", sql=W + v.T1_RAW + """
SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT drive_id FROM t1_raw WHERE day < 9300)""")
def drives_without_stats(spark: SparkSession, sf: str) -> DataFrame:
    early = lifespan.lifespans(v.raw_telemetry(spark, sf).where(F.col("day") < 9300))
    return lifespan.without_stats(v.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), early)


@query("clean_lifespans", "D8", sql=W + ANOMALIES + """
SELECT * FROM lifespans WHERE drive_id NOT IN (SELECT drive_id FROM anomalies)""")
def clean_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    return lifespan.exclude(lifespans(spark, sf), _anomalies(spark, sf))


@query("count_and_bounds", "E7", sql=W + v.T1_RAW + " SELECT count(*) AS n, min(day) AS min_key, max(day) AS max_key FROM t1_raw")
def count_and_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return facts.count_and_bounds(v.raw_telemetry(spark, sf), "day")


@query("newest_day", "E8", sql=W + v.LIFESPANS + " SELECT max(last_day) AS last_day FROM lifespans")
def newest_day(spark: SparkSession, sf: str) -> DataFrame:
    return lifespan.newest_day(lifespans(spark, sf))


@query("failed_summary", "E9", sql=W + v.T1 + """
SELECT drive_id, min(CASE WHEN failure = 1 THEN day END) AS first_failure_day, min(day) AS first_day, max(day) AS last_day
FROM t1 GROUP BY drive_id HAVING max(failure) = 1""")
def failed_summary(spark: SparkSession, sf: str) -> DataFrame:
    return lifespan.failed_summary(v.raw_telemetry(spark, sf))


REDUCED = v.LIFESPANS + """,
worked AS (SELECT drive_id, first_day, last_day, failure_day, failure_day - first_day AS days_in_dataset_failure,
  last_day - first_day AS days_in_dataset FROM lifespans)"""
FULL = v.LIFESPANS + """,
worked AS (SELECT l.drive_id, first_day, last_day, failure_day, fi.power_on_hours_raw AS first_hours,
  la.power_on_hours_raw AS last_hours, fa.power_on_hours_raw AS failure_hours,
  failure_day - first_day AS days_in_dataset_failure, last_day - first_day AS days_in_dataset,
  (fa.power_on_hours_raw - fi.power_on_hours_raw) // 24 AS days_in_dataset_failure_smart,
  fa.power_on_hours_raw // 24 AS failure_worked_days_smart,
  fi.power_on_hours_raw // 24 + last_day - first_day AS failure_worked_days_synthetic,
  (la.power_on_hours_raw - fi.power_on_hours_raw) // 24 AS days_in_dataset_smart,
  la.power_on_hours_raw // 24 AS total_worked_days_smart
  FROM lifespans l JOIN t1 fi ON fi.drive_id = l.drive_id AND fi.day = l.first_day
  JOIN t1 la ON la.drive_id = l.drive_id AND la.day = l.last_day
  LEFT JOIN t1 fa ON fa.drive_id = l.drive_id AND fa.day = l.failure_day)"""


@query("hours_at_key_days", "D5", sql=W + FULL + """
SELECT drive_id, first_day, last_day, failure_day, first_hours, last_hours, failure_hours FROM worked""")
def hours_at_key_days(spark: SparkSession, sf: str) -> DataFrame:
    return lifespan.lifespans_with_hours(v.telemetry(spark, sf))


@query("worked_days_full", "G1", sql=W + FULL + " SELECT * FROM worked")
def worked_days_full(spark: SparkSession, sf: str) -> DataFrame:
    return lifespan.worked_days(hours_at_key_days(spark, sf), reduced=False)


@query("worked_days_reduced", "G1", sql=W + REDUCED + " SELECT * FROM worked")
def worked_days_reduced(spark: SparkSession, sf: str) -> DataFrame:
    return lifespan.worked_days(lifespans(spark, sf))


@query("worked_days_failed", "G2", sql=W + FULL + " SELECT * FROM worked WHERE failure_day IS NOT NULL")
def worked_days_failed(spark: SparkSession, sf: str) -> DataFrame:
    return lifespan.worked_days(hours_at_key_days(spark, sf), reduced=False, keep="failed")


@query("worked_days_surviving", "G2", sql=W + REDUCED + " SELECT * FROM worked WHERE failure_day IS NULL")
def worked_days_surviving(spark: SparkSession, sf: str) -> DataFrame:
    return lifespan.worked_days(lifespans(spark, sf), keep="surviving")


@query("survival_subjects", "F1", sql=W + REDUCED + """
SELECT drive_id, days_in_dataset_failure IS NOT NULL AS failed,
  CAST(coalesce(days_in_dataset_failure, days_in_dataset) AS DOUBLE) AS duration_worked FROM worked""")
def survival_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return lifespan.duration_and_event(worked_days_reduced(spark, sf)).select("drive_id", "failed", "duration_worked")


@query("survival_subjects_by_hours", "F1", sql=W + FULL + """
SELECT drive_id, failure_worked_days_smart IS NOT NULL AS failed,
  CAST(coalesce(failure_worked_days_smart, total_worked_days_smart) AS DOUBLE) AS duration_worked FROM worked""")
def survival_subjects_by_hours(spark: SparkSession, sf: str) -> DataFrame:
    worked = worked_days_full(spark, sf)
    return lifespan.duration_and_event(worked, reduced=False).select("drive_id", "failed", "duration_worked")


@query("lost_failures", "F1", sql=W + FULL + """
SELECT count(*) FILTER (failure_day IS NOT NULL AND failure_worked_days_smart IS NULL) AS lost_failures,
  count(*) AS devices FROM worked""")
def lost_failures(spark: SparkSession, sf: str) -> DataFrame:
    return lifespan.lost_failures(worked_days_full(spark, sf))


@query("toy_subset", "A15", sql=W + v.T1 + " SELECT * FROM t1 WHERE drive_id % 10 = 0")
def toy_subset(spark: SparkSession, sf: str) -> DataFrame:
    drives = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return facts.every_nth_device(v.telemetry(spark, sf), drives, 10)


@query("toy_subset_by_size", "A15", sql=W + v.T1 + ", " + v.DIMS + """,
n AS (SELECT greatest(1, CAST(ceil(count(*) / 2000.0) AS BIGINT)) AS n FROM t1), d AS (SELECT drives.* FROM drives, n WHERE id % n = 0),
m AS (SELECT * FROM models WHERE id IN (SELECT model_id FROM d)), b AS (SELECT * FROM brands WHERE id IN (SELECT brand_id FROM m))
SELECT 'drives' AS "table", id, serial_number AS name FROM d UNION ALL SELECT 'models', id, name FROM m UNION ALL SELECT 'brands', id, name FROM b
UNION ALL SELECT 'vendors', id, name FROM vendors WHERE id IN (SELECT vendor_id FROM b)
UNION ALL SELECT 'facts', drive_id, CAST(day AS VARCHAR) FROM t1, n WHERE drive_id % n = 0""")
def toy_subset_by_size(spark: SparkSession, sf: str) -> DataFrame:
    """About 2,000 records with the dimensions they need."""
    parts = facts.toy_subset(v.telemetry(spark, sf), all_dimensions(spark, sf), 2000)
    names = {"drives": "serial_number"}
    rows = parts.pop("facts").select(F.lit("facts").alias("table"), F.col("drive_id").alias("id"), F.col("day").cast("string").alias("name"))
    for name, df in parts.items():
        rows = rows.unionByName(df.select(F.lit(name).alias("table"), F.col("id").cast("bigint").alias("id"), F.col(names.get(name, "name")).alias("name")))
    return rows


def all_dimensions(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {"vendors": v.vendors(spark, sf), "brands": v.brands(spark, sf), "models": v.models(spark, sf), "drives": v.drives(spark, sf)}


@query("lifespan_histogram", "E14", sql=W + v.LIFESPANS + ", " + v.DIMS + """,
lin AS (SELECT l.last_day - l.first_day AS days, v.name AS vendor_name, b.name AS brand_name, m.name AS model_name
  FROM lifespans l JOIN drives d ON d.id = l.drive_id JOIN models m ON m.id = d.model_id
  LEFT JOIN brands b ON b.id = m.brand_id LEFT JOIN vendors v ON v.id = b.vendor_id)
SELECT vendor_name, brand_name, model_name, days, CAST(count(*) AS BIGINT) AS n,
  CAST(3 - bit_count(grouping(vendor_name, brand_name, model_name, days)) AS INTEGER) AS level FROM lin
GROUP BY GROUPING SETS ((vendor_name, brand_name, model_name, days), (vendor_name, brand_name, days), (vendor_name, days), (days))""")
def lifespan_histogram(spark: SparkSession, sf: str) -> DataFrame:
    lineage = drives_with_lineage(spark, sf).select(F.col("id").alias("drive_id"), "vendor_name", "brand_name", "model_name")
    spans = worked_days_reduced(spark, sf).select("drive_id", F.col("days_in_dataset").alias("days"))
    return strata.lifespan_histogram(spans.join(lineage, "drive_id"), ["vendor_name", "brand_name", "model_name"], "days")


@query("exported_dimensions", "A13 A20", sql=W + v.DIMS + """
SELECT 'vendors' AS "table", id, name FROM vendors UNION ALL SELECT 'models', id, name FROM models
UNION ALL SELECT 'brands', id, name FROM brands UNION ALL SELECT 'drives', id, serial_number FROM drives""")
def exported_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    root = new_folder(spark, "export")
    tables = all_dimensions(spark, sf)
    out = None
    for name in store.export_tables(tables, root):
        back = store.read_table(spark, root, name)
        label = "serial_number" if name == "drives" else "name"
        part = back.select(F.lit(name).alias("table"), F.col("id").cast("bigint").alias("id"), F.col(label).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out


@query("dimension_documents", "A14", sql=W + v.DIMS + """
SELECT 'vendors' AS "table", '{"id":' || id || ',"name":"' || name || '"}' AS document FROM vendors UNION ALL
SELECT 'brands', '{"id":' || id || ',"name":"' || name || '","vendor_id":' || vendor_id || ',"model_name_regex":"' || model_name_regex || '"}' FROM brands UNION ALL
SELECT 'models', '{"id":' || id || ',"name":"' || name || '"' || coalesce(',"brand_id":' || brand_id, '') || '}' FROM models UNION ALL
SELECT 'drives', '{"id":' || id || ',"model_id":' || model_id || ',"serial_number":"' || serial_number || '"}' FROM drives""")
def dimension_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All dimensions written as JSON lines and read again."""
    root = new_folder(spark, "documents")
    store.export_documents(all_dimensions(spark, sf), root)
    return spark.read.schema("value string, `table` string").text(root).select("table", F.col("value").alias("document"))
