"""The test tables in the roles of a device fleet, in Spark and (as CTE text) in SQL.

``T1`` telemetry out of orders; ``D`` dimensions out of region, nation and customer; ``SV`` survival subjects out of
lineitem; ``M`` model attributes out of part; ``T2`` event telemetry; pages and documents as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import number_by_hash
from ..functions.staging_area import stage
from ..operators.dims import classify_models
from ..operators.facts import one_per_day

BASE = 9131  # 1995-01-01, the first day of the test telemetry
CUT = 10227  # 1998-01-01: the telemetry before it counts as loaded earlier


_SCHEMAS: dict[str, T.StructType] = {}
_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table; its schema is read from the files once, so later reads start no footer job."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def staged(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A dimension as a stored table: written once per application, then read by every query."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STAGED:
        _STAGED[key] = stage(make(), name)
    return _STAGED[key]


def day_of(column: str):
    return F.unix_date(F.to_date(column))


def raw_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    failure = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("drive_id"), day_of("o_orderdate").alias("day"), failure.cast("int").alias("failure"),
        F.floor("o_totalprice").cast("bigint").alias("power_on_hours_raw"))


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return one_per_day(raw_telemetry(spark, sf))


def drive_names(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").join(n, "c_nationkey").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("serial_number"),
        F.concat_ws(" ", "n_name", "c_mktsegment").alias("model"))


def staging(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.date_format(F.to_date("o_orderdate"), "yyyy-MM-dd").alias("date"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).cast("int").alias("failure"),
        F.floor("o_totalprice").cast("bigint").alias("power_on_hours_raw"))
    return o.join(drive_names(spark, sf), "id").select("date", "serial_number", "model", "failure", "power_on_hours_raw")


def vendors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))


def brands(spark: SparkSession, sf: str) -> DataFrame:
    """Brands of the vendor EUROPE have no pattern, so their models stay unknown."""
    v = vendors(spark, sf).select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor"))
    n = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("vendor_id"))
    pattern = F.when(F.col("vendor") == "EUROPE", "").otherwise(F.concat(F.lit("^"), F.col("name"), F.lit(" ")))
    return n.join(v, "vendor_id").select("id", "name", "vendor_id", pattern.alias("model_name_regex"))


def classified_models(spark: SparkSession, sf: str) -> DataFrame:
    names = drive_names(spark, sf).select(F.col("model").alias("name")).distinct()
    return classify_models(number_by_hash(names, ["name"], "id"), brands(spark, sf)).select("id", "name", "brand_id")


def models(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, sf, "models", lambda: classified_models(spark, sf))


def drives(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, sf, "drives", lambda: drives_of_models(spark, sf))


def drives_of_models(spark: SparkSession, sf: str) -> DataFrame:
    m = models(spark, sf).select(F.col("id").alias("model_id"), F.col("name").alias("model"))
    return drive_names(spark, sf).join(m, "model").select("id", "model_id", "serial_number")


def subjects(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """One row per line item; duration in whole days, failed when returned."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("double").alias("duration_worked"),
        (F.col("l_returnflag") == "R").alias("failed"), "l_linestatus", *extra)


def subjects_with_brand(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size")
    return subjects(spark, sf, *extra).join(p, "l_partkey")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("drive_id"), "ts", day_of("ts").alias("day"),
        (F.col("event_type") == "error").cast("int").alias("failure"), "value", "props")


# The same views as CTEs.
DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST({0} AS DATE)) AS INTEGER)"
FAILURE = "CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END"
T1_RAW = f"""t1_raw AS (SELECT o_custkey AS drive_id, {DAY.format('o_orderdate')} AS day, {FAILURE} AS failure,
  CAST(floor(o_totalprice) AS BIGINT) AS power_on_hours_raw FROM orders)"""
T1 = T1_RAW + """, t1 AS (SELECT drive_id, day, max(failure) AS failure, max(power_on_hours_raw) AS power_on_hours_raw
  FROM t1_raw GROUP BY drive_id, day)"""
LIFESPANS = T1 + """, lifespans AS (SELECT drive_id, min(day) AS first_day, max(day) AS last_day,
  max(CASE WHEN failure = 1 THEN day END) AS failure_day FROM t1 GROUP BY drive_id)"""
NAMES = """drive_names AS (SELECT c_custkey AS id, c_name AS serial_number, n_name || ' ' || c_mktsegment AS model
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
STAGING = NAMES + f""", staging AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, serial_number, model, {FAILURE} AS failure,
  CAST(floor(o_totalprice) AS BIGINT) AS power_on_hours_raw FROM orders JOIN drive_names ON id = o_custkey)"""
DIMS = NAMES + """, vendors AS (SELECT r_regionkey AS id, r_name AS name FROM region),
brands AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey AS vendor_id,
  CASE WHEN r_name = 'EUROPE' THEN '' ELSE '^' || n_name || ' ' END AS model_name_regex
  FROM nation JOIN region ON n_regionkey = r_regionkey),
model_names AS (SELECT DISTINCT model AS name FROM drive_names),
models AS (SELECT row_number() OVER (ORDER BY md5(name), name) AS id, name,
  (SELECT min(b.id) FROM brands b WHERE length(b.model_name_regex) > 0
   AND regexp_matches(model_names.name, b.model_name_regex)) AS brand_id FROM model_names),
drives AS (SELECT d.id, m.id AS model_id, serial_number FROM drive_names d JOIN models m ON m.name = d.model)"""
SV = """sv AS (SELECT *, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS duration_worked,
  l_returnflag = 'R' AS failed FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)"""
T2 = f"""t2 AS (SELECT user_id AS drive_id, ts, {DAY.format('ts')} AS day,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failure, value, props FROM events)"""
REDUCED_SUBJECTS = LIFESPANS + """,
subjects AS (SELECT drive_id, failure_day IS NOT NULL AS failed, CAST(coalesce(failure_day, last_day) - first_day AS DOUBLE) AS duration_worked
  FROM lifespans)"""
