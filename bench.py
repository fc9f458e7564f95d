"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default: all), ``BENCH_QUERIES``
(comma-separated names, ``all`` for every registered query). Stored dimensions are written before the clock starts; the time
of the first query of a fresh session, start-up included, is reported as ``first_run``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetlife.plans.session import local_session  # noqa: E402
from fleetlife.workload import all_entries  # noqa: E402

HEADLINE = (
    "lifespans", "normalized_records", "new_models_and_drives", "model_brands", "anomaly_report", "worked_days_full",
    "vendor_survival", "survival_overall", "survival_by_status", "survival_by_brand", "nested_survival",
    "binned_survival", "mean_durations", "lifespan_histogram", "failures_kept_sample", "weibull_by_brand",
    "cox_coefficients", "baseline_hazard", "expected_survival", "concordance", "enriched_models", "model_mentions",
    "catalogue_pieces", "streamed_lifespans", "boosted_cox", "boosted_contributions", "cross_validated_cox",
    "weibull_rows", "scored_models", "imputed_attributes", "imported_facts", "survival_fractional",
)


def timed(spark: SparkSession, name: str, sf: str) -> float:
    start = time.perf_counter()
    all_entries()[name].run(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(all_entries()) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    spark = local_session("bench", cpus)
    first = round(timed(spark, "count_and_bounds", sf), 3)  # starts the JVM's machinery
    timed(spark, "drives_with_lineage", sf)  # writes the dimensions that later queries share
    times = {}
    for name in names:
        times[name] = round(timed(spark, name, sf), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")), "lineitem_rows": rows, "first_run": first,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
