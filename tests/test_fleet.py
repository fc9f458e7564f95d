"""Edge cases of dimensions, lifespans, anomalies, samples."""

import pytest
from pyspark.sql import functions as F

from fleetlife.operators import anomalies, dims, enrich, facts, lifespan, sampling, strata

# drive 1: one day; 2: fails twice; 3: used after failure; 4: fails on day 0; 5: repeated day; 6: no hours at failure
ROWS = [
    (1, 5, 0, 100), (2, 1, 0, 10), (2, 3, 1, 50), (2, 7, 1, 90), (3, 1, 0, 24), (3, 2, 1, 48), (3, 9, 0, 240),
    (4, 0, 1, 1), (5, 2, 0, 30), (5, 2, 1, 20), (5, 4, 0, 80), (6, 1, 0, 24), (6, 4, 1, None),
]


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(ROWS, "drive_id int, day int, failure int, power_on_hours_raw long")


def by_drive(df):
    return {r["drive_id"]: r for r in df.collect()}


def test_lifespans(rows):
    got = {k: (r.first_day, r.last_day, r.failure_day) for k, r in by_drive(lifespan.lifespans(rows)).items()}
    assert got == {1: (5, 5, None), 2: (1, 7, 7), 3: (1, 9, 2), 4: (0, 0, 0), 5: (2, 4, 2), 6: (1, 4, 4)}


def test_one_per_day_takes_the_maximum(rows):
    got = {(r.drive_id, r.day): (r.failure, r.power_on_hours_raw) for r in facts.one_per_day(rows).collect()}
    assert got[5, 2] == (1, 30) and len(got) == len(ROWS) - 1


def test_lost_failure_becomes_censored(rows):
    spans = lifespan.lifespans_with_hours(facts.one_per_day(rows))
    worked = lifespan.worked_days(spans, reduced=False)
    full = by_drive(lifespan.duration_and_event(worked, reduced=False))
    assert full[6].failed is False and full[2].failed is True and full[2].duration_worked == 3.0
    assert tuple(lifespan.lost_failures(worked).first()) == (1, 6)
    reduced = by_drive(lifespan.duration_and_event(lifespan.worked_days(spans)))
    assert reduced[6].failed is True and reduced[6].duration_worked == 3.0


def test_anomalies_merge_reasons(spark, rows):
    unknown = spark.createDataFrame([(3,), (9,)], "id int")
    got = by_drive(anomalies.anomaly_report(lifespan.lifespans(rows), facts.failure_records(rows), unknown))
    assert set(got) == {2, 3, 5, 9}
    assert (got[2].overshoot, got[2].failure_days, got[2].unknown) == (None, [3, 7], False)
    assert (got[3].overshoot, got[3].failure_days, got[3].unknown) == (7, None, True)


def test_failure_on_ordinal_zero_counts(spark):
    rows = spark.createDataFrame([(1, 0), (1, 4)], "drive_id int, failure_day int")
    assert anomalies.multiple_failures(rows).first()["failure_days"] == [0, 4]


def test_brand_edges(spark):
    brands = spark.createDataFrame([(3, "c", "^AB"), (1, "u", ""), (2, "b", "^A")], "id int, name string, model_name_regex string")
    models = spark.createDataFrame([("ABC",), ("A",), ("zz",), (None,)], "name string")
    got = {r["name"]: r["brand_id"] for r in dims.classify_models(models, brands).collect()}
    assert got == {"ABC": 2, "A": 2, "zz": None, None: None}


def test_seed_brands_classify_known_names(spark):
    names = ["ST4000DM000", "HGST HMS5C4040ALE640", "Hitachi HDS5C3030ALA630", "WDC WD30EFRX", "TOSHIBA DT01ACA300", "SAMSUNG HD154UI"]
    models = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: r["brand_id"] for r in dims.classify_models(models, dims.seed_brands(spark)).collect()}
    assert [got[n] for n in names] == [2, 6, 7, 4, 5, 3]
    assert dims.brands_with_vendor(dims.seed_brands(spark), dims.seed_vendors(spark)).count() == 7


def test_serial_under_two_models_takes_the_smaller(spark):
    staged = spark.createDataFrame([("s1", "B"), ("s1", "A"), ("s2", "B")], "serial_number string, model string")
    none_m, none_d = spark.createDataFrame([], "id long, name string"), spark.createDataFrame([], "id long, serial_number string")
    models, drives = dims.new_models_and_drives(staged, none_m, none_d)
    name = {r["id"]: r["name"] for r in models.collect()}
    assert {r["serial_number"]: name[r["model_id"]] for r in drives.collect()} == {"s1": "A", "s2": "B"}
    assert [r["serial_number"] for r in dims.model_conflicts(staged).collect()] == ["s1"]


@pytest.mark.parametrize("fraction,kept", [(0.05, 50), (0.5, 500), (1.0, 1000)])
def test_sample_sizes(spark, fraction, kept):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).alias("failed"))
    out = sampling.keep_failures_sample(df, ["id"], fraction)
    failed = out.where("failed").count()
    assert out.count() == kept and failed == min(100, kept)
    assert {r.id for r in out.collect()} == {r.id for r in sampling.keep_failures_sample(df.repartition(5), ["id"], fraction).collect()}


def test_enrichment_priorities(spark):
    models = spark.createDataFrame([("A1",), ("B2",), ("??",)], "name string")
    table = spark.createDataFrame([("B2", 7, "t")], "model string, first_known_date int, code string")
    out = enrich.enrich(models, {
        "rules": enrich.rule_enricher([enrich.Rule("code", "^([A-Z])"), enrich.Rule("rpm", r"(\d+)", 1, "int")]),
        "table": enrich.table_enricher(table)})
    got = {r["name"]: (r.code, r.rpm, r.first_known_date, r.missed) for r in out.collect()}
    assert got == {"A1": ("A", 1, None, 2), "B2": ("t", 2, 7, 0), "??": (None, None, None, 3)}


def test_missing_attributes_are_reported(spark):
    stats = spark.createDataFrame([(1, 2.0)], "model_id int, price double")
    models = spark.createDataFrame([(1, 5.0)], "id int, price double")
    out, missing = enrich.attach_attributes(stats, models, ["price", "rpm"])
    assert missing == ["rpm"] and out.columns == ["model_id", "price", "price_model"]


def test_histogram_levels(spark):
    df = spark.createDataFrame([("v", "m", 3), ("v", "n", 3), (None, "k", 3)], "vendor string, model string, days int")
    got = {(r.level, r.vendor, r.model): r.n for r in strata.lifespan_histogram(df, ["vendor", "model"], "days").collect()}
    assert got[0, None, None] == 3 and got[1, "v", None] == 2 and got[2, "v", "m"] == 1 and got[1, None, None] == 1


def test_hot_device_changes_nothing(spark):
    """One device with a third of all rows, against plain Python."""
    rows = [(7 if i % 3 == 0 else i % 200, (i * 37) % 900, int(i % 211 == 0), i % 5000) for i in range(6000)]
    best = {}
    for device, day, failure, hours in rows:
        f, h = best.get((device, day), (0, 0))
        best[device, day] = (max(f, failure), max(h, hours))
    spans = {}
    for (device, day), (failure, hours) in best.items():
        spans.setdefault(device, {})[day] = (failure, hours)
    want = {}
    for device, days in spans.items():
        failed = [d for d, (f, _) in days.items() if f]
        last = max(failed) if failed else None
        want[device] = (min(days), max(days), last, days[min(days)][1], days[max(days)][1], days[last][1] if failed else None)
    df = spark.createDataFrame(rows, "drive_id int, day int, failure int, power_on_hours_raw long").repartition(13)
    once = facts.one_per_day(df)
    got = {r[0]: tuple(r)[1:] for r in lifespan.lifespans_with_hours(once).select(
        "drive_id", "first_day", "last_day", "failure_day", "first_hours", "last_hours", "failure_hours").collect()}
    assert got == want
    many = {r["drive_id"]: r["failure_days"] for r in anomalies.multiple_failures(facts.failure_records(df)).collect()}
    assert many == {d: sorted(k for k, (f, _) in days.items() if f) for d, days in spans.items()
                    if sum(f for f, _ in days.values()) > 1}
