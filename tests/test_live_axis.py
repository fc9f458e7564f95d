import random

import pytest
from pyspark.sql import functions as F

from fleetlife.operators import lifespan
from fleetlife.plans import km, live_axis
from fleetlife.sources import buckets

SCHEMA = "drive_id long, first_day int, last_day int, failure_day int, brand string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def new_store(spark, root, rows=()):
    live_axis.create_live_axis(spark, root, frame(spark, []).schema, "drive_id", ["brand"], 8)
    if rows:
        live_axis.load_lifespans(spark, root, frame(spark, rows), ["brand"])


def axis(df):
    return sorted(((r.brand, r.duration, r.n, r.d) for r in df.collect()), key=str)


def stored(spark, root):
    return axis(live_axis.read_axis(spark, root))


def recomputed(spark, root):
    return axis(live_axis.axis_of(live_axis.read_spans(spark, root), ["brand"]))


def test_loads_by_day_equal_one_load(spark, tmp_path):
    rng = random.Random(3)
    facts = spark.createDataFrame(
        [(rng.randrange(60) if rng.random() > 0.02 else None, rng.randrange(100), int(rng.random() < 0.02)) for _ in range(2000)],
        "drive_id long, day int, failure int")
    brand = F.when(F.col("drive_id") % 4 > 0, F.concat(F.lit("b"), (F.col("drive_id") % 4).cast("string")))
    root = str(tmp_path / "live")
    new_store(spark, root)
    for part in ("day < 30", "day between 30 and 69", "day > 69", "day between 20 and 50"):  # the last one repeats records
        live_axis.load_lifespans(spark, root, lifespan.lifespans(facts.where(part)).withColumn("brand", brand), ["brand"])
    whole = lifespan.lifespans(facts).withColumn("brand", brand)
    assert stored(spark, root) == axis(live_axis.axis_of(whole, ["brand"]))
    curve = sorted(map(str, live_axis.live_curve(spark, root, ["brand"]).collect()))
    assert curve == sorted(map(str, km.survival_curve(live_axis.reduced_subjects(whole), ["brand"]).collect()))


def test_a_device_leaves_its_old_point_and_stratum(spark, tmp_path):
    root = str(tmp_path / "live")
    new_store(spark, root, [(1, 0, 10, None, "a"), (2, 0, 10, None, "a"), (None, 5, 6, None, None)])
    assert stored(spark, root) == sorted([("a", 10.0, 2, 0), (None, 1.0, 1, 0)], key=str)
    live_axis.load_lifespans(spark, root, frame(spark, [(1, 11, 20, 20, "b"), (None, 7, 8, None, None)]), ["brand"])
    assert stored(spark, root) == sorted([("a", 10.0, 1, 0), ("b", 20.0, 1, 1), (None, 3.0, 1, 0)], key=str)
    assert stored(spark, root) == recomputed(spark, root)


def test_repeated_and_empty_loads_change_nothing(spark, tmp_path):
    root, rows = str(tmp_path / "live"), [(k, k, k + 9, None, "a") for k in range(30)]
    new_store(spark, root, rows)
    generation = buckets.latest(spark, f"{root}/spans").generation
    assert live_axis.load_lifespans(spark, root, frame(spark, rows), ["brand"]) == []
    assert live_axis.load_lifespans(spark, root, frame(spark, []), ["brand"]) == []
    assert buckets.latest(spark, f"{root}/spans").generation == generation
    assert stored(spark, root) == [("a", 9.0, 30, 0)]


def test_only_touched_buckets_are_read(spark, tmp_path):
    root = str(tmp_path / "live")
    new_store(spark, root, [(k, 0, 9, None, "a") for k in range(200)])
    fresh = frame(spark, [(7, 10, 12, 12, "a")])
    now = buckets.latest(spark, f"{root}/spans")
    touched = buckets.touched_buckets(fresh, now)
    changed = live_axis.changes(buckets.read_buckets(spark, f"{root}/spans", touched), fresh, "drive_id", ["brand"])
    assert {f.rsplit("=", 1)[1].split("/")[0] for f in changed.inputFiles() if "bucket=" in f} == {str(touched[0])}
    assert live_axis.load_lifespans(spark, root, fresh, ["brand"]) == touched
    assert stored(spark, root) == [("a", 12.0, 1, 1), ("a", 9.0, 199, 0)]
    # A curve needs the axis alone.
    assert all("/axis/" in f for f in live_axis.live_curve(spark, root, ["brand"]).inputFiles())


def test_a_broken_load_is_repeated(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "live")
    new_store(spark, root, [(1, 0, 10, None, "a")])
    fresh = frame(spark, [(1, 0, 30, 30, "a")])

    def lost(*args, **kwargs):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(buckets, "upsert_buckets", lost)
        with pytest.raises(OSError):
            live_axis.load_lifespans(spark, root, fresh, ["brand"])
    assert stored(spark, root) == [("a", 10.0, 1, 0)]  # the axis without a manifest does not count
    live_axis.load_lifespans(spark, root, fresh, ["brand"])
    assert stored(spark, root) == [("a", 30.0, 1, 1)] == recomputed(spark, root)
    live_axis.drop_superseded(spark, root, keep=1)
    assert stored(spark, root) == [("a", 30.0, 1, 1)]


def test_subjects_may_be_left_out(spark, tmp_path):
    root = str(tmp_path / "live")
    new_store(spark, root)

    def sound(spans):
        return live_axis.reduced_subjects(spans.where("failure_day is null or last_day <= failure_day"))

    for rows in ([(1, 0, 10, 10, "a"), (2, 0, 4, None, "a")], [(1, 11, 12, None, "a")]):  # device 1 is used after its failure
        live_axis.load_lifespans(spark, root, frame(spark, rows), ["brand"], sound)
    assert stored(spark, root) == [("a", 4.0, 1, 0)]
