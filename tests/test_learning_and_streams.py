import datetime

import pytest
from pyspark.sql import functions as F

from fleetlife.operators import lifespan
from fleetlife.plans import impute, roles, score
from fleetlife.streaming import lifespan_stream as stream


def test_imputers_fill_only_gaps(spark, tmp_path):
    df = spark.range(400).select(
        "id", (F.col("id") % 5).cast("double").alias("size"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    df = df.withColumn("price", F.when(F.col("id") % 7 != 0, F.col("size") * 10 + F.when(F.col("kind") == "even", 100).otherwise(0)))
    df = df.withColumn("group", F.when(F.col("id") % 9 != 0, F.when(F.col("size") > 2, "big").otherwise("small")))
    spec = {"id": "stop", "size": "numerical", "kind": "categorical", "price": "numerical", "group": "categorical"}
    imputers = impute.train_imputers(df, spec, ["price", "group"], max_iter=10, trees=5)
    imputers.save(spark, str(tmp_path / "i"))
    imputers = impute.Imputers.load(spark, str(tmp_path / "i"))
    out = imputers.apply(df)
    assert out.columns == df.columns and out.schema["price"].dataType == df.schema["price"].dataType
    for r in out.collect():
        want = r["size"] * 10 + (100 if r.kind == "even" else 0)
        assert r.price == want if r.id % 7 else r.price == pytest.approx(want, abs=6)
        assert r.group == ("big" if r["size"] > 2 else "small")
    scores = impute.score_imputers(df, spec, ["price", "group"], ["id"], max_iter=10, trees=5)
    assert scores["price"] > 0.9 and scores["group"] == 1.0


def test_roles(spark):
    df = spark.createDataFrame([("x", 1.0, True, 3), (None, 2.0, False, 4)], "kind string, size double, flag boolean, id int")
    spec = {"kind": "categorical", "size": "numerical", "flag": "binary", "id": "stop"}
    out = roles.feature_pipeline(df, spec).fit(df).transform(df).collect()
    assert [len(r.features) for r in out] == [out[0].features.size] * 2
    with pytest.raises(ValueError, match="extra"):
        roles.feature_pipeline(df.withColumn("extra", F.lit(1)), spec)
    at_fit = roles.with_survival_roles(roles.ATTRIBUTE_ROLES, "duration_worked", "failed", "w")
    assert at_fit["duration_worked_prep"] == "survival" and at_fit["w"] == "weight" and at_fit["failed"] == "stop"


def test_numeric_features_mark_gaps(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    out, names = roles.numeric_features(df, ["x"])
    assert [tuple(r[n] for n in names) for r in out.collect()] == [(1.0, 0.0), (2.0, 1.0), (3.0, 0.0)]


def test_descriptors(spark):
    rows = spark.createDataFrame([('[{"name":"A","rpm":5},"B"]',), ('{"name":"C"}',), ("ST 4000",)], "t string")
    got = [(r["name"], r.rpm) for r in score.parse_descriptors(rows, "t", {"name": "string", "rpm": "int"}).collect()]
    assert got == [("A", 5), ("B", None), ("C", None), ("ST 4000", None)]


def test_scoring_sorts_and_explains(spark):
    requests = spark.createDataFrame([("a", 1.0), ("b", 400.0)], "name string, x double")

    def predict(rows):
        return rows.withColumns({"predicted_survival": F.col("x"), "phi_x": F.col("x")})

    out = score.score_models(requests, {}, predict, ["x"], datetime.date(2020, 1, 1))
    rows = out.collect()
    assert out.columns[:3] == ["name", "predicted_survival", "fancy_time"]
    assert [r["name"] for r in rows] == ["b", "a"] and rows[1].fancy_time == "1 d" and rows[0].explanation["x"] == 1.0


SCHEMA = "drive_id int, day int, failure int"


def test_streamed_lifespans_follow_late_and_repeated_files(spark, tmp_path):
    source, table, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    drops = [[(1, 5, 0), (2, 6, 1)], [(1, 2, 0), (1, 9, 1)], [(2, 6, 1), (3, 1, 0)]]  # the second holds a late day
    everything = []
    for rows in drops:
        everything += rows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        facts = stream.telemetry_stream(spark, source, spark.createDataFrame([], SCHEMA).schema)
        stream.keep_lifespans(facts, table, check).awaitTermination()
        got = stream.current_lifespans(spark, table)
        want = lifespan.lifespans(spark.createDataFrame(everything, SCHEMA))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    before = len(got.inputFiles())
    stream.compact_changes(spark, table)
    got = stream.current_lifespans(spark, table)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and len(got.inputFiles()) < before
    # A job whose checkpoint is lost starts anew and overwrites nothing of the earlier one.
    stream.keep_lifespans(facts.where("drive_id = 3"), table, str(tmp_path / "other")).awaitTermination()
    assert sorted(map(tuple, stream.current_lifespans(spark, table).collect())) == sorted(map(tuple, want.collect()))


def test_daily_failures_drop_rows_behind_the_watermark(spark, tmp_path):
    source, table, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    ts = lambda day: datetime.datetime(2024, 1, day, 12)
    for rows in ([(ts(1), 1), (ts(1), 0), (ts(2), 1)], [(ts(5), 1)], [(ts(1), 1), (ts(9), 0)]):
        spark.createDataFrame(rows, "ts timestamp, failure int").coalesce(1).write.mode("append").parquet(source)
        events = stream.telemetry_stream(spark, source, spark.createDataFrame([], "ts timestamp, failure int").schema)
        stream.write_daily_failures(stream.daily_failures(events), table, check).awaitTermination()
    first = (datetime.date(2024, 1, 1) - datetime.date(1970, 1, 1)).days
    got = sorted((r.day - first + 1, r.failures, r.records) for r in spark.read.parquet(table).collect())
    assert got == [(1, 1, 2), (2, 1, 1), (5, 1, 1)]


def test_gaps_that_stay_are_counted_and_left_out(spark):
    nan = float("nan")
    rows = [(i, float(i % 4) if i % 3 else nan, "x" if i % 2 else None, None, i % 4) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b string, c double, d int")
    spec = {"a": "numerical", "b": "categorical", "c": "numerical", "d": "numerical"}
    imputers = impute.train_imputers(df, spec, ["a", "b", "c"], max_iter=3, trees=3)
    assert set(imputers.pipelines) == {"a", "b"}
    out = imputers.apply(df)
    assert [(r.attribute, r.known, r.left) for r in impute.leftovers(df, ["a", "b", "c"]).collect()] == [("a", 40, 20), ("b", 30, 30), ("c", 0, 60)]
    assert [(r.attribute, r.left) for r in impute.leftovers(out, ["a", "b", "c"]).collect()] == [("a", 0), ("b", 0), ("c", 60)]
    assert all(r.a == pytest.approx(r.d) for r in out.collect())  # a follows from d
    first = df.orderBy("id").select(impute.known_attributes(df, ["a", "b", "c"]).alias("j")).head(2)
    assert [r.j for r in first] == ["{}", '{"a":1.0,"b":"x"}']
    empty = impute.train_imputers(df.where("id < 0"), spec, ["a", "b", "c"])
    assert empty.pipelines == {} and empty.apply(df).count() == 60
