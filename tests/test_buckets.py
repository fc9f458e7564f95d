import pytest
from pyspark.sql import functions as F

from fleetlife.sources import buckets

SCHEMA = "id long, bucket string, day int"


def rows(df):
    return sorted(((r.id, r.bucket, r.day) for r in df.collect()), key=str)


def files(spark, root):
    found = {}
    for f in buckets.read_buckets(spark, root).inputFiles():
        found.setdefault(int(f.rsplit("=", 1)[1].split("/")[0]), set()).add(f)
    return found


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    root = str(tmp_path / "t")
    start = [(k, f"a{k}", 1) for k in range(200)] + [(None, "none", 1)]
    buckets.create_buckets(spark.createDataFrame(start, SCHEMA), root, "id", 8)
    assert rows(buckets.read_buckets(spark, root)) == sorted(start, key=str)
    before, reader = files(spark, root), buckets.read_buckets(spark, root)
    # An int key has to meet the long one; the later of two updates wins; a null key is replaced; a new key is added.
    updates = spark.createDataFrame([(7, "x", 2), (7, "y", 3), (None, "new", 2), (1000, "z", 2)], "id int, bucket string, day int")
    touched = buckets.upsert_buckets(spark, root, updates, order="day")
    want = [r for r in start if r[0] not in (7, None)] + [(7, "y", 3), (None, "new", 2), (1000, "z", 2)]
    assert rows(buckets.read_buckets(spark, root)) == sorted(want, key=str)
    after = files(spark, root)
    assert 1 <= len(touched) <= 3
    assert {b for b in after if after[b] != before.get(b)} == set(touched)
    assert rows(reader) == sorted(start, key=str)  # readers of the old generation go on

    assert buckets.upsert_buckets(spark, root, updates.where("id < 0")) == []
    buckets.upsert_buckets(spark, root, spark.createDataFrame([(7, "w", 9)], SCHEMA))
    assert buckets.drop_superseded(spark, root, keep=1) >= 1
    assert sorted(buckets.snapshots(spark, root)) == [2]
    want = [r for r in want if r[0] != 7] + [(7, "w", 9)]
    assert rows(buckets.read_buckets(spark, root)) == sorted(want, key=str)


def test_empty_and_missing_tables(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no table"):
        buckets.read_buckets(spark, root)
    empty = spark.createDataFrame([], SCHEMA)
    buckets.create_buckets(empty, root, "id", 4)
    assert buckets.read_buckets(spark, root).count() == 0
    with pytest.raises(ValueError, match="there is a table"):
        buckets.create_buckets(empty, root, "id", 4)
    buckets.upsert_buckets(spark, root, spark.range(5).select("id", F.lit("b").alias("bucket"), F.lit(1).alias("day")))
    assert buckets.read_buckets(spark, root).count() == 5


def test_a_taken_generation_fails_and_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    buckets.create_buckets(spark.createDataFrame([(1, "a", 1)], SCHEMA), root, "id", 4)
    now = buckets.latest(spark, root)
    buckets.upsert_buckets(spark, root, spark.createDataFrame([(1, "b", 2)], SCHEMA))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        buckets._write(spark.createDataFrame([(1, "c", 3)], now.schema), root, now, [0])
    assert rows(buckets.read_buckets(spark, root)) == [(1, "b", 2)]
