import os

import pytest
from pyspark.sql import functions as F

from fleetlife.functions import stage_store


class Stage:
    """A stage that counts how often it is computed."""

    def __init__(self, root, *paths, label="sums"):
        self.root, self.paths, self.label, self.runs = root, {f"in{i}": str(p) for i, p in enumerate(paths)}, label, 0

    def __call__(self, spark, params=None):
        def make():
            self.runs += 1
            first, second = (spark.read.schema("id long").parquet(self.paths[f"in{min(i, len(self.paths) - 1)}"]) for i in (0, 1))
            return first.agg(F.sum("id").alias("total")).withColumn("top", second.agg(F.max("id")).scalar())

        return stage_store.stored_stage(spark, self.root, self.label, self.paths, make, params).collect()


@pytest.fixture
def made(spark, tmp_path):
    for name, n in (("a", 10), ("b", 20)):
        spark.range(n).write.parquet(str(tmp_path / name))
    return tmp_path


def folders(root, label="sums"):
    return len(os.listdir(f"{root}/data/{label}"))


def test_a_second_session_computes_nothing(spark, made):
    stage = Stage(str(made / "store"), made / "a")
    assert stage(spark) == [(45, 9)] == stage(spark) == stage(spark.newSession())
    assert stage.runs == 1


def test_changed_files_parameters_and_roles_miss(spark, made):
    root = str(made / "store")
    stage = Stage(root, made / "a", made / "b")
    assert stage(spark) == [(45, 19)] == stage(spark, {"version": 2})
    assert stage.runs == 2
    swapped = Stage(root, made / "b", made / "a")  # the same files in other roles
    assert swapped(spark) == [(190, 9)]
    spark.range(100, 101).write.mode("append").parquet(str(made / "a"))
    assert stage(spark) == [(145, 19)] == stage(spark)
    assert stage.runs == 3 and folders(root) == 4
    assert stage_store.drop_stages(spark, root, "sums", keep=1) == 3
    assert folders(root) == 1
    assert stage(spark) == [(145, 19)] and stage.runs == 3  # the newest is left
    assert stage_store.drop_stages(spark, root, "sums", keep=0) == 1
    assert folders(root) == 0


def test_broken_runs_leave_nothing_that_counts(spark, made):
    root = str(made / "store")
    stage = Stage(root, made / "a")
    assert stage_store.drop_unreferenced(spark, root, hours=0) == 0
    stage(spark)
    spark.range(5).write.parquet(f"{root}/data/sums/{'0' * 32}")  # data without a manifest
    assert stage_store.drop_unreferenced(spark, root) == 0  # may still be written to
    assert stage_store.drop_unreferenced(spark, root, hours=0) == 1
    assert folders(root) == 1 and stage(spark) == [(45, 9)] and stage.runs == 1
    (row,) = stage_store._manifests(spark, f"{root}/manifests")
    stage_store.delete_folder(spark, f"{root}/{row.folder}")  # data that somebody removed are made again
    assert stage(spark) == [(45, 9)] and stage.runs == 2


def test_empty_results_and_inputs(spark, made):
    root = str(made / "store")
    (made / "none").mkdir()

    def none():
        return spark.range(0)

    for _ in range(2):
        got = stage_store.stored_stage(spark, root, "none", {"in": str(made / "none")}, none)
        assert got.collect() == [] and got.columns == ["id"]
    with pytest.raises(ValueError, match="label"):
        stage_store.stored_stage(spark, root, "a/b", {}, none)
