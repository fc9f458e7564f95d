"""A table kept in hash buckets: an update writes new files for the buckets it touches, and a manifest says which count."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging_area import delete_folder, forget, stage

MANIFEST = "generation int, bucket int, folder string, buckets int, key string, schema string"


@dataclass(frozen=True)
class Snapshot:
    generation: int
    key: str
    buckets: int
    schema: T.StructType
    folders: dict[int, str]  # of the buckets that hold rows, relative to the table's root

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")


def snapshots(spark: SparkSession, root: str) -> dict[int, Snapshot]:
    """All generations that the manifests still list; none where the table does not exist."""
    try:
        rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{root}/manifests").collect()  # one row per bucket
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r.generation: Snapshot(
        r.generation, r.key, r.buckets, T.StructType.fromJson(json.loads(r.schema)),
        {b.bucket: b.folder for b in rows if b.generation == r.generation and b.bucket is not None})
        for r in rows if r.bucket is None}


def latest(spark: SparkSession, root: str) -> Snapshot:
    found = snapshots(spark, root)
    if not found:
        raise ValueError(f"no table at {root}")
    return found[max(found)]


def _read(spark: SparkSession, root: str, snapshot: Snapshot, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], snapshot.schema)
    return spark.read.schema(snapshot.schema).parquet(*[f"{root}/{f}" for f in folders])


def read_buckets(spark: SparkSession, root: str, only: Iterable[int] | None = None) -> DataFrame:
    """The newest generation, or the buckets ``only`` of it. A frame keeps reading its own generation while newer ones are
    written."""
    now = latest(spark, root)
    wanted = now.folders if only is None else set(only) & set(now.folders)
    return _read(spark, root, now, [now.folders[b] for b in sorted(wanted)])


def touched_buckets(rows: DataFrame, snapshot: Snapshot) -> list[int]:
    """Numbers of the buckets that rows fall into: at most ``snapshot.buckets``."""
    return sorted(r[0] for r in rows.select(snapshot.bucket()).distinct().collect())


def _write(rows: DataFrame, root: str, base: Snapshot, touched: list[int]) -> None:
    """Store the rows of the touched buckets (none of which is empty) as new folders and then, in one file, the manifest that puts them in place of the old ones."""
    spark, name = rows.sparkSession, "bucket"
    while name in rows.columns:
        name += "_"
    data = f"data/{uuid.uuid4().hex}"
    rows.withColumn(name, base.bucket()).repartition(name).write.partitionBy(name).parquet(f"{root}/{data}")
    folders = base.folders | {b: f"{data}/{name}={b}" for b in touched}
    generation = base.generation + 1
    lines = [(generation, None, None, base.buckets, base.key, base.schema.json())] + [
        (generation, b, f, None, None, None) for b, f in sorted(folders.items())]
    spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{root}/manifests/{generation}")


def create_buckets(df: DataFrame, root: str, key: str, buckets: int = 64) -> None:
    """Store a table whose keys are unique; ``buckets`` should make a bucket a few hundred megabytes."""
    if snapshots(df.sparkSession, root):
        raise ValueError(f"there is a table at {root}")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
    stored, empty = stage(df, "buckets"), Snapshot(-1, key, buckets, schema, {})
    _write(stored, root, empty, touched_buckets(stored, empty))
    forget(stored)


def upsert_buckets(spark: SparkSession, root: str, updates: DataFrame, order: str | None = None) -> list[int]:
    """Replace rows by key and return the buckets that were written; the files of all others stay as they are.

    The latest update by ``order`` wins; without it keys of the updates have to be unique. A null key is a key like any
    other. Only touched buckets are read. Old files stay for readers of earlier generations until ``drop_superseded``. A
    table has one writer at a time: a second one finds its generation taken and fails, and nothing of it counts.
    """
    now = latest(spark, root)
    if order is not None:
        values = [c for c in now.schema.names if c not in (now.key, order)]
        kept = [F.max_by(c, F.col(order)).alias(c) for c in values]
        if order in now.schema.names and order != now.key:
            kept.append(F.max(order).alias(order))
        updates = updates.groupBy(now.key).agg(*kept)
    fresh = stage(updates.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in now.schema]), "updates")
    touched = touched_buckets(fresh, now)
    if touched:
        old = _read(spark, root, now, [now.folders[b] for b in touched if b in now.folders])
        keys = fresh.select(F.col(f"`{now.key}`").alias("_fresh"))
        rest = old.join(keys, old[now.key].eqNullSafe(keys["_fresh"]), "left_anti")
        _write(rest.unionByName(fresh), root, now, touched)
    forget(fresh)
    return touched


def drop_superseded(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete what only generations before the last ``keep`` use; returns the number of bucket folders that went."""
    found = snapshots(spark, root)
    last = sorted(found)[-max(1, keep):]
    used = {f for g in last for f in found[g].folders.values()}
    gone = {f for g in found for f in found[g].folders.values()} - used
    for g in sorted(set(found) - set(last)):
        delete_folder(spark, f"{root}/manifests/{g}")
    for f in gone:
        delete_folder(spark, f"{root}/{f}")
    return len(gone)
