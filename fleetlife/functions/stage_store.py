"""Expensive stages kept between runs, under a key of their inputs' files and their parameters."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging_area import delete_folder

MANIFEST = "label string, key string, folder string, schema string, created timestamp"


def _files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, length, modified) of all files below the paths, without opening any."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([paths] if isinstance(paths, str) else list(paths))
    return files.select(F.col("_metadata.file_path").alias("file"), "length", F.col("modificationTime").alias("modified"))


def files_digest(spark: SparkSession, paths: str | Sequence[str]) -> tuple[int, int, int, int]:
    """Number and bytes of the files below the paths, and two sums of hashes of each one's name, size and time: four numbers
    reach the driver, whatever the number of files."""
    parts = ("file", "length", "modified")
    sums = [F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)")) for seed in (1, 2)]
    row = _files(spark, paths).agg(F.count("*"), F.sum("length"), *sums).first()
    return tuple(int(x or 0) for x in row)


def stage_key(spark: SparkSession, label: str, inputs: Mapping[str, str | Sequence[str]], params: Any = None) -> str:
    """Depends on each input's files (under the name it plays in the stage) and on the parameters; the same in any session."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", label):
        raise ValueError(f"label {label!r}: use letters, digits, _ and -")
    state = [label, {name: files_digest(spark, paths) for name, paths in inputs.items()}, params]
    return hashlib.sha256(json.dumps(state, sort_keys=True).encode()).hexdigest()


def _manifests(spark: SparkSession, folder: str) -> list[Row]:
    """The newest first; one row per stored stage."""
    try:
        rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(folder).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(rows, key=lambda r: (r.created, r.folder), reverse=True)


def _read(spark: SparkSession, root: str, row: Row) -> DataFrame | None:
    """None where somebody removed the data."""
    try:
        return spark.read.schema(T.StructType.fromJson(json.loads(row.schema))).parquet(f"{root}/{row.folder}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stored_stage(
    spark: SparkSession, root: str, label: str, inputs: Mapping[str, str | Sequence[str]], make: Callable[[], DataFrame],
    params: Any = None,
) -> DataFrame:
    """What ``make`` returns, computed only where no run has stored it yet for the same files and parameters.

    ``inputs`` names every path that ``make`` reads, and ``params`` (anything JSON can hold) whatever else its result depends
    on, a version of its code included. ``root`` is a folder that all executors share. Data go to a folder of their own and
    count once a manifest names them, so a run that breaks off leaves nothing that is read; ``drop_unreferenced`` clears it
    away. Two runs that compute the same stage at once both store it, and either copy serves.
    """
    key = stage_key(spark, label, inputs, params)
    where = f"{root}/manifests/{label}/{key}"
    for row in _manifests(spark, where):
        stored = _read(spark, root, row)
        if stored is not None:
            return stored
    df, folder = make(), f"data/{label}/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{root}/{folder}")
    line = spark.createDataFrame([(label, key, folder, df.schema.json())], "label string, key string, folder string, schema string")
    line.withColumn("created", F.current_timestamp()).coalesce(1).write.mode("append").json(where)
    return spark.read.schema(df.schema).parquet(f"{root}/{folder}")


def drop_stages(spark: SparkSession, root: str, label: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` results of a stage; returns how many went. Nothing may be reading those."""
    gone = _manifests(spark, f"{root}/manifests/{label}")
    kept = {r.key for r in gone[:keep]}
    gone = [r for r in gone[keep:]]
    for r in gone:
        if r.key not in kept:
            delete_folder(spark, f"{root}/manifests/{label}/{r.key}")
        delete_folder(spark, f"{root}/{r.folder}")
    return len(gone)


def drop_unreferenced(spark: SparkSession, root: str, hours: float = 24) -> int:
    """Delete data that no manifest names and that nobody has written to for some hours (a run may be at it still)."""
    named = {r.folder for r in _manifests(spark, f"{root}/manifests")}
    folder = F.regexp_extract("file", "/(data/[^/]+/[0-9a-f]{32})/", 1)
    try:
        files = _files(spark, f"{root}/data")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    idle = F.max("modified") < F.current_timestamp() - F.make_dt_interval(mins=F.lit(float(hours) * 60).cast("int"))
    folders = files.groupBy(folder.alias("folder")).agg(idle.alias("idle")).where("idle").collect()
    gone = [r.folder for r in folders if r.folder and r.folder not in named]
    for f in gone:
        delete_folder(spark, f"{root}/{f}")
    return len(gone)
