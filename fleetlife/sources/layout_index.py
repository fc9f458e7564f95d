"""Header lines of text files, read by ranges of bytes and kept with each file's size and time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_READ = 8 << 10  # bytes of the first read of a file; each further one reads as much again as all before
FILES_PER_TASK = 1_000
INDEX = "file string, length long, modified timestamp, head string, read_bytes long"
SCHEMES = {"": "file", "file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


def list_files(spark: SparkSession, paths: list[str], wanted: Column) -> DataFrame:
    """(file, length, modified) of the ``.csv`` files below the paths, without opening any."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(paths)
    return files.select(F.col("_metadata.file_path").alias("file"), "length", F.col("modificationTime").alias("modified")).where(wanted)


def _opener() -> Callable[[str], BinaryIO]:
    """Opens files by their URI; the connection to a remote store is made once per task."""
    from pyarrow import fs

    stores: dict[tuple[str, str], fs.FileSystem] = {}

    def open_file(uri: str) -> BinaryIO:
        parts = urlsplit(uri)
        kind = SCHEMES[parts.scheme]
        if kind == "file":
            return open(unquote(parts.path), "rb")
        if (kind, parts.netloc) not in stores:
            stores[kind, parts.netloc] = fs.FileSystem.from_uri(f"{kind}://{parts.netloc}/")[0]
        path = unquote(parts.path)
        return stores[kind, parts.netloc].open_input_file(parts.netloc + path if kind in ("s3", "gs") else path)

    return open_file


def first_line(file: BinaryIO, first_read: int = FIRST_READ) -> tuple[bytes, int]:
    """The first line that is not blank, without its end (empty if there is none), and how many bytes were read for it."""
    got = file.read(first_read)
    while b"\n" not in got.lstrip():
        more = file.read(len(got))
        if not more:
            break
        got += more
    return got.lstrip().split(b"\n", 1)[0].removesuffix(b"\r"), len(got)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_file = _opener()
    for batch in batches:
        lines, read = [], []
        for uri in batch.column("file").to_pylist():
            with open_file(uri) as file:
                line, count = first_line(file)
            lines.append(line.decode("utf-8", "replace"))
            read.append(count)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.string()), pa.array(read, pa.int64())],
                                         [*batch.schema.names, "head", "read_bytes"])


def _scanned(spark: SparkSession, paths: list[str], wanted: Column) -> DataFrame:
    """Header lines by a text scan, for stores that only the JVM can open: it goes over all bytes."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    # The first line of a file is a row of its first block, and rows of a block come in order.
    return lines.where(wanted & (F.col("block") == 0) & (F.trim("value") != "")).groupBy("file").agg(F.first("value").alias("head"))


def _known(spark: SparkSession, index: str) -> DataFrame:
    try:
        return spark.read.schema(INDEX).parquet(index)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INDEX)


def read_heads(spark: SparkSession, paths: list[str], wanted: Column, index: str | None = None) -> DataFrame:
    """(file, head) of the files that ``wanted`` (a condition on the column ``file``) lets pass, without empty ones. The
    head is the first line that is not blank.

    Files are listed by their metadata, and a task reads the first bytes of each of its files. With ``index``, a shared
    folder, lines are looked up there by file, size and time; only files that are new or changed are opened, and their lines
    are appended. Two loads that index the same file at once store the same line twice, which does no harm.
    """
    files = list_files(spark, paths, wanted)
    schemes = {urlsplit(p).scheme for p in files.inputFiles()[:1]}
    if not schemes <= set(SCHEMES):
        return _scanned(spark, paths, wanted)
    same = ["file", "length", "modified"]
    new = files if index is None else files.join(_known(spark, index), same, "left_anti")
    if index is None:
        tasks = max(1, -(-len(files.inputFiles()) // FILES_PER_TASK), spark.sparkContext.defaultParallelism)
        return new.repartition(tasks).mapInArrow(_heads, INDEX).select("file", "head")
    new.repartition(spark.sparkContext.defaultParallelism, "file").mapInArrow(_heads, INDEX).write.mode("append").parquet(index)
    return files.join(_known(spark, index).dropDuplicates(same), same).select("file", "head")
