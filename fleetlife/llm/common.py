"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20  # texts that a task holds as Python objects at once


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it. On a cluster that has no such path, ship it
    with ``--py-files`` or install it as usual; the entry then does no harm."""
    bound_batches(spark)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


BATCH_ROWS, BATCH_BYTES = "1000", "8m"


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than the default of 10,000 rows, where the session has not chosen its own: texts may be long,
    and a batch is held by the JVM and by the Python worker at once."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[str | None]]:
    """The texts in order, in lists of at most ``limit`` bytes (or one text)."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_pylist()
    start, base = 0, 0
    for i, end in enumerate(ends):
        if end - base > limit and i > start:
            yield texts.slice(start, i - start).to_pylist()
            start, base = i, ends[i - 1]
    if start < len(texts):
        yield texts.slice(start).to_pylist()


def on_texts(
    make: Callable[[], Callable[[list[str | None]], dict[str, list]]], schema: pa.Schema, limit: int = SLICE_BYTES,
):
    """An Arrow UDF from a text column to a struct. ``make`` runs once per task and returns the function on lists, which
    hold ``limit`` bytes of text at most (or one text)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            parts = [pa.RecordBatch.from_pydict(work(part), schema=schema).to_struct_array() for part in slices(batch, limit)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(schema)))

    share_code(SparkSession.active())
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.float64(): "double", pa.string(): "string",
             pa.bool_(): "boolean", pa.binary(): "binary"}
    return F.arrow_udf(run, ", ".join(f"`{f.name}` {names[f.type]}" for f in schema))


def fold_of(doc: str | Column, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32((F.col(doc) if isinstance(doc, str) else doc).cast("string")), F.lit(folds))


def bounded_sample(rows: DataFrame, keys: list[str], bound: int, seed: int = 0) -> DataFrame:
    """About ``bound`` rows (all, if fewer), chosen by a seeded hash of ``keys``; costs one count."""
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
