"""Result tables: full scans, replace-by-key upserts, exports, introspection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema_tools import text_safe


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def upsert(old: DataFrame, updates: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``old`` replaced by key with those of ``updates``; the latest update by ``order`` wins.

    Both sides meet once, on the key. Repeated updates of a key are settled by ``max_by`` before that, on the map side.
    """
    if order is not None:
        values = [c for c in updates.columns if c not in (key, order)]
        updates = updates.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in values])
    return old.join(updates.select(key), key, "left_anti").select(*old.columns).unionByName(
        updates.select(*old.columns))


def replace_table(df: DataFrame, root: str, name: str, version: int) -> str:
    """Write a new snapshot beside the old one (which may be an input of ``df``) and return its name."""
    df.write.mode("overwrite").parquet(f"{root}/{name}_v{version}")
    return f"{name}_v{version}"


def with_json_info(df: DataFrame, key: str, info: Column, name: str = "info") -> DataFrame:
    """(key, JSON text) rows, the storage form of anomaly reports."""
    return df.select(key, F.to_json(info).alias(name))


def export_tables(tables: Mapping[str, DataFrame], root: str, what: Sequence[str] | None = None) -> list[str]:
    """Write the chosen tables as Parquet, one folder per table; every table is written by all executors."""
    chosen = list(what or tables)
    for name in chosen:
        tables[name].write.mode("overwrite").parquet(f"{root}/{name}")
    return chosen


def as_document_lines(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Tables as JSON lines ``(table, document)``: one line per record, so no table has to fit in one row."""
    lines = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("document"))
        lines = part if lines is None else lines.unionByName(part)
    return lines


def export_documents(tables: Mapping[str, DataFrame], root: str) -> None:
    as_document_lines(tables).write.mode("overwrite").partitionBy("table").text(root)


def write_predictions(df: DataFrame, path: str, format: str) -> None:
    """``json`` (nulls kept), ``csv`` or ``tsv`` with a header."""
    if format == "json":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif format in ("csv", "tsv"):
        sep = "," if format == "csv" else "\t"
        text_safe(df).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    else:
        raise ValueError(f"unknown format {format!r}: use json, csv or tsv")


def table_names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def column_names(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table)]


def is_reduced(spark: SparkSession, facts: str = "drive_stats") -> bool:
    """True when the fact table is absent, so that only precomputed lifespans can be used."""
    return not spark.catalog.tableExists(facts)
