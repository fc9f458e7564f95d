"""Daily telemetry files into a staging DataFrame."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .layout_index import read_heads
from .smart_schema import staging_schema


def is_data_file(path: Column) -> Column:
    """``.csv`` files outside archive side folders."""
    return F.lower(path).endswith(".csv") & ~F.upper(path).contains("MACOSX")


def read_daily_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, index: str | None = None,
) -> DataFrame:
    """All data files below ``path`` in a given schema, whatever columns each file has and in whatever order.

    The header lines are read first, by their first bytes only (``layout_index``; ``index`` is a folder that keeps them for
    the next load; one line reaches the driver per distinct layout). Files of the same layout are then read in one pass by
    their own column names. Columns a file lacks are null, columns the schema lacks are left out. No inference; large files
    are split.
    """
    schema = schema or staging_schema()
    paths = [path] if isinstance(path, str) else list(path)
    heads = read_heads(spark, paths, is_data_file(F.col("file")), index).where(F.col("head") != "")
    layouts = heads.groupBy("head").agg(F.collect_list("file").alias("files")).collect()
    out = spark.createDataFrame([], schema)
    for layout in sorted(layouts, key=lambda r: r.head):
        names = [n.strip().strip('"') for n in layout.head.lstrip("\ufeff").split(",")]
        types = {f.name: f.dataType for f in schema.fields}
        own = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
        read = spark.read.schema(own).option("header", True).option("enforceSchema", True).csv([unquote(f) for f in layout.files])
        read = drop_repeated_headers(read, "model" if "model" in names else names[0])
        out = out.unionByName(align_schema(read.select(*[n for n in names if n in types]), schema))
    return out


def drop_repeated_headers(df: DataFrame, column: str = "model") -> DataFrame:
    """Concatenated files carry their header rows along; those repeat the column's own name."""
    return df.where(~F.col(column).eqNullSafe(column))


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add missing columns as nulls, in the schema's order and types; columns the schema lacks are an error."""
    extra = sorted(set(df.columns) - set(schema.names))
    if extra:
        raise ValueError(f"columns not in the schema: {extra}")
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def union_aligned(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both frames; ``new`` may bring columns ``old`` lacks, but may not lack any of old's."""
    lost = sorted(set(old.columns) - set(new.columns))
    if lost:
        raise ValueError(f"columns missing from the new data: {lost}")
    return old.unionByName(new, allowMissingColumns=True)
