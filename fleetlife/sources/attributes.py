"""Hand-kept attribute tables of models: lenient tab-separated text."""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Day 0 of model dates, and the date spellings of the table (missing parts count as the first).
MODEL_DAY_ZERO = datetime.date(2000, 1, 1)
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM", "yyyy")


def parse_lines(lines: DataFrame, line: str, order: Sequence[str], header: Sequence[str]) -> DataFrame:
    """Data lines to columns: comments and blanks go, runs of tabs separate, missing trailing fields are null.

    ``order`` names the columns that keep the place of a line in its source; they stay in the result.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col(line), "#.+$", ""), r"^\s+|\s+$", ""))
    kept = lines.select(*order, text.alias("_text")).where(F.length("_text") > 0)
    fields = kept.withColumn("_fields", F.split("_text", "\t+ *"))
    return fields.select(*order, *[F.get("_fields", F.lit(i)).alias(name) for i, name in enumerate(header)])


def header_names(header_line: str) -> list[str]:
    """Lower case, blanks to underscores."""
    return [h.replace(" ", "_").lower() for h in re.split("\t+ *", header_line.strip())]


def read_lenient_tsv(spark: SparkSession, path: str) -> DataFrame:
    """One attribute table with its header line; ``line_no`` orders the lines by file name and place in the file.

    A block of a file is read by one task from start to end, so the running number orders the lines inside a block, and
    (file, block, number) orders all of them however blocks were packed into tasks.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select("value", place.alias("line_no"))
    clean = F.trim(F.regexp_replace("value", "#.+$", ""))
    first = lines.where(F.length(clean) > 0).orderBy("line_no").select(clean.alias("h")).first()
    if first is None:
        raise ValueError(f"no lines in {path}")
    header = header_names(first["h"])
    rows = parse_lines(lines, "value", ["line_no"], header)
    return rows.where(F.lower(F.col(header[0])) != header[0])


def parse_model_date(text: Column) -> Column:
    """Full or partial date text to days since 2000-01-01."""
    parsed = F.coalesce(*[F.try_to_date(text, f) for f in DATE_FORMATS])
    return F.datediff(parsed, F.lit(MODEL_DAY_ZERO))


def attribute_table(
    rows: DataFrame, order: str, model: str = "model", date: str = "first_known_date", keep: Sequence[str] = (),
) -> DataFrame:
    """Typed attributes per upper-case model name; the last line wins when a name is repeated.

    The winner is found by ``max_by`` on the line order, which combines on the map side, so a name repeated on a third
    of all lines is no hot spot.
    """
    typed = rows.select(
        F.upper(F.col(model)).alias("model"), F.col(order).alias("_order"),
        parse_model_date(F.col(date)).alias(date), *keep)
    values = [c for c in typed.columns if c not in ("model", "_order")]
    return typed.groupBy("model").agg(*[F.max_by(c, "_order").alias(c) for c in values])
