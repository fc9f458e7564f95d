"""The download catalogue: from page scripts to typed pieces with time spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The page's script syntax and the wording of the catalogue's size texts.
TABLE_CALL = r"(?:var|let)\s+(\w+)\s*=\s*new\s+(Article|Data)Table\s*\(([^\)]+)\)\s*;"
SCRIPT_COMMENT = r"/\*\w+\*/"
QUOTED = r"'([^']+)'"
SIZE = r"(\d+(?:\.\d+)?)\s+([MG])B\s+"
COMPRESSED = SIZE + r"((?:ZIP|zip|Zip)\s+)?[fF]ile"
UNPACKED = SIZE + r"on\s+[dD]isk"
FILE_COUNT = r"(\d+) files"
KIND = r"data|docs"
QUARTER = r"Q([1-4])"
MEGABYTES = {"K": 1 / 1024, "M": 1.0, "G": 1024.0}

RECORD = "struct<title:string,year:string,dataURL:string,metaData:string>"


def script_tables(pages: DataFrame, html: str, *carry: str) -> DataFrame:
    """Every table literal in page scripts: ``kind``, ``variable`` and its JSON text, one row per table."""
    calls = F.regexp_extract_all(F.col(html), F.lit(TABLE_CALL), F.lit(0))
    one = pages.select(*carry, F.explode(calls).alias("call"))
    body = F.regexp_extract("call", TABLE_CALL, 3)
    body = F.regexp_replace(F.regexp_replace(body, SCRIPT_COMMENT, ""), QUOTED, '"$1"')
    return one.select(
        *carry, F.lower(F.regexp_extract("call", TABLE_CALL, 2)).alias("kind"),
        F.regexp_extract("call", TABLE_CALL, 1).alias("variable"),
        F.concat(F.lit("["), F.trim(body), F.lit("]")).alias("json"),
    )


def catalogue_records(pages: DataFrame, html: str, variable: str, *carry: str) -> DataFrame:
    """Records of the data table called ``variable``: title, year, dataURL, metaData."""
    tables = script_tables(pages, html, *carry).where((F.col("kind") == "data") & (F.col("variable") == variable))
    third = F.from_json("json", "array<string>")[2]
    records = F.from_json(third, f"array<{RECORD}>")
    return tables.select(*carry, F.inline(records))


def _megabytes(text: Column, pattern: str) -> Column:
    number, unit = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    scale = F.create_map(*[F.lit(x) for pair in MEGABYTES.items() for x in pair])
    return F.when(number != "", F.try_element_at(scale, unit) * number.cast("double"))


def _nullable(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def catalogue_pieces(records: DataFrame, *carry: str) -> DataFrame:
    """Typed catalogue pieces; ``complete`` is false where a required size text was not understood."""
    meta, name = F.col("metaData"), F.regexp_extract("dataURL", "[^/]*$", 0)
    typed = records.select(
        *carry, name.alias("name"), F.col("title"), F.col("year").cast("int").alias("year"),
        _nullable(name, KIND, 0).alias("type"), _nullable(name, QUARTER, 1).cast("int").alias("quarter"),
        F.col("dataURL").alias("uri"), _megabytes(meta, COMPRESSED).alias("compressed_mb"),
        _megabytes(meta, UNPACKED).alias("unpacked_mb"), _nullable(meta, FILE_COUNT, 1).cast("int").alias("files"),
        F.nullif(F.trim(F.lower(F.regexp_extract(meta, COMPRESSED, 3))), F.lit("")).alias("format"),
    )
    required = ("compressed_mb", "unpacked_mb", "files", "format", "type", "year")
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    return typed.withColumns({
        "complete": complete,
        "start": span_start(F.col("year"), F.col("quarter")), "end": span_end(F.col("year"), F.col("quarter")),
    })


def span_start(year: Column, quarter: Column) -> Column:
    """First day of the year's quarter, or of the whole year when the quarter is null."""
    return F.make_date(year, F.coalesce((quarter - 1) * 3 + 1, F.lit(1)), F.lit(1))


def span_end(year: Column, quarter: Column) -> Column:
    """First day after the span."""
    return F.add_months(span_start(year, quarter), F.when(quarter.isNull(), 12).otherwise(3))


def newer_pieces(pieces: DataFrame, loaded: DataFrame, last_day: str = "last_day") -> DataFrame:
    """Pieces that start after the newest day already loaded (days since 1970-01-01); all when nothing is loaded."""
    newest = loaded.agg(F.max(last_day)).scalar()
    return pieces.where(F.unix_date("start") > F.coalesce(newest, F.lit(-(2 ** 31))))


def covered_span(pieces: DataFrame) -> DataFrame:
    return pieces.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("pieces"))


def catalogue_tree(pieces: DataFrame, value: str = "name") -> DataFrame:
    """One row per year with a column per quarter; pieces for a whole year stand in ``whole_year``.

    A cell holds all its pieces in order; it is null without any.
    """
    slot = F.coalesce(F.concat(F.lit("q"), F.col("quarter").cast("string")), F.lit("whole_year"))
    slots = ["q1", "q2", "q3", "q4", "whole_year"]
    cells = pieces.withColumn("_slot", slot).groupBy("year").pivot("_slot", slots).agg(F.sort_array(F.collect_list(value)))
    return cells.select("year", *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in slots])
