"""Text expressions: model names, free-text series, mentions in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Series words recognised in a free-text series description, in order of preference.
SERIES_WORDS = (
    "RED", "Green", "Purple", "Gold", "Black", "Blue", "AV", r"RE\d?", "RE16", "Xe", "S25", "SE16", "SE",
    "WD450AA line", "Protege", "(?:Veloci)?Raptor", "My Passport", "UltraSlim",
)
DEFAULT_SERIES = "Old Caviar"

# White space in the Unicode sense, as one character class.
WHITESPACE = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def regex_search(pattern: Column, item: Column) -> Column:
    """Unanchored search; an empty or null pattern, or a null item, gives false."""
    return F.coalesce((F.length(pattern) > 0) & F.rlike(item, pattern), F.lit(False))


def longest_token(tokens: Column) -> Column:
    """The longest string of an array, the first one on ties."""
    return F.aggregate(tokens, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))


def normalize_model_name(vendor: Column, model: Column) -> Column:
    """Drop everything up to the vendor word, keep the longest remaining token, in upper case."""
    name, word = F.lower(model), F.lower(vendor)
    at = F.instr(name, word)
    rest = F.trim(F.substring(name, at + F.length(word), F.length(name)))
    name = F.when(at > 0, rest).otherwise(name)
    return F.upper(longest_token(F.split(name, " ")))


def series_and_modifiers(text: Column) -> Column:
    """Struct of ``series``, ``form_factor`` (last whole number / 10) and ``modifiers`` (flag map)."""
    pattern = "(" + "|".join(SERIES_WORDS) + ")"
    series = F.regexp_extract(text, pattern, 1)
    at = F.regexp_instr(text, F.lit(pattern))
    rest = F.when(at > 0, F.concat(
        F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(series), F.length(text))
    )).otherwise(text)
    tokens = F.split(rest, r"(?U)\W")
    numbers = F.filter(tokens, lambda t: t.rlike(r"^\d+$"))
    flags = F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 0) & ~t.rlike(r"^\d+$")))
    return F.struct(
        F.when(at > 0, series).otherwise(F.lit(DEFAULT_SERIES)).alias("series"),
        (F.element_at(F.when(F.size(numbers) > 0, numbers), -1).cast("double") / 10).alias("form_factor"),
        F.map_from_arrays(flags, F.transform(flags, lambda _: F.lit(True))).alias("modifiers"),
    )


def whitespace_tokens(df: DataFrame, text: str, out: str = "token") -> DataFrame:
    """One row per piece of text between single white space characters (empty pieces included)."""
    return df.withColumn(out, F.explode(F.split(F.col(text), WHITESPACE))).drop(text)


def model_mentions(pages: DataFrame, page_id: str, html: str, patterns: list[str]) -> DataFrame:
    """Every model name written in the text nodes of pages: mentions and pages per name.

    Tags become line breaks first, so that no match runs across a node boundary. Counts are combined on the map side,
    so a name found on a third of all pages costs one partial row per task.
    """
    any_pattern = "|".join(f"(?:{p})" for p in patterns)
    nodes = F.regexp_replace(F.col(html), "<[^>]*>", "\n")
    found = pages.select(
        F.col(page_id), F.explode(F.regexp_extract_all(nodes, F.lit(any_pattern), F.lit(0))).alias("name")
    )
    per_page = found.groupBy("name", page_id).agg(F.count("*").alias("mentions"))
    return per_page.groupBy("name").agg(F.sum("mentions").alias("mentions"), F.count("*").alias("pages"))
