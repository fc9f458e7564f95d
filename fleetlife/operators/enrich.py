"""Adding attributes to models: rule tables, attribute tables, repairs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``attribute`` is what ``group`` of ``pattern`` captures in the name, as ``type``; earlier rules win."""

    attribute: str
    pattern: str
    group: int = 1
    type: str = "string"


def decode_columns(name: Column, rules: Sequence[Rule]) -> dict[str, Column]:
    """One expression per attribute out of the rule table: all of it stays in one projection."""
    found: dict[str, list[Column]] = {}
    for r in rules:
        text = F.nullif(F.regexp_extract(name, r.pattern, r.group), F.lit(""))
        found.setdefault(r.attribute, []).append(text.try_cast(r.type))
    return {a: F.coalesce(*cs) for a, cs in found.items()}


# An enricher returns the models with its attributes and a boolean column ``hit``.
Enricher = Callable[[DataFrame], DataFrame]


def rule_enricher(rules: Sequence[Rule], name: str = "name", false_when_absent: Sequence[str] = ()) -> Enricher:
    """Decoder driven by a rule table; a model is a hit when any rule finds something."""

    def apply(models: DataFrame) -> DataFrame:
        columns = decode_columns(F.col(name), rules)
        out = models.withColumns(columns)
        out = out.withColumn("hit", reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns]))
        absent = {c: F.when(F.col("hit"), F.coalesce(F.col(c), F.lit(False))) for c in false_when_absent if c in columns}
        return out.withColumns(absent) if absent else out

    return apply


def table_enricher(attributes: DataFrame, key: str = "model", name: str = "name") -> Enricher:
    """Attribute table joined by exact name; its values override earlier ones where it has them."""

    def apply(models: DataFrame) -> DataFrame:
        values = [c for c in attributes.columns if c != key]
        side = attributes.select(
            F.col(key).alias("_key"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in values])
        out = models.join(side, F.col(name) == F.col("_key"), "left")
        out = out.withColumns({
            c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in models.columns else F.col(f"_new_{c}") for c in values})
        return out.withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_key", "_hit", *[f"_new_{c}" for c in values])

    return apply


def enrich(models: DataFrame, enrichers: Mapping[str, Enricher]) -> DataFrame:
    """Apply enrichers in order of priority; bit k of ``missed`` is set when the k-th of them found nothing."""
    out = models.withColumn("missed", F.lit(0))
    for k, enricher in enumerate(enrichers.values()):
        out = enricher(out).withColumn("missed", F.when(F.col("hit"), F.col("missed")).otherwise(
            F.col("missed").bitwiseOR(F.lit(1 << k)))).drop("hit")
    return out


def coverage(enriched: DataFrame, name: str = "name") -> DataFrame:
    """Which enrichers missed a name on any of its models."""
    return enriched.groupBy(name).agg(F.bit_or("missed").alias("missed"))


def attach_attributes(
    stats: DataFrame, models: DataFrame, attributes: Sequence[str], model_id: str = "model_id",
) -> tuple[DataFrame, list[str]]:
    """Inner join of subjects with model attributes; clashing names get ``_model``; returns missing names too."""
    missing = [a for a in attributes if a not in models.columns]
    side = models.select(F.col("id").alias(model_id), *[
        F.col(a).alias(f"{a}_model" if a in stats.columns else a) for a in attributes if a in models.columns])
    return stats.join(side, model_id), missing


def repair(df: DataFrame, repairs: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Apply (column, condition, value) repairs in turn; a null condition leaves the value alone."""
    for name, condition, value in repairs:
        current = F.col(name) if name in df.columns else F.lit(None)
        df = df.withColumn(name, F.when(condition, value).otherwise(current))
    return df


def brand_repairs(brand: str = "brand") -> list[tuple[str, Column, Column]]:
    """Known gaps of decoded attributes: product lines of one vendor are absent elsewhere, and so on."""
    b, wd = F.col(brand), "Western Digital"
    repairs = [(line, b != wd, F.lit(False)) for line in ("Caviar", "Scorpio", "GP")]
    repairs.append(("Scorpio", (b == wd) & (F.col("form_factor") == 3.5) & F.col("Scorpio").isNull(), F.lit(False)))
    repairs.append(("product_code", b.isin("Hitachi", "HGST"), F.lit("N/A")))
    return repairs
