"""The vendor - brand - model - device snowflake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import number_by_hash
from ..functions.pattern_index import candidates, indexed_patterns
from ..functions.staging_area import stage
from ..functions.text import regex_search

# Seed vendors and brands with the patterns of their model names, in matching order.
SEED_VENDORS = ((0, "Unknown"), (1, "Seagate"), (2, "Western Digital"), (3, "Toshiba"), (4, "Hitachi"))
SEED_BRANDS = (
    (1, "Unknown", 0, ""),
    (2, "Seagate", 1, r"ST\d+(?:[A-Z]{2}\d+|AS)(\s[A-Z]{2})?"),
    (3, "Samsung", 1, r"H[DAEMS]\d{3}[A-Z]{2}(?:/p)?|[SM][PV]\d{4}[A-Z](?:/r)?|(7(PA|PC|TD|TE|WD)|M(P[AC]|TD)|N(LN|TD)"
                      r"|CBQ|C[QR]E|DOE|HPV|YTY)(28G|024|032|E32|56G|64G|256|128|256|480|512)([5F]M[PXU]P"
                      r"|H[MABCD](CD|DR|F[UV]|G[LMR]|H[PQ]|JP|LH))"),
    (4, "Western Digital", 2, r"(?:WDC )?WD\d+(?:[A-X][0-29A-Z])?[26A-Z][A-Z]"),
    (5, "Toshiba", 3, r"TOSHIBA.+(AL|DT|M[DGCNQ]|PX|THN)\w{2}[ASPRC]([ABCEX]|[HLMRV])[ABDFQU]\d{2,3}[0DE]?"
                      r"([ANE]Y|VS?|[BCHPQWDFGR])?|M[BJH]\w{2}[23]\d{3}(A[CHT]|B[HJKS]|C[HJ]|F[CD]|N[PC]|RC)"),
    (6, "HGST", 4, r"^HGST [WH][UDTECM][HSCEATNP](\d{2}|5C)\d{4}[PVDKABCHJLMSG][L795S]"
                   r"([13][68]|F[24]|A[T3]|SA|[AENS]6|SS|[45]2)[0-486][01245]"),
    (7, "Hitachi", 4, r"^Hitachi H[UDTECM][HSCEATNP](\d{2}|5C)\d{4}[PVDKABCHJLMSG][L795S]"
                      r"([13][68]|F[24]|A[T3]|SA|[AENS]6|SS|[45]2)[0123486][01245]"),
)


BRAND_BUCKET = 256  # patterns that one row holds


def seed_vendors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_VENDORS, "id int, name string")


def seed_brands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_BRANDS, "id int, name string, vendor_id int, model_name_regex string")


def brands_with_vendor(brands: DataFrame, vendors: DataFrame) -> DataFrame:
    v = vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"))
    return brands.join(v, "vendor_id")


def models_with_brand(models: DataFrame, brands: DataFrame) -> DataFrame:
    """Models without a brand drop out."""
    b = brands.select(F.col("id").alias("brand_id"), F.col("name").alias("brand_name"), "vendor_id")
    return models.join(b, "brand_id")


def classify_models(models: DataFrame, brands: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``brand_id``: the first brand, by id, whose pattern is found in the model name; null when none is.

    Distinct names meet the patterns by a trigram that every match has to contain, and a pattern is tried only on names that
    hold its literal. Patterns without such a literal are tried on every name, in buckets of ``BRAND_BUCKET``, each of which
    is one array row, so there is neither a nested-loop join nor the whole list in one row. Nothing limits the number of
    brands.
    """
    listed = brands.where(F.coalesce(F.length("model_name_regex"), F.lit(0)) > 0).select(
        F.col("id").alias("_id"), F.col("model_name_regex").alias("_rx"))
    rare, always = indexed_patterns(listed)
    names = models.select(F.col(name).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    found = candidates(names, rare).where(regex_search(F.col("_rx"), F.col("_name"))).select("_name", "_id")

    bucket = F.pmod(F.xxhash64("_id"), F.ceil(brands.agg(F.count("*")).scalar() / BRAND_BUCKET))
    buckets = always.groupBy(bucket.alias("_bucket")).agg(F.collect_list(F.struct("_id", "_rx")).alias("_brands"))
    numbers = buckets.agg(F.collect_list("_bucket").alias("n")).scalar()
    tried = names.withColumn("_bucket", F.explode(numbers)).join(buckets, "_bucket")
    hits = F.array_min(F.transform(F.filter("_brands", lambda b: regex_search(b["_rx"], F.col("_name"))), lambda b: b["_id"]))
    first = found.unionByName(tried.select("_name", hits.alias("_id"))).groupBy("_name").agg(F.min("_id").alias("brand_id"))
    return models.join(first, models[name] == first["_name"], "left").drop("_name")


def new_models_and_drives(
    staging: DataFrame, models: DataFrame, drives: DataFrame, serial: str = "serial_number", model: str = "model",
) -> tuple[DataFrame, DataFrame]:
    """Model and drive rows that an import adds: unseen names get ids after the largest known one.

    The staging rows are read once and combine on the map side to one row per serial, which meets the known drives in the
    same partitioning; what is new is stored, and everything else starts from there. A serial reported under two models goes to the smaller
    name. Ids follow the md5 order of the names, so they are the same on every run and numbering needs no global sort.
    """
    seen = staging.where(F.col(serial).isNotNull()).groupBy(serial).agg(F.min(model).alias("model_name"))
    fresh = seen.where(F.col("model_name").isNotNull()).join(drives.select(serial), serial, "left_anti")
    fresh = stage(fresh, "new-serials")
    unseen_models = fresh.select(F.col("model_name").alias("name")).distinct().join(
        models.select("name"), "name", "left_anti")
    last_model = models.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()
    new_models = stage(number_by_hash(unseen_models, ["name"], "id", last_model).select("id", "name"), "new-models")
    all_models = models.select("id", "name").unionByName(new_models).select(
        F.col("id").cast("bigint").alias("model_id"), F.col("name").alias("model_name"))
    last_drive = drives.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()
    numbered = number_by_hash(fresh, [serial], "id", last_drive)
    return new_models, numbered.join(all_models, "model_name").select("id", "model_id", serial)


def model_conflicts(staging: DataFrame, serial: str = "serial_number", model: str = "model") -> DataFrame:
    """Serials reported under more than one model name: one row for every name that is not kept."""
    pairs = staging.where(F.col(serial).isNotNull() & F.col(model).isNotNull()).select(serial, model).distinct()
    kept = pairs.groupBy(serial).agg(F.min(model).alias("kept_model"), F.count("*").alias("_names")).where("_names > 1")
    return pairs.join(kept.drop("_names"), serial).where(F.col(model) != F.col("kept_model")).select(
        serial, "kept_model", F.col(model).alias("other_model"))


def unknown_model_drives(drives: DataFrame, models: DataFrame) -> DataFrame:
    """Drives of models without a brand, or with the brand number 0."""
    unknown = models.where(F.coalesce(F.col("brand_id"), F.lit(0)) == 0).select(F.col("id").alias("model_id"))
    return drives.join(unknown, "model_id", "left_semi")


def drives_with_lineage(drives: DataFrame, models: DataFrame, brands: DataFrame, vendors: DataFrame) -> DataFrame:
    """Every drive with its model, brand and vendor; the upper levels are joined first, while they are small."""
    b = brands_with_vendor(brands, vendors).select(
        F.col("id").alias("brand_id"), F.col("name").alias("brand_name"), "vendor_id", "vendor_name")
    m = models.join(b, "brand_id", "left").select(
        F.col("id").alias("model_id"), F.col("name").alias("model_name"), "brand_id", "brand_name", "vendor_id",
        "vendor_name")
    return drives.join(m, "model_id")
