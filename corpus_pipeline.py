"""A pipeline from raw documents to token digests of a weighted mix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlife.functions.staging_area import stage
from fleetlife.llm import chunk_bpe, language, mixing, simhash, toxicity
from fleetlife.llm.common import table

LEAST_SHARE = 0.35  # of the words that the main language of a kept document has


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; null and empty texts stay."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity_of(model, "text") < 0.5)


def drop_unclear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; texts without a letter, and mixtures in which no language has ``LEAST_SHARE`` of the
    words, go. Where no language can be learned, all documents with letters stay."""
    model = language.fit_language(docs)
    return docs.where(language.language_of(model, "text")["score"] >= LEAST_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles link at three differing bits or fewer."""
    return simhash.keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mix wants them, shuffled; repetitions are rows of their own."""
    return mixing.mix(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of the mix."""
    return docs.select("doc_id", chunk_bpe.encode_digests("text").alias("e")).select("doc_id", "e.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unclear_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# Learned scores, fingerprints and tokens have no SQL form; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage is stored in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
