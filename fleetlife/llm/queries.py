"""The registered queries of this subpackage: each operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlife.llm import (
    chat_format, chunk_bpe, graph_search, language, license_scan, line_quality, merkle, mixing, prefix_trie, sharding, simhash,
    toxicity, warc,
)
from fleetlife.llm.common import table


def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf, "documents"), shards=40)


def op2_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf, "pages"))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    return line_quality.judge_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op7_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return graph_search.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", chunk_bpe.encode_digests("text").alias("e")).select("doc_id", "e.*")


def op9_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf, "documents"))


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text"))


def op11_chat(spark: SparkSession, sf: str) -> DataFrame:
    turns = chat_format.with_tricky(table(spark, sf, "conversations"))
    return chat_format.conversation_digests(chat_format.format_conversations(turns))


def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = merkle.manifest(docs, merkle.tamper_with_lengths(docs), proofs=False)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_nodes(prefix_trie.rebuilt_conversations(table(spark, sf, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_sharding, op2_simhash, op3_warc, op4_toxicity, op5_language, op6_quality, op7_neighbours, op8_bpe, op9_licenses,
        op10_mixing, op11_chat, op12_merkle, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc_sql(), "op10_mixing": mixing.mix_sql(), "op11_chat": chat_format.digests_sql(),
            "op12_merkle": merkle.manifest_sql(), "op13_prefix_trie": prefix_trie.nodes_sql()}


def warc_sql(pages: str = "pages") -> str:
    """Op3 without archives. DuckDB has no base32, so the digest is spelt out from its hex form, five bits a letter."""
    letters = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(substr(bits, {5 * i + 1}, 5)::bit::int as int), 1)" for i in range(32))
    bits = " || ".join(f"lpad(bin(cast('0x' || substr(hex, {8 * i + 1}, 8) as bigint)), 32, '0')" for i in range(5))
    return f"""
with p as (select page_id, coalesce(html, '') as body from {pages}),
h as (select page_id, octet_length(encode(body)) as payload_bytes, sha1(body) as hex, max(page_id) over (partition by body) as top from p),
b as (select *, {bits} as bits from h)
select page_id, cast(payload_bytes as bigint) as payload_bytes, {letters} as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to
from b"""
