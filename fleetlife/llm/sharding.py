"""Longest-processing-time scheduling of groups that must stay together onto shards."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlife.functions.staging_area import stage

ROW_OVERHEAD = 16
CELL_ROWS = 50_000


def least_loaded(items: Iterable[tuple[int, str]], shards: int) -> dict[str, int]:
    """Largest item first, each to the shard with the smallest load so far (ties: the smaller shard)."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for weight, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + weight, shard))
    return placed


def assign_shards(
    docs: DataFrame, shards: int = 40, grains: int = 8192, doc: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one per row of ``docs``.

    Rows with equal texts form a group that stays together; shard sizes in bytes come out near equal (law ``bytes``).
    Groups above 1/``grains`` of all bytes are scheduled one by one; there are fewer than ``grains`` of them, whatever
    the corpus. The smaller ones are first tied into ``grains`` bundles by the hash of their text and the bundles are
    scheduled, so the heap sees at most 2 x ``grains`` items, which is all that passes through the driver. A group
    larger than a mean shard has a shard of its own. Slots count from 0 inside a shard without gaps.

    Null texts are a group of their own of size 16 with a null crc; empty texts are another group. Rows that repeat,
    and rows with a null id, are kept as rows. An empty table gives no rows.
    """
    digest = F.coalesce(F.md5(F.col(text)), F.lit(""))
    rows = stage(docs.select(
        F.col(doc).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), digest.alias("group_key"), F.monotonically_increasing_id().alias("row_no"),
    ), "shard-rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    grain = F.pmod(F.xxhash64("group_key"), F.lit(grains)).cast("string")
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("weight"))
    heavy = F.col("weight") * grains > total
    items = groups.groupBy(heavy.alias("heavy"), F.when(heavy, F.col("group_key")).otherwise(grain).alias("item")).agg(
        F.sum("weight").alias("weight")).collect()  # at most 2 x grains rows
    placed = least_loaded([(r.weight, f"{int(r.heavy)}{r.item}") for r in items], shards)
    schema = "item string, {} int"
    alone = docs.sparkSession.createDataFrame([(k[1:], s) for k, s in placed.items() if k[0] == "1"], schema.format("own"))
    tied = docs.sparkSession.createDataFrame([(k[1:], s) for k, s in placed.items() if k[0] == "0"], schema.format("bundled"))
    where = (
        rows.join(F.broadcast(alone), F.col("group_key") == alone.item, "left").drop("item")
        .join(F.broadcast(tied), grain == tied.item, "left").drop("item")
        .withColumn("shard", F.coalesce("own", "bundled")).drop("own", "bundled", "group_key")
    )
    blocks = max(1, n // (shards * CELL_ROWS))
    where = where.withColumn("block", F.pmod(F.xxhash64("row_no"), F.lit(blocks)))
    sizes = where.groupBy("shard", "block").agg(F.count("*").alias("in_block"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "block", F.coalesce(F.sum("in_block").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row_no")) - 1
    return where.withColumn("inside", inside).join(offsets, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("inside")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
