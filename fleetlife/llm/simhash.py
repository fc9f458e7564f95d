"""SimHash near duplicates: exact comparison of fingerprint tiles by exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlife.functions.staging_area import stage
from fleetlife.llm.common import on_texts, share_code
from fleetlife.llm.components import connected

RADIUS = 3
WORDS = 3
SEED = 42
TILE = 512  # fingerprints on each side of one comparison
UNIT = 4096  # fingerprints of one part of a large bucket
BUCKET = 256  # wanted mean bucket size


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of the word shingles, as a signed long."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    whole, size = b" ".join(tokens), np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    last = min(words, len(tokens)) - 1
    spans = zip(starts[: len(tokens) - last].tolist(), ends[last:].tolist(), strict=True)
    hashes = np.array([xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Rows (doc_id, fp, digest) of all rows; the digest (md5, null for a null text) tells equal texts."""
    run = on_texts(lambda: lambda texts: {"fp": [fingerprint(t, words) for t in texts]}, pa.schema([("fp", pa.int64())]))
    return docs.select(F.col(doc).alias("doc_id"), run(F.col(text))["fp"].alias("fp"), F.md5(text).alias("digest"))


def _near_pairs(unit: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius inside equal units; rows are ordered by (unit, population count)."""
    n = len(fp)
    heads = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    size = np.diff(np.r_[heads, n])
    end = np.repeat(heads + size, size)
    rows = np.flatnonzero(np.repeat(size <= TILE, size))
    gap = 1
    while True:  # all small units side by side: row i against row i + gap of its own unit
        rows = rows[end[rows] - rows > gap]
        if not len(rows):
            break
        hit = rows[np.bitwise_count(fp[rows] ^ fp[rows + gap]) <= radius]
        if len(hit):
            yield hit, hit + gap
        gap += 1
    ones = np.bitwise_count(fp).astype(np.int16)
    for head, count in zip(heads[size > TILE], size[size > TILE], strict=True):
        for i in range(head, head + count, TILE):
            i_end = min(i + TILE, head + count)
            for j in range(i, head + count, TILE):
                if ones[j] - ones[i_end - 1] > radius:
                    break  # this tile and all after it hold too many ones
                j_end = min(j + TILE, head + count)
                a, b = np.nonzero(np.bitwise_count(fp[i:i_end, None] ^ fp[None, j:j_end]) <= radius)
                yield a + i, b + j


def _links(unit: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row linked inside its unit, (fingerprint, smallest signed fingerprint reached): the same components as all
    pairs have, with at most one edge per row."""
    order = np.lexsort((np.bitwise_count(fp), unit))
    unit, fp = unit[order], fp[order]
    signed = fp.view(np.int64)
    by_value = np.argsort(signed, kind="stable")
    label = np.empty(len(fp), np.int64)
    label[by_value] = np.arange(len(fp))  # rank of the fingerprint, so that the smallest label is the smallest one
    owner = by_value
    pairs = [(a, b) for a, b in ((p[0].astype(np.int32), p[1].astype(np.int32)) for p in _near_pairs(unit, fp, radius)) if len(a)]
    moved = True
    while moved:
        before = label.copy()
        for a, b in pairs:
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        label = np.minimum(label, label[owner[label]])
        moved = bool((label != before).any())
    root = signed[owner[label]]
    linked = root != signed
    return signed[linked], root[linked]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_u, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(unit: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            u, v = _links(unit, fp, radius)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            unit = np.r_[held_u, batch.column(0).to_numpy(zero_copy_only=False)]
            fp = np.r_[held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            whole = np.searchsorted(unit, unit[-1]) if len(unit) else 0  # the last unit may go on in the next batch
            held_u, held_f = unit[whole:], fp[whole:]
            if whole:
                yield from out(unit[:whole], fp[:whole])
        if len(held_u):
            yield from out(held_u, held_f)

    return run


def _masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of every choice of ``blocks - radius`` out of ``blocks`` blocks: two fingerprints within the radius
    differ in at most ``radius`` blocks, so they agree on all bits of some mask."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _blocks_for(n: int, radius: int) -> int:
    """The least number of blocks that keeps the mean bucket of ``n`` fingerprints small."""
    return next(b for b in range(radius + 1, 4 * radius + 1)
                if n / 2 ** (64 * (b - radius) / b) <= BUCKET or comb(b + 1, radius) > 400)


def linked_fingerprints(
    distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None, unit_rows: int = UNIT,
) -> DataFrame:
    """Edges (u, v) that connect exactly the ``fp`` values that differ in at most ``radius`` bits.

    A bucket holds the fingerprints that agree on one mask. Buckets up to ``unit_rows`` are compared as a whole. Larger
    ones are cut into parts by population count (and by hash, where one count is still too many), and each pair of
    parts whose counts are within the radius is a unit of its own, so no bucket meets in one task.
    """
    if blocks is None:
        blocks = _blocks_for(distinct.count(), radius)
    masks = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
             for i, m in enumerate(_masks(blocks, radius))]
    keyed = distinct.select("fp", F.explode(F.array(*masks)).alias("k")).select(
        "fp", F.xxhash64("k.mask", "k.bits").alias("bucket"))
    large = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > unit_rows).drop("n")
    large = stage(large, "large-buckets")
    if large.isEmpty():
        units = keyed.select(F.col("bucket").alias("unit"), "fp")
    else:
        small = keyed.join(large, "bucket", "left_anti").select(F.col("bucket").alias("unit"), "fp")
        split = keyed.join(large, "bucket").withColumn("ones", F.bit_count("fp"))
        parts = split.groupBy("bucket", "ones").agg(F.ceil(F.count("*") / unit_rows).alias("cuts"))
        part = F.pmod(F.xxhash64("fp"), F.col("cuts"))
        mine = split.join(parts, ["bucket", "ones"]).select("bucket", "ones", part.alias("cut"), "fp")
        cuts = parts.select("bucket", "ones", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
        other = cuts.select("bucket", F.col("ones").alias("o_ones"), F.col("cut").alias("o_cut"))
        pairs = cuts.join(other, "bucket").where(F.abs(F.col("ones") - F.col("o_ones")) <= radius)
        here, there = F.struct("ones", "cut"), F.struct(F.col("o_ones").alias("ones"), F.col("o_cut").alias("cut"))
        pairs = pairs.select("bucket", "ones", "cut",
                             F.xxhash64("bucket", F.least(here, there), F.greatest(here, there)).alias("unit"))
        units = small.unionByName(mine.join(pairs, ["bucket", "ones", "cut"]).select("unit", "fp"))
    share_code(distinct.sparkSession)
    placed = units.select("unit", "fp").repartition("unit").sortWithinPartitions("unit")
    return placed.mapInArrow(_compare(radius), "u bigint, v bigint").distinct()


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, doc: str = "doc_id", text: str = "text", words: int = WORDS,
    blocks: int | None = None, unit_rows: int = UNIT,
) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id, root, digest), one per row of ``docs``.

    Fingerprints link when they differ in at most ``radius`` bits; a component is what links reach, and its id is the
    smallest document id in it (null if it has none); ``root`` is its smallest fingerprint. Equal fingerprints are compared once. Null and wordless texts
    have fingerprint zero and link like any other. An empty table gives no rows.
    """
    rows = stage(fingerprints(docs, doc, text, words), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = connected(linked_fingerprints(distinct, radius, blocks, unit_rows)).withColumnRenamed("node", "fp")
    rooted = stage(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    first = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    component = rooted.join(first, "root").select("fp", "component_id", "root")
    return rows.join(component, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "digest")


def keep_one_each(
    docs: DataFrame, radius: int = RADIUS, doc: str = "doc_id", text: str = "text", words: int = WORDS,
) -> DataFrame:
    """One row of every component, as ``keep_one_of`` chooses it."""
    return keep_one_of(docs, near_duplicates(docs, radius, doc, text, words), doc, text)


def keep_one_of(docs: DataFrame, found: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of ``docs`` with the smallest id of every ``root`` of ``found`` (doc_id, root, digest), with all its columns.

    Of a component without ids, and of rows that repeat id and text, one row stays: the first by the text of its other
    columns.
    """
    lowest = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.coalesce("digest", F.lit("")).alias("digest"))
    chosen = found.groupBy("root").agg(F.min(lowest).alias("k")).select(
        F.col("k.doc_id").alias("k_id"), F.col("k.digest").alias("k_digest"))
    repeats = found.groupBy("doc_id", F.coalesce("digest", F.lit("")).alias("digest")).agg(F.count("*").alias("k_rows"))
    chosen = stage(chosen.join(
        repeats, F.col("k_id").eqNullSafe(F.col("doc_id")) & (F.col("k_digest") == F.col("digest")),
    ).select("k_id", "k_digest", "k_rows"), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc).alias("own_id"),
                       F.coalesce(F.md5(F.col(text)), F.lit("")).alias("own_digest"))
    kept = rows.join(chosen, F.col("own_id").eqNullSafe(F.col("k_id")) & (F.col("own_digest") == F.col("k_digest")))
    once = kept.where("k_rows = 1").select("row.*")
    again = kept.where("k_rows > 1").groupBy("k_id", "k_digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.unionByName(again.select("row.*"))
