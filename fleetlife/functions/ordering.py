"""Exact global ranks and running totals without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

HASH_BLOCK_DIGITS = 3  # 16 ** 3 blocks: the only table that is ordered as a whole has at most 4,096 rows


def _with_block_offsets(df: DataFrame, block: str, offset: str, parts: Sequence[str] = ()) -> DataFrame:
    """Adds the number of rows in all smaller blocks (of the same part; nulls are a part of their own)."""
    sizes = df.groupBy(*parts, block).agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*parts).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_size").over(earlier), F.lit(0))
    offsets = sizes.select(*[F.col(p).alias(f"_part_{i}") for i, p in enumerate(parts)], F.col(block).alias("_of_block"),
                           before.alias(offset), F.col("_size").alias("_block_size"))
    same = F.col(block) == F.col("_of_block")
    for i, p in enumerate(parts):
        same = same & F.col(p).eqNullSafe(F.col(f"_part_{i}"))
    # Without parts there are at most 4,096 blocks; otherwise the planner decides by size.
    return df.join(offsets if parts else F.broadcast(offsets), same).drop("_of_block", *[f"_part_{i}" for i in range(len(parts))])


def number_by_hash(df: DataFrame, key: Sequence[str], out: str, start: Column | int = 0) -> DataFrame:
    """Consecutive numbers ``start + 1 ...`` for rows with distinct keys, in the order of (md5(key), key).

    Ranks are taken inside hash blocks (evenly filled, because keys are distinct) and shifted by the block offsets, so
    numbering a billion new serials never sorts them in one task, and the result does not depend on partitioning.
    """
    digest = F.md5(F.concat_ws("\t", *[F.col(k).cast("string") for k in key]))
    hashed = df.withColumn("_md5", digest).withColumn("_block", F.substring("_md5", 1, HASH_BLOCK_DIGITS))
    placed = _with_block_offsets(hashed, "_block", "_before")
    rank = F.row_number().over(Window.partitionBy("_block").orderBy("_md5", *key))
    start = F.lit(start) if isinstance(start, int) else start
    return placed.withColumn(out, (start + F.col("_before") + rank).cast("bigint")).drop(
        "_md5", "_block", "_before", "_block_size")


def smallest_by_hash(
    df: DataFrame, key: Sequence[str], how_many: Column, seed: int, parts: Sequence[str] = (),
) -> DataFrame:
    """Exactly ``how_many`` rows, chosen by the seeded md5 order of their key.

    ``parts`` are flag-like columns: each of their values, null included, is drawn from on its own, and ``how_many`` may
    depend on them. Whole hash blocks below the cut are kept as they are; only the one block on the cut is ordered.
    """
    digest = F.md5(F.concat_ws("\t", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    hashed = df.withColumn("_md5", digest).withColumn("_block", F.substring("_md5", 1, HASH_BLOCK_DIGITS))
    placed = _with_block_offsets(hashed, "_block", "_before", parts).withColumn("_k", how_many)
    placed = placed.where(F.col("_before") < F.col("_k"))
    on_cut = F.col("_before") + F.col("_block_size") > F.col("_k")
    rest = [c for c in df.columns if c not in key]
    rank = F.row_number().over(Window.partitionBy(*parts, "_block").orderBy("_md5", *key, *rest))
    cut = placed.where(on_cut).withColumn("_rank", rank).where(F.col("_before") + F.col("_rank") <= F.col("_k"))
    return placed.where(~on_cut).select(*df.columns).unionByName(cut.select(*df.columns))


AXIS_ROWS = 1 << 14  # points of an axis that one window orders
AXIS_CUTS = 512


def axis_sketch(order: str, prefix: str = "") -> list[Column]:
    """Aggregates that ``bounds_from`` reads: they fit into a job that goes over the rows anyway."""
    x = F.col(order).cast("double")
    x = F.when(~F.isnan(x), x)
    cuts = [i / AXIS_CUTS for i in range(1, AXIS_CUTS)]
    return [F.min(x).alias(f"{prefix}low"), F.max(x).alias(f"{prefix}high"), F.max(x - F.floor(x)).alias(f"{prefix}part"),
            F.approx_count_distinct(x).alias(f"{prefix}points"), F.percentile_approx(x, cuts, 4 * AXIS_CUTS).alias(f"{prefix}cuts")]


def bounds_from(row: Row, prefix: str = "") -> list[float] | None:
    """None where the axis is whole numbers no further apart than ``AXIS_ROWS``; else quantiles that cut it into blocks of
    about that many points (``AXIS_CUTS`` blocks at most)."""
    low, high = row[f"{prefix}low"], row[f"{prefix}high"]
    if low is None or (row[f"{prefix}part"] == 0 and high - low < AXIS_ROWS):
        return None
    blocks = min(AXIS_CUTS, max(2, -(-row[f"{prefix}points"] // AXIS_ROWS)))
    return sorted({row[f"{prefix}cuts"][i * AXIS_CUTS // blocks - 1] for i in range(1, blocks)})


def axis_bounds(rows: DataFrame, order: str) -> list[float] | None:
    """Block bounds for running totals along ``order``, by one pass over it. Integral columns are days, of which a fleet has
    8,192 at most, and need none."""
    if isinstance(rows.schema[order].dataType, IntegralType):
        return None
    return bounds_from(rows.agg(*axis_sketch(order)).first())


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str], block_width: float | Sequence[float] | None = None,
) -> DataFrame:
    """Adds ``sums[out] = column`` running totals (current row included) per ``keys``, in the order of ``order``.

    ``df`` has one row per (keys, order). With whole-day axes a group has a few thousand rows and one window does it.
    ``block_width`` splits longer axes: totals run inside blocks of that width, or between such bounds, and the blocks' own
    totals are added.
    """
    if block_width is None:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({out: F.sum(c).over(w) for out, c in sums.items()})
    if isinstance(block_width, (int, float)):
        blocked = df.withColumn("_axis_block", F.floor(F.col(order) / F.lit(block_width)))
    else:
        bounds = F.array(*[F.lit(float(b)) for b in block_width]).cast("array<double>")
        blocked = df.withColumn("_axis_block", F.size(F.filter(bounds, lambda b: b < F.col(order))).cast("bigint"))
    inside = Window.partitionBy(*keys, "_axis_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_axis_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys, "_axis_block").agg(*[F.sum(c).alias(f"_axis_total_{out}") for out, c in sums.items()])
    offsets = totals.select(
        *[F.col(k).alias(f"_axis_key_{i}") for i, k in enumerate(keys)], F.col("_axis_block").alias("_axis_of"),
        *[F.coalesce(F.sum(f"_axis_total_{out}").over(earlier), F.lit(0)).alias(f"_axis_before_{out}") for out in sums],
    )
    same = F.col("_axis_block") == F.col("_axis_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_axis_key_{i}"))
    joined = blocked.withColumns({out: F.sum(c).over(inside) for out, c in sums.items()}).join(offsets, same)
    return joined.withColumns({out: F.col(out) + F.col(f"_axis_before_{out}") for out in sums}).select(*df.columns, *sums)


def backwards(blocks: float | Sequence[float] | None) -> float | list[float] | None:
    """The same blocks for an axis whose sign is turned."""
    return blocks if blocks is None or isinstance(blocks, (int, float)) else [-b for b in reversed(blocks)]
