"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlife.functions.staging_area import forget, stage


SALTS = 16  # tasks over which the rows of one node are spread


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """Adds to (u, v) the smallest v of u.

    It is aggregated before the shuffle and joined back on (node, salt), so a node with very many neighbours, as the
    root of a large component is, meets in no single task and is never ordered.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least, ["u", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _least_neighbour(both).withColumn("least", F.least("u", "least"))
    return near.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    near = _least_neighbour(edges)
    links = near.select(F.explode(F.array(
        F.struct(F.col("v").alias("u"), F.col("least").alias("v")),
        F.struct(F.col("u"), F.col("least").alias("v")))).alias("e")).select("e.u", "e.v")
    return links.where("u > v")


def connected(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (u, v: longs): root is the smallest node reachable.

    Alternates large-star and small-star steps, which need few rounds even on long chains. Each round is stored in the
    shared folder and the one before is deleted; only a count and a hash sum go to the driver. Nulls and loops are
    ignored. An empty table gives no rows.
    """
    state = stage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seal = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seal or not now[0]:
            break
        seal = now
        after = stage(_small_star(_large_star(state)).distinct(), "edges")
        forget(state)
        state = after
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
