"""Approximate nearest neighbours by inner product: a robust-pruned directed graph per shard, searched with a beam."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlife.functions.staging_area import stage
from fleetlife.llm.common import share_code

SHARD_ROWS = 8192
QUERY_BLOCK = 16 * SHARD_ROWS  # queries that stream past one copy of a shard
DEGREE = 32
BUILD_BEAM = 48
ALPHA = 1.2
SEARCH_BEAM = 96
TOGETHER = 256  # searches that advance side by side


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows whose vector has finite components that are not all zero."""
    v = F.col(vector)
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & v.isNotNull()).where(good & F.exists(v, lambda x: x != 0)).select(
        F.col(key).cast("bigint").alias("vec_id"), v.cast("array<double>").alias("vector"))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Points with one more coordinate that makes all of equal length, so that the nearest point of a query (whose extra
    coordinate is zero) is the one with the largest inner product."""
    rest = np.sqrt(np.maximum(longest**2 - (x.astype(np.float64) ** 2).sum(axis=1), 0.0))
    return np.c_[x, rest].astype(np.float32)


def beam_search(
    points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int, visited: bool = False,
) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` nearest points met by greedy search, nearest first, as (indices, squared distances);
    -1 fills up. With ``visited`` the points that were expanded come instead, in no order.

    All queries take one step at a time: each expands its nearest point not yet expanded.
    """
    q, n = len(queries), len(points)
    norms, square = (points**2).sum(axis=1), (queries**2).sum(axis=1)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    done = np.zeros((q, beam), bool)
    seen = np.zeros((q, n), bool)
    ids[:, 0], dist[:, 0] = start, norms[start] - 2 * queries @ points[start] + square
    seen[:, start] = True
    trail: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.arange(q)
    while len(active):
        open_dist = np.where(done[active], np.inf, dist[active])
        best = open_dist.argmin(axis=1)
        going = np.isfinite(open_dist[np.arange(len(active)), best])
        active, best = active[going], best[going]
        if not len(active):
            break
        done[active, best] = True
        at = ids[active, best]
        if visited:
            trail.append((active, at, dist[active, best]))
        near = graph[at]
        fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        seen[np.repeat(active, near.shape[1])[fresh.ravel()], near.ravel()[fresh.ravel()]] = True
        safe = np.where(fresh, near, 0)
        d = norms[safe] - 2 * np.einsum("qrd,qd->qr", points[safe], queries[active]) + square[active][:, None]
        d = np.where(fresh, d, np.inf).astype(np.float32)
        all_d = np.concatenate([dist[active], d], axis=1)
        all_i = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
        all_done = np.concatenate([done[active], np.zeros(d.shape, bool)], axis=1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_i, keep, axis=1)
        dist[active] = np.take_along_axis(all_d, keep, axis=1)
        done[active] = np.take_along_axis(all_done, keep, axis=1)
    if not visited:
        return ids, dist
    count = np.zeros(q, np.int64)
    found = np.full((q, len(trail)), -1, np.int64)
    far = np.full((q, len(trail)), np.inf, np.float32)
    for active, at, d in trail:
        found[active, count[active]], far[active, count[active]] = at, d
        count[active] += 1
    return found, far


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-edges of each point of ``own`` from its row of ``candidates`` (-1 fills up): the nearest candidate is kept and
    every other one that is ``alpha`` times nearer to it than to the point goes, again and again."""
    here = points[own]
    safe = np.maximum(candidates, 0)
    at = points[safe]
    dist = ((at - here[:, None, :]) ** 2).sum(axis=2)
    dist[(candidates < 0) | (candidates == own[:, None])] = np.inf
    out = np.full((len(own), degree), -1, np.int64)
    rows = np.arange(len(own))
    for k in range(degree):
        best = dist.argmin(axis=1)
        some = np.isfinite(dist[rows, best])
        if not some.any():
            break
        out[some, k] = candidates[some, best[some]]
        between = ((at - at[rows, best][:, None, :]) ** 2).sum(axis=2)
        gone = alpha**2 * between <= dist
        gone[rows, best] = True
        dist[gone & some[:, None]] = np.inf
    return out


def build_graph(
    points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0,
) -> tuple[np.ndarray, int]:
    """(out-edges with -1 where there are fewer, start point) of a graph over ``points``.

    Points enter in a random order, in batches that grow with the graph. A greedy search from the point nearest the mean
    proposes neighbours, pruning keeps diverse ones, and edges back are added, pruned again where they are too many.
    A second round over all points, on the finished graph, mends the edges of those that came early.
    """
    n = len(points)
    graph = np.full((n, degree), -1, np.int64)
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.r_[start, order[order != start]]
    todo = []
    at = 1
    while at < n:
        size = min(max(1, at // 2), TOGETHER, n - at)
        todo.append(order[at : at + size])
        at += size
    todo += [order[i : i + TOGETHER] for i in range(0, n, TOGETHER)] if n > 1 else []
    for batch in todo:
        near, _ = beam_search(points, graph, start, points[batch], beam, visited=True)
        proposed = np.concatenate([near, graph[batch]], axis=1)
        graph[batch] = robust_prune(points, batch, proposed, degree, alpha)
        source = np.repeat(batch, degree)
        target = graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        touched, sizes = target[heads], np.diff(np.r_[heads, len(target)])
        wide = np.full((len(touched), int(sizes.max(initial=0))), -1, np.int64)
        wide[np.repeat(np.arange(len(touched)), sizes), np.arange(len(target)) - np.repeat(heads, sizes)] = source
        wide[(wide[:, :, None] == graph[touched][:, None, :]).any(axis=2)] = -1
        merged = np.concatenate([graph[touched], wide], axis=1)
        merged = np.take_along_axis(merged, np.argsort(merged < 0, axis=1, kind="stable"), axis=1)
        full = (merged >= 0).sum(axis=1) > degree
        graph[touched[~full]] = merged[~full, :degree]
        for i in range(0, int(full.sum()), TOGETHER):
            rows = np.flatnonzero(full)[i : i + TOGETHER]
            graph[touched[rows]] = robust_prune(points, touched[rows], merged[rows], degree, alpha)
    return graph, start


def build_index(
    vectors: DataFrame, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA,
) -> DataFrame:
    """One row per distinct vector and shard: (shard, node, vector, vec_ids, edges, start, longest).

    Rows go to shards by the hash of their id, so shards have about ``shard_rows`` rows each whatever the data. Equal
    vectors of a shard are one node with several ids, which keeps copies from filling a neighbourhood.
    """
    n = vectors.count()
    shards = max(1, -(-n // shard_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        unique, inverse = np.unique(x, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        by = np.lexsort((pdf["vec_id"].to_numpy(), inverse))
        ids = np.split(pdf["vec_id"].to_numpy()[by], np.cumsum(np.bincount(inverse))[:-1])
        longest = float(np.sqrt((unique**2).sum(axis=1).max()))
        graph, start = build_graph(lifted(unique, longest), degree, beam, alpha)
        return pd.DataFrame({
            "shard": pdf["shard"].iloc[0], "node": np.arange(len(unique)), "vector": list(unique), "vec_ids": ids,
            "edges": [g[g >= 0] for g in graph], "start": start, "longest": longest})

    share_code(vectors.sparkSession)
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    # Many more partitions than shards, so that hardly two shards share a task; a shard is much work on few bytes, so
    # adaptive execution must not put them together by size (it leaves a given number alone).
    return vectors.withColumn("shard", shard).repartition(4 * shards, "shard").groupBy("shard").applyInPandas(
        run, "shard int, node int, vector array<double>, vec_ids array<bigint>, edges array<int>, start int, longest double")


def search(
    index: DataFrame, queries: DataFrame, k: int = 20, beam: int = SEARCH_BEAM, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query, ties to the smaller id.

    Every shard is a task of its own: its graph comes first and is held (``shard_rows`` nodes at most), the queries then
    stream past it. Beyond ``query_block`` queries a shard has one more task for each further block, so copies of the graphs
    stay a small part of what is moved. A task searches with a beam and scores what it found exactly, in double precision;
    the shards' best are then merged per query. A query never finds rows of its own id. Of queries that repeat an id the
    smallest vector counts.
    """
    asked = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    asked = stage(asked, "queries")
    blocks = max(1, -(-asked.count() // query_block))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    nodes = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn(
        "query_id", F.lit(None).cast("bigint"))
    wanted = asked.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    stream = nodes.unionByName(wanted, allowMissingColumns=True).withColumn("task", F.expr(f"shard * {blocks} + block"))
    width = max(beam, k + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, parts = None, []
        for pdf in batches:
            is_node = pdf["query_id"].isna().to_numpy()
            if is_node.any():
                parts.append(pdf[is_node])
            rest = pdf[~is_node]
            if rest.empty or not parts:
                continue
            if graph is None:
                graph = shard_graph(pd.concat(parts, ignore_index=True))
            for at in range(0, len(rest), TOGETHER):
                found = nearest_in_shard(*graph, rest.iloc[at : at + TOGETHER], k, width)
                if found is not None:
                    yield found

    share_code(index.sparkSession)
    # Partitions by task number: no two shards meet in a task, and nodes come before queries.
    found = stream.repartitionById(shards * blocks, F.col("task").cast("int")).sortWithinPartitions(
        F.col("node").asc_nulls_last()).select("query_id", "node", "vector", "vec_ids", "edges", "start", "longest").mapInPandas(
        run, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def shard_graph(nodes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(original vectors, lifted vectors, edges padded with -1, ids of each node, start node) of a shard's index rows."""
    nodes = nodes.sort_values("node")
    exact = np.stack(nodes["vector"].to_numpy())
    graph = np.full((len(nodes), max(1, int(nodes["edges"].map(len).max()))), -1, np.int64)
    for i, e in enumerate(nodes["edges"]):
        graph[i, : len(e)] = e
    return exact, lifted(exact, float(nodes["longest"].iloc[0])), graph, nodes["vec_ids"].to_numpy(), int(nodes["start"].iloc[0])


def nearest_in_shard(
    exact: np.ndarray, points: np.ndarray, graph: np.ndarray, members: np.ndarray, start: int, wanted: pd.DataFrame, k: int,
    width: int,
) -> pd.DataFrame | None:
    """The best of one shard for a few queries: at least ``k`` rows where there are so many, with all ties of the last."""
    q = np.stack(wanted["vector"].to_numpy())
    out = []
    found, _ = beam_search(points, graph, start, np.c_[q, np.zeros(len(q))].astype(np.float32), width)
    for query_id, vector, row in zip(wanted["query_id"].to_numpy().astype(np.int64), q, found, strict=True):
        row = row[row >= 0]
        score = (exact[row] * vector).sum(axis=1)
        ids, scores, taken = [], [], 0
        for i in np.argsort(-score, kind="stable"):
            own = members[row[i]]
            own = own[own != query_id][:k]
            if taken >= k and score[i] < scores[-1][0]:
                break
            if len(own):
                ids.append(own)
                scores.append(np.full(len(own), score[i]))
                taken += len(own)
        if ids:
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": np.concatenate(ids), "score": np.concatenate(scores)}))
    return pd.concat(out, ignore_index=True) if out else None


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding",
    shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM,
) -> DataFrame:
    """Index every usable row of ``vectors`` and search it for the rows of ``queries``.

    Null, zero and non-finite vectors and rows without an id take no part. Empty tables give no rows.
    """
    rows = stage(usable(vectors, key, vector), "vectors")
    index = stage(build_index(rows, shard_rows), "graph")
    return search(index, usable(queries, key, vector), k, beam)
