"""Boosted regression trees grown from gradient histograms."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging_area import forget, stage

BINS = 64  # thresholds per feature: all of its values where there are no more, else quantiles
ACCURACY = 10_000  # of the quantile sketch
NULL = -1  # bin of nulls and NaN


@dataclass
class Node:
    """A node of a tree: its value as a leaf, the weight (sum of second derivatives) it was grown from, and its split. Rows
    with ``feature`` up to ``at`` go left, nulls where ``nulls_left`` says."""

    value: float
    weight: float
    feature: int = -1
    at: float = math.nan
    bin: int = -1
    nulls_left: bool = False
    left: int = -1
    right: int = -1


@dataclass
class Tree:
    """Nodes in the order of their growth, the root first."""

    nodes: list[Node] = field(default_factory=list)

    def leaf_of(self, columns: Sequence[Column], binned: bool = False) -> Column:
        """The number of the leaf (or of the deepest node so far) that a row falls into."""

        def walk(i: int) -> Column:
            node = self.nodes[i]
            if node.left < 0:
                return F.lit(i)
            x = columns[node.feature]
            gap = (x == NULL) if binned else (x.isNull() | F.isnan(x))
            left = F.when(gap, F.lit(node.nulls_left)).otherwise(x <= (node.bin if binned else F.lit(node.at)))
            return F.when(left, walk(node.left)).otherwise(walk(node.right))

        return walk(0)

    def value_of(self, columns: Sequence[Column], binned: bool = False) -> Column:
        def walk(i: int) -> Column:
            node = self.nodes[i]
            if node.left < 0:
                return F.lit(node.value)
            x = columns[node.feature]
            gap = (x == NULL) if binned else (x.isNull() | F.isnan(x))
            left = F.when(gap, F.lit(node.nulls_left)).otherwise(x <= (node.bin if binned else F.lit(node.at)))
            return F.when(left, walk(node.left)).otherwise(walk(node.right))

        return walk(0)

    def to_list(self) -> list[list]:
        return [[n.value, n.weight, n.feature, None if math.isnan(n.at) else n.at, n.bin, n.nulls_left, n.left, n.right] for n in self.nodes]

    @staticmethod
    def of_list(rows: list[list]) -> Tree:
        return Tree([Node(v, w, f, math.nan if at is None else at, b, nl, lo, hi) for v, w, f, at, b, nl, lo, hi in rows])


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Ascending thresholds per feature, made once per fit.

    Features with at most ``bins`` values (by a sketch of their number) get all of them, the others ``bins`` quantiles of a
    sketch. Two jobs for all features; what reaches the driver does not grow with the rows.
    """
    return bin_edges_of(rows, features, [F.lit(True)], bins)[0]


def bin_edges_of(rows: DataFrame, features: Sequence[str], kept: Sequence[Column], bins: int = BINS) -> list[list[list[float]]]:
    """``bin_edges`` of the rows that each condition of ``kept`` holds for, in the same two jobs."""
    known = [F.when(keep & ~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for keep in kept for f in features]
    cuts = [i / bins for i in range(1, bins + 1)]
    row = rows.agg(*[x for i, c in enumerate(known) for x in (
        F.approx_count_distinct(c, 0.02).alias(f"n{i}"), F.percentile_approx(c, cuts, ACCURACY).alias(f"q{i}"))]).first()
    few = [i for i in range(len(known)) if row[f"n{i}"] <= 0.95 * bins]
    edges = [sorted({x + 0.0 for x in row[f"q{i}"] or []}) for i in range(len(known))]
    if few:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), known[i].alias("x")) for i in few])
        exact: dict[int, list[float]] = {i: [] for i in few}
        for r in rows.select(F.explode(pairs).alias("p")).select("p.i", "p.x").where("x is not null").distinct().collect():
            exact[r["i"]].append(r["x"] + 0.0)
        edges = [sorted(set(exact[i])) if i in exact else e for i, e in enumerate(edges)]
    return [edges[k * len(features):(k + 1) * len(features)] for k in range(len(kept))]


def bin_of(x: Column, edges: Sequence[float]) -> Column:
    """The first threshold that is not below the value, found by bisection; ``NULL`` for nulls and NaN."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x <= F.lit(float(edges[mid])), search(low, mid)).otherwise(search(mid + 1, high))

    return F.when(x.isNull() | F.isnan(x), F.lit(NULL)).otherwise(search(0, len(edges))).cast("smallint")


def binned(rows: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]], *kept: Column | str) -> DataFrame:
    """Columns ``bin_0``, ``bin_1``, ... of the features, beside those ``kept``."""
    return rows.select(*[bin_of(F.col(f).cast("double"), e).alias(f"bin_{i}") for i, (f, e) in enumerate(zip(features, edges, strict=True))], *kept)


def _histograms(rows: DataFrame, trees: Sequence[Tree], sums: Sequence[tuple[str, str]], wanted: Sequence[tuple[int, int]],
                sizes: Sequence[Sequence[int]]) -> dict[tuple[int, int], list[np.ndarray]]:
    """Per (tree, node) and feature an array of (gradients, second derivatives, rows) by bin, nulls first: one aggregation
    that combines on the map side, whose result has bins x features rows per node."""
    bins = [F.col(f"bin_{i}") for i in range(len(sizes[0]))]
    parts = []
    for k, (g, h) in enumerate(sums):
        nodes = [n for t, n in wanted if t == k]
        if nodes:
            at = trees[k].leaf_of(bins, binned=True)
            parts.append(F.when(at.isin(nodes), F.struct(F.lit(k).alias("tree"), at.alias("node"), F.col(g).alias("g"), F.col(h).alias("h"))))
    each = rows.select(F.array(*bins).alias("bins"), F.explode(F.array_compact(F.array(*parts))).alias("s"))
    return _sums_by_bin(each.select("s.*", "bins"), wanted, sizes)


def _histograms_by_fit(rows: DataFrame, trees: Sequence[Tree], wanted: Sequence[tuple[int, int]],
                       sizes: Sequence[Sequence[int]]) -> dict[tuple[int, int], list[np.ndarray]]:
    """``_histograms`` of rows that belong to one tree each, the one that their column ``fit`` names."""
    bins = [F.col(f"bin_{i}") for i in range(len(sizes[0]))]
    node = F.lit(None).cast("int")
    for k in sorted({t for t, _ in wanted}):
        at = trees[k].leaf_of(bins, binned=True)
        node = F.when(F.col("fit") == k, F.when(at.isin([n for t, n in wanted if t == k]), at)).otherwise(node)
    each = rows.select(F.col("fit").alias("tree"), node.alias("node"), "g", "h", F.array(*bins).alias("bins"))
    return _sums_by_bin(each.where(F.col("node").isNotNull()), wanted, sizes)


def _sums_by_bin(each: DataFrame, wanted: Sequence[tuple[int, int]], sizes: Sequence[Sequence[int]]) -> dict[tuple[int, int], list[np.ndarray]]:
    found = each.select("tree", "node", "g", "h", F.posexplode("bins").alias("feature", "bin")).groupBy(
        "tree", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect()
    out = {key: [np.zeros((size + 2, 3)) for size in sizes[key[0]]] for key in wanted}
    for r in found:
        out[r["tree"], r["node"]][r["feature"]][r["bin"] + 1] = (r["g"], r["h"], r["n"])
    return out


def _best_split(histogram: list[np.ndarray], ridge: float, least: float) -> tuple[float, int, int, bool, np.ndarray, np.ndarray] | None:
    """(gain, feature, bin, whether nulls go left, sums left, sums right) of the best split; the first of equal ones in the
    order of feature, bin, nulls right before left. Without nulls the heavier side takes them."""
    best = None
    for f, by_bin in enumerate(histogram):
        whole, gap = by_bin.sum(axis=0), by_bin[0]
        below = np.cumsum(by_bin[1:-1], axis=0)
        for k in np.flatnonzero(by_bin[1:-1, 2]):
            for nulls_left in ((False, True) if gap[2] else (False,)):
                left = below[k] + (gap if nulls_left else 0)
                right = whole - left
                if not left[2] or not right[2] or left[1] < least or right[1] < least or min(left[1], right[1]) + ridge <= 0:
                    continue
                gain = sum(s[0] ** 2 / (s[1] + ridge) for s in (left, right)) - whole[0] ** 2 / (whole[1] + ridge)
                if gain > 1e-12 * abs(whole[1]) and (best is None or gain > best[0]):
                    best = gain, f, int(k), bool(nulls_left if gap[2] else left[1] > right[1]), left, right
    return best


def _local_leaves(tree: Tree, bins: np.ndarray) -> np.ndarray:
    at = np.zeros(len(bins), int)
    for i, node in enumerate(tree.nodes):  # parents stand before their children
        if node.left >= 0:
            x, mine = bins[:, node.feature], at == i
            left = np.where(x == NULL, node.nulls_left, x <= node.bin)
            at[mine] = np.where(left[mine], node.left, node.right)
    return at


def _local_histograms(bins: np.ndarray, sums: Sequence[tuple[np.ndarray, np.ndarray]]):
    """What ``_histograms`` does, over arrays that the driver holds."""

    def run(trees: Sequence[Tree], wanted: Sequence[tuple[int, int]], sizes: Sequence[Sequence[int]]):
        out = {}
        for k, n in wanted:
            mine = _local_leaves(trees[k], bins) == n
            weights = [sums[k][0][mine], sums[k][1][mine], np.ones(mine.sum())]
            out[k, n] = [np.stack([np.bincount(bins[mine, f] + 1, x, size + 2) for x in weights], axis=1) for f, size in enumerate(sizes[k])]
        return out

    return run


def grow(
    rows: DataFrame, edges: Sequence[Sequence[float]], sums: Sequence[tuple[str, str]], max_depth: int, ridge: float = 0.0,
    min_weight: float = 0.0,
) -> list[Tree]:
    """One tree for each pair of columns (gradient, second derivative) of binned ``rows``, all grown side by side."""
    return _grow(lambda trees, wanted, sizes: _histograms(rows, trees, sums, wanted, sizes), [edges] * len(sums), max_depth, ridge, min_weight)


def grow_by_fit(
    rows: DataFrame, edges: Sequence[Sequence[Sequence[float]]], max_depth: int, ridge: float = 0.0, min_weight: float = 0.0,
) -> list[Tree]:
    """One tree for each fit, whose binned rows (``g``, ``h``) carry its number in ``fit``; each fit has edges of its own."""
    return _grow(lambda trees, wanted, sizes: _histograms_by_fit(rows, trees, wanted, sizes), edges, max_depth, ridge, min_weight)


def _grow(histograms, edges: Sequence[Sequence[Sequence[float]]], max_depth: int, ridge: float, min_weight: float) -> list[Tree]:
    """Grows a tree for each entry of ``edges`` side by side from ``histograms(trees, wanted nodes, bins per tree and feature)``.

    A level is one aggregation: of every two siblings only the smaller one is summed, the other is what remains of
    their parent. Splits are chosen on the driver from the histograms, nulls take the side that gains more.
    ``min_weight`` is the least share of the whole weight that a node may have.
    """
    n_trees, sizes = len(edges), [[len(e) for e in of_tree] for of_tree in edges]
    trees = [Tree([Node(0.0, 0.0)]) for _ in range(n_trees)]
    summed = {(k, 0): None for k in range(n_trees)}  # node -> (parent, sibling) that it is subtracted for, if any
    least = [0.0] * n_trees
    for level in range(max(1, max_depth)):
        if not summed:
            break
        found = histograms(trees, list(summed), sizes)
        for key, rest in summed.items():
            if rest is not None:
                parent, sibling = rest
                found[key[0], sibling] = [a - b for a, b in zip(parent, found[key], strict=True)]
                for h in found[key[0], sibling]:
                    h[h[:, 2] == 0] = 0.0  # what cancels out is nothing
        summed = {}
        for (k, n), histogram in sorted(found.items()):
            node = trees[k].nodes[n]
            if level == 0:
                whole = histogram[0].sum(axis=0)
                least[k] = min_weight * whole[1]
                node.weight, node.value = float(whole[1]), float(-whole[0] / (whole[1] + ridge)) if whole[1] + ridge > 0 else 0.0
            split = _best_split(histogram, ridge, least[k]) if max_depth > 0 else None
            if split is None:
                continue
            _, node.feature, node.bin, node.nulls_left, left, right = split
            node.at = float(edges[k][node.feature][node.bin])
            node.left, node.right = len(trees[k].nodes), len(trees[k].nodes) + 1
            trees[k].nodes += [Node(float(-s[0] / (s[1] + ridge)), float(s[1])) for s in (left, right)]
            small, large = (node.left, node.right) if left[2] <= right[2] else (node.right, node.left)
            summed[k, small] = (histogram, large)
    return trees


def total(trees: Sequence[Tree], columns: Sequence[Column], rate: float, start: float = 0.0) -> Column:
    """``start`` plus ``rate`` times the sum of the trees."""
    out = F.lit(start)
    for tree in trees:
        out = out + F.lit(rate) * tree.value_of(columns)
    return out


@dataclass
class BoostedRegression:
    """Least-squares boosting: for each target a start value and trees."""

    features: list[str]
    starts: list[float]
    trees: list[list[Tree]]
    rate: float

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "starts": self.starts, "rate": self.rate,
                           "trees": [[t.to_list() for t in trees] for trees in self.trees]})

    @staticmethod
    def of_json(text: str) -> BoostedRegression:
        info = json.loads(text)
        return BoostedRegression(info["features"], info["starts"], [[Tree.of_list(t) for t in trees] for trees in info["trees"]], info["rate"])

    def predict(self, target: int) -> Column:
        return total(self.trees[target], [F.col(f).cast("double") for f in self.features], self.rate, self.starts[target])


LOCAL_CELLS = 1 << 16  # distinct combinations of bins that are boosted on the driver, at most


def fit_boosted_regression(
    rows: DataFrame, features: Sequence[str], targets: Sequence[Column], weight: Column | None = None, rounds: int = 20,
    max_depth: int = 4, rate: float = 0.2, ridge: float = 0.0, bins: int = BINS, local_cells: int = LOCAL_CELLS,
) -> BoostedRegression:
    """Boosts all ``targets`` side by side.

    Rows with a null target or weight are left out; null features take part. Least squares needs of the rows only the
    weight and the weighted targets of each combination of bins, so they are aggregated to such cells once. Up to
    ``local_cells`` of them go to the driver, which grows the trees at once; more stay in Spark, where a round is one
    aggregation per level for all targets. Both give the same trees.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    ys = [f"y_{k}" for k in range(len(targets))]
    known = rows.select(*[F.col(f).cast("double").alias(f) for f in features], w.alias("w_"),
                        *[t.cast("double").alias(y) for t, y in zip(targets, ys, strict=True)]).na.drop(subset=["w_", *ys])
    known = stage(known, "regression-rows")
    edges = bin_edges(known, features, bins)
    names = [f"bin_{i}" for i in range(len(features))]
    cells = binned(known, features, edges, "w_", *ys).groupBy(*names).agg(
        F.sum("w_").alias("w"), *[F.sum(F.col("w_") * F.col(y)).alias(y) for y in ys])
    cells = stage(cells, "regression-cells")
    forget(known)
    row = cells.agg(F.count("*").alias("n"), *[(F.sum(y) / F.sum("w")).alias(y) for y in ys]).first()
    starts = [float(row[y] or 0.0) for y in ys]
    boost = _boost_locally if row["n"] <= local_cells else _boost_in_spark
    grown = boost(cells, edges, names, ys, starts, rounds, max_depth, rate, ridge)
    return BoostedRegression(list(features), starts, grown, rate)


def _boost_locally(cells, edges, names, ys, starts, rounds, max_depth, rate, ridge) -> list[list[Tree]]:
    held = cells.toPandas()  # ``LOCAL_CELLS`` rows at most
    forget(cells)
    bins, w = held[names].to_numpy(int).reshape(len(held), len(names)), held["w"].to_numpy(float)
    now = [np.full(len(held), s) for s in starts]
    grown: list[list[Tree]] = [[] for _ in ys]
    for _ in range(rounds):
        sums = [(w * p - held[y].to_numpy(float), w) for p, y in zip(now, ys, strict=True)]
        for k, tree in enumerate(_grow(_local_histograms(bins, sums), [edges] * len(ys), max_depth, ridge, 0.0)):
            grown[k].append(tree)
            now[k] = now[k] + rate * np.array([n.value for n in tree.nodes])[_local_leaves(tree, bins)]
    return grown


def _boost_in_spark(cells, edges, names, ys, starts, rounds, max_depth, rate, ridge) -> list[list[Tree]]:
    columns = [F.col(c) for c in names]
    stored = cells.withColumns({f"p_{k}": F.lit(s) for k, s in enumerate(starts)})
    grown: list[list[Tree]] = [[] for _ in ys]
    for _ in range(rounds):
        step = stored.withColumns({f"g_{k}": F.col("w") * F.col(f"p_{k}") - F.col(y) for k, y in enumerate(ys)})
        for k, tree in enumerate(grow(step, edges, [(f"g_{k}", "w") for k in range(len(ys))], max_depth, ridge)):
            grown[k].append(tree)
        # Predictions are stored after every round, so plans stay short.
        after = stored.withColumns({
            f"p_{k}": F.col(f"p_{k}") + F.lit(rate) * trees[-1].value_of(columns, binned=True) for k, trees in enumerate(grown)})
        before, stored = stored, stage(after, "regression-cells")
        forget(before)
    forget(stored)
    return grown
