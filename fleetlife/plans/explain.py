"""Why a prediction is what it is."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import smallest_by_hash
from .cox import BoostedCoxModel
from .trees import Tree

OTHER = "$other"


def with_compact_explanation(
    df: DataFrame, features: Sequence[str], out: str, threshold_ratio: float = 50.0, prefix: str = "",
) -> DataFrame:
    """Adds a map of significant contributions (columns ``<prefix><feature>``): shares of their sum, those above the
    largest magnitude over ``threshold_ratio`` kept, the rest summed under ``$other``; null when the sum is zero.

    The feature list is known, so shares and limit are plain columns inside code generation.
    """
    shares = {f: f"_share_{i}" for i, f in enumerate(features)}
    total = reduce(lambda a, b: a + b, [F.col(f"{prefix}{f}").cast("double") for f in features])
    df = df.withColumn("_total", F.when(total != 0, total))
    df = df.withColumns({s: F.col(f"{prefix}{f}") / F.col("_total") for f, s in shares.items()})
    sizes = [F.abs(s) for s in shares.values()]
    df = df.withColumn("_limit", (F.greatest(*sizes) if len(sizes) > 1 else sizes[0]) / F.lit(threshold_ratio))
    rest = reduce(lambda a, b: a + b, [
        F.when(F.abs(s) > F.col("_limit"), F.lit(0.0)).otherwise(F.col(s)) for s in shares.values()])
    entries = [F.when(F.abs(s) > F.col("_limit"), F.struct(F.lit(f).alias("key"), F.col(s).alias("value"))) for f, s in shares.items()]
    other = F.struct(F.lit(OTHER).alias("key"), rest.alias("value"))
    explained = F.map_from_entries(F.array_compact(F.array(*entries, other)))
    df = df.withColumn(out, F.when(F.col("_total").isNotNull(), explained))
    return df.drop("_total", "_limit", *shares.values())


def mean_explanation(contributions: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: root mean square with the sign of the mean, one row with a column per feature."""
    return contributions.agg(*[
        (F.sqrt(F.avg(F.col(f) * F.col(f))) * F.signum(F.avg(f))).alias(f) for f in features])


def linear_contributions(rows: DataFrame, contributions: dict[str, Column], prefix: str = "phi_") -> DataFrame:
    return rows.withColumns({f"{prefix}{f}": c for f, c in contributions.items()})


@dataclass
class Leaf:
    """A leaf of a regression tree: its value, and per feature on its path the interval (above, up to], the share of the
    training weight that the path's splits on that feature let through, and whether nulls pass them all."""

    value: float
    paths: dict[int, tuple[float, float, float, bool]]


def tree_leaves(tree: Tree) -> list[Leaf]:
    leaves: list[Leaf] = []
    todo: list[tuple[int, dict[int, tuple[float, float, float, bool]]]] = [(0, {})]
    while todo:
        at, paths = todo.pop()
        node = tree.nodes[at]
        if node.left < 0:
            leaves.append(Leaf(node.value, paths))
            continue
        low, high, share, nulls = paths.get(node.feature, (-math.inf, math.inf, 1.0, True))
        for child, interval, takes in ((node.right, (max(low, node.at), high), not node.nulls_left),
                                       (node.left, (low, min(high, node.at)), node.nulls_left)):
            part = tree.nodes[child].weight / (tree.nodes[node.left].weight + tree.nodes[node.right].weight)
            todo.append((child, paths | {node.feature: (*interval, share * part, nulls and takes)}))
    return leaves


def _worth(leaf: Leaf, inside: int, known: int) -> float:
    """What the leaf adds to the expected value when the features of ``known`` are given; bit k of ``inside`` tells whether
    the k-th feature of the path lies in its interval. An unknown feature follows both ways by their shares."""
    worth = leaf.value
    for k, (_, _, share, _) in enumerate(leaf.paths.values()):
        worth *= float(inside >> k & 1) if known >> k & 1 else share
    return worth


def _shapley(leaf: Leaf, inside: int, i: int) -> float:
    m = len(leaf.paths)
    rest = [s for s in range(1 << m) if not s >> i & 1]
    return sum(math.factorial(s.bit_count()) * math.factorial(m - s.bit_count() - 1) / math.factorial(m)
               * (_worth(leaf, inside, s | 1 << i) - _worth(leaf, inside, s)) for s in rest)


def _interaction(leaf: Leaf, inside: int, i: int, j: int) -> float:
    m, a, b = len(leaf.paths), 1 << i, 1 << j
    rest = [s for s in range(1 << m) if not s & (a | b)]
    return sum(math.factorial(s.bit_count()) * math.factorial(m - s.bit_count() - 2) / (2 * math.factorial(m - 1)) * (
        _worth(leaf, inside, s | a | b) - _worth(leaf, inside, s | a) - _worth(leaf, inside, s | b) + _worth(leaf, inside, s))
        for s in rest)


MOST_PATH, MOST_LEAVES = 4, 32  # of a model whose contributions are plain columns; larger plans take long to compile


def path_products(leaves: Sequence[Leaf], x: np.ndarray, interactions: bool = False) -> dict[tuple[int, ...], np.ndarray]:
    """Shapley values of the leaves' sum for the rows of ``x`` (NaN for null), in time linear in leaves x depth.

    A leaf's worth is its value times one factor per path feature: whether it lies in its interval, if known, else its share.
    The Shapley weights of all sets are the integral over u from 0 to 1 of the product of share + u (inside - share), a
    polynomial that a Gauss-Legendre rule with half as many points as features integrates exactly. A feature's own factor
    is divided out, which cannot be zero: shares are positive and the points lie inside.
    """
    out: dict[tuple[int, ...], np.ndarray] = {}
    for leaf in leaves:
        order = list(leaf.paths)
        if not order:
            continue
        points, weights = np.polynomial.legendre.leggauss(len(order) // 2 + 1)
        points, weights = (points + 1) / 2, weights / 2
        share = np.array([leaf.paths[f][2] for f in order])
        inside = np.empty((len(x), len(order)))
        for k, f in enumerate(order):
            low, high, _, nulls = leaf.paths[f]
            inside[:, k] = np.where(np.isnan(x[:, f]), nulls, (x[:, f] > low) & (x[:, f] <= high))
        gap = inside - share
        factors = share + gap * points[:, None, None]
        worth = factors.prod(axis=2) * weights[:, None] * leaf.value
        for i, f in enumerate(order):
            without = worth / factors[:, :, i]
            out[f,] = out.get((f,), 0.0) + gap[:, i] * without.sum(axis=0)
            if interactions:
                for j in range(i + 1, len(order)):
                    key = tuple(sorted((f, order[j])))
                    out[key] = out.get(key, 0.0) + gap[:, i] * gap[:, j] * (without / factors[:, :, j]).sum(axis=0) / 2
    return out


def tree_contributions(
    rows: DataFrame, model: BoostedCoxModel, prefix: str = "phi_", interactions: bool = False,
) -> tuple[DataFrame, float]:
    """(rows with one exact Shapley value per feature, base value) of a sum of trees.

    The value of a set of features is the trees' mean over the training weight with these features given. Base value and
    contributions of a row add up to its prediction. ``interactions`` adds ``<prefix><f>__<g>`` for every pair (f before
    g): half of what both add together. There are no background rows and no shuffle. A leaf depends only on which of its
    path features lie in their intervals, so for small trees its contributions are a table indexed by those bits, as
    plain columns; larger models go through ``path_products`` in Arrow batches.
    """
    leaves = [Leaf(model.rate * leaf.value, leaf.paths) for tree in model.trees for leaf in tree_leaves(tree)]
    base = sum(_worth(leaf, 0, 0) for leaf in leaves)
    n = len(model.features)
    keys = [(i,) for i in range(n)] + ([(i, j) for i in range(n) for j in range(i + 1, n)] if interactions else [])
    names = [prefix + "__".join(model.features[i] for i in key) for key in keys]
    if len(leaves) > MOST_LEAVES or max((len(leaf.paths) for leaf in leaves), default=0) > MOST_PATH:
        return _contributions_by_batch(rows, model, leaves, keys, names, interactions), base
    terms: dict[tuple[int, ...], list[Column]] = {}
    for leaf in leaves:
        order = list(leaf.paths)
        if not order:
            continue
        flags = []
        for k, (f, (low, high, _, nulls)) in enumerate(leaf.paths.items()):
            x = F.col(model.features[f]).cast("double")
            hit = F.when(x.isNull() | F.isnan(x), F.lit(nulls)).otherwise((x > F.lit(low)) & (x <= F.lit(high)))
            flags.append(F.when(hit, 1 << k).otherwise(0))
        inside = reduce(lambda a, b: a + b, flags)
        tables = {(f,): [_shapley(leaf, b, i) for b in range(1 << len(order))] for i, f in enumerate(order)}
        if interactions:
            tables |= {tuple(sorted((f, g))): [_interaction(leaf, b, i, j) for b in range(1 << len(order))]
                       for i, f in enumerate(order) for j, g in enumerate(order) if i < j}
        for key, table in tables.items():
            terms.setdefault(key, []).append(F.get(F.array(*[F.lit(x) for x in table]), inside))
    out = {name: reduce(lambda a, b: a + b, terms.get(key, []), F.lit(0.0)) for key, name in zip(keys, names, strict=True)}
    return rows.withColumns(out), base


def _contributions_by_batch(rows: DataFrame, model: BoostedCoxModel, leaves, keys, names, interactions: bool) -> DataFrame:
    def run(*columns: pd.Series) -> pd.DataFrame:
        x = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
        found = path_products(leaves, x, interactions)
        return pd.DataFrame({f"c{i}": found.get(key, np.zeros(len(x))) for i, key in enumerate(keys)})

    run.__annotations__ = {"columns": pd.Series, "return": pd.DataFrame}
    explain = F.pandas_udf(run, ", ".join(f"c{i} double" for i in range(len(keys))))
    phi = explain(*[F.col(f).cast("double") for f in model.features])
    own = [F.col(f"row.{c}") for c in rows.columns if c not in names]
    return rows.select(F.struct("*").alias("row"), phi.alias("phi")).select(
        *own, *[F.col(f"phi.c{i}").alias(name) for i, name in enumerate(names)])


def sampled_contributions(
    rows: DataFrame, key: Sequence[str], features: Sequence[str], predict: Callable[[DataFrame], DataFrame],
    background: DataFrame, samples: int = 16, seed: int = 0, prediction: str = "log_hazard", prefix: str = "phi_",
) -> DataFrame:
    """Sampled Shapley values of any predictor that adds the column ``prediction``.

    ``samples`` background rows (chosen by hash, a fixed small number) and as many feature orders are literals of the
    plan. Each distinct feature combination walks every order from the background row to itself; neighbouring
    predictions differ by one feature. The contributions of a row sum to its prediction minus the background's mean.
    """
    features = list(features)
    base = smallest_by_hash(background.select(*features).distinct(), features, F.lit(samples), seed)
    points = [[float(r[f]) for f in features] for r in base.collect()]  # at most ``samples`` rows
    rng = random.Random(seed)
    walks = []
    for z in points:
        order = features[:]
        rng.shuffle(order)
        for step in range(len(features) + 1):
            taken = order[:step]
            gains = order[step - 1] if step > 0 else None
            loses = order[step] if step < len(features) else None
            walks.append((z, taken, gains, loses))
    walk_type = "struct<z:array<double>,own:array<boolean>,gains:string,loses:string>"
    literal = F.array(*[
        F.struct(
            F.array(*[F.lit(v) for v in z]).alias("z"), F.array(*[F.lit(f in taken) for f in features]).alias("own"),
            F.lit(gains).cast("string").alias("gains"), F.lit(loses).cast("string").alias("loses"),
        ).cast(walk_type) for z, taken, gains, loses in walks])
    own = [F.col(f).cast("double").alias(f"_x_{f}") for f in features]
    combos = rows.select(*own).distinct().withColumn("_w", F.explode(literal))
    mixed = combos.select(
        *[f"_x_{f}" for f in features], "_w.gains", "_w.loses",
        *[F.when(F.col("_w.own")[i], F.col(f"_x_{f}")).otherwise(F.col("_w.z")[i]).alias(f) for i, f in enumerate(features)])
    value = F.col(prediction) / len(points)
    keys = [f"_x_{f}" for f in features]
    phi = predict(mixed).groupBy(*keys).agg(*[
        (F.sum(F.when(F.col("gains") == f, value).otherwise(0.0)) - F.sum(F.when(F.col("loses") == f, value).otherwise(0.0)))
        .alias(f"{prefix}{f}") for f in features])
    match = [F.col(f).cast("double") == F.col(f"_x_{f}") for f in features]
    return rows.join(phi, match).select(*rows.columns, *[f"{prefix}{f}" for f in features])
