import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlife.functions import ordering
from fleetlife.functions.ordering import number_by_hash, smallest_by_hash
from fleetlife.plans import cox, evaluate, explain, km, trees


def regression_rows(spark, n=600, seed=4):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 9, n).astype(float), rng.normal(size=n).round(2)
    rows = [(None if i % 7 == 0 else float(a[i]), float("nan") if i % 11 == 0 else float(b[i]), float(1 + i % 3),
             float((5 if i % 7 == 0 else a[i] > 4) + 0.1 * b[i]), float(b[i] > 0)) for i in range(n)]
    return spark.createDataFrame(rows, "a double, b double, w double, y double, z double")


def test_edges_are_all_values_or_quantiles(spark):
    rows = spark.range(5000).select((F.col("id") % 6).cast("double").alias("few"), F.col("id").cast("double").alias("many"),
                                    F.lit(None).cast("double").alias("none"), F.when(F.col("id") == 3, float("nan")).otherwise(1.0).alias("one"))
    few, many, none, one = trees.bin_edges(rows, ["few", "many", "none", "one"], bins=10)
    assert few == [0, 1, 2, 3, 4, 5] and none == [] and one == [1.0]
    assert len(many) == 10 and many == pytest.approx([500 * i for i in range(1, 11)], abs=10)


def test_bins_find_the_first_threshold(spark):
    rows = spark.createDataFrame([(x,) for x in (None, float("nan"), -5.0, 1.0, 1.5, 2.0, 4.0, 9.0)], "x double")
    got = [r.b for r in rows.select(trees.bin_of(F.col("x"), [1.0, 2.0, 4.0]).alias("b")).collect()]
    assert got == [-1, -1, 0, 0, 1, 1, 2, 3]


def test_trees_are_the_same_on_the_driver_and_in_spark(spark):
    rows = regression_rows(spark)
    fits = [trees.fit_boosted_regression(rows, ["a", "b"], [F.col("y"), F.col("z")], F.col("w"), rounds=3, max_depth=3, local_cells=n) for n in (10**6, 0)]
    for one, other in zip(*(f.trees for f in fits), strict=True):
        for s, t in zip(one, other, strict=True):
            assert [(n.feature, n.bin, n.nulls_left, n.left) for n in s.nodes] == [(n.feature, n.bin, n.nulls_left, n.left) for n in t.nodes]
            assert [n.value for n in s.nodes] == pytest.approx([n.value for n in t.nodes])


def test_first_split_agrees_with_brute_force(spark):
    rows = regression_rows(spark, 200)
    model = trees.fit_boosted_regression(rows, ["a", "b"], [F.col("y")], F.col("w"), rounds=1, max_depth=1, rate=1.0, bins=300)
    held = rows.collect()
    w, y = np.array([r.w for r in held]), np.array([r.y for r in held])
    g, best = w * ((w * y).sum() / w.sum() - y), (-1.0,)
    for f in ("a", "b"):
        x = np.array([np.nan if r[f] is None else r[f] for r in held])
        for at in np.unique(x[~np.isnan(x)]):
            for nulls_left in (False, True):
                left = np.where(np.isnan(x), nulls_left, x <= at)
                if 0 < left.sum() < len(left):
                    gain = sum(g[s].sum() ** 2 / w[s].sum() for s in (left, ~left))
                    best = max(best, (gain, f, at, nulls_left))
    root = model.trees[0][0].nodes[0]
    assert (model.features[root.feature], root.at, root.nulls_left) == best[1:]


def test_null_features_are_learned_from(spark):
    model = trees.fit_boosted_regression(regression_rows(spark), ["a", "b"], [F.col("y")], rounds=30, max_depth=3)
    model = trees.BoostedRegression.of_json(model.to_json())
    out = regression_rows(spark).withColumn("p", model.predict(0)).collect()
    assert all(abs(r.p - r.y) < 0.4 for r in out) and all(r.p > 4 for r in out if r.a is None)
    empty = trees.fit_boosted_regression(regression_rows(spark).limit(0), ["a"], [F.col("y")], rounds=2)
    assert regression_rows(spark).select(empty.predict(0).alias("p")).distinct().collect() == [(0.0,)]


def test_boosted_cox_uses_gaps(spark):
    rng = np.random.default_rng(1)
    x = rng.random(500)
    gap = rng.random(500) < 0.3
    t = rng.exponential(np.where(gap, 10.0, 1 + x))
    rows = spark.createDataFrame([(None if g else float(a), float(b), True) for g, a, b in zip(gap, x, t, strict=True)],
                                 "x double, duration_worked double, failed boolean")
    model = cox.fit_boosted_cox(rows, ["x"], rounds=4, max_depth=2, checkpoint_every=2)
    out = model.with_log_hazard(rows).groupBy(F.col("x").isNull().alias("gap")).agg(F.avg("log_hazard").alias("h")).collect()
    level = {r.gap: r.h for r in out}
    assert level[True] < level[False] - 0.5
    explained, base = explain.tree_contributions(model.with_log_hazard(rows), model)
    assert all(r.phi_x + base == pytest.approx(r.log_hazard) for r in explained.collect())


@pytest.mark.parametrize("interactions", [False, True])
def test_deep_trees_are_explained_in_batches(spark, monkeypatch, interactions):
    rows = regression_rows(spark, 300).withColumn("c", F.col("w") * 2).withColumn("phi_old", F.lit(1))
    reg = trees.fit_boosted_regression(rows, ["a", "b", "c"], [F.col("y")], rounds=2, max_depth=4)
    model = cox.BoostedCoxModel(["a", "b", "c"], reg.trees[0], reg.rate)
    monkeypatch.setattr(explain, "MOST_LEAVES", 10**6)
    plain, base = explain.tree_contributions(model.with_log_hazard(rows), model, interactions=interactions)
    monkeypatch.setattr(explain, "MOST_LEAVES", 0)
    batch, same = explain.tree_contributions(model.with_log_hazard(rows), model, interactions=interactions)
    assert plain.columns == batch.columns and base == same
    for r, q in zip(plain.collect(), batch.collect(), strict=True):
        assert [r[c] for c in plain.columns if c.startswith("phi_")] == pytest.approx([q[c] for c in plain.columns if c.startswith("phi_")], abs=1e-12)
        assert r.phi_a + r.phi_b + r.phi_c + base == pytest.approx(r.log_hazard)


def test_a_tree_of_depth_twelve_is_explained_quickly(spark):
    rng = np.random.default_rng(3)
    names = [f"f{i}" for i in range(14)]
    x = rng.random((4000, 14)).round(3)
    y = (x[:, :7] > 0.5) @ (2.0 ** np.arange(7)) + x[:, 7:] @ rng.normal(size=7)
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], ", ".join(f"{n} double" for n in names) + ", y double")
    reg = trees.fit_boosted_regression(rows, names, [F.col("y")], rounds=1, max_depth=12, rate=1.0, bins=16)
    model = cox.BoostedCoxModel(names, reg.trees[0], 1.0)
    leaves = explain.tree_leaves(model.trees[0])
    assert len(leaves) > 300 and max(len(leaf.paths) for leaf in leaves) >= 9
    out, base = explain.tree_contributions(model.with_log_hazard(rows).limit(200), model)
    for r in out.collect():
        assert sum(r[f"phi_{n}"] for n in names) + base == pytest.approx(r.log_hazard)


def test_folds_fitted_together_equal_single_fits(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2))
    t = rng.exponential(np.exp(-x @ [0.8, -0.4])).round(2) + 0.01
    rows = spark.createDataFrame([(i, *map(float, r), float(u), bool(i % 5)) for i, (r, u) in enumerate(zip(x, t, strict=True))],
                                 "id int, a double, b double, duration_worked double, failed boolean")
    fold = F.col("id") % 3
    together = cox.fit_cox_folds(rows, ["a", "b"], fold, 3)
    for k, model in enumerate(together):
        alone = cox.fit_cox(rows.where(fold != k), ["a", "b"])
        assert model.coefficients == pytest.approx(alone.coefficients, rel=1e-6) and model.means == pytest.approx(alone.means)
        assert model.log_likelihood == pytest.approx(alone.log_likelihood) and model.converged
    out = evaluate.cross_validate_cox(rows, ["a", "b"], fold, 3)
    for k, value in enumerate(out["folds"]):
        mine = rows.where(fold == k).withColumn("score", -together[k].log_hazard())
        assert value == pytest.approx(evaluate.concordance(mine).first().concordance)
    with pytest.raises(ValueError, match="no failures"):
        cox.fit_cox_folds(rows.withColumn("failed", F.col("id") % 3 == 0), ["a"], fold, 3)


def test_samples_keep_rows_with_null_parts(spark):
    rows = spark.createDataFrame([(i, [True, False, None][i % 3]) for i in range(12)], "id int, part boolean")
    assert smallest_by_hash(rows, ["id"], F.lit(100), 0, ["part"]).count() == 12
    kept = smallest_by_hash(rows, ["id"], F.lit(2), 0, ["part"]).groupBy("part").count().collect()
    assert sorted(r["count"] for r in kept) == [2, 2, 2]
    assert sorted(r.n for r in number_by_hash(rows.select("id"), ["id"], "n").collect()) == list(range(1, 13))


def test_fractional_axes_cut_themselves(spark, monkeypatch):
    rng = np.random.default_rng(8)
    t = np.r_[rng.exponential(50, 700), rng.integers(1, 9, 100), [np.nan]]
    rows = spark.createDataFrame([(float(x), bool(i % 3), float(i % 7)) for i, x in enumerate(t)], "duration_worked double, failed boolean, x double")
    rows = rows.repartition(3)
    monkeypatch.setattr(ordering, "AXIS_ROWS", 1 << 14)
    assert ordering.axis_bounds(rows.where("duration_worked = floor(duration_worked)"), "duration_worked") is None
    assert ordering.axis_bounds(rows.select(F.lit(1).alias("d")), "d") is None
    assert ordering.axis_bounds(rows.limit(0), "duration_worked") is None

    def all_results():
        known = rows.where("not isnan(duration_worked)")
        model = cox.fit_cox(known, ["x"])
        curve = [tuple(r) for r in km.survival_curve(rows).orderBy("duration", "at_risk").collect()]
        base = [tuple(r) for r in cox.baseline_hazard(known, F.col("x") / 10).orderBy("t").collect()]
        boosted = cox.fit_boosted_cox(known, ["x"], rounds=2, max_depth=2).trees
        return model.coefficients, curve, base, [n.value for tree in boosted for n in tree.nodes]

    whole = all_results()
    monkeypatch.setattr(ordering, "AXIS_ROWS", 40)
    bounds = ordering.axis_bounds(rows, "duration_worked")
    assert 10 < len(bounds) < 25 and bounds == sorted(bounds)
    for a, b in zip(whole, all_results(), strict=True):
        flat = lambda x: [v for r in x for v in (r if isinstance(r, tuple) else (r,))]
        assert [v is None for v in flat(a)] == [v is None for v in flat(b)]
        assert [v for v in flat(a) if v is not None] == pytest.approx([v for v in flat(b) if v is not None], rel=1e-9, abs=1e-12)
