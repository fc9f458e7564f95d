"""Cross-validation reads the subjects once, and its folds do not grow with equal subjects."""

import datetime

import pytest
from pyspark.sql import functions as F

from fleetlife.plans import cox, evaluate, weibull
from fleetlife.workload import learning_queries


def subjects(spark, copies=1):
    """480 subjects and a few with gaps, each ``copies`` times under keys of its own."""
    rows = spark.range(500).select(
        "id", F.when(F.col("id") % 50 != 0, (F.col("id") % 4).cast("double")).alias("size"),
        F.when(F.col("id") % 61 != 0, (1 + F.pmod(F.xxhash64("id"), F.lit(12))).cast("double")).alias("duration_worked"),
        F.when(F.col("id") % 67 != 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) > 0).alias("failed"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))


def test_weights_stand_for_equal_subjects(spark):
    rows = subjects(spark, 3).withColumn("score", F.pmod("id", F.lit(7)).cast("double"))
    few = rows.groupBy("size", "score", "duration_worked", "failed").agg(F.count("*").alias("many"))
    assert evaluate.concordance(few, weight="many").first() == evaluate.concordance(rows).first()
    want = {r["size"]: r for r in weibull.fit_weibull_groups(rows, ["size"]).collect()}
    got = {r["size"]: r for r in weibull.fit_weibull_groups(few, ["size"], weight="many").collect()}
    assert set(got) == set(want) and None in got
    for size, r in got.items():
        assert r.aggregate_weight == want[size].aggregate_weight and r.rejected == want[size].rejected
        assert r.weibull_shape == pytest.approx(want[size].weibull_shape)
        assert r.weibull_scale == pytest.approx(want[size].weibull_scale)


def test_folds_of_compacted_subjects(spark):
    rows = subjects(spark, 5)

    def fit(weight):
        def run(train, held_out):
            means = train.withColumn("w", F.lit(1) if weight is None else F.col(weight)).groupBy("size").agg(
                (F.sum(F.col("duration_worked") * F.col("w")) / F.sum("w")).alias("score"))
            at = means.withColumnRenamed("size", "of")
            return held_out.join(at, held_out["size"].eqNullSafe(at["of"]))

        return run

    want = evaluate.cross_validate(rows, ["id", "copy"], fit(None), folds=3)
    got = evaluate.cross_validate(rows, ["id", "copy"], fit(evaluate.COUNT), folds=3, features=["size"])
    assert got["folds"] == pytest.approx(want["folds"])


def test_cross_validated_weibull_fits_on_compacted_subjects(spark, tmp_path, monkeypatch):
    day = datetime.datetime(1995, 1, 2)
    part = [(k, "b", "t", 1 + k % 5) for k in range(20)]
    line = [(o, n, o % 20, day + datetime.timedelta(days=o * 7 % 30 + o % 5), "R" if o % 3 else "N", "F")
            for o in range(150) for n in range(8)]
    spark.createDataFrame(part, "p_partkey bigint, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(
        line, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_shipdate timestamp, l_returnflag string, l_linestatus string",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    seen = []
    plain = weibull.fit_weibull_groups

    def watched(train, *args, **options):
        seen.append((train.count(), train.agg(F.sum(evaluate.COUNT)).first()[0]) if evaluate.COUNT in train.columns else (train.count(), None))
        return plain(train, *args, **options)

    monkeypatch.setattr(weibull, "fit_weibull_groups", watched)
    out = learning_queries.cross_validated_weibull(spark, str(tmp_path)).collect()
    kinds = len({(r[0] % 20 % 5, r[3], r[4]) for r in line})
    assert len(out) == 2 and len(seen) == 2 and all(n <= kinds for n, _ in seen)
    assert kinds < 400 and sum(all_of for _, all_of in seen) == len(line)  # every subject trains one of the two folds


def boosting_subjects(spark, fraction=0.0):
    rows = spark.range(600).select(
        "id", F.pmod("id", F.lit(3)).cast("int").alias("fold"),
        F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(9)).cast("double")).alias("a"),
        F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1000)).cast("double").alias("b"))
    noise = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(20))
    return rows.withColumns({
        "duration_worked": F.when(F.col("id") % 97 != 0, 1 + noise + F.coalesce("a", F.lit(4.0)) + fraction * F.col("b")),
        "failed": F.pmod(F.xxhash64("id", F.lit(9)), F.lit(4)) > 0})


def plain(trees):
    return [[(n.feature, n.bin, n.nulls_left, n.left, n.right, pytest.approx(n.at, nan_ok=True), pytest.approx(n.value),
              pytest.approx(n.weight)) for n in t.nodes] for t in trees]


@pytest.mark.parametrize("fraction", [0.0, 0.001])
def test_boosted_folds_have_the_trees_of_single_fits(spark, fraction):
    rows = boosting_subjects(spark, fraction)
    options = {"rounds": 4, "max_depth": 2, "checkpoint_every": 2}
    models = cox.fit_boosted_cox_folds(rows, ["a", "b"], F.col("fold"), 3, **options)
    for k, model in enumerate(models):
        alone = cox.fit_boosted_cox(rows.where(F.col("fold") != k), ["a", "b"], **options)
        assert [[(n.feature, n.bin, n.nulls_left, n.left, n.right, n.at, n.value, n.weight) for n in t.nodes] for t in model.trees] == plain(alone.trees)
    scored = rows.withColumn("h", cox.log_hazard_of_fold(models, F.col("fold")))
    for k, model in enumerate(models):
        assert scored.where((F.col("fold") == k) & ~F.col("h").eqNullSafe(model.log_hazard())).count() == 0


def test_folds_together_are_folds_one_by_one(spark):
    rows = boosting_subjects(spark).drop("fold")
    options = {"rounds": 2, "max_depth": 2}

    def one(train, held_out):
        return held_out.withColumn("score", -cox.fit_boosted_cox(train, ["a", "b"], **options).log_hazard())

    def all_at_once(train, held_out):
        fold = F.col(evaluate.FOLD)
        return held_out.withColumn("score", -cox.log_hazard_of_fold(cox.fit_boosted_cox_folds(train, ["a", "b"], fold, 2, **options), fold))

    want = evaluate.cross_validate(rows, ["id"], one, folds=2)
    assert evaluate.cross_validate(rows, ["id"], all_at_once, folds=2, together=True) == want


def test_search_grows_the_folds_of_a_trial_together(spark, tmp_path, monkeypatch):
    customers = [(c, f"Customer {c}", c % 25, float(c * 37 % 100), "S") for c in range(120)]
    orders = [(c * 10 + o, c, "F" if (c + o) % 3 else "O", 1000.0 * (1 + (c * 7 + o) % 13), datetime.datetime(1995, 1, 1) + datetime.timedelta(days=(c * 5 + o * 31) % 400),
               "1-URGENT" if (c + o) % 2 else "5-LOW") for c in range(120) for o in range(6)]
    spark.createDataFrame(customers, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(
        orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    ).write.parquet(str(tmp_path / "orders.parquet"))
    grown = []
    plain_grow = cox.grow_by_fit

    def watched(rows, edges, *args):
        grown.append(len(edges))
        return plain_grow(rows, edges, *args)

    monkeypatch.setattr(cox, "grow_by_fit", watched)
    out = learning_queries.hyperparameter_search(spark, str(tmp_path)).collect()
    assert len(out) == 2 and grown == [2] * 20  # ten rounds a trial, however many folds
