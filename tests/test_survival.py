"""Curves and fits against independent references."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlife.plans import cox, evaluate, explain, km, weibull


def frame(spark, t, e, **columns):
    names = ["duration_worked", "failed", *columns]
    rows = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in zip(t, e, *columns.values())]
    kinds = ", ".join(f"{n} {'string' if isinstance(v[0], str) else 'double'}" for n, v in columns.items())
    return spark.createDataFrame([(float(r[0]), bool(r[1]), *r[2:]) for r in rows],
                                 "duration_worked double, failed boolean" + (f", {kinds}" if kinds else "")).select(*names)


def curve(df):
    return {r.duration: r for r in df.collect()}


def test_tiny_curve(spark):
    got = curve(km.survival_curve(frame(spark, [1, 2, 2, 2, 3, 4], [1, 0, 1, 1, 1, 0])))
    assert [got[float(t)].at_risk for t in (0, 1, 2, 3, 4)] == [6, 6, 5, 2, 1]
    assert [got[float(t)].survival for t in (0, 1, 2, 3, 4)] == pytest.approx([1, 5 / 6, 0.5, 0.25, 0.25])
    var = 1 / 30 + 2 / 15
    theta = 1.959963984540054 * math.sqrt(var) / math.log(0.5)
    assert (got[2.0].lower, got[2.0].upper) == pytest.approx((0.5 ** math.exp(-theta), 0.5 ** math.exp(theta)))


def test_curve_that_dies_out(spark):
    got = curve(km.survival_curve(frame(spark, [1, 2, 2], [1, 1, 1])))
    assert got[2.0].survival == 0 and got[2.0].lower is None and got[0.0].upper == 1


def test_zero_durations_keep_their_row(spark):
    got = curve(km.survival_curve(frame(spark, [0, 0, 3], [1, 0, 1])))
    assert sorted(got) == [0.0, 3.0] and got[0.0].survival == pytest.approx(2 / 3)


def test_uncensored_curve_is_the_empirical_one(spark):
    rng = np.random.default_rng(3)
    t = rng.integers(1, 40, 300)
    got = curve(km.survival_curve(frame(spark, t, np.ones(300))))
    for d, r in got.items():
        assert r.survival == pytest.approx((t > d).mean(), abs=1e-9)


def test_blocked_axis_gives_the_same_curve(spark):
    rng = np.random.default_rng(4)
    df = frame(spark, rng.exponential(100, 400), rng.random(400) < 0.6, g=[str(x) for x in rng.integers(0, 3, 400)])
    plain, blocked = (km.survival_curve(df, ["g"], block_width=w).orderBy("g", "duration").collect() for w in (None, 10.0))
    assert [(r.g, r.duration, r.at_risk) for r in plain] == [(r.g, r.duration, r.at_risk) for r in blocked]
    assert [r.survival for r in plain] == pytest.approx([r.survival for r in blocked])


def test_bins_lose_nothing(spark):
    x = [0.0] * 5 + [1.0] * 3 + [10.0] * 4
    df = frame(spark, [3] * 12, [1] * 12, x=x)
    rows = [r for r in km.binned_curves(df, "x").collect() if r.duration == 3.0]
    assert sum(r.at_risk for r in rows) == 12
    assert min(r.bin_left for r in rows) == 0 and max(r.bin_right for r in rows) == 10
    edges = sorted((r.bin_left, r.bin_right) for r in rows)
    assert all(a[1] == b[0] for a, b in zip(edges, edges[1:]))


def test_named_views(spark):
    df = frame(spark, [3, 4, 5, 6], [1, 1, 0, 1], model_id=["a", "a", "b", "c"], brand_id=["x", "x", "x", "y"],
               capacity=[1.0, 1.0, 4.0, 9.0], vendor_id=["v", "v", "v", "w"])
    assert {r.vendor_id for r in km.named_view(df, "vendor").collect()} == {"v", "w"}
    brand = km.named_view(df, "brand").collect()
    assert {(r.level, r.brand_id, r.model_id) for r in brand} == {
        ("secondary", "x", "a"), ("secondary", "x", "b"), ("secondary", "y", "c"), ("primary", "x", None), ("primary", "y", None)}
    capacity = km.named_view(df, "capacity").collect()
    assert {r.level for r in capacity} == {"primary", "secondary"}
    assert max(r.at_risk for r in capacity if r.level == "primary" and r.bin_left == 1.0) == 2


def test_constant_attribute_is_one_bin(spark):
    rows = km.binned_curves(frame(spark, [1, 2, 3], [1, 1, 0], x=[5.0, 5.0, 5.0]), "x").collect()
    assert {r.label for r in rows} == {"[5.0, 5.0)"}


def weibull_reference(t, e):
    t, e = np.asarray(t, float), np.asarray(e, float)
    lo, hi = math.log(1e-3), math.log(1e3)
    lt = np.log(t / t.max())
    for _ in range(200):
        r = math.exp((lo + hi) / 2)
        p = np.exp(r * lt)
        g = (p * lt).sum() / p.sum() - 1 / r - (e * lt).sum() / e.sum()
        lo, hi = (math.log(r), hi) if g < 0 else (lo, math.log(r))
    return r, t.max() * (np.exp(r * lt).sum() / e.sum()) ** (1 / r)


def test_weibull_groups(spark):
    rng = np.random.default_rng(5)
    t, e, g = [], [], []
    for name, scale, shape, n in (("a", 500, 1.5, 3000), ("b", 900, 3.0, 2000), ("c", 100, 0.8, 1000), ("d", 50, 20.0, 400)):
        life = np.maximum(np.floor(scale * rng.weibull(shape, n)), 1)
        stop = np.floor(rng.uniform(0.3, 2, n) * scale) + 1
        t += list(np.minimum(life, stop)); e += list(life <= stop); g += [name] * n
    t += [3, 4, 5, 6, 7, 8, 9, 9]; e += [1, 1, 0, 0, 0, 1, 1, 1]; g += ["two"] * 2 + ["none"] * 3 + ["same"] * 0 + ["ok"] * 3
    t += [5, 5, 5]; e += [1, 1, 1]; g += ["flat"] * 3
    got = {r.g: r for r in weibull.fit_weibull_groups(frame(spark, t, e, g=g), ["g"]).collect()}
    t, e, g = np.array(t, float), np.array(e, float), np.array(g)
    for name in ("a", "b", "c", "d", "ok"):
        want = weibull_reference(t[g == name], e[g == name])
        assert got[name].rejected is None
        assert (got[name].weibull_shape, got[name].weibull_scale) == pytest.approx(want, rel=1e-6)
    assert got["two"].rejected == "fewer than three subjects" and got["none"].rejected == "no failures"
    assert got["flat"].rejected == "no convergence" and got["flat"].weibull_shape is None


def cox_reference(t, e, x, w, steps=30):
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        r = w * np.exp(x @ beta)
        g, h = np.zeros(len(beta)), np.zeros((len(beta),) * 2)
        for ti in np.unique(t[e > 0]):
            at, now = t >= ti, (t == ti) & (e > 0)
            s0, s1 = r[at].sum(), (r[at, None] * x[at]).sum(0)
            s2 = (r[at, None, None] * x[at, :, None] * x[at, None, :]).sum(0)
            d = w[now].sum()
            g += (w[now, None] * x[now]).sum(0) - d * s1 / s0
            h += d * (s2 / s0 - np.outer(s1, s1) / s0 ** 2)
        beta = beta + np.linalg.solve(h, g)
    return beta


@pytest.fixture(scope="module")
def cox_data():
    rng = np.random.default_rng(6)
    n = 500
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 2, n)]).round(1)
    life = np.ceil(100 * rng.exponential(size=n) * np.exp(-(x @ [1.0, -0.7])))
    stop = np.ceil(rng.uniform(20, 300, n))
    return np.minimum(life, stop), (life <= stop).astype(float), x


def test_cox_against_reference_with_weights(spark, cox_data):
    t, e, x = cox_data
    w = np.random.default_rng(7).integers(1, 4, len(t)).astype(float)
    df = frame(spark, t, e, a=x[:, 0], b=x[:, 1], w=w)
    model = cox.fit_cox(df, ["a", "b"], weight="w")
    want = cox_reference(t, e, x, w)
    assert model.converged and model.coefficients == pytest.approx(want.tolist(), rel=1e-6)
    repeated = df.withColumn("_", F.explode(F.expr("sequence(1, int(w))")))
    assert cox.fit_cox(repeated, ["a", "b"]).coefficients == pytest.approx(model.coefficients, rel=1e-8)


def test_constant_feature_stays_out(spark, cox_data):
    t, e, x = cox_data
    model = cox.fit_cox(frame(spark, t, e, a=x[:, 0], one=np.ones(len(t))), ["a", "one"])
    assert model.coefficients[1] == pytest.approx(0, abs=1e-9)


def test_cox_without_failures_is_refused(spark):
    with pytest.raises(ValueError, match="no failures"):
        cox.fit_cox(frame(spark, [1, 2], [0, 0], a=[1.0, 2.0]), ["a"])


def test_baseline_and_expectation(spark, cox_data, tmp_path):
    t, e, x = cox_data
    df = frame(spark, t, e, a=x[:, 0], b=x[:, 1])
    model = cox.CoxModel(["a", "b"], [0.9, -0.5], [0.1, 0.4], 0.0, 0, True)
    model.save(spark, str(tmp_path / "m"))
    model = cox.CoxModel.load(spark, str(tmp_path / "m"))
    base = cox.baseline_hazard(df, model.log_hazard())
    eta = (x - [0.1, 0.4]) @ [0.9, -0.5]
    axis = np.unique(t)
    h = np.array([e[t == u].sum() / np.exp(eta)[t >= u].sum() for u in axis])
    got = base.orderBy("t").collect()
    assert [r.cumulative_hazard for r in got] == pytest.approx(np.cumsum(h).tolist())
    grid, cum = np.r_[0, axis], np.r_[0, np.cumsum(h)]
    out = cox.expected_survival(df, model.log_hazard(), base).collect()
    want = {(a, b): np.trapezoid(np.exp(-cum * np.exp(v)), grid) for (a, b), v in zip(map(tuple, x.tolist()), eta)}
    assert len(out) == len(t)
    for r in out:
        assert r.predicted_survival == pytest.approx(want[r.a, r.b])


def test_boosted_cox_orders_subjects(spark, cox_data, tmp_path):
    t, e, x = cox_data
    df = frame(spark, t, e, a=x[:, 0], b=x[:, 1])
    model = cox.fit_boosted_cox(df, ["a", "b"], rounds=6, max_depth=2, rate=0.4, checkpoint_every=3)
    out = model.with_log_hazard(df).select("a", "b", "log_hazard").collect()
    truth = [r.a - 0.7 * r.b for r in out]
    assert np.corrcoef(truth, [r.log_hazard for r in out])[0, 1] > 0.9
    model.save(spark, str(tmp_path / "b"))
    again = cox.BoostedCoxModel.load(spark, str(tmp_path / "b")).with_log_hazard(df).select("log_hazard").collect()
    assert [r.log_hazard for r in again] == [r.log_hazard for r in out]
    base = cox.baseline_hazard(model.with_log_hazard(df), F.col("log_hazard"))
    assert base.agg(F.max("cumulative_hazard")).first()[0] > 0


def pairs(t, e, s):
    c = d = tied = 0
    for i in range(len(t)):
        for j in range(len(t)):
            if e[i] and (t[j] > t[i] or (t[j] == t[i] and not e[j])):
                c += s[j] > s[i]; d += s[j] < s[i]; tied += s[j] == s[i]
    return c, d, tied


@pytest.mark.parametrize("seed,days,scores,blocks", [(1, 10, 5, 4), (2, 200, 1000, 8), (3, 1, 7, 2), (4, 64, 3, 64)])
def test_concordance_counts(spark, seed, days, scores, blocks):
    rng = np.random.default_rng(seed)
    t, e, s = rng.integers(0, days, 120), rng.random(120) < 0.5, rng.integers(0, scores, 120)
    row = evaluate.concordance(frame(spark, t, e, score=s.astype(float)), blocks=blocks).first()
    c, d, tied = pairs(t, e, s)
    assert (int(row.concordant), int(row.discordant), int(row.tied)) == (c, d, tied)
    assert row.concordance == pytest.approx((c + tied / 2) / (c + d + tied))


def test_perfect_and_empty_concordance(spark):
    t = list(range(1, 30))
    assert evaluate.concordance(frame(spark, t, [1] * 29, score=[float(x) for x in t])).first().concordance == 1.0
    assert evaluate.concordance(frame(spark, [1, 2], [0, 0], score=[1.0, 2.0])).first().concordance is None


def test_cross_validation(spark, cox_data):
    t, e, x = cox_data
    df = frame(spark, t, e, a=x[:, 0], b=x[:, 1], id=np.arange(len(t), dtype=float))

    def fit(train, held_out):
        return held_out.withColumn("score", -cox.fit_cox(train, ["a", "b"]).log_hazard())

    out = evaluate.cross_validate(df, ["id"], fit, folds=3)
    assert len(out["folds"]) == 3 and 0.7 < out["mean"] <= 1 and out["std"] >= 0


def test_search_resumes(spark, tmp_path):
    calls = []

    def value(point):
        calls.append(point)
        return -abs(point["rate"] - 0.3)

    space, log = {"rate": (0.0, 1.0), "kind": ["x", "y", "z"]}, str(tmp_path / "log")
    evaluate.search_hyperparameters(spark, space, value, 3, log)
    best = evaluate.search_hyperparameters(spark, space, value, 6, log)
    assert len(calls) == 6 and best["trials"] == 6
    assert evaluate.best_point(spark, log) == best["point"]
    assert best["value"] == max(-abs(p["rate"] - 0.3) for p in calls)


def test_nan_is_rejected(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "p double")
    with pytest.raises(Exception, match="NaN in p"):
        evaluate.reject_nan(df, "p").collect()


def test_compact_explanation(spark):
    df = spark.createDataFrame([(8.0, 1.9, 0.1), (1.0, -1.0, 0.0)], "a double, b double, c double")
    rows = explain.with_compact_explanation(df, ["a", "b", "c"], "e").collect()
    assert rows[0].e == pytest.approx({"a": 0.8, "b": 0.19, "$other": 0.01}) and rows[1].e is None


def test_sampled_contributions_sum_up(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 5, (60, 3)).astype(float)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")

    def predict(rows):
        return rows.withColumn("log_hazard", 2 * F.col("a") - F.col("b") + F.lit(0.0) * F.col("c"))

    out = explain.sampled_contributions(predict(df), ["id"], ["a", "b", "c"], predict, df, samples=10).collect()
    assert len(out) == 60
    base = {round(r.log_hazard - r.phi_a - r.phi_b - r.phi_c, 9) for r in out}
    assert len(base) == 1  # prediction minus contributions is the background's mean
    assert all(abs(r.phi_c) < 1e-12 for r in out)
    slopes = {round((r.phi_a - out[0].phi_a) - 2 * (r.a - out[0].a), 9) for r in out}
    assert slopes == {0.0}


def test_row_level_weibull(spark):
    rng = np.random.default_rng(9)
    n = 2000
    x = rng.integers(0, 2, n).astype(float)
    life = 100 * np.exp(0.7 * x) * rng.weibull(1.5, n)
    stop = rng.uniform(50, 400, n)
    df = frame(spark, np.minimum(life, stop), life <= stop, x=x)
    model = weibull.fit_weibull_rows(df, ["x"])
    aft = model.stages[-1]
    assert aft.coefficients[0] == pytest.approx(0.7, abs=0.1) and aft.scale == pytest.approx(1 / 1.5, abs=0.05)
    got = {r.x: r.p for r in weibull.expected_lifetime(model, df).groupBy("x").agg(F.max("predicted_survival").alias("p")).collect()}
    assert got[0.0] == pytest.approx(100 * math.gamma(1 + 1 / 1.5), rel=0.1)
    assert got[1.0] / got[0.0] == pytest.approx(math.exp(aft.coefficients[0]))


def test_weibull_from_attributes(spark):
    rows = [(float(a), 1.0 + a, 100.0 * (1 + a), 10) for a in range(4) for _ in range(10)]
    fits = spark.createDataFrame(rows, "a double, weibull_shape double, weibull_scale double, aggregate_weight long")
    out = weibull.fit_weibull_from_attributes(fits, ["a"], rounds=20).predict(fits.dropDuplicates(["a"])).collect()
    for r in out:
        assert r.predicted_shape == pytest.approx(r.weibull_shape, rel=0.1)
        assert r.predicted_survival == pytest.approx(r.predicted_scale * math.gamma(1 + 1 / r.predicted_shape))


@pytest.mark.parametrize("strata", [[], ["g"]])
def test_curve_and_left_out_in_one_pass(spark, strata):
    rows = [("a", 1.0, True), ("a", 2.5, False), ("a", None, True), ("a", float("nan"), False), (None, 3.0, None), (None, 3.0, True), ("b", None, True)]
    df = spark.createDataFrame(rows, "g string, duration_worked double, failed boolean")
    curve, left_out = km.curve_and_left_out(df, strata)
    assert sorted(map(str, curve.collect())) == sorted(map(str, km.survival_curve(df, strata).collect()))
    assert sorted(map(str, left_out.collect())) == sorted(map(str, km.without_duration(df, strata).collect()))
    assert len({f.rsplit("/", 2)[1] for f in [*curve.inputFiles(), *left_out.inputFiles()]}) == 1  # the stored axis
