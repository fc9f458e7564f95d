"""Missing values, file layouts, and what must not be lost."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlife.functions import staging_area
from fleetlife.operators import dims
from fleetlife.plans import cox, explain, km
from fleetlife.sources import catalogue, telemetry

SUBJECTS = "duration_worked double, failed boolean, x double"


def subjects(spark):
    rows = [(1.0, True, 0.0), (2.0, False, 1.0), (3.0, True, 2.0)] + [(None, True, 1.0), (None, False, None), (float("nan"), True, 0.0)]
    return spark.createDataFrame(rows, SUBJECTS)


def test_curves_leave_out_subjects_without_duration(spark):
    got = km.survival_curve(subjects(spark)).orderBy("duration").collect()
    assert [(r.duration, r.at_risk, r.events) for r in got] == [(0.0, 3, 0), (1.0, 3, 1), (2.0, 2, 0), (3.0, 1, 1)]
    assert got[-1].survival == 0.0
    lost = km.without_duration(subjects(spark)).first()
    assert (lost.left_out, lost.subjects) == (3, 6)


def test_a_curve_from_day_zero_has_no_second_opening(spark):
    df = spark.createDataFrame([("a", 0.0, True), ("a", 2.0, False), ("b", 1.0, True)], "s string, duration_worked double, failed boolean")
    got = sorted((r.s, r.duration, r.at_risk) for r in km.survival_curve(df, ["s"]).collect())
    assert got == [("a", 0.0, 2), ("a", 2.0, 1), ("b", 0.0, 1), ("b", 1.0, 1)]
    blocked = sorted((r.s, r.duration, r.at_risk) for r in km.survival_curve(df, ["s"], block_width=0.5).collect())
    assert blocked == got


def scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation [")


def test_a_curve_reads_its_subjects_once(spark, tmp_path):
    subjects(spark).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert scans(km.survival_curve(stored, ["failed"])) == 1
    assert scans(km.nested_curves(stored, "failed", "x")) == 1


def test_cox_ignores_gaps_and_counts_them(spark):
    rng = np.random.default_rng(4)
    full = [(float(t), bool(e), float(x)) for t, e, x in zip(rng.exponential(10, 200).round() + 1, rng.random(200) < 0.6, rng.normal(size=200), strict=True)]
    gaps = [(5.0, True, None), (7.0, False, float("nan")), (None, True, 0.3)]
    a = cox.fit_cox(spark.createDataFrame(full, SUBJECTS), ["x"])
    holed = spark.createDataFrame(full + gaps, SUBJECTS)
    b = cox.fit_cox(holed, ["x"])
    assert a.converged and b.coefficients == pytest.approx(a.coefficients) and b.means == pytest.approx(a.means)
    assert cox.incomplete_subjects(holed, ["x"]).first().left_out == 3


def test_expected_survival_returns_every_row(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.5), (4, float("nan"))], "id int, x double")
    baseline = spark.createDataFrame([(float(t), 0.01 * t) for t in range(1, 101)], "t double, cumulative_hazard double")
    for from_zero in (True, False):
        for width in (1e9, 512.0, 7.0):
            got = {r.id: r.predicted_survival for r in cox.expected_survival(rows, F.col("x"), baseline, from_zero, width).collect()}
            t = np.arange(0 if from_zero else 1, 101)
            s = np.exp(-0.01 * t * math.exp(0.5))
            assert got[1] == got[3] == pytest.approx(np.trapezoid(s, t)) and got[2] is None and got[4] is None


def brute_shapley(leaves, x, n, i):
    def worth(known):
        total = 0.0
        for leaf in leaves:
            v = leaf.value
            for f, (low, high, share, _) in leaf.paths.items():
                v *= float(low < x[f] <= high) if f in known else share
            total += v
        return total

    rest = [f for f in range(n) if f != i]
    out = 0.0
    for size in range(n):
        for s in itertools.combinations(rest, size):
            out += math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n) * (worth({*s, i}) - worth(set(s)))
    return out


def test_tree_contributions_are_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (300, 3)).astype(float)
    t = rng.exponential(np.exp(1 - 0.5 * x[:, 0] + 0.3 * x[:, 1] * (x[:, 2] > 2))).round(1) + 0.1
    df = spark.createDataFrame([(i, *map(float, r), float(u), True) for i, (r, u) in enumerate(zip(x, t, strict=True))],
                               "id int, a double, b double, c double, duration_worked double, failed boolean")
    model = cox.fit_boosted_cox(df, ["a", "b", "c"], rounds=3, max_depth=3)
    out, base = explain.tree_contributions(model.with_log_hazard(df), model, interactions=True)
    leaves = [leaf for tree in model.trees for leaf in explain.tree_leaves(tree)]
    for r in out.limit(40).collect():
        phi = [r.phi_a, r.phi_b, r.phi_c]
        assert sum(phi) + base == pytest.approx(r.log_hazard)
        point = (r.a, r.b, r.c)
        assert phi == pytest.approx([model.rate * brute_shapley(leaves, point, 3, i) for i in range(3)])
    assert {"phi_a__b", "phi_a__c", "phi_b__c"} <= set(out.columns)
    assert any(abs(r.phi_b__c) > 1e-3 for r in out.collect())


def test_csv_files_of_different_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,serial_number,model,failure\n2016-01-01,s1,m1,0\ndate,serial_number,model,failure\n2016-01-02,s1,,1\n")
    (tmp_path / "b.csv").write_text('capacity_bytes,"model",failure,date,serial_number,extra\n100,m2,0,2016-01-03,s2,zz\n')
    (tmp_path / "MACOSX").mkdir()
    (tmp_path / "MACOSX" / "c.csv").write_text("date,serial_number,model,failure\nx,y,z,1\n")
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("date", T.StringType()), ("serial_number", T.StringType()), ("model", T.StringType()), ("capacity_bytes", T.LongType()), ("failure", T.IntegerType()))])
    got = sorted(map(tuple, telemetry.read_daily_csv(spark, str(tmp_path), schema).collect()), key=str)
    assert got == [("2016-01-01", "s1", "m1", None, 0), ("2016-01-02", "s1", None, None, 1), ("2016-01-03", "s2", "m2", 100, 0)]


def test_every_lost_model_is_reported(spark):
    df = spark.createDataFrame([("s", "B"), ("s", "A"), ("s", "C"), ("t", "A"), ("s", "A"), (None, "Z"), ("u", None)], "serial_number string, model string")
    got = sorted((r.serial_number, r.kept_model, r.other_model) for r in dims.model_conflicts(df).collect())
    assert got == [("s", "A", "B"), ("s", "A", "C")]


def test_many_brands(spark):
    brands = spark.range(11_000).select("id", F.concat(F.lit("^n"), F.col("id").cast("string"), F.lit("$")).alias("model_name_regex"))
    models = spark.createDataFrame([("n7",), ("n10999",), ("n10999",), ("x",), (None,)], "name string")
    got = sorted((r["name"] or "", r.brand_id) for r in dims.classify_models(models, brands).collect())
    assert got == [("", None), ("n10999", 10999), ("n10999", 10999), ("n7", 7), ("x", None)]


def test_a_cell_of_the_catalogue_keeps_all_pieces(spark):
    df = spark.createDataFrame([(2016, 1, "b"), (2016, 1, "a"), (2016, None, "y"), (2017, 2, "c")], "year int, quarter int, name string")
    got = {r.year: (r.q1, r.q2, r.whole_year) for r in catalogue.catalogue_tree(df).collect()}
    assert got == {2016: (["a", "b"], None, ["y"]), 2017: (None, ["c"], None)}


def test_stages_go_to_a_shared_folder_and_can_be_forgotten(spark):
    stored = staging_area.stage(spark.range(5), "probe")
    files = stored.inputFiles()
    assert files and stored.count() == 5
    staging_area.forget(stored)
    fs = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getFileSystem(spark._jsc.hadoopConfiguration())
    assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(files[0]))
    outside = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    staging_area.forget(outside)  # not below the shared folder: stays
    assert outside.count() == 25
