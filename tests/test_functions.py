import datetime
import math

import pytest
from pyspark.sql import functions as F

from fleetlife.functions import durations, keys, ordering, schema_tools, staging_area, text, weibull_math
from fleetlife.sources import attributes, catalogue, smart_schema, store, telemetry


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize("device,ordinal", [(0, 0), (1, 8191), (300000, 17), (2 ** 40, 5000)])
def test_packed_key_round_trip(spark, device, ordinal):
    key = keys.pack_key(F.lit(device), F.lit(ordinal))
    assert one(spark, key, keys.unpack_device(key), keys.unpack_ordinal(key)) == ((device << 13) | ordinal, device, ordinal)


def test_packed_key_refuses_ordinals_that_do_not_fit(spark):
    assert one(spark, keys.pack_key(F.lit(1), F.lit(8192)), keys.pack_key(F.lit(1), F.lit(-1))) == (None, None)


def test_ordinal_zero_and_last(spark):
    assert one(spark, keys.iso_date(keys.ordinal_to_day(F.lit(0))), keys.iso_date(keys.ordinal_to_day(F.lit(8191)))) == (
        "2012-01-01", "2034-06-05")


def test_telemetry_schema_sizes():
    assert len(smart_schema.ATTRIBUTE_IDS) == 62
    assert len(smart_schema.DISK_ATTRIBUTE_IDS) == 47
    staged, facts = smart_schema.staging_schema(), smart_schema.fact_schema()
    assert len(staged) == 5 + 124 and len(facts) == 4 + 94
    assert len(set(facts.names)) == len(facts)
    assert "smart_9_raw" in staged.names and "Power_On_Hours_raw" in facts.names
    assert smart_schema.pretty_name(255) == "smart_255"


def test_pretty_names_apply_to_present_columns(spark):
    df = spark.createDataFrame([(1, 2)], "smart_9_raw long, other int")
    assert smart_schema.prettify(df).columns == ["Power_On_Hours_raw", "other"]


def test_data_file_selection(spark):
    paths = ["/x/2016-01-01.csv", "/x/a.txt", "/x/__MACOSX/._2016.csv", "/y/b.CSV"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.p for r in rows.where(telemetry.is_data_file(F.col("p"))).collect()] == [paths[0], paths[3]]


def test_alignment_refuses_extra_columns(spark):
    df = spark.createDataFrame([(1, "x")], "day int, note string")
    with pytest.raises(ValueError, match="note"):
        telemetry.align_schema(df, smart_schema.fact_schema())
    with pytest.raises(ValueError, match="note"):
        telemetry.union_aligned(df, df.drop("note"))


def test_lenient_tsv(spark, tmp_path):
    path = tmp_path / "models.tsv"
    path.write_text(
        "# list of models\n\ndb_id\tbrand\tmodel\tfirst known date\n1\t\tX\tab-1\t2013-12\n??\tX\tab-2\t2007 # guess\n"
        "\n3\tX\tAB-1\t2014-02-03\n4\tX\tab-3\n")
    rows = attributes.read_lenient_tsv(spark, str(path))
    assert rows.columns == ["line_no", "db_id", "brand", "model", "first_known_date"]
    assert rows.count() == 4
    table = {r["model"]: r["first_known_date"] for r in attributes.attribute_table(rows, "line_no").collect()}
    day = lambda *d: (datetime.date(*d) - datetime.date(2000, 1, 1)).days
    assert table == {"AB-1": day(2014, 2, 3), "AB-2": day(2007, 1, 1), "AB-3": None}


@pytest.mark.parametrize("vendor,model,want", [
    ("Toshiba", "TOSHIBA DT01ACA300", "DT01ACA300"), ("HGST", "HGST HMS5C4040ALE640", "HMS5C4040ALE640"),
    ("Seagate", "ST4000DM000", "ST4000DM000"), ("X", "aa bb x cc dd", "CC"), (None, "abc de", "ABC"),
])
def test_model_names(spark, vendor, model, want):
    assert one(spark, text.normalize_model_name(F.lit(vendor).cast("string"), F.lit(model))) == (want,)


def test_series_and_modifiers(spark):
    def decode(s):
        r = one(spark, text.series_and_modifiers(F.lit(s)))[0]
        return r["series"], r["form_factor"], r["modifiers"]

    assert decode("Green Power 35") == ("Green", 3.5, {"Power": True})
    assert decode("SE16 GP") == ("SE16", None, {"GP": True})
    assert decode("plain 25/10") == ("Old Caviar", 1.0, {"plain": True})
    assert decode("VelociRaptor") == ("VelociRaptor", None, {})


@pytest.mark.parametrize("pattern,item,want", [("b+", "abbc", True), ("^b", "abc", False), ("", "abc", False), (None, "a", False), ("a", None, False)])
def test_regex_search(spark, pattern, item, want):
    assert one(spark, text.regex_search(F.lit(pattern).cast("string"), F.lit(item).cast("string"))) == (want,)


def test_human_span(spark):
    rows = spark.createDataFrame([(400.7,), (30.0,), (0.0,), (None,), (float("nan"),), (3654.0,)], "d double")
    out = durations.with_human_span(rows, "d", "s", datetime.date(2020, 1, 31))
    assert [r.s for r in out.collect()] == ["1 y, 1 m, 6 d", "1 m, 1 d", None, None, None, "10 y, 1 d"]


@pytest.mark.parametrize("x", [0.5, 1.0, 1.5, 2.0, 3.7, 20.0, 101.0])
def test_log_gamma(spark, x):
    assert one(spark, weibull_math.log_gamma(F.lit(x)))[0] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


def test_divergence_vanishes_for_equal_laws(spark):
    a, b = F.lit(500.0), F.lit(1.5)
    got = one(spark, weibull_math.divergence(a, b, a, b), weibull_math.shape_divergence(b, b), weibull_math.scale_divergence(a, a, b))
    assert got == pytest.approx((0, 0, 0), abs=1e-12)


def test_flatten_and_reorder(spark):
    df = spark.createDataFrame([((1, (2, 3)), 4)], "a struct<x:int,b:struct<b:int,c:int>>, d int")
    flat = schema_tools.flatten(df)
    assert flat.columns == ["a_x", "a_b", "a_b_c", "d"] and tuple(flat.first()) == (1, 2, 3, 4)
    assert schema_tools.reorder(flat, ["d", "nope", "a_b"]).columns == ["d", "a_b", "a_x", "a_b_c"]


def test_numbering_is_dense_and_repeatable(spark):
    df = spark.createDataFrame([(f"s{i}",) for i in range(500)], "name string")
    first = {r["name"]: r["id"] for r in ordering.number_by_hash(df.repartition(7), ["name"], "id", 10).collect()}
    again = {r["name"]: r["id"] for r in ordering.number_by_hash(df.repartition(3), ["name"], "id", 10).collect()}
    assert sorted(first.values()) == list(range(11, 511)) and first == again


@pytest.mark.parametrize("width", [None, 3.0])
def test_running_sum(spark, width):
    rows = [(k, float(t), t * 2) for k in ("a", None) for t in range(20)]
    df = spark.createDataFrame(rows, "k string, t double, v long")
    out = ordering.running_sum(df, ["k"], "t", {"total": "v"}, width)
    assert out.columns == ["k", "t", "v", "total"]
    got = {(r.k, r.t): r.total for r in out.collect()}
    assert got == {(k, float(t)): t * (t + 1) for k in ("a", None) for t in range(20)}


def test_catalogue_edge_cases(spark):
    page = (
        "<script>var a = new ArticleTable(['x'], 'i', [{'title':'no'}]); let b=new DataTable(['t'],/*x*/'i',"
        "[{'title':'T','year':'2015','dataURL':'https://e.org/docs_2015.zip','metaData':'2 GB file, 3.5 GB on disk, 92 files'}]);</script>")
    pages = spark.createDataFrame([(page,)], "html string")
    assert catalogue.script_tables(pages, "html").count() == 2
    piece = catalogue.catalogue_pieces(catalogue.catalogue_records(pages, "html", "b")).first()
    assert (piece["type"], piece["quarter"], piece["compressed_mb"], piece["unpacked_mb"], piece["files"]) == ("docs", None, 2048.0, 3584.0, 92)
    assert piece["format"] is None and piece["complete"] is False  # no format word
    assert str(piece["start"]) == "2015-01-01" and str(piece["end"]) == "2016-01-01"


def test_last_quarter_ends_next_year(spark):
    got = one(spark, catalogue.span_start(F.lit(2016), F.lit(4)), catalogue.span_end(F.lit(2016), F.lit(4)))
    assert [str(x) for x in got] == ["2016-10-01", "2017-01-01"]


def test_introspection(spark):
    spark.range(1).createOrReplaceTempView("some_facts")
    assert "some_facts" in store.table_names(spark) and store.column_names(spark, "some_facts") == ["id"]
    assert not store.is_reduced(spark, "some_facts") and store.is_reduced(spark, "no_such_table")


def test_predictions_keep_nulls_in_json(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "name string, predicted_survival double")
    store.write_predictions(df, str(tmp_path / "p"), "json")
    assert '{"name":"a","predicted_survival":null}' in [r.value for r in spark.read.text(str(tmp_path / "p")).collect()]
    with pytest.raises(ValueError):
        store.write_predictions(df, str(tmp_path / "q"), "xls")


class FakeSession:
    """Just enough of a session to see where the shared folder comes from."""

    def __init__(self, master, configured=None, current=None):
        self.configured, self.current, self.master = configured, current, master
        self.conf, self.sparkContext = self, self

    def get(self, key, default="hdfs://warehouse/"):
        return self.configured if key == "spark.checkpoint.dir" and self.configured else default

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path


def test_shared_folder_comes_from_the_session():
    cluster = FakeSession("spark://host", configured="hdfs://shared/x/")
    assert staging_area.shared_root(cluster) == "hdfs://shared/x" and cluster.current == "hdfs://shared/x/"
    assert staging_area.shared_root(FakeSession("yarn", current="hdfs://set")) == "hdfs://set"
    for master in ("yarn", "local[2]"):  # unset: below the warehouse, never a folder of one machine
        assert staging_area.shared_root(FakeSession(master)) == "hdfs://warehouse/_stages"
