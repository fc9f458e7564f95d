import io
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlife.sources import layout_index, telemetry

SCHEMA = T.StructType([T.StructField("model", T.StringType()), T.StructField("failure", T.IntegerType())])


@pytest.mark.parametrize("data, want, read", [
    (b"", b"", 0), (b"a,b", b"a,b", 3), (b"a,b\r\n1,2\r\n", b"a,b", 8), (b"\nx", b"x", 2), (b"\r\n \r\n", b"", 5), (b"\n\n\n\nab\n1", b"ab", 8), (b"0123456789,b\n" + b"9" * 90, b"0123456789,b", 16),
])
def test_first_line(data, want, read):
    assert layout_index.first_line(io.BytesIO(data), 4) == (want, read)


def heads(spark, root, index=None):
    return {os.path.basename(r["file"]): r["head"] for r in layout_index.read_heads(
        spark, [str(root)], telemetry.is_data_file(F.col("file")), index).collect()}


def test_the_header_pass_reads_few_bytes(spark, tmp_path):
    data, index = tmp_path / "data", str(tmp_path / "index")
    data.mkdir()
    for i in range(3):
        (data / f"{i}.csv").write_text("model,failure\n" + f"m{i},0\n" * 300_000)
    heads(spark, data, index)
    stored = spark.read.parquet(index)
    assert stored.count() == 3
    assert stored.agg(F.sum("read_bytes") / F.sum("length")).first()[0] < 0.01


def test_known_files_are_not_opened_again(spark, tmp_path):
    data, index = tmp_path / "a b%20c", str(tmp_path / "index")
    data.mkdir()
    (data / "x y.csv").write_text("model,failure\nm,1\n")
    (data / "none.csv").write_text("")
    (data / "other.txt").write_text("no,data\n")
    assert heads(spark, data, index) == {"x%20y.csv": "model,failure"} == heads(spark, data)
    assert spark.read.parquet(index).count() == 1
    heads(spark, data, index)
    assert spark.read.parquet(index).count() == 1  # nothing was read again
    (data / "x y.csv").write_text("failure,model\n0,changed\n")
    (data / "z.csv").write_text("model\nmm\n")
    assert heads(spark, data, index) == {"x%20y.csv": "failure,model", "z.csv": "model"}
    assert spark.read.parquet(index).count() == 3
    got = sorted(map(tuple, telemetry.read_daily_csv(spark, str(data), SCHEMA, index).collect()))
    assert got == [("changed", 0), ("mm", None)] == sorted(map(tuple, telemetry.read_daily_csv(spark, str(data), SCHEMA).collect()))


def test_scan_of_other_stores_gives_the_same_lines(spark, tmp_path):
    for i, head in enumerate(("model,failure", "failure,model", "model")):
        (tmp_path / f"{i}.csv").write_text("\n" * i + f"{head}\n1,1\n")
    wanted = telemetry.is_data_file(F.col("file"))
    scanned = {os.path.basename(r["file"]): r["head"] for r in layout_index._scanned(spark, [str(tmp_path)], wanted).collect()}
    assert scanned == heads(spark, tmp_path)


def test_no_files(spark, tmp_path):
    assert heads(spark, tmp_path) == {} == heads(spark, tmp_path, str(tmp_path / "index"))
    assert telemetry.read_daily_csv(spark, str(tmp_path), SCHEMA).count() == 0
