import heapq
import math
import zlib
from collections import defaultdict

import duckdb
import pytest

from fleetlife.llm import mixing, sharding, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, source string, size int, shard string, mix_copy int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x", 9) for i, t, s in rows], SCHEMA)


def test_lpt_takes_the_least_loaded_shard():
    items = [(7, "a"), (7, "b"), (5, "c"), (4, "d"), (4, "e"), (1, "f")]
    placed = sharding.least_loaded(items, 3)
    heap = [(0, s) for s in range(3)]
    for w, n in sorted(items, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        assert placed[n] == s
        heapq.heappush(heap, (load + w, s))


@pytest.mark.parametrize("grains", [4, 8192])
def test_shards_keep_groups_and_balance_bytes(spark, grains):
    rows = [(i, "word " * (i % 37) + str(i // 3), "s") for i in range(600)]
    rows += [(1000 + i, "copied text", "s") for i in range(300)] + [(2000, None, "s"), (None, None, "s"), (2001, "", "s"), (5, "word", "s"), (5, "word", "s")]
    out = sharding.assign_shards(frame(spark, rows), shards=5, grains=grains).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in out) == sorted((i is None, i) for i, _, _ in rows)
    slots, load = defaultdict(list), defaultdict(int)
    for r in out:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 5
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in out if r.doc_id is not None and 1000 <= r.doc_id < 1300}) == 1
    assert len({r.shard for r in out if r.text_crc32 is None}) == 1
    by_id = {r.doc_id: r for r in out}
    assert by_id[2000].size == 16 and by_id[2001].size == 16 and by_id[2001].text_crc32 == 0
    assert by_id[17].text_crc32 == zlib.crc32(rows[17][1].encode())
    if grains > 1000:
        assert max(load.values()) - min(load.values()) <= 200


def test_shards_of_an_empty_table(spark):
    assert sharding.assign_shards(frame(spark, []), shards=4).collect() == []


def test_slots_stay_gapless_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    out = sharding.assign_shards(frame(spark, [(i, f"t{i}", "s") for i in range(500)]), shards=3).collect()
    for s in range(3):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))


def mixed(df):
    return sorted(df.collect(), key=lambda r: r.mix_position)


def test_mix_agrees_with_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    wanted = db.execute(f"select doc_id, source, mix_copy, mix_position from ({mixing.mix_sql()}) order by mix_position").fetchall()
    got = mixed(mixing.mix(docs))
    assert [(r.doc_id, r.source, r.mix_copy, r.mix_position) for r in got] == wanted
    assert [r.mix_position for r in got] == list(range(len(got)))


@pytest.mark.parametrize("many", [False, True])
def test_mix_reaches_weights_with_nulls_and_repeats(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(mixing, "BROADCAST_STEPS", 1)
    rows = [(i, f"t{i}", "hot") for i in range(3000)] + [(10_000 + i, None, "cold") for i in range(300)]
    rows += [(20_000 + i, "", None) for i in range(200)] + [(30_000, "z", "none")] + [(7, "t7", "hot"), (None, "n", "hot")]
    out = mixed(mixing.mix(frame(spark, rows), weights={"hot": 1.0, "cold": 2.0, None: 1.0}))
    n = len(rows)
    count = {s: sum(r.source == s for r in out) for s in ("hot", "cold", None, "none")}
    for source, share in (("hot", 0.25), ("cold", 0.5), (None, 0.25)):
        mean = share * n
        assert abs(count[source] - mean) < 5 * mean**0.5
    assert count["none"] == 0
    times = defaultdict(list)
    for r in out:
        times[r.doc_id].append(r.mix_copy)
    assert all(sorted(c) == [*range(1, len(c) + 1)] for d, c in times.items() if d != 7)
    assert out[0].size == 7 and out[0].shard == "x"


def test_rows_of_one_id_draw_separately(spark):
    rows = [(None, "same", "a")] * 400 + [(None, f"t{i}", "a") for i in range(400)] + [(5, f"t{i}", "a") for i in range(400)] + [(6, "x", "b")]
    out = mixed(mixing.mix(frame(spark, rows)))
    for mine in ([r for r in out if r.text == "same"], [r for r in out if r.doc_id is None and r.text != "same"], [r for r in out if r.doc_id == 5]):
        assert 250 < len(mine) < 550 and len({r.mix_copy for r in mine}) > 1
    assert [r.mix_position for r in out] == list(range(len(out))) and len({r.mix_position // 400 for r in out if r.text == "same"}) > 1
    frame(spark, rows).createOrReplaceTempView("repeated")
    db = duckdb.connect()
    db.register("documents", frame(spark, rows).selectExpr("doc_id", "source", "shard lang", "size n_chars", "text").toPandas().astype({"doc_id": "Int64"}))
    want = db.execute(f"select doc_id, text, mix_copy, mix_position from ({mixing.mix_sql()}) order by mix_position").fetchall()
    assert [(r.doc_id, r.text, r.mix_copy, r.mix_position) for r in out] == want


def test_poisson_quantiles(spark):
    steps = {r.steps_of: r.steps for r in mixing.cumulative(spark.createDataFrame([("a", 900.0), (None, 0.3)], "source string, rate double")).collect()}
    exact = math.fsum(math.exp(k * math.log(900) - 900 - math.lgamma(k + 1)) for k in range(900))
    assert abs(steps["a"][-1] - 1) < 1e-9 and abs(steps["a"][899] - exact) < 1e-9
    assert abs(steps[None][0] - 0.7408182) < 1e-6 and abs(steps[None][1] - 0.9630637) < 1e-6


def test_columns_may_be_called_as_the_operators_own(spark):
    names = ["row", "own", "id", "copy", "block", "inside", "before", "order", "steps", "steps_of", "times", "shared", "_block", "_source",
             "k_id", "k_digest", "k_rows", "own_id", "own_digest", "root", "digest", "fp"]
    docs = spark.createDataFrame([(i, f"one two three {i // 2}", "s", *[f"v{i}"] * len(names)) for i in range(40)],
                                 "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    out = mixing.mix(docs).collect()
    assert out and all(r[n] == f"v{r.doc_id}" for r in out for n in names)
    kept = simhash.keep_one_each(docs).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 40, 2)) and all(r[n] == f"v{r.doc_id}" for r in kept for n in names)


def test_one_of_equal_rows_stays_whatever_their_order(spark):
    rows = [(1, "a b c", s) for s in ("z", "y", "x")] + [(None, "d e f", "q"), (None, "d e f", "p")]
    for given in (rows, rows[::-1]):
        assert sorted((r.doc_id or 0, r.source) for r in simhash.keep_one_each(frame(spark, given)).collect()) == [(0, "p"), (1, "x")]


def test_mix_of_an_empty_table(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
