import base64
import gzip
import hashlib
import os
import time

import pytest

from fleetlife.functions.staging_area import new_folder
from fleetlife.llm import warc

SCHEMA = "page_id bigint, url string, html string, kind string, payload int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", 1) for i, u, h in rows], SCHEMA)


def one(i, body=b"<p>hello</p>", first=None):
    return warc.build_record(f"urn:page:{i}", f"http://e.org/{i}", body, warc.sha1_base32(body), first)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows):
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        first = largest.get(h or "")
        revisit = first is not None and first != i
        out.append((i, len((h or "").encode()), digest(h), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip_with_edge_cases(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u v\r\nX: y", None), (4, "", ""), (5, "u", "WARC/1.1\r\nfake: 1\r\n\r\n"),
            (None, "n", "lonely"), (None, "n", "<p>é</p>"), (6, "u", "long " * 100_000), (7, "u", "same"), (7, "u", "same"), (8, "u", "x\x00y\r\n\r\nz")]
    got = [tuple(r) for r in warc.archived_pages(pages(spark, rows)).collect()]
    assert sorted(got, key=str) == expected(rows)


def test_small_payloads_are_all_responses(spark):
    path = new_folder(spark, "warc-test")
    warc.write_archives(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]), path, least_bytes=5)
    got = {r.record_id: r.record_type for r in warc.records(warc.read_archives(spark, path)).collect()}
    assert got == {"urn:page:1": "response", "urn:page:2": "response", "urn:page:3": "revisit", "urn:page:4": "response"}


def test_empty_table(spark):
    assert warc.archived_pages(pages(spark, [])).collect() == []


def test_members_are_plain_gzip_that_end_in_zero():
    record = one(1)
    member = warc.to_member(record)
    assert member[-1:] == b"\0" and gzip.decompress(member) == record
    long = one(2, os.urandom(1 << 24))
    assert warc.to_member(long)[-1:] == b"\0" and gzip.decompress(warc.to_member(long)) == long


def parts(data):
    out = list(warc.salvage(data))
    at = 0
    for _, start, size, _, _ in out:  # records and gaps cover the file without overlap
        assert start >= at
        at = start + size
    return [(kind, fields.get("record_id"), start, size, reason) for kind, start, size, reason, fields in out]


@pytest.mark.parametrize("pack", [warc.to_member, lambda r: r])
def test_salvage_skips_damage_and_logs_it(pack):
    a, b, c, d = (pack(one(i, b"<p>%d</p>" % i * 20)) for i in range(4))
    broken = bytearray(b)
    broken[len(b) - 40] ^= 0xFF  # inside the payload, which a digest covers
    data = b"junk" + a + bytes(broken) + c + d[:-9]
    got = parts(data)
    want = [("gap", None), ("record", "urn:page:0"), ("gap", None), ("record", "urn:page:2"), ("gap", None)]
    if pack is warc.to_member:  # of the last member only the end is lost, not the record
        want.insert(4, ("record", "urn:page:3"))
    assert [(k, r) for k, r, *_ in got] == want
    assert got[0][2:4] == (0, 4) and got[2][2:4] == (4 + len(a), len(b))
    assert got[-1][2] + got[-1][3] == len(data) and all(g[4] for g in got if g[0] == "gap")


def many(n, start=0):
    return [one(i, b"<p>%d</p>" % i * 30) for i in range(start, start + n)]


def found(data):
    return [f["record_id"] for kind, _, _, _, f in warc.salvage(data) if kind == "record"]


def test_a_damaged_record_inside_a_member_keeps_its_neighbours():
    a, b, c = many(3)
    broken = bytearray(b)
    broken[len(b) - 40] ^= 0xFF
    out = list(warc.salvage(gzip.compress(a + bytes(broken) + c) + warc.to_member(one(9))))
    assert [(kind, f.get("record_id")) for kind, _, _, _, f in out] == [
        ("record", "urn:page:0"), ("gap", None), ("record", "urn:page:2"), ("record", "urn:page:9")]
    gap = out[1]
    assert gap[3] == "block digest differs" and (gap[4]["inner_start"], gap[4]["inner_size"]) == (len(a), len(b))
    assert gap[1] == 0 and out[3][1] == gap[2]


def test_a_truncated_or_damaged_member_keeps_what_came_before():
    rng = [one(i, os.urandom(3000)) for i in range(40)]
    member = gzip.compress(b"".join(rng))
    cut = list(warc.salvage(member[: len(member) // 2]))
    ids = [f["record_id"] for kind, *_, f in cut if kind == "record"]
    assert 17 <= len(ids) <= 20 and ids == [f"urn:page:{i}" for i in range(len(ids))]
    assert [(k, s, n, why) for k, s, n, why, _ in cut if k == "gap"] == [("gap", 0, len(member) // 2, "broken gzip member")]
    crc = bytearray(member)
    crc[-6] ^= 1
    assert found(bytes(crc) + warc.to_member(one(99))) == [f"urn:page:{i}" for i in range(40)] + ["urn:page:99"]
    stored = gzip.compress(b"".join(rng[:3]), 0)[:-8]
    assert found(stored) == ["urn:page:0", "urn:page:1", "urn:page:2"]  # seen in the member and as plain bytes, given once


def test_reading_is_linear_in_the_members():
    def seconds(n):
        data = warc.to_member(one(1, os.urandom(2700))) * n
        start = time.perf_counter()
        assert sum(kind == "record" for kind, *_ in warc.salvage(data)) == n
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 8 * max(seconds(4000), 0.05)


def test_version_line_inside_a_payload_is_no_record():
    inner = one(9)
    whole = one(1, b"before " + inner + b" after")
    assert [r for _, r, *_ in parts(whole + one(2))] == ["urn:page:1", "urn:page:2"]
    damaged = whole.replace(b"Content-Length: ", b"Content-Length: 9", 1)  # then the inner one is the next that passes
    assert "urn:page:9" in [r for _, r, *_ in parts(damaged)]


def test_mixed_files_are_read_by_spark(spark, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(warc.to_member(one(1)) + b"\x1f\x8b\x08broken" + warc.to_member(one(2)))
    (tmp_path / "y.warc").write_bytes(one(3) + b"WARC/1.1\r\nnonsense\r\n\r\n" + one(4, first="urn:page:3"))
    (tmp_path / "empty").write_bytes(b"")
    found = warc.read_archives(spark, str(tmp_path))
    assert sorted(r.record_id for r in warc.records(found).collect()) == [f"urn:page:{i}" for i in (1, 2, 3, 4)]
    gaps = warc.quarantine(found).collect()
    assert len(gaps) == 2 and all(g.size > 0 and g.reason for g in gaps)
    revisit = warc.records(found).where("record_type = 'revisit'").first()
    assert revisit.refers_to == "urn:page:3" and revisit.payload_bytes == len(b"<p>hello</p>") and revisit.payload is None
