"""WARC archives: writing with payload revisits, and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlife.functions.staging_area import new_folder
from fleetlife.llm.common import share_code

VERSION = b"WARC/1.1\r\n"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
FILE_RECORDS = 4000
WINDOW, FINE_WINDOW = 1 << 16, 1 << 8  # compressed bytes that are inflated at once, and around damage
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
# Fixed value of the WARC 1.1 standard: the profile of a revisit whose payload digest equals an earlier one.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = (
    "kind string, path string, start bigint, size bigint, reason string, record_id string, record_type string, url string, "
    "refers_to string, payload_bytes bigint, payload_digest string, payload binary, inner_start bigint, inner_size bigint"
)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(
    record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = DATE,
) -> bytes:
    """One record; with ``refers_to`` a revisit, whose block holds the HTTP header alone."""
    block = HTTP.format(len(payload)).encode() + (b"" if refers_to else payload)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        *([f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def to_member(record: bytes, level: int = 6) -> bytes:
    """The record as a gzip member that ends in a zero byte.

    A member ends with its length, so one below 16 MiB ends in zero already; an empty member follows a longer one.
    """
    def pack(data: bytes) -> bytes:
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()

    member = pack(record)
    return member if member[-1:] == b"\0" else member + pack(b"")


def parse_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at ``at``: (fields, end, "") when all checks hold, else (None, at, reason)."""
    start = VERSION_LINE.match(data, at)
    if not start:
        return None, at, "no version line"
    stop = data.find(b"\r\n\r\n", start.end() - 2)
    if stop < 0:
        return None, at, "header without end"
    head = {}
    for line in data[start.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "malformed header"
        head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    length = head.get(b"content-length", "")
    if not length.isdecimal() or b"warc-record-id" not in head or b"warc-type" not in head:
        return None, at, "mandatory header missing"
    end = stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "block length does not fit"
    block = data[stop + 4 : end]
    said = head.get(b"warc-block-digest")
    if said and said != f"sha1:{sha1_base32(block)}":
        return None, at, "block digest differs"
    kind, payload, size = head[b"warc-type"], None, None
    digest = head.get(b"warc-payload-digest", "").removeprefix("sha1:") or None
    http, blank, body = block.partition(b"\r\n\r\n")
    if kind == "response" and blank:
        payload, size = body, len(body)
        if digest and digest != sha1_base32(body):
            return None, at, "payload digest differs"
    elif kind == "revisit" and (m := re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)):
        size = int(m[1])
    return {
        "record_id": head[b"warc-record-id"].strip("<>"), "record_type": kind, "url": head.get(b"warc-target-uri"),
        "refers_to": head[b"warc-refers-to"].strip("<>") if b"warc-refers-to" in head else None,
        "payload_bytes": size, "payload_digest": digest, "payload": payload,
    }, end + 4, ""


def open_member(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """(content, end, whole) of the gzip member at ``at``. Input goes in by windows and stops with the member, so later bytes
    are not touched. A member that ends early or fails its checks is not whole and gives what was inflated before that."""
    view, out, window, pos, z = memoryview(data), [], WINDOW, at, zlib.decompressobj(31)
    while not z.eof and pos < len(data):
        before = z.copy() if window < WINDOW else None
        try:
            out.append(z.decompress(view[pos : pos + window]))
            pos += window
        except zlib.error:
            if window == WINDOW:  # once more in small steps, to keep all but the last
                out, window, pos, z = [], FINE_WINDOW, at, zlib.decompressobj(31)
            elif window == FINE_WINDOW:
                window, z = 1, before
            else:
                break
    return b"".join(out), min(pos, len(data)) - len(z.unused_data) if z.eof else at, z.eof


def _inside(content: bytes) -> Iterator[tuple[str, int, int, str, dict]]:
    """Like ``salvage``, for the records of a member."""
    at, gap, why = 0, None, ""
    while at < len(content):
        record, end, reason = parse_record(content, at)
        if record is not None:
            if gap is not None:
                yield "gap", gap, at - gap, why, {}
                gap = None
            yield "record", at, end - at, "", record
            at = end
            continue
        if gap is None:
            gap, why = at, reason
        after = VERSION_LINE.search(content, at + 1)
        at = after.start() if after else len(content)
    if gap is not None:
        yield "gap", gap, len(content) - gap, why, {}


def salvage(data: bytes) -> Iterator[tuple[str, int, int, str, dict]]:
    """(kind, start, size, reason, fields) for the file's records and its quarantined gaps, in order.

    Where a check fails, the search goes on one byte later for the next place that starts a gzip member or a version line
    and passes all checks; the bytes between form a gap with the first failure's reason. Members and gaps cover the file
    without overlap. Inside a member the search is for version lines: its sound records come with their ``inner_start`` and
    ``inner_size``, and so do its inner gaps. What a broken member held before the damage comes with size 0, at its
    start; its bytes are a gap.
    """
    at, gap, why, n = 0, None, "", len(data)
    rescued: set[tuple[str, str | None]] = set()  # from the last broken member, lest its stored blocks give a record twice
    candidate = re.compile(re.escape(MEMBER) + b"|" + VERSION_LINE.pattern)
    while at < n:
        packed = data.startswith(MEMBER, at)
        if packed:
            content, end, whole = open_member(data, at)
            found = list(_inside(content))
            sound = [f for f in found if f[0] == "record"]
            good = whole and (bool(sound) or not content)
            reason = "broken gzip member" if not whole else "" if good else found[0][3]
        else:
            record, end, reason = parse_record(data, at)
            found, good = [("record", at, end - at, "", record)], record is not None
            if good and (record["record_id"], record["payload_digest"]) in rescued:
                at = end  # a stored block of the broken member: still its gap
                continue
        if good:
            if gap is not None:
                yield "gap", gap, at - gap, why, {}
                gap = None
            for kind, start, size, inner_why, fields in found:
                place = {"inner_start": start, "inner_size": size} if packed else {}
                yield kind, at, end - at, inner_why, fields | place
            if packed:
                rescued.clear()
            at = end
            continue
        if gap is None:
            gap, why = at, reason
        if packed and not whole:
            for _, start, size, _, fields in sound:
                name = fields["record_id"], fields["payload_digest"]
                if name not in rescued:
                    rescued.add(name)
                    yield "record", at, 0, "", fields | {"inner_start": start, "inner_size": size}
        after = candidate.search(data, at + 1)
        at = after.start() if after else n
    if gap is not None:
        yield "gap", gap, n - gap, why, {}


def payload_table(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, payload_bytes, payload_digest) per row; a null payload counts as empty."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    return pages.select(F.col(key).alias("key"), F.octet_length(body).cast("bigint").alias("payload_bytes"),
                        F.sha1(body).alias("sha1"))


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0,
    records_per_file: int = FILE_RECORDS,
) -> None:
    """Write one gzip member per row of ``pages`` below ``path``, each a WARC record.

    Of rows with equal payloads of at least ``least_bytes``, that with the largest key is a response and the others are
    revisits of it; rows that repeat the largest key are responses too, and rows without a key revisit it. Smaller
    payloads are all responses. Files are written by Spark's text writer, so any store works and lost tasks leave nothing behind: each row is
    a member without its last byte, which is zero, and that zero is the line separator.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).cast("string").alias("url"), body.alias("body"))
    sha = F.sha1("body")
    largest = payload_table(pages, key, payload).where(F.col("payload_bytes") >= least_bytes).groupBy("sha1").agg(
        F.max(F.col("key").cast("bigint")).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    # Only repeated payloads have a row here, so that most pages find nothing and keep their place; adaptive execution
    # splits the partition of a payload that very many pages share.
    placed = rows.join(largest, (sha == largest.sha1) & (F.octet_length("body") >= least_bytes), "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("key")), F.col("first"))
    placed = placed.select("key", "url", "body", refers.alias("refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pylist()
                out = []
                for r in part:
                    data = r["body"].encode("utf-8", "surrogatepass")
                    name = "urn:page:" if r["key"] is None else f"urn:page:{r['key']}"
                    first = None if r["refers_to"] is None else f"urn:page:{r['refers_to']}"
                    out.append(to_member(build_record(name, r["url"], data, sha1_base32(data), first))[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    share_code(pages.sparkSession)
    members = placed.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``path`` (columns of ``READ_SCHEMA``; ``kind`` is record or gap).

    ``payloads=False`` leaves the payload bytes out once they have passed their checks. A file is read as a whole by one
    task, so archives should be of the usual size (1 GB at most); a folder without files gives no rows.
    """
    names = [part.split()[0] for part in READ_SCHEMA.split(", ")]
    numbers = {part.split()[0] for part in READ_SCHEMA.split(", ") if part.endswith("bigint")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in numbers
                             else pa.string()) for n in names])
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for kind, start, size, reason, fields in salvage(content.as_py()):
                    row = {"kind": kind, "path": path.as_py(), "start": start, "size": size, "reason": reason} | fields
                    held += len(row.get("payload") or b"")
                    rows.append(row if payloads else row | {"payload": None})
                    if len(rows) >= 5000 or (payloads and held > 16 << 20):
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    share_code(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    return files.select("path", "content").mapInArrow(run, READ_SCHEMA)


def records(archives: DataFrame) -> DataFrame:
    return archives.where("kind = 'record'").drop("kind", "reason")


def quarantine(archives: DataFrame) -> DataFrame:
    """The log of byte gaps: (path, start, size, reason, inner_start, inner_size); the last two are set for a gap inside the
    member at ``start``."""
    return archives.where("kind = 'gap'").select("path", "start", "size", "reason", "inner_start", "inner_size")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, one row per page.

    Repeated rows, null urls and null ids come back as they are; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(pages, path)
    found = records(read_archives(spark, path, payloads=False))
    number = lambda c: F.nullif(F.element_at(F.split(c, ":"), -1), F.lit("")).cast("bigint")
    return found.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"))
