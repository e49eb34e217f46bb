"""WARC archives, index first (op8).

Writing: a record a page, each a gzip member of its own, in archives of about ARCHIVE_BYTES in the shared folder. Of the records with one payload, that of the
largest page_id is the response and the others are revisits without the payload. Who is which is decided on rows of (part, row, page_id, digest, size) alone; the
revisits among them go back to the parts of the input they are in (see larkspar.llm.parts), and each task of a second scan writes its own pages: no payload is ever
shuffled. A payload that a third of the pages share is one row of an aggregate. The writer returns the index: archive,
offset, length, URL and digest of each record. An archive is named at random by the task attempt that writes it and counts only through its index rows, so a
lost executor leaves at worst a file that nobody reads.

Reading: the selected index rows are range-partitioned by archive and offset into as many tasks as their bytes ask for, neighbours at most GAP bytes apart are read as one
range of at most RANGE bytes, and records are parsed from the ranges. Payload digests are verified.

Null html: empty payload. Null or odd URLs are escaped to a valid header. Null page_id: smaller than any other, record name "null". Rows with equal page_id and
payload: one of them is the candidate for response, the others are revisits of that id. Empty tables give no archives and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspar.llm.common import keep, map_texts, scratch_path, table
from larkspar.llm.parts import Parts, Side

ARCHIVE_BYTES, GAP, RANGE, MIN_BYTES = 32 << 20, 64 << 10, 8 << 20, 0
#: Bytes of archives a reading task gets, at most on average, and at least where that leaves cores idle.
READ_BYTES, LEAST_READ = 64 << 20, 1 << 20
#: Shared payloads up to which (digest, page_id) of their responses is broadcast, about 100 bytes each; beyond, Spark's shuffled join.
BROADCAST_SHARED = 20_000
DATE, PROFILE, NAME = "1970-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "urn:larkspar:page:"
INDEX = "archive string, offset long, length long, page_id long, url string, digest string, record_type string"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def decided(pages: DataFrame, min_bytes: int = MIN_BYTES) -> tuple[Parts, DataFrame, DataFrame]:
    """The parts of pages; (part, row, page_id, sha, size) of all rows, with the hex SHA-1 of the payload; and (part, row, best) of the revisits: the page_id of their
    response."""
    parts = Parts(pages, "html")
    html = F.coalesce("html", F.lit(""))
    thin = keep(parts.df.select(parts.column.alias("part"), parts.row.alias("row"), F.col("page_id").cast("long").alias("page_id"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).cast("long").alias("size")), "thin")
    # the response: the largest page_id, null before any; of equal ones any, but always the same
    rank = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "part", "row")
    best = thin.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.max(rank).alias("b"), F.count("*").alias("n")).where("n > 1").select("sha", "b")
    best = keep(best, "shared")
    near = F.broadcast(best) if best.limit(BROADCAST_SHARED + 1).count() <= BROADCAST_SHARED else best
    revisits = thin.join(near, "sha").where("part <> b.part or row <> b.row")
    return parts, thin, revisits.select("part", "row", F.col("b.page_id").alias("best"))


def record(page_id: int | None, url: str | None, payload: bytes, key: str, revisit: bool, of: int | None) -> bytes:
    """One WARC/1.1 record; key tells it from others of the page_id."""
    digest, size = digest32(payload), len(payload)
    name = NAME + ("null" if page_id is None else str(page_id))
    uri = urllib.parse.quote(url or "urn:larkspar:unknown", safe="/:?#[]@!$&'()*+,;=%-._~")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}:{key}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{NAME}{'null' if of is None else of}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's page_id, type, URL, payload (None for revisits), its digest, full size, and for revisits the response's page_id. Checks lengths and digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) for x in lines[1:])
    n = int(h["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"broken record {h.get('WARC-Record-ID')}")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")

    def page(name: str) -> int | None:
        x = name.strip("<>").removeprefix(NAME).split(":")[0]
        return None if x == "null" else int(x)

    revisit = h["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest32(payload) != digest):
        raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
    return {"page_id": page(h["WARC-Record-ID"]), "type": h["WARC-Type"], "url": h["WARC-Target-URI"], "payload": None if revisit else payload, "digest": digest, "size": size, "refers_to": page(h["WARC-Refers-To"]) if revisit else None}


def _revisits(t: pa.Table) -> dict[int, int | None]:
    """Row and response of the revisits of a part."""
    return {row: best for row, best in zip(t["row"].to_pylist(), t["best"].to_pylist(), strict=True) if row >= 0}


def _write(batches: Iterator[pa.RecordBatch], base: str, limit: int, side: Side) -> Iterator[pa.RecordBatch]:
    where, path = fs.FileSystem.from_uri(base)
    out, archive, at, rows = None, "", 0, []

    def index() -> pa.RecordBatch:
        names = [x.split()[0] for x in INDEX.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        got = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
        rows.clear()
        return got

    for b in batches:
        for part, row, page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if out is None or at >= limit:
                if out is not None:
                    out.close()
                    yield index()
                archive, at = f"{uuid.uuid4().hex}.warc.gz", 0
                where.create_dir(path, recursive=True)
                out = where.open_output_stream(f"{path}/{archive}", compression=None)
            payload, of = (html or "").encode(), side.of(part)
            z = zlib.compressobj(3, zlib.DEFLATED, 31)
            data = z.compress(record(page_id, url, payload, f"{part:x}-{row:x}", row in of, of.get(row))) + z.flush()
            out.write(data)
            rows.append((archive, at, len(data), page_id, url, digest32(payload), "revisit" if row in of else "response"))
            at += len(data)
    if out is not None:
        out.close()
        yield index()


def write(pages: DataFrame, base: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives below base; the index."""
    parts, thin, revisits = decided(pages, min_bytes)
    # a row for each part, so that a part that is missing means an error
    there = thin.select("part", F.lit(-1).cast("long").alias("row"), F.lit(None).cast("long").alias("best")).distinct()
    back = parts.sent_back(revisits.unionByName(there), "revisits", ("row",))
    side = Side(back.path, parts.buckets, _revisits)
    rows = parts.df.select(parts.column.alias("part"), parts.row.alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return keep(map_texts(rows, lambda x: _write(x, base, archive_bytes, side), INDEX), "index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = RANGE) -> Iterator[tuple[int, int, int, int]]:
    """Coalesced reads of sorted (offset, length): first and last row (exclusive), start and end."""
    i = 0
    while i < len(rows):
        j, end = i + 1, sum(rows[i])
        while j < len(rows) and rows[j][0] - end <= gap and sum(rows[j]) - rows[i][0] <= most:
            end = max(end, sum(rows[j]))
            j += 1
        yield i, j, rows[i][0], end
        i = j


def _read(batches: Iterator[pa.RecordBatch], base: str, make, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    where, path = fs.FileSystem.from_uri(base)
    for b in batches:
        names = b.column(0).to_pylist()
        spans = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        i = 0
        while i < len(names):
            j = i
            while j < len(names) and names[j] == names[i]:
                j += 1
            with where.open_input_file(f"{path}/{names[i]}") as f:
                for k, m, start, end in ranges(spans[i:j]):
                    data = f.read_at(end - start, start)
                    out = [make(parse(zlib.decompress(data[o - start : o - start + n], 31))) for o, n in spans[i + k : i + m]]
                    yield pa.RecordBatch.from_pylist(out, schema)
            i = j


def read(index: DataFrame, base: str, make, fields: str, schema: pa.Schema) -> DataFrame:
    """The records of the selected index rows; make turns what parse() gives into a row of the fields."""
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, math.ceil(size / READ_BYTES), min(math.ceil(size / LEAST_READ), index.sparkSession.sparkContext.defaultParallelism))
    sorted_rows = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return sorted_rows.mapInArrow(lambda x: _read(x, base, make, schema), fields)


def _digest_row(r: dict) -> dict:
    return {"page_id": r["page_id"], "payload_bytes": r["size"] if r["payload"] is None else len(r["payload"]), "payload_digest": r["digest"], "record_type": r["type"], "refers_to": r["refers_to"]}


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "warc")
    index = write(table(spark, sf_dir, "pages"), base)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return read(index, base, _digest_row, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", schema)


_CODE = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_PART = "('0x' || substr(h, k * 5 + 1, 5))::BIGINT"
OP8_SQL = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
d AS (SELECT h, string_agg({" || ".join(f"substr({_CODE}, (({_PART} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))}, '' ORDER BY k) AS payload_digest
    FROM (SELECT DISTINCT h FROM p), range(8) r(k) GROUP BY h),
m AS (SELECT h, max(page_id) AS best FROM p GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM p JOIN d USING (h) JOIN m USING (h)
"""
