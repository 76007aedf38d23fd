"""WARC archives: writing records in segments, and putting them together again.

Writing: a record's block is an HTTP response whose body is in chunked transfer framing (a revisit has headers only). Blocks longer
than SEGMENT bytes become segments: the first record is number 1, continuation records name it as their origin, the last one states the
total length. Spark's text writer writes the files, its line separator being WARC's end of record, so that any file system Spark knows will do;
files are gzipped and hold at most FILE_RECORDS records each, so at most FILE_RECORDS * SEGMENT bytes of blocks (66 MB) beside their headers, as a reader takes a file whole.

Reading: files come from Spark's binary reader and are cut into records by their Content-Length. Whole records go straight on. Segments are grouped
by origin identifier and ordered by number; a block is accepted if numbers run from 1 without gaps and its length is the stated total. Then
chunked framing is decoded and the payload's digest compared with the header's. A broken record raises an error with its identifier.

Duplicates: of records whose payloads are equal and at least REVISIT_FROM bytes, the one with the smallest page_id is the response, the others are revisits that refer to it.
Groups are found by digest with partial aggregation; a list of groups of at most BROADCAST_GROUPS rows is broadcast, a longer one joined by
shuffle. Nulls: null html is empty, a null url an empty one; a null page_id is a revisit where its group has an id to refer to, else a response. Rows that
repeat the smallest page_id of a group are responses too. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, scratch

SEGMENT, CHUNK, REVISIT_FROM, FILE_RECORDS = 32768, 8192, 100, 2000
#: Rows (digest, page_id) of about 100 bytes that may be broadcast (20 MB).
BROADCAST_GROUPS = 200_000
END = b"\r\n\r\n"
RECORD = "rec string, type string, page string, uri string, refers string, digest string, origin string, number int, total long, block binary"


def classify(pages: DataFrame) -> DataFrame:
    """(page_id, url, body, digest, refers_to, revisit): refers_to is set for revisits."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    light = rows.where(F.length("body") >= REVISIT_FROM).select("page_id", "digest")
    groups = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)  # else bodies are shuffled once, by digest
    joined = rows.join(groups, (F.col("digest") == F.col("d")) & (F.length("body") >= REVISIT_FROM), "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return joined.select("page_id", "url", "body", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def _chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (body[at : at + size] for at in range(0, len(body), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def decode_chunked(framed: bytes) -> bytes:
    """The body of chunked transfer framing; chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        parts.append(framed[end + 2 : end + 2 + size])
        if len(parts[-1]) != size or framed[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def _head(kind: str, rec: str, length: int, **more) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{rec}>", "WARC-Date: 1970-01-01T00:00:00Z", *[f"{k.replace('_', '-')}: {v}" for k, v in more.items()], f"Content-Length: {length}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()


def records(page, rec: str, url: str, body: bytes, digest: str, refers, revisit: bool, segment: int = SEGMENT):
    """The WARC records of one page, without the line ends that close a record."""
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    own = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha256:{digest}", "X_Page_ID": "" if page is None else page, "Content_Type": "application/http; msgtype=response"}
    if revisit:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Bytes: %d\r\n\r\n" % len(body)
        own["WARC_Refers_To"] = f"<urn:page:{'' if refers is None else refers}>"
        own["WARC_Profile"] = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + _chunked(body)
    kind = "revisit" if revisit else "response"
    if len(block) <= segment:
        yield _head(kind, rec, len(block), **own) + block
        return
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    yield _head(kind, rec, len(parts[0]), WARC_Segment_Number=1, **own) + parts[0]
    for n, part in enumerate(parts[1:], 2):
        more = {"WARC_Segment_Total_Length": len(block)} if n == len(parts) else {}
        yield _head("continuation", f"{rec}:{n}", len(part), WARC_Segment_Number=n, WARC_Segment_Origin_ID=f"<urn:page:{rec}>", WARC_Target_URI=uri, **more) + part


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """WARC files of pages (page_id, url, html) in the folder path."""

    def run(batch):
        out = []
        for page, url, body, digest, refers, revisit, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out += records(page, f"{'' if page is None else page}#{row}", url, body, digest, refers, revisit, segment)
            if sum(map(len, out[-64:])) > 1 << 24 or len(out) > 512:
                yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])
                out = []
        yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    made = by_batch(classify(pages).withColumn("row", F.monotonically_increasing_id()), run, "record binary")
    made.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _inflate(data: bytes) -> bytes:
    """The content of a gzip file of any number of members; data itself if it isn't one."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data:
        z = zlib.decompressobj(31)
        parts.append(z.decompress(data))
        data = z.unused_data
    return b"".join(parts)


def split_records(data: bytes):
    """(headers, block) of each record of a file's content; header names in lower case."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != END:
            raise ValueError(f"{headers.get('warc-record-id')} is cut short")
        yield headers, block
        at = end + 8 + size


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, type, refers_to, digest, payload_bytes, payload) of the logical records in the WARC files under path."""

    def cut(batch):
        names = ["rec", "type", "page", "uri", "refers", "digest", "origin", "number", "total", "block"]
        kinds = [pa.string()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
        for data in batch.column(0):
            rows = []
            for h, block in split_records(_inflate(data.as_py())):
                number = int(h["warc-segment-number"]) if "warc-segment-number" in h else None
                total = int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None
                rec = h["warc-record-id"]
                rows.append((rec, h["warc-type"], h.get("x-page-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), h.get("warc-segment-origin-id", rec), number, total, block))
                if len(rows) >= 256:
                    yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
                    rows = []
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    found = by_batch(files, cut, RECORD)
    parts = F.sort_array(F.collect_list(F.struct("number", "block")))
    segments = found.where("number is not null").groupBy("origin").agg(
        *[F.max(F.when(F.col("type") != "continuation", F.col(c))).alias(c) for c in ("type", "page", "uri", "refers", "digest")], F.max("total").alias("total"), parts.alias("parts")
    )
    numbers = F.transform("parts", lambda p: p["number"])
    block = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["block"]))
    whole = segments.select("origin", "type", "page", "uri", "refers", "digest", "total", (numbers == F.sequence(F.lit(1), F.size("parts"))).alias("complete"), block.alias("block"))
    single = found.where("number is null").select("origin", "type", "page", "uri", "refers", "digest", F.lit(None).cast("long").alias("total"), F.lit(True).alias("complete"), "block")

    def payload(batch):
        out = []
        for origin, kind, page, uri, refers, digest, total, complete, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not complete or kind is None or (total is not None and total != len(block)):
                raise ValueError(f"segments of {origin} are missing")
            head, _, body = block.partition(END)
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
            said, size = (digest or "").removeprefix("sha256:"), None
            if kind == "revisit":
                body, size = None, int(fields[b"x-payload-bytes"])
            else:
                body = decode_chunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
                size = len(body)
                if said and hashlib.sha256(body).hexdigest() != said:
                    raise ValueError(f"the payload of {origin} has another digest")
            number = lambda x: int(x) if x else None
            out.append((number(page), uri, kind, number((refers or "")[len("<urn:page:") : -1]), said, size, body))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["page_id", "url", "type", "refers_to", "digest", "payload_bytes", "payload"])

    return by_batch(single.unionByName(whole), payload, "page_id long, url string, type string, refers_to long, digest string, payload_bytes long, payload binary")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    path = scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM r
"""
