"""A content-addressed web archive.

Payload bytes are stored once under their SHA-256, compressed one by one; the exact header of every record is
stored apart, with the digest of its payload. Records come back by joining the two, and a payload whose
bytes no longer have the digest they are stored under is an error. Records are WARC 1.1 responses, each an HTTP
head and the payload, or revisits of the first record with the same payload, which hold the HTTP head alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import put, table, work_path, written

NO_ID = -(1 << 63)
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FACTS = "page_id long, url string, digest string, bytes long, sha1 string, packed binary"


def sha1_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def digested(batches):
    """(page_id, url, digest, bytes, sha1, packed) of pages (page_id, url, html)."""
    press = zstandard.ZstdCompressor(3)
    for batch in batches:
        payloads = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(2)]
        columns = [
            pa.array([hashlib.sha256(x).hexdigest() for x in payloads], pa.string()),
            pa.array(list(map(len, payloads)), pa.int64()),
            pa.array(list(map(sha1_of, payloads)), pa.string()),
            pa.array(list(map(press.compress, payloads)), pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["page_id", "url", "digest", "bytes", "sha1", "packed"])


def line(name: str, value: Column) -> Column:
    """A header line; none for a null value. Line ends inside a value are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n"))).otherwise(F.lit(""))


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes pages (page_id, url, html) under path: payloads/ (digest, packed) and headers/ (digest, header).

    Among records with equal payloads of at least least_bytes bytes the smallest page_id is the
    response and the others are revisits of it; smaller payloads and rows with a null page_id are
    responses. Repeated rows are repeated records of one payload. A null html is an empty payload
    and a null url leaves its header line out. Other columns of pages are ignored.
    """
    columns = [F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")]
    rows = written(pages.select(columns).mapInArrow(digested, FACTS), "versions")
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"))
    # payloads travel once, keyed by digest and id: copies of one payload are spread
    known = lambda c: F.coalesce(F.col(c), F.lit(NO_ID))
    kept = rows.select("digest", known("page_id").alias("id"), "packed").join(first.select("digest", known("first").alias("id")), ["digest", "id"], "left_semi")
    kept.dropDuplicates(["digest", "id"]).select("digest", "packed").write.option("compression", "uncompressed").parquet(f"{path}/payloads")

    records = rows.select("page_id", "url", "digest", "bytes", "sha1").join(first, "digest")
    repeats = (F.col("bytes") >= least_bytes) & (F.col("page_id") != F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(repeats, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Refers-To", F.when(repeats, urn(F.col("first")))),
        line("WARC-Profile", F.when(repeats, F.lit(PROFILE))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(repeats, F.lit(0)).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n"),
        http,
    )
    records.select("digest", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers")


def rebuilt(batches):
    """(record, payload) from (digest, header, packed): the record's bytes as in a WARC file, and its full payload."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for digest, header, packed in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            payload = press.decompress(packed)
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload differs from its digest {digest}")
            own = b"" if b"\r\nWARC-Type: revisit\r\n" in header[:64] else payload
            out.append((header + own + b"\r\n\r\n", payload))
        record, payload = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(record, pa.binary()), pa.array(payload, pa.binary())], names=["record", "payload"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record again, as (record, payload): revisits come with the payload of the response they refer to."""
    payloads = spark.read.schema("digest string, packed binary").parquet(f"{path}/payloads")
    headers = spark.read.schema("digest string, header binary").parquet(f"{path}/headers")
    return headers.join(payloads, "digest").select("digest", "header", "packed").mapInArrow(rebuilt, "record binary, payload binary")


def opened(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields of one record and its HTTP body; its lengths must be those it states."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if version != "WARC/1.1" or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record of {len(record)} bytes is not of its stated length {size}")
    http, _, body = rest[:size].partition(b"\r\n\r\n")
    if fields["WARC-Type"] == "response" and int(re.search(rb"Content-Length: (\d+)", http)[1]) != len(body):
        raise ValueError("HTTP body is not of its stated length")
    return fields, body


def facts_of(batches):
    number = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    for batch in batches:
        out = []
        for record, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fields, body = opened(record)
            sha1 = sha1_of(payload)
            if f"sha1:{sha1}" != fields["WARC-Payload-Digest"] or fields["WARC-Type"] == "response" and body != payload:
                raise ValueError(f"payload differs from its digest sha1:{sha1}")
            out.append((number(fields.get("WARC-Record-ID")), len(payload), sha1, fields["WARC-Type"], number(fields.get("WARC-Refers-To"))))
        columns = zip(*out, strict=True) if out else ((),) * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """One row per record rebuilt from the archive: id, length and digest of the full payload, type and reference, read from the record's bytes."""
    return records(spark, path).mapInArrow(facts_of, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Writes the records as .warc files under folder, one a task; returns file, records and bytes of each."""

    def run(batches):
        sizes = []

        def sized():
            for batch in batches:
                for record in batch.column(0):
                    sizes.append(len(raw := record.as_py()))
                    yield raw

        name = f"part-{TaskContext.get().partitionId():06d}.warc"
        stream = sized()
        if (first := next(stream, None)) is not None:
            put(f"{folder}/{name}", chain([first], stream))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["file", "records", "bytes"])

    return written(records(spark, path).select("record").mapInArrow(run, "file string, records long, bytes long"), "files")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive(table(spark, sf_dir, "pages"), path := work_path(spark, "archive"))
    return read_back(spark, path)


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LETTER = f"substr('{ALPHABET}', 1 + CAST((('0x' || substr(h, 5 * j + 1, 5))::BIGINT >> (15 - 5 * i)) & 31 AS BIGINT), 1)"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages),
digests AS (SELECT h, string_agg({_LETTER}, '' ORDER BY j, i) AS payload_digest FROM (SELECT DISTINCT h FROM p), range(8) a(j), range(4) c(i) GROUP BY h),
firsts AS (SELECT b, min(page_id) AS first FROM p GROUP BY b)
SELECT page_id, CAST(strlen(b) AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN firsts USING (b) JOIN digests USING (h)"""
