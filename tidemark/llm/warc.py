"""Operator 10: a content-addressed WARC archive.

Payload bytes are stored once under their SHA-256 (``payloads``), each compressed on
its own; the exact header of each record is stored beside (``records``), naming the
digest. Records are rebuilt by joining the two. Of records with equal payloads of at
least ``min_payload`` bytes, the one with the smallest page_id is a ``response``, the
others are ``revisit`` records that refer to it and hold no payload. On reading, each
stored payload is verified against the digest it is filed under, and what a record
says of its payload against the payload itself.

Payloads move twice, compressed: to be collapsed when written, and to their headers
when read. Revisits need no payload, so a large group of copies joins nothing.

Cases: null html is an empty payload; a null url gives an empty target; rows that
repeat the response's page_id are responses, too, and share its record id; rows with a
null page_id revisit the smallest id there is, or are responses where there is none;
very long pages take memory for themselves; an empty table gives an empty archive;
other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from base64 import b32encode
from dataclasses import dataclass
from hashlib import sha1, sha256

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_row, shared_dir, table

CRLF = "\r\n"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five digits are four symbols."""
    parts = [
        F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)
    ]
    return F.translate(
        F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def packed(payloads: DataFrame) -> DataFrame:
    """(digest, page_id, packed) of (digest, page_id, payload)."""

    def rows(batch):
        pack = zstandard.ZstdCompressor(3)
        return [(digest, i, pack.compress(bytes(data))) for digest, i, data in batch]

    return per_row(payloads, "digest string, page_id long, packed binary", rows, ["digest", "page_id", "payload"])


def unpacked(digest: str, data: bytes) -> bytes:
    """A stored payload; one that doesn't match its digest is an error."""
    payload = zstandard.ZstdDecompressor().decompress(data)
    if sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload does not match {digest}")
    return payload


def parsed(record: bytes) -> tuple:
    """(payload_bytes, payload_digest, record_type, refers_to) of a record's bytes."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF)[1:])
    length = int(fields["Content-Length"])
    if block[length:] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} does not end where it says")
    n, digest = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        payload = block[len(HTTP_HEAD) : length]
        own = len(payload), b32encode(sha1(payload).digest()).decode()
        if own != (n, digest):
            raise ValueError(f"record {fields['WARC-Record-ID']} does not hold what it says")
    refers = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("WARC-Refers-To", ""))
    return n, digest, fields["WARC-Type"], int(refers[1]) if refers else None


@dataclass
class Archive:
    """Paths of an archive's two tables."""

    spark: SparkSession
    path: str

    @property
    def payloads(self) -> DataFrame:
        """(digest, owner, packed)"""
        return self.spark.read.parquet(f"{self.path}/payloads")

    @property
    def records(self) -> DataFrame:
        """(page_id, digest, record_type, header)"""
        return self.spark.read.parquet(f"{self.path}/records")

    def rebuilt(self) -> DataFrame:
        """Each record's bytes (``record``) beside page_id: header, HTTP head,
        payload unless it is a revisit, and the two line ends."""
        end = (CRLF * 2).encode()

        def rows(batch):
            return [(i, header.encode() + unpacked(digest, data) + end) for i, header, digest, data in batch]

        whole = self.records.where("record_type = 'response'").join(self.payloads.select("digest", "packed"), "digest")
        responses = per_row(whole, "page_id long, record binary", rows, ["page_id", "header", "digest", "packed"])
        revisits = self.records.where("record_type = 'revisit'").select(
            "page_id", F.encode(F.concat("header", F.lit(CRLF * 2)), "UTF-8").alias("record")
        )
        return responses.unionByName(revisits)

    def index(self) -> DataFrame:
        """Per record what its bytes say."""

        def rows(batch):
            return [(i, *parsed(bytes(record))) for i, record in batch]

        ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
        return per_row(self.rebuilt(), ddl, rows, ["page_id", "record"])


def write(
    pages: DataFrame,
    path: str,
    min_payload: int = 0,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = "2026-01-01T00:00:00Z",
) -> Archive:
    """Write ``pages`` to an archive under ``path``."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    keyed = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", "%0A").alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    # groups of copies collapse before the shuffle
    packed(keyed).groupBy("digest").agg(F.min("page_id").alias("owner"), F.first("packed").alias("packed")).write.option(
        "compression", "none"
    ).parquet(f"{path}/payloads")
    archive = Archive(pages.sparkSession, path)
    owners = archive.payloads.select("digest", "owner")
    n = F.octet_length("payload")
    small = keyed.select(
        "page_id", "url", "digest", n.alias("n"), base32(F.sha1("payload")).alias("sha1")
    )
    revisit = (F.col("n") >= min_payload) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Payload-Length", F.col("n").cast("string")),
        F.when(
            F.col("record_type") == "revisit",
            F.concat(
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("owner").cast("string"), F.lit(">"))),
                line("WARC-Profile", F.lit(PROFILE)),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line(
            "Content-Length",
            (F.lit(len(HTTP_HEAD)) + F.when(F.col("record_type") == "response", F.col("n")).otherwise(0)).cast("string"),
        ),
        F.lit(CRLF + HTTP_HEAD),
    )
    (
        small.join(owners, "digest")
        .withColumn("record_type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")))
        .select("page_id", "digest", "record_type", header.alias("header"))
        .write.parquet(f"{path}/records")
    )
    return archive


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return write(table(spark, sf_dir, "pages"), path).index()


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner
  FROM pages
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, 5 * (k // 4)::BIGINT + 1, 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT) & 31) + 1, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM p
"""
