"""WARC archives with revisit resolution, written and read by Spark.

An archive is a text file of Spark whose line separator is the blank line pair that ends a WARC
record, so Spark's committer writes it (to any file system, safe against lost executors).  It is
read as a binary file and cut by Content-Length, never by separators, since a payload may hold
anything.

Of responses with equal payloads of at least ``least`` bytes the one with the largest id stays a
response; the others become revisit records that carry fresh headers (with the HTTP headers of the
response, no payload) and the id of the response.  Rows that repeat the largest id stay responses
too, so each row gives one record.  A row with a null id is a response with an empty id.  Null
payloads are empty.  A null url is written as an empty one.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.llm.shared import shared_folder

#: Bytes of a payload from which on copies are written as revisits.
LEAST = 1000
#: Records of an archive.  It is read record by record, so its compressed bytes and one record are in memory.
ARCHIVE_RECORDS = 1000
#: Tasks that the copies of a payload are dealt over.
SALTS = 32
EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"
_URN = "urn:page:"


def _head(*fields: tuple[str, Column]) -> Column:
    lines = [F.lit("WARC/1.1")]
    lines += [F.concat(F.lit(f"\r\n{name}: "), value) for name, value in fields]
    return F.concat(*lines, F.lit(_END))


def response_headers(records: DataFrame, least: int = LEAST) -> DataFrame:
    """For each payload digest that several records share: the record that stays a response.

    Only headers (digest and id) are shuffled; the maximum is combined before the shuffle.
    """
    large = records.filter(F.col("payload_bytes") >= least)
    return large.groupBy("digest").agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("digest", "original")


def resolve_revisits(records: DataFrame, least: int = LEAST) -> DataFrame:
    """``records`` (id, url, payload, payload_bytes, digest) with ``refers_to``, null for responses.

    Copies of a payload are dealt over SALTS tasks, and records that can't be revisits join on a key
    of their own, so no payload's copies meet in one task.  The other side has headers only.
    """
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    originals = response_headers(records, least).select(F.col("digest").alias("__key"), F.col("original").alias("__original"), salts.alias("__salt"))
    spread = F.xxhash64("id", "url")
    key = F.when(F.col("payload_bytes") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), spread.cast("string")))
    keyed = records.withColumn("__key", key).withColumn("__salt", F.pmod(spread, F.lit(SALTS)))
    joined = keyed.join(originals, ["__key", "__salt"], "left")
    return joined.withColumn("refers_to", F.when(F.col("__original") != F.col("id"), F.col("__original"))).drop("__key", "__salt", "__original")


def record_text(date: str = EPOCH) -> Column:
    """A WARC record for a row of ``resolve_revisits``."""
    url, ident = F.coalesce("url", F.lit("")), F.concat(F.lit(f"<{_URN}"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    common = [("WARC-Record-ID", ident), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.regexp_replace(url, "[\r\n]", "%0A")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    kind = [("Content-Type", F.lit("application/http; msgtype=response"))]
    full = F.concat(_head(("WARC-Type", F.lit("response")), *common, *kind, ("Content-Length", (F.octet_length(http) + F.col("payload_bytes")).cast("string"))), http, F.coalesce("payload", F.lit("")))
    refers = [("WARC-Refers-To", F.concat(F.lit(f"<{_URN}"), F.col("refers_to").cast("string"), F.lit(">"))), ("WARC-Profile", F.lit(PROFILE))]
    short = _head(("WARC-Type", F.lit("revisit")), *common, *refers, *kind, ("Content-Length", F.octet_length(http).cast("string")))
    short = F.concat(short, http)
    return F.when(F.col("refers_to").isNull(), full).otherwise(short)


def write_archives(records: DataFrame, path: str) -> None:
    """Writes the records, gzip-compressed, at most ARCHIVE_RECORDS to an archive."""
    out = records.select(record_text().alias("value"))
    out.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def _records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and the block of each record of an archive, read one by one."""
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head = {}
        while (line := file.readline().rstrip(b"\r\n").decode("utf-8")):
            name, _, value = line.partition(":")
            head[name.lower()] = value.removeprefix(" ")
        size = int(head["content-length"])
        block = file.read(size)
        if len(block) < size or file.read(4) != _END.encode():
            raise ValueError("a WARC record is cut off")
        yield head, block


def _ident(value: str | None) -> int | None:
    ident = value[len(_URN) + 1 : -1] if value else ""
    return int(ident) if ident else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "url", "record_type", "digest", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            file = io.BytesIO(content.as_buffer())
            rows: list[tuple] = []
            room = 0
            for head, block in _records(gzip.GzipFile(fileobj=file) if name.endswith(".gz") else file):
                payload = block[block.index(_END.encode()) + 4 :] if head["warc-type"] == "response" else None
                rows.append((_ident(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), _ident(head.get("warc-refers-to")), payload))
                room += len(block)
                if room > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows, room = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives of a folder; a revisit has no payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_read, "id long, url string, record_type string, digest string, refers_to long, payload binary")


def op10_warc(spark, folder: str) -> DataFrame:
    """Every page written to deduplicated archives and read back, revisits resolved."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    html = F.coalesce("html", F.lit(""))
    records = pages.select(F.col("page_id").alias("id"), "url", html.alias("payload"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    path = shared_folder(spark, "warc")
    write_archives(resolve_revisits(records), path)
    back = read_archives(spark, path)
    responses = back.filter("record_type = 'response'").select(F.col("id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = back.filter("record_type = 'revisit'").select("id", "refers_to", "digest")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    visited = responses.filter(F.col("payload_bytes") >= LEAST).select(F.col("id").alias("refers_to"), "payload_bytes", "digest").join(revisits.select("refers_to", "digest").distinct(), ["refers_to", "digest"], "left_semi")
    originals = visited.groupBy("refers_to", "digest").agg(F.max("payload_bytes").alias("payload_bytes")).withColumn("salt", salts)
    resolved = revisits.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).join(originals, ["refers_to", "digest", "salt"]).select("id", "payload_bytes", "digest", F.lit("revisit").alias("record_type"), "refers_to")
    return responses.union(resolved).select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN m.original <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.original <> p.page_id THEN m.original END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND p.payload_bytes >= 1000
"""
