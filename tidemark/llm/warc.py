"""Operator 9: WARC archives in which repeated payloads are revisits, written and read back.

Heads of pages (id, url, digest and size) are shuffled by digest without the payloads, reduced to the first
page of each and joined to that. The first keeps its payload as a response, the others become revisit records
that name it, with fresh headers all. Revisits are written from their heads alone; payloads meet only the ids
of revisits, to leave those out, and are shuffled for that only where the ids are too many for Spark to
broadcast. Archives are written by Spark's own writer (records separated by the four bytes that WARC asks for,
gzip over the whole file), so a lost executor leaves no half file. A file holds as many records as pages of
the mean size fill ``FILE_BYTES`` with. Reading goes by each record's Content-Length, whatever the payload
holds, and joins revisits to the responses they name.

Null html is an empty payload and a null url an empty one; line ends in a url are written percent-encoded.
Pages that repeat the first's page_id and payload are responses too. A missing page_id sorts after all
others. Payloads shorter than ``least`` bytes are all responses. An empty table gives no archives and an
empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import new_path, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
FILE_BYTES, FILE_RECORDS, HEAD_BYTES = 1 << 27, 20_000, 1024
FIELDS = "page_id long, record_id string, record_type string, refers_to_id string, payload_bytes long, payload_digest string"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary column in upper-case base32: 32 digits for 160 bits, 8 for each 40."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page: Column, digest: Column) -> Column:
    """A name-based UUID of a page's capture, the same whenever the record is made."""
    h = F.md5(F.concat(F.lit("capture:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-") if a > 1 else F.lit(""), F.substring(h, a, n))], F.lit(">"))


def captures(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, digest and size of each page."""
    payload = F.coalesce(F.col(html), F.lit(""))
    return pages.select(
        F.col(page).cast("long").alias("page_id"), F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        payload.alias("payload"), base32_sha1(F.encode(payload, "UTF-8")).alias("digest"), F.octet_length(payload).cast("long").alias("size"),
    )


def mark_revisits(rows: DataFrame, least: int = 0) -> DataFrame:
    """Heads of captures with record_type and, for revisits, the page and url of the response."""
    heads = written(rows.select("page_id", "url", "digest", "size"), "captures")
    known = F.col("page_id").isNotNull()
    firsts = heads.where(F.col("size") >= least).groupBy("digest").agg(F.min(F.when(known, F.struct("page_id", "url"))).alias("first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("size") >= least)
    marked = heads.join(firsts, "digest", "left").select("page_id", "url", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("first"))
    return written(marked, "marks")


def with_payloads(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """All records: revisits as they are marked, responses with their payloads."""
    # Digests first, so that in a sorted partition sizes of pages come in no order.
    capture = F.concat_ws(":", "digest", F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    revisits = marks.where("record_type = 'revisit'")
    left_out = revisits.select(capture.alias("capture")).distinct()
    responses = rows.withColumn("capture", capture).join(left_out, "capture", "left_anti").drop("capture")
    return revisits.withColumn("payload", F.lit(None).cast("string")).unionByName(responses.withColumn("record_type", F.lit("response")), allowMissingColumns=True)


def record_texts(marked: DataFrame, date: str = DATE) -> DataFrame:
    """The text of each record, without the separator that follows it."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("digest"))),
        F.concat(F.lit("WARC-Date: "), F.lit(date)),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), record_id(F.col("first.page_id"), F.col("digest")), F.lit("\r\nWARC-Refers-To-Target-URI: "), F.col("first.url"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return marked.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block).alias("value"))


def records_per_file(marks: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """How many responses of the mean size fill a file, at most ``FILE_RECORDS``."""
    mean = marks.where("record_type = 'response'").agg(F.avg("size")).first()[0]
    return max(1, min(FILE_RECORDS, int(file_bytes // ((mean or 0) + HEAD_BYTES))))


def write_archives(rows: DataFrame, marks: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Gzipped WARC files, one or more a task, of about ``file_bytes`` before compression."""
    records = record_texts(with_payloads(rows, marks))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file(marks, file_bytes)).text(path)


def parse_archive(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends within a record")
        yield headers, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row a record: page_id, record_id, record_type, refers_to_id, and size and digest of payloads at hand."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def read(batches: Iterator[pa.RecordBatch], rows: int = 5000) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        schema = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes") else pa.string()) for n in names])
        out: list[tuple] = []
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                with gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data) as stream:
                    for headers, block in parse_archive(stream):
                        page = headers["warc-page-id"]
                        payload = block.partition(b"\r\n\r\n")[2]
                        kept = headers["warc-type"] == "response"
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kept else headers["warc-payload-digest"].removeprefix("sha1:")
                        out.append((None if page == "null" else int(page), headers["warc-record-id"], headers["warc-type"], headers.get("warc-refers-to"), len(payload) if kept else None, digest))
                        if len(out) >= rows:
                            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out))), schema=schema)
                            out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out))), schema=schema)

    return files.mapInArrow(read, FIELDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each record with the size of its payload and, for revisits, the page it refers to."""
    responses = records.where("record_type = 'response'")
    # Only responses that are referred to are needed, once each.
    originals = responses.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("original_bytes"))
    found = records.where("record_type = 'revisit'").join(originals, "refers_to_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(found.withColumn("payload_bytes", F.col("original_bytes")).select(columns))


def deduplicate_archives(pages: DataFrame, path: str, least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` as archives under ``path``, read them back and resolve their revisits."""
    rows = captures(pages)
    write_archives(rows, mark_revisits(rows, least), path, file_bytes)
    return resolve_revisits(read_archives(pages.sparkSession, path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` through archives in the shared folder."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return deduplicate_archives(pages, new_path(spark, "warc"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS x FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST((i // 8) * 10 + 1 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f
"""
