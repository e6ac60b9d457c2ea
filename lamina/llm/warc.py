"""WARC archives with resolved revisits (operator 5).

Headers are shuffled by payload digest and reduced to the smallest page of each digest that returns;
joined with these, they tell which pages are revisits. Payloads are not shuffled for that: the pages
that a bitmap of revisits can't hold stay where they are, and only the few others that it takes for
revisits are looked up by a join. Archives are written with fresh headers and without the payloads of
revisits; reading them back, each revisit record is joined to the response that it refers to.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.bitmap import Bitmap
from lamina.llm.common import materialised, shared_folder

CRLF, END = "\r\n", "\r\n\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def resolved(pages: DataFrame, least_bytes: int, id_column: str, url_column: str, html_column: str) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is set for revisits only, whose payload is null."""
    payload = F.coalesce(html_column, F.lit(""))
    page = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    headers = materialised(page.select("page_id", "url", "digest", F.octet_length("payload").alias("size")))
    heads = headers.where(F.col("size") >= least_bytes).groupBy(F.col("digest").alias("of_digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Kept apart from the join, or the partition of a payload that many pages share could not be split.
    returning = materialised(heads.where("n > 1 AND first IS NOT NULL").select("of_digest", "first"))
    again = Bitmap(returning.select(F.xxhash64("of_digest").alias("of")), "of")
    maybe = again.filter(headers.withColumn("mark", F.xxhash64("digest")), "mark")
    met = maybe.join(returning, maybe["digest"] == returning["of_digest"]).where(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = materialised(met.select("page_id", "url", F.lit(None).cast("string").alias("payload"), "digest", F.col("first").alias("refers_to")))

    pair = F.xxhash64("page_id", "digest")
    pairs = lambda df: df.select(F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest")).distinct()
    held = Bitmap(revisits.select(pair.alias("of")), "of")
    suspects = held.filter(headers.withColumn("mark", pair), "mark").select("page_id", "digest")
    wrong = materialised(pairs(_by_pair(suspects, pairs(revisits), "left_anti")))
    marked = page.withColumn("mark", pair)
    looked_up = Bitmap(wrong.select(F.xxhash64("of_page", "of_digest").alias("of")), "of").filter(marked, "mark")
    responses = held.filter(marked, "mark", inside=False).unionAll(_by_pair(looked_up, wrong, "left_semi")).drop("mark")
    return responses.withColumn("refers_to", F.lit(None).cast(page.schema["page_id"].dataType)).unionAll(revisits)


def _by_pair(pages: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
    return pages.join(pairs, pages["page_id"].eqNullSafe(pairs["of_page"]) & (pages["digest"] == pairs["of_digest"]), how)


def header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def record(date: str) -> Column:
    """A whole record as text, without the blank lines that end it."""
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP), F.coalesce("payload", F.lit("")))
    urn = lambda page: F.concat(F.lit("<urn:x-page:"), page.cast("string"), F.lit(":"), F.col("digest"), F.lit(">"))
    unsafe = F.col("url").rlike(r"[\x00-\x20\x7f]")
    return F.concat(
        F.lit(VERSION + CRLF),
        header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", urn(F.coalesce(F.col("page_id").cast("string"), F.lit("none")))),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", F.when(unsafe, F.url_encode("url")).otherwise(F.col("url"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}{CRLF}")).otherwise(F.lit("")),
        header("WARC-Refers-To", urn(F.col("refers_to"))),
        header("WARC-Refers-To-Page", F.col("refers_to")),
        header("WARC-Page", F.col("page_id")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        header("Content-Length", F.octet_length(block)),
        F.lit(CRLF),
        block,
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100, archive_bytes: int = 16 << 20, date: str = "2024-01-01T00:00:00Z", id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> None:
    """Writes gzip-compressed archives of about archive_bytes (before compression) each, by Spark's own
    writer and commit protocol. An archive holds one record at least, so no record is too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for one in batch.column(0):
                text = one.as_py()
                held.append(text)
                size += len(text)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([END.join(held)])], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.join(held)])], ["value"])

    records = resolved(pages, least_bytes, id_column, url_column, html_column).select(record(date).alias("value"))
    records.mapInArrow(run, "value string").write.option("lineSep", END).option("maxRecordsPerFile", 1).option("compression", "gzip").text(folder)


FIELD = re.compile(rb"([^:\r\n]+): ([^\r\n]*)\r\n")


def parse(raw: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(raw):
        start = raw.index(b"\r\n", at) + 2
        if not raw.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        stop = raw.index(b"\r\n\r\n", start - 2) + 2
        fields = {k.lower(): v for k, v in FIELD.findall(raw, start, stop)}
        body = stop + 2
        at = body + int(fields[b"content-length"])
        if raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record is not as long as it says")
        yield fields, raw[body:at]
        at += 4


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, digest, payload_bytes): one row a record. A response's digest
    and size are those of the payload that was read, and a header that says otherwise is an error; a
    revisit has the digest of its header and no size."""

    def number(value: bytes | None) -> int | None:
        return None if value is None else int(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse(zlib.decompress(content.as_py(), wbits=47)):
                    kind, said = fields[b"warc-type"], fields[b"warc-payload-digest"].removeprefix(b"sha256:").decode()
                    size = None
                    if kind == b"response":
                        payload = memoryview(block)[block.index(b"\r\n\r\n") + 4 :]
                        size = len(payload)
                        if hashlib.sha256(payload).hexdigest() != said:
                            raise ValueError("a payload does not match its digest")
                    rows.append((number(fields.get(b"warc-page")), kind.decode(), number(fields.get(b"warc-refers-to-page")), said, size))
                if not rows:
                    continue
                page, kind, refers, digest, size = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(kind), pa.array(refers, pa.int64()), pa.array(digest), pa.array(size, pa.int64())], ["page_id", "record_type", "refers_to", "digest", "payload_bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(run, "page_id long, record_type string, refers_to long, digest string, payload_bytes long")


def revisits_resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisit records take the size
    and digest of the response that they refer to. One response may be revisited by any number of
    records; the engine splits such a partition, as only the revisits' side of the join is skewed."""
    records = materialised(records)  # without payloads; the archives are read and checked once
    responses = records.where("record_type = 'response'")
    originals = responses.select(F.col("page_id").alias("original"), F.col("digest").alias("of_digest"), F.col("payload_bytes").alias("bytes")).distinct()
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes")
    met = revisits.join(originals, (revisits["refers_to"] == originals["original"]) & (revisits["digest"] == originals["of_digest"]), "left")
    columns = lambda size, digest: ["page_id", F.col(size).alias("payload_bytes"), F.col(digest).alias("payload_digest"), "record_type", "refers_to"]
    return responses.select(*columns("payload_bytes", "digest")).unionAll(met.select(*columns("bytes", "of_digest")))


def deduplicated(pages: DataFrame, folder: str | None = None, least_bytes: int = 100) -> DataFrame:
    """Writes archives of pages (page_id, url, html), reads them back and resolves revisits: one row
    for each row in.

    A null html is an empty payload. Payloads under least_bytes are always responses. Among equal
    payloads, rows with the smallest page_id are responses (all of them, if that row repeats), the rest
    revisit it; a null page_id revisits any other and is a response where no row has an id. A null url
    leaves its header out. An empty table writes no record and gives an empty result. Page ids must be
    whole numbers, up to a long: those of another type raise ValueError.
    """
    if not isinstance(pages.schema["page_id"].dataType, T.IntegralType):
        raise ValueError("page ids must be whole numbers")
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    write_archives(pages, folder, least_bytes)
    return revisits_resolved(read_archives(spark, folder))
