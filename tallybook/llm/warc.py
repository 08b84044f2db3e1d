"""A content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records by join."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, stored, tidied, utf8

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    """``payloads``: (digest, payload); ``headers``: (digest, warc_header, http_header), the records' exact header bytes."""

    payloads: DataFrame
    headers: DataFrame


def _record_id(page: Column, digest: Column) -> Column:
    """A record's name: its page's id and its payload's digest."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":sha256:"), digest, F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field that is null has none."""
    return F.concat_ws("", *(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in fields))


def write(pages: DataFrame, least_revisit: int = LEAST_REVISIT, date: str = DATE, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> Archive:
    """Write a record for each page to a new archive in the shared folder.

    Payloads are addressed by SHA-256. The digest is verified: should two payloads of one digest differ in
    length or MD5, the write fails. Among records whose payloads are equal and of ``least_revisit`` bytes
    or more, that of the smallest page id is the response and the others revisit it; shorter payloads are
    all responses. Null html is an empty payload. Rows that repeat the response's page id and payload are
    responses too; rows with null ids revisit the smallest id, or are responses where no copy has an id.
    A null url leaves its header line out. Empty tables give an empty archive.
    """
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"), utf8(html_column).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    index = stored(rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"), F.md5("payload").alias("second")), "warc-index")
    same = (F.min("size") == F.max("size")) & (F.min("second") == F.max("second"))
    firsts = index.groupBy("digest").agg(F.min("page_id").alias("first"), F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("two payloads have one digest"))).alias("verified"))
    found = index.join(firsts, "digest").filter("verified")
    revisit = (F.col("size") >= least_revisit) & ~F.col("page_id").eqNullSafe(F.col("first"))
    found = found.select("page_id", "url", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length("http_header") + F.when(F.col("record_type") == "response", F.col("size")).otherwise(0)
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _lines(
            ("WARC-Type", F.col("record_type")),
            ("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
            ("WARC-Date", F.lit(date)),
            ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), _record_id(F.col("refers_to"), F.col("digest")))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
            ("Content-Length", length.cast("string")),
        ),
        F.lit("\r\n"),
    )
    headers = found.withColumn("http_header", http).withColumn("warc_header", header).select("digest", F.col("warc_header").cast("binary"), F.col("http_header").cast("binary"))
    # Equal digests meet on the map side first: a payload of many copies crosses the shuffle once from each task.
    payloads = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    return Archive(stored(payloads, "warc-payloads"), stored(headers, "warc-headers"))


def _field(header: Column, name: str) -> Column:
    """A header field's value; null without such a field. Only the two characters of a line end part fields, as written."""
    return F.nullif(F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))


def records(archive: Archive) -> DataFrame:
    """(record, payload): each original record's bytes, and its payload, also where it revisits another.

    The headers meet the payloads by digest; what belongs in a record follows from its own header.
    """
    joined = archive.headers.join(archive.payloads, "digest")
    block = F.when(_field(F.col("warc_header").cast("string"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select(F.concat("warc_header", "http_header", block, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def read_back(archive: Archive, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): what the rebuilt records themselves say.

    Page ids, types and references are parsed from the header bytes of each record; sizes and digests are
    taken anew from the payload bytes. A record whose payload, its own or the one it refers to, has not the
    digest that its header states, or whose length is not as stated, fails the reading.
    """
    parts = records(archive).withColumn("header", F.split_part(F.col("record").cast("string"), F.lit("\r\n\r\n"), F.lit(1)))
    # A record is its header and two line ends, the block as long as stated, and two line ends again.
    block = F.octet_length("record") - F.octet_length("header") - 4 - 4
    whole = F.col("header").startswith("WARC/1.1\r\n") & (block == _field(F.col("header"), "Content-Length").cast("long")) & (F.concat(F.lit("sha256:"), F.col("payload_digest")) == _field(F.col("header"), "WARC-Payload-Digest"))
    page = lambda name: F.nullif(F.regexp_extract(_field(F.col("header"), name), "^<urn:page:(.*):sha256:", 1), F.lit("")).cast(id_type)
    parts = parts.withColumn("payload_digest", F.sha2("payload", 256))
    kind = F.when(F.coalesce(whole, F.lit(False)), _field(F.col("header"), "WARC-Type")).otherwise(F.raise_error(F.lit("a record is not as its header says")))
    return parts.select(page("WARC-Record-ID").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", kind.alias("record_type"), page("WARC-Refers-To").alias("refers_to"))


def export(archive: Archive, path: str, compression: str = "gzip", records_in_file: int = 10_000) -> None:
    """Write the records as WARC files: each is followed by two line ends, the text writer's separator."""
    text = F.expr("cast(substring(record, 1, octet_length(record) - 4) as string)")
    written = records(archive).select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression)
    written.option("maxRecordsPerFile", records_in_file).text(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, refers_to, target_uri, payload_digest, payload): the records of WARC files, plain or gzip.

    One task reads a file whole: files hold as many records as ``export`` was asked for.
    """
    bounded_batches(spark)
    names = ["record_type", "record_id", "refers_to", "target_uri", "payload_digest"]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                if content[:2] == b"\x1f\x8b":
                    content = gzip.decompress(content)
                rows: list[tuple] = []
                at = 0
                while at < len(content):
                    end = content.index(b"\r\n\r\n", at)
                    fields = dict(line.split(": ", 1) for line in content[at:end].decode().split("\r\n")[1:])
                    size = int(fields["Content-Length"])
                    block = content[end + 4 : end + 4 + size]
                    payload = block.partition(b"\r\n\r\n")[2]
                    rows.append((fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), fields.get("WARC-Target-URI"), fields["WARC-Payload-Digest"].removeprefix("sha256:"), payload))
                    at = end + 4 + size + 4
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:5]), pa.array(columns[5], pa.binary())], names=[*names, "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{n} string" for n in names) + ", payload binary")
