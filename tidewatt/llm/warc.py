"""WARC archives without repeated payloads, and reading them back with revisits resolved.

Headers of all pages meet by payload digest; of the pages that share a payload the one with
the smallest id keeps it, the others become revisit records that refer to it. Records are
made by column expressions and written by Spark's text writer, whose line separator is the
blank lines that end a record, so a part file is a WARC file (compressed as a whole). Files
hold a bounded number of records.

Defined results: a null payload is empty; payloads shorter than ``least_bytes`` are always
responses; rows that repeat the smallest id and its payload are responses each; a null id is
larger than all others; a null URL gives a record without target; line breaks in a URL are
percent-encoded; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.session import stage_path, staged

# Fixed values of the WARC 1.1 format.
VERSION, END = "WARC/1.1", "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FILE_BYTES = 16 << 20


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits."""
    out = []
    for k in range(8):
        number = F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(number, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def record_id(page_id: Column, digest: Column) -> Column:
    """A URN that depends on a page's id and payload alone."""
    name = F.sha2(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("null")), digest).cast("binary"), 256)
    parts = [F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def field(name: str, value: Column) -> Column:
    """One header line, or nothing where the value is null."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, *, date: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """(record, n_bytes): the text of each record, less the blank lines that end it."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"n_bytes": F.octet_length("body"), "digest": F.sha2(F.col("body").cast("binary"), 256), "sha1": F.sha1(F.col("body").cast("binary"))})
    headers = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"))
    rows = rows.join(staged(headers, "payloads"), "digest")
    again = (F.col("n_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("body")))
    target = F.when(again, record_id(F.col("first_id"), F.col("digest")))
    header = F.concat(
        F.lit(VERSION + "\r\n"),
        field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        field("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        field("WARC-Profile", F.when(again, REVISIT)),
        field("WARC-Refers-To", target),
        field("WARC-Refers-To-Target-URI", F.when(again, F.col("first_url"))),
        field("WARC-Refers-To-Date", F.when(again, date)),
        field("X-Page-ID", F.col("page_id").cast("string")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(header, block).alias("record"))


def write_archives(pages: DataFrame, path: str, *, date: str, payload: str = "html", file_bytes: int = FILE_BYTES, **options) -> None:
    """Writes the pages as gzip files of records; a file holds about ``file_bytes`` at most, or one record."""
    size = F.coalesce(F.octet_length(F.col(payload).cast("string")), F.lit(0)) + 1000
    mean = pages.agg(F.avg(size)).first()[0] or file_bytes
    out = records(pages, date=date, payload=payload, **options)
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(file_bytes / mean))).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, found by the lengths that the headers give."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record begins at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        begin = end + 4
        at = begin + int(fields["Content-Length"]) + len(END)
        yield fields, content[begin : at - len(END)]


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """(page_id, record_type, record_id, target, refers_to, declared, payload_bytes, payload_digest[, payload])
    of every record; what is said of the payload is computed from the payload."""
    schema = "page_id string, record_type string, record_id string, target string, refers_to string, declared string, payload_bytes bigint, payload_digest string, payload binary"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    if not with_payload:
        schema = schema.removesuffix(", payload binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                rows = []
                for fields, block in parse(gzip.decompress(value.as_py())):
                    body = block[block.index(b"\r\n\r\n") + 4 :]
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    rows.append((fields.get("X-Page-ID"), fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Target-URI"), fields.get("WARC-Refers-To"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), len(body), digest, body))
                kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names) if with_payload else pa.RecordBatch.from_arrays(columns[:-1], names=names[:-1])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def resolved(read: DataFrame) -> DataFrame:
    """Page id, type, payload size and digest of each record; revisits take theirs from the response they refer to."""
    narrow = staged(read.select("page_id", "record_type", "record_id", "refers_to", "payload_bytes", "payload_digest"), "records")
    responses = narrow.where("record_type = 'response'").dropDuplicates(["record_id"])
    originals = staged(responses.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("of_page"), F.col("payload_bytes").alias("of_bytes"), F.col("payload_digest").alias("of_digest")), "originals")
    revisits = narrow.where("record_type = 'revisit'").join(originals, "refers_to", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = narrow.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("string")).select(columns)
    return own.unionByName(revisits.select("page_id", F.col("of_bytes").alias("payload_bytes"), F.col("of_digest").alias("payload_digest"), "record_type", F.col("of_page").alias("refers_to")))


def archive_digest(pages: DataFrame, *, date: str = "2025-01-01T00:00:00Z", page_id: str = "page_id", **options) -> DataFrame:
    """Writes the pages, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = stage_path(spark, "warc")
    write_archives(pages, path, date=date, page_id=page_id, **options)
    kind = pages.schema[page_id].dataType
    return resolved(read_archives(spark, path, with_payload=False)).withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
