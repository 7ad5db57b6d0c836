"""WARC archives of web pages with duplicate payloads as revisit records.

`page_records` decides record types from headers alone: only digests and page_ids meet by
digest, where a key may be hot; the decisions then meet the payloads by page. `write_archive` writes records with fresh headers through Spark's text writer, whose
line separator is the blank line that ends a record, so any Hadoop store works. `read_archive`
parses the files by Content-Length; `resolve` shuffles the headers that were read by payload
digest and joins each revisit to the response it refers to.

Defined results: a null html is an empty payload; a null url is written as an empty one;
among equal rows of the largest page_id each is a response; a null page_id never is the one
that others refer to, and is written without its header; an empty table gives no records.
Files are gzip'ed as a whole (the text writer knows no other way) and hold at most
MAX_RECORDS records; records of more than LARGE bytes are dealt to files of about
FILE_BYTES, so that no file outgrows a task.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obscast.llm.shared import shared_path, stored

#: Payloads of fewer bytes are always written whole.
MIN_BYTES = 1000
MAX_RECORDS, LARGE, FILE_BYTES = 10_000, 65_536, 64_000_000
#: Parts into which the revisits of one payload are dealt when their response is looked up.
SALTS = 8
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = "page_id long, url string, record_type string, digest string, refers_to long, payload_bytes long"


def page_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, digest, payload_bytes, refers_to (null for responses)."""
    html = F.coalesce("html", F.lit(""))
    body = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"))
    body = body.withColumns({"digest": F.sha1("html"), "payload_bytes": F.octet_length("html").cast("long")})
    heads = body.where(F.col("payload_bytes") >= min_bytes).select("page_id", "digest")
    shared = heads.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to"))
    shared = shared.where("n > 1 and refers_to is not null").select("digest", "refers_to")
    # Only headers meet by digest; payloads meet the decisions by page, where no key is hot.
    revisits = heads.join(shared, "digest").where("page_id is null or page_id <> refers_to").distinct()
    revisits = revisits.select(
        F.col("page_id").alias("to_page"), F.col("digest").alias("to_digest"), F.col("refers_to")
    )
    same = F.col("page_id").eqNullSafe(F.col("to_page")) & (F.col("digest") == F.col("to_digest"))
    return body.join(revisits, same, "left").drop("to_page", "to_digest")


def _uuid(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record_text(record_type: Column) -> Column:
    """A record without the blank line at its end."""
    end = "\r\n"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(end + end),
    )
    revisit = record_type == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7F]", "%20")
    fields = [
        F.concat(F.lit("WARC-Type: "), record_type),
        F.concat(F.lit("WARC-Record-ID: "), _uuid(F.coalesce("page_id", F.xxhash64("digest", "url")))),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _uuid(F.col("refers_to")))),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    # concat_ws leaves out the fields that are null.
    return F.concat(F.concat_ws(end, F.lit("WARC/1.1"), *fields), F.lit(end + end), block)


def write_archive(records: DataFrame, path: str) -> None:
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    large = F.col("payload_bytes") > LARGE
    sizes = records.groupBy(large.alias("large")).agg(F.sum("payload_bytes").alias("n")).collect()
    volume = {r.large: r.n for r in sizes}

    def write(rows: DataFrame, name: str) -> None:
        writer = rows.select(record_text(kind).alias("value")).write.option("lineSep", "\r\n\r\n")
        writer.option("compression", "gzip").option("maxRecordsPerFile", MAX_RECORDS).text(f"{path}/{name}")

    # Only the large ones are moved again; an empty archive has one folder, too.
    if volume.get(False) is not None or not volume:
        write(records.where(~large), "small")
    if volume.get(True) is not None:
        shelf = F.pmod(F.xxhash64("page_id", "digest"), F.lit(1 + volume[True] // FILE_BYTES))
        write(records.where(large).repartition(1 + volume[True] // FILE_BYTES, shelf), "large")


def _parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict, bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record is expected, not {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        yield head, block


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row a record; responses are measured and digested from their payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = ["page_id", "url", "record_type", "digest", "refers_to", "payload_bytes"]
        if with_payload:
            kinds, names = [*kinds, pa.binary()], [*names, "payload"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                data = io.BytesIO(content.as_py())
                for head, block in _parse(io.BufferedReader(gzip.GzipFile(fileobj=data))):
                    payload = block.partition(b"\r\n\r\n")[2]
                    whole = head["warc-type"] == "response"
                    digest = hashlib.sha1(payload).hexdigest()
                    told = head["warc-payload-digest"].removeprefix("sha1:")
                    if whole and digest != told:
                        raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
                    row = (
                        number(head.get("x-page-id")), head["warc-target-uri"], head["warc-type"], told,
                        number(head.get("x-refers-to-page-id")), len(payload) if whole else None,
                    )
                    rows.append((*row, payload if whole else None) if with_payload else row)
                    held += len(payload)
                    if len(rows) >= 5000 or held > 16_000_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, _READ + ", payload binary" * with_payload)


def resolve(heads: DataFrame) -> DataFrame:
    """Headers that were read, each revisit with the payload size of its response."""
    whole = heads.where("record_type = 'response' and page_id is not null").select(
        "digest", F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("whole_bytes")
    )
    asked = heads.where("record_type = 'revisit'").select("digest", "refers_to").distinct()
    found = asked.join(whole, ["digest", "refers_to"]).distinct()
    # Very many pages may revisit one response: they are dealt into parts, the response into each.
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    size = F.coalesce("payload_bytes", "whole_bytes").alias("payload_bytes")
    salted = heads.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(found, ["digest", "refers_to", "salt"], "left")
    return joined.select("page_id", "url", size, "digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes deduplicated archives of `pages` to the shared folder and resolves them again."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archive(page_records(pages), path)
    return resolve(stored(read_archive(spark, path), "warc-heads"))
