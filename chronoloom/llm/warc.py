"""WARC archives with revisit records for repeated payloads.

Only headers (id, URL, payload digest and length) are shuffled by digest. Of records
with equal payloads of at least min_bytes, the one with the largest id keeps its payload;
revisit records are joined to it. All records get fresh headers and are written as
archives by Spark's own writer, so a lost task is redone and no half archive stays. A
reader parses the archives by Content-Length.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, scratch_path, written

#: Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def _record_id(id_: Column, url: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.coalesce(id_.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-"))))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-"))][:-1], F.lit(">"))


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """Per row: id, url, payload_bytes, payload_digest, record_type, refers_to, refers_to_url.

    - Null payload counts as empty. Null ids are never referred to, unless a payload has no
      other: then all its rows are responses.
    - Rows that repeat the largest id with the same payload are all responses.
    """
    body = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    heads = only(pages, id_col, url_col, payload_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body.cast("binary")).alias("payload_digest"))
    heads = written(heads, "warc-heads")
    # struct of id and URL: the URL of the largest id
    first = heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    first = written(first, "warc-first")
    urls = heads.join(first, (F.col("id") == F.col("refers_to")) & (heads["payload_digest"] == first["payload_digest"])).groupBy(first["payload_digest"].alias("digest"), first["payload_bytes"].alias("bytes"), "refers_to").agg(F.min("url").alias("refers_to_url"))
    urls = written(urls, "warc-originals")
    both = heads.join(urls, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") == F.col("bytes")), "left")
    again = F.col("refers_to").isNotNull() & ~F.col("id").eqNullSafe(F.col("refers_to"))
    return both.select("id", "url", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("refers_to")).alias("refers_to"), F.when(again, F.col("refers_to_url")).alias("refers_to_url"))


def _line(name: str, value: Column) -> Column:
    """A header line, left out if value is null; line ends in it become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.translate(value.cast("string"), "\r\n", "  "), F.lit(END)), F.lit(""))


def records(pages: DataFrame, resolved: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One string for each WARC record, without the two line ends that close it. Payloads are
    joined back by (id, URL, digest); rows equal in all of these are interchangeable, and
    as many come out as went in."""
    body = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    given = only(pages, id_col, url_col, payload_col).select(F.col(f"`{id_col}`").cast("long").alias("p_id"), F.col(f"`{url_col}`").cast("string").alias("p_url"), F.sha1(body.cast("binary")).alias("p_digest"), body.alias("body"))
    r = resolved.dropDuplicates(["id", "url", "payload_digest"])
    same = F.col("p_id").eqNullSafe(F.col("id")) & F.col("p_url").eqNullSafe(F.col("url")) & (F.col("p_digest") == F.col("payload_digest"))
    both = given.join(r, same)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), _line("Content-Length", F.col("payload_bytes")), F.lit(END))
    again = F.col("record_type") == "revisit"
    block = F.when(again, http).otherwise(F.concat(http, F.col("body")))
    head = F.concat(
        F.lit(f"{VERSION}{END}"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", _record_id(F.col("id"), F.col("url"))), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), F.when(again, _line("WARC-Profile", F.lit(REVISIT))).otherwise(""),
        F.when(again, F.concat(_line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("refers_to_url"))), _line("WARC-Refers-To-Target-URI", F.col("refers_to_url")), _line("WARC-Refers-To-Date", F.lit(date)), _line("X-Refers-To-Page", F.col("refers_to")))).otherwise(""),
        _line("X-Page", F.col("id")), F.lit(f"Content-Type: application/http; msgtype=response{END}"), _line("Content-Length", F.octet_length(block)), F.lit(END),
    )
    return both.select(F.concat(head, block).alias("value"))


def write_archives(recs: DataFrame, path: str, per_file: int = 2000, compression: str = "gzip") -> None:
    """Archives of at most per_file records below path; each record is closed by two line ends.
    compression: gzip over each whole archive, or none."""
    recs.write.option("lineSep", 2 * END).option("maxRecordsPerFile", per_file).option("compression", compression).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split(END)
        if lines[0] != VERSION:
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(head["content-length"])
        yield head, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.
    A response's bytes and digest are those of the payload that was read; a revisit's are
    those of its headers, and its payload is null. An archive is read whole by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def as_batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for head, block in parse(content.as_py()):
                    cut = block.index(b"\r\n\r\n") + 4
                    http = {k.lower(): v for k, _, v in (x.partition(": ") for x in block[:cut].decode().split(END))}
                    if head["warc-type"] == "revisit":
                        size, digest, payload = int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:"), None
                    else:
                        payload = block[cut:]
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    rows.append((number(head.get("x-page")), head.get("warc-target-uri"), head["warc-type"], number(head.get("x-refers-to-page")), size, digest, payload))
                    if len(rows) >= 500:
                        yield as_batch(rows)
                        rows = []
                if rows:
                    yield as_batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def dedup_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000, per_file: int | None = None) -> DataFrame:
    """Writes pages as archives below path (a new one in the shared folder by default) and
    reads them back; see resolve_revisits() and read_archives(). An empty table writes no
    record. per_file: records in an archive; by default about 16 MB's worth, 2000 at most."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archives")
    resolved = written(resolve_revisits(pages, id_col, url_col, payload_col, min_bytes), "resolved")
    if per_file is None:
        mean = resolved.agg(F.avg(F.col("payload_bytes") + 1000)).first()[0]
        per_file = max(1, min(2000, int(16e6 / (mean or 1000))))
    write_archives(records(pages, resolved, id_col, url_col, payload_col), path, per_file)
    return read_archives(spark, path)
