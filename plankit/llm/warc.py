"""WARC archives with identical payloads stored once.

Headers (id, digest, size: no payload) are written, shuffled by payload digest and pre-aggregated to
the original of each digest; records are joined to their original, and go to the archives either whole
(response) or as headers that refer to it (revisit, profile identical-payload-digest). An archive is
of WARC/1.1 records, each a gzip member of its own, so that a reader may start at any of them. A task
writes as many archives as its records fill, each of about ``archive_bytes``, so that a reader may
also hold one whole. Archives are rows of Spark's text writer, one to a file, and so are written by its
committer, to any file system; the line separator that ends a file is a gzip member without content.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plankit.llm.arrow import map_arrow
from plankit.llm.scratch import written

#: Compressed bytes of an archive, about; and tasks that write archives, at most.
ARCHIVE_BYTES, TASKS = 8 << 20, 8192
MIN_PAYLOAD = 0
_LEVEL = 4
#: Fixed values of the format.
_END = b"\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:plankit:page:"


def member(content: bytes) -> bytes:
    """A gzip member of its own."""
    made = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return made.compress(content) + made.flush()


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base32: four characters for each five hexadecimal digits."""
    digits = F.sha1(payload)
    letters = []
    for at in range(1, 41, 5):
        word = F.conv(F.substring(digits, at, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(word, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload binary, payload_bytes, payload_digest); a null payload is empty."""
    payload = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit("").cast("binary"))
    made = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return made.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def revisits(headers: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, payload_digest, refers_to): the records of headers that repeat the payload of another.

    headers: (page_id, payload_digest, payload_bytes). The record with the largest page_id of a
    payload is its original, and smaller payloads than min_payload are never repeats. Rows that repeat
    that page_id are originals too; a null page_id is less than any.
    """
    of_size = headers.where(F.col("payload_bytes") >= min_payload)
    originals = of_size.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = of_size.select("page_id", "payload_digest").distinct().join(originals, "payload_digest")
    return joined.where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "payload_digest", "refers_to")


def _urn(page_id: int | None, digest: str, nth: int = 0) -> str:
    """The id of a record; nth tells apart records that agree in page id and payload."""
    return f"<{_URN}{'' if page_id is None else page_id}:{digest}{f':{nth}' if nth else ''}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, nth: int = 0) -> bytes:
    """The bytes of a record: fresh headers, the HTTP headers, and a response's payload. A revisit has refers_to."""
    again = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + _END
    named = {
        "WARC-Type": "revisit" if again else "response",
        "WARC-Record-ID": _urn(page_id, digest, nth),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else url.replace("\r", "%0A").replace("\n", "%0A") or "about:blank",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Refers-To": _urn(refers_to, digest) if again else None,
        "WARC-Profile": _PROFILE if again else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(http) + (0 if again else len(payload))),
    }
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in named.items() if v is not None]]
    return "\r\n".join(lines).encode() + _END + http + (b"" if again else payload) + _END


def _archived(archive_bytes: int, date: str):
    """Records in, archives out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, Counter()

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["blob"])

        for batch in batches:
            for row in zip(*batch.columns):
                page_id, url, payload, digest, refers_to, repeated = (x.as_py() for x in row)
                if repeated:
                    seen[page_id, digest] += 1
                held.append(member(record(page_id, url, payload, digest, refers_to, date, max(0, seen[page_id, digest] - 1) if repeated else 0)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield closed()
                    held, size = [], 0
        if held:
            yield closed()

    return each


def write_archives(found: DataFrame, headers: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None, min_payload: int = MIN_PAYLOAD) -> None:
    """Write records (as of records()) to path, each payload once. headers: (page_id, payload_digest, payload_bytes) of them, written before.

    date: of the records, as WARC has it; now, if none is given.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    total = headers.agg(F.sum("payload_bytes")).first()[0] or 0
    tasks = min(TASKS, max(1, math.ceil(total / archive_bytes)))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("_key")  # never null, so records are dealt out once
    again = revisits(headers, min_payload).select("payload_digest", key, "refers_to")
    repeated = headers.groupBy("payload_digest", key).count().where("count > 1").select("payload_digest", "_key", F.lit(True).alias("repeated"))
    known = again.join(repeated, ["payload_digest", "_key"], "full")
    dealt = found.withColumn("_key", key).repartition(tasks, "payload_digest", "_key").join(known, ["payload_digest", "_key"], "left")
    rows = dealt.select("page_id", "url", "payload", "payload_digest", "refers_to", F.coalesce("repeated", F.lit(False)).alias("repeated"))
    blobs = map_arrow(rows, _archived(archive_bytes, date), "blob binary").select(F.col("blob").cast("string").alias("value"))
    blobs.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", member(b"").decode("latin-1")).text(path)


def inflated(content: bytes) -> bytes:
    """A plain archive as it is; the members of a gzip file, one after another."""
    return gzip.GzipFile(fileobj=io.BytesIO(content)).read() if content[:2] == b"\x1f\x8b" else content


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], int, int]]:
    """The headers of each record of an archive, by lower-case name, and where its block starts and ends."""
    at = 0
    while at < len(archive):
        stop = archive.index(_END, at)
        lines = archive[at:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = stop + 4
        end = start + int(headers["content-length"])
        yield headers, start, end
        at = end + 4


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives in path: page_id, url, record_type, refers_to, payload_bytes, payload_digest.

    Sizes are of the full payload, which a revisit's HTTP headers state. A response's payload is
    checked against its digest; a record that differs raises. with_payload adds the payload (null for
    a revisit).
    """
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload

    def urn(value: str | None) -> int | None:
        number = (value or "").strip("<>").removeprefix(_URN).partition(":")[0]
        return int(number) if number else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                archive, rows = inflated(content.as_py()), []
                for headers, start, end in parse(archive):
                    body = archive.index(_END, start, end) + 4
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                    payload = archive[body:end] if kind == "response" else None
                    if payload is None:
                        size = int(archive[start:body].lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                    else:
                        size = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"the payload of {headers['warc-record-id']} differs from its digest")
                    row = (urn(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, urn(headers.get("warc-refers-to")), size, digest)
                    rows.append((*row, payload) if with_payload else row)
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    return map_arrow(files, each, schema)


def archive(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for each row of pages to path, each payload once, and read the archives back.

    Null and empty payloads are empty ones, and equal; a null url has no target header, an empty one
    is about:blank; rows without page_id have a record id without one and never are originals of others;
    rows that repeat page_id and payload have record ids that a number tells apart; an empty table makes
    no archive and gives no rows; other columns of pages are not looked at.
    """
    found = records(pages, id_col, url_col, payload_col)
    headers, _ = written(found.select("page_id", "payload_digest", "payload_bytes"), "headers")
    write_archives(found, headers, path, archive_bytes)
    return read_archives(pages.sparkSession, path)
