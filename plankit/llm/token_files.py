"""Token-id files with Elias-Fano encoded document boundaries.

A file holds the ids of consecutive documents (ascending doc_id), one array after another, and where
each document starts. The starts are a growing sequence of n numbers up to u: each one's low
log2(u/n) bits are stored packed, the rest as a unary bit vector in which the i-th one-bit stands at
(start >> low) + i; about 2 + log2(u/n) bits for a document instead of 64. Select (where is the i-th
one-bit?) starts from a sample of every 256th one-bit and counts the bits of a few bytes. The doc ids
grow too, and are kept in the same way, as what they are above the smallest.

Layout, little-endian: MAGIC, 15 numbers of 8 bytes (file's place in order: task and its chunk;
documents; documents without id, which come first; smallest doc id; ids; bytes of an id; then for doc
ids and for starts the number of low bits and the sizes in bytes of the three parts): doc ids, starts
(for each of both low bits, high bits, and select samples of 4 bytes), ids; a newline ends the file. Files are written by Spark's text writer, one row and so one file each,
to any file system, and by its committer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plankit.llm.arrow import map_arrow
from plankit.llm.scratch import starts, written
from plankit.llm.tokens import encoder, slices

MAGIC = b"PKTOKEN2"
_HEAD = 15
_SAMPLE = 256
#: Ids, and documents, in a file, at which it is closed. Documents are never split over files.
FILE_IDS, FILE_DOCS = 3_000_000, 200_000


class EliasFano:
    """A sequence of n growing numbers from 0 to at most u; select(i) returns the i-th."""

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.samples = n, low, lows, highs, samples

    @classmethod
    def encode(cls, values: np.ndarray, u: int) -> EliasFano:
        n = len(values)
        low = max(0, int(u // n).bit_length() - 1) if n else 0
        values = values.astype(np.uint64)
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        vector = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        vector[ones] = 1
        return cls(n, low, lows, np.packbits(vector, bitorder="little"), ones[::_SAMPLE].astype("<u4"))

    def _one(self, i: int) -> int:
        """Where the i-th one-bit of the high part stands."""
        at = int(self.samples[i // _SAMPLE])
        left = i % _SAMPLE
        byte = at // 8
        word = int(self.highs[byte]) >> (at % 8) << (at % 8)
        while (here := word.bit_count()) <= left:
            left, byte = left - here, byte + 1
            word = int(self.highs[byte])
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def select(self, i: int) -> int:
        first, low = i * self.low, 0
        for k in range(self.low):
            low |= (int(self.lows[(first + k) // 8]) >> ((first + k) % 8) & 1) << k
        return (self._one(i) - i) << self.low | low

    def selected(self, first: int, count: int) -> np.ndarray:
        """select() of ``count`` numbers in a row, from the sample before the first; unsigned. Only their bytes are looked at."""
        count = max(0, min(count, self.n - first))
        if not count:
            return np.zeros(0, np.uint64)
        block = first // _SAMPLE
        start, stop = int(self.samples[block]), (first + count - 1) // _SAMPLE + 1
        end = int(self.samples[stop]) + 1 if stop < len(self.samples) else 8 * len(self.highs)
        bits = np.unpackbits(self.highs[start // 8 : (end + 7) // 8], bitorder="little")
        bits[: start % 8] = 0
        skipped = first - block * _SAMPLE
        ones = np.flatnonzero(bits)[skipped : skipped + count] + start // 8 * 8
        found = (ones - np.arange(first, first + count)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            a, b = first * self.low, (first + count) * self.low
            bits = np.unpackbits(self.lows[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].reshape(count, self.low)
            found |= bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low, dtype=np.uint64))
        return found

    def parts(self) -> list[bytes]:
        return [self.lows.tobytes(), self.highs.tobytes(), self.samples.tobytes()]


def pack_file(task: int, chunk: int, docs: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """The bytes of a file, without the newline that ends it. docs: nulls first, then ascending; ids: little-endian, width bytes each."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    bounds = EliasFano.encode(ends - np.asarray(lengths, np.int64), total)
    named = [d for d in docs if d is not None]
    least = named[0] if named else 0
    known = EliasFano.encode(np.asarray([d - least for d in named], np.uint64), named[-1] - least if named else 0)
    parts = [*known.parts(), *bounds.parts()]
    sizes = list(map(len, parts))
    head = [task, chunk, len(docs), len(docs) - len(named), least, total, width, known.low, *sizes[:3], bounds.low, *sizes[3:]]
    return MAGIC + np.asarray(head, "<i8").tobytes() + b"".join(parts) + ids


class TokenFile:
    """A file's contents, as they lie there: ids is a view, boundaries and doc ids stay encoded."""

    def __init__(self, content: bytes):
        if content[: len(MAGIC)] != MAGIC or content[-1:] != b"\n":
            raise ValueError("not a token file")
        head = np.frombuffer(content, "<i8", _HEAD, len(MAGIC)).tolist()
        self.task, self.chunk, self.n, self.nameless, self.least, self.total, width = head[:7]
        (low, *sizes), (bounds_low, *bounds_sizes) = head[7:11], head[11:]
        ends = np.cumsum([len(MAGIC) + 8 * _HEAD, *sizes, *bounds_sizes]).tolist()
        if ends[-1] + self.total * width + 1 != len(content):
            raise ValueError("a token file is cut short")
        part = [np.frombuffer(content, np.uint8, b - a, a) for a, b in zip(ends, ends[1:])]
        self.known = EliasFano(self.n - self.nameless, low, part[0], part[1], part[2].view("<u4"))
        self.bounds = EliasFano(self.n, bounds_low, part[3], part[4], part[5].view("<u4"))
        self.ids = np.frombuffer(content, f"<u{width}", self.total, ends[-1])

    def docs(self, first: int, count: int) -> pa.Array:
        """The ids of documents in a row; null where they have none."""
        count = min(count, self.n - first)
        nulls = max(0, min(count, self.nameless - first))
        named = self.known.selected(first + nulls - self.nameless, count - nulls) + np.uint64(self.least % (1 << 64))
        return pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(named.view(np.int64))])

    def starts(self, first: int, count: int) -> np.ndarray:
        """Where documents in a row start, and where the last of them ends."""
        found = self.bounds.selected(first, count + 1).astype(np.int64)
        return found if first + count < self.n else np.append(found, self.total)

    def tokens(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file."""
        end = self.bounds.select(i + 1) if i + 1 < self.n else self.total
        return self.ids[self.bounds.select(i) : end]


def write_files(docs: DataFrame, path: str, tokenizer: str, kind: str = "words", end_id: int = 2, width: int = 2, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs and write them to path in ascending doc_id order (nulls first; repeated rows side by side).

    Texts are dealt out by ranges of doc_id, so files are in order across tasks too. width: bytes of an
    id; an id that needs more raises.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, chunk = encoder(tokenizer, kind).many, TaskContext.get().partitionId(), 0
        fits = max(end_id, encoder(tokenizer, kind).largest()) < 1 << (8 * width)
        end = np.asarray([end_id], "<u4").tobytes()
        names, lengths, parts, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack_file(task, chunk, names, lengths, b"".join(parts), width)], pa.binary())], ["blob"])

        for batch in batches:
            for some in slices(batch, 1):
                for doc, ids in zip(some.column(0).to_pylist(), encode(some.column(1))):
                    ids = np.frombuffer(ids + end, "<u4")
                    if not fits and int(ids.max()) >> (8 * width):
                        raise ValueError(f"id {ids.max()} needs more than {width} bytes")
                    names.append(doc)
                    lengths.append(len(ids))
                    parts.append(ids.astype(f"<u{width}").tobytes())
                    held += len(ids)
                    if held >= file_ids or len(names) >= FILE_DOCS:
                        yield closed()
                        names, lengths, parts, held, chunk = [], [], [], 0, chunk + 1
        if names:
            yield closed()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    blobs = map_arrow(ordered, each, "blob binary").select(F.col("blob").cast("string").alias("value"))
    blobs.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(task, chunk, doc_id, within, ids binary): a row for each document of the files in path.

    within: ids before it in its file; ids: little-endian unsigned 32-bit. Task and chunk order the files.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = TokenFile(content.as_py())
                for at in range(0, file.n, 1000):
                    some = file.starts(at, 1000)
                    ids = [file.ids[a:b].astype("<u4").tobytes() for a, b in zip(some.tolist(), some[1:].tolist())]
                    n = len(ids)
                    place = [pa.array([x] * n, pa.int64()) for x in (file.task, file.chunk)]
                    yield pa.RecordBatch.from_arrays([*place, file.docs(at, n), pa.array(some[:n]), pa.array(ids, pa.binary())], ["task", "chunk", "doc_id", "within", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    return map_arrow(files, each, "task long, chunk long, doc_id long, within long, ids binary")


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of the files; start counts the ids of all before it.

    A null text is empty: the end id alone. No files, no rows.
    """
    read = read_files(spark, path).select("task", "chunk", "doc_id", "within", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    found, _ = written(read, "offsets")
    sums = found.groupBy("task", "chunk").agg(F.sum("n_tokens").alias("_n"))
    base = starts(sums, ["task", "chunk"], "_n", "_base").select("task", "chunk", "_base")
    return found.join(base, ["task", "chunk"]).select("doc_id", (F.col("_base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
