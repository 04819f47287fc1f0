"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Covering (Pagh, SODA 2016): give each of the 64 bit positions a non-zero vector of r + 1 bits. Each
of the 2^(r+1) - 1 non-zero vectors v makes one mask: the positions whose vector has odd inner
product with v. The vectors of any r positions span at most r dimensions, so some v is orthogonal to
all of them, and under its mask two fingerprints that differ in those positions alone are equal.
Every pair within the radius therefore collides in some table, without exception.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plankit.llm.arrow import map_arrow
from plankit.llm.components import components
from plankit.llm.scratch import written

BITS = 64


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words; of the whole sequence if there are fewer; none if no words."""
    words = text.lower().split()  # of bytes: A-Z alone, and the six ASCII white-space characters alone
    if len(words) <= size:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    count = 0 if not words else max(1, len(words) - size + 1)
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, count)


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit is 1 if it is set in over half of the hashes. Signed, as Spark has longs; 0 for none."""
    if not len(hashes):
        return 0
    bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        bits += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row of docs. A null or empty text has no words, and so 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(shingle_hashes(t or b"", size)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], ["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(slim, each, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks. Positions take the non-zero vectors in turn, so masks are of like size."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(nodes: DataFrame, radius: int = 2, crowd: int = 512) -> DataFrame:
    """nodes: (fp long), distinct. Returns edges (u, v) whose components are those of all pairs within radius.

    In a table's buckets of up to ``crowd`` fingerprints, the members are compared with one another.
    More crowded buckets are not compared pair by pair: for an even radius, two fingerprints are that
    near if and only if some point lies within half of it of both. Each member posts its points (65 for
    radius 2), and those that meet at a point are linked to the smallest there: a linear number of rows,
    and at most as many members to a point. For radius 1 each member posts itself and its neighbours,
    and at a point that is itself a member all that meet there are linked to it.
    """
    if radius % 2 and radius != 1:
        raise ValueError("an odd radius above 1 has no exact way for crowded buckets here")
    tables = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(covering_masks(radius))])
    posted = nodes.select("fp", F.explode(tables).alias("t")).select("fp", "t.k", "t.key")
    sizes = posted.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    # merged: an exploded side is sized by its rows before, and would be broadcast
    members, _ = written(posted.join(sizes.hint("merge"), ["k", "key"]), "members")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    few = members.where(F.col("n") <= crowd)
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near)
    pairs = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    bits = [1 << i for i in range(BITS)]
    ball = [0]
    for _ in range((radius + 1) // 2):
        ball = sorted({x ^ b for x in ball for b in [0, *bits]})
    many = members.where(F.col("n") > crowd).select("fp").distinct()
    points = many.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(signed(x))) for x in ball])).alias("at"))
    met = points.groupBy("at").agg(F.array_sort(F.collect_set("fp")).alias("all")).where(F.size("all") > 1)
    if radius == 1:
        met = met.where(F.array_contains("all", F.col("at"))).select(F.col("at").alias("u"), F.explode(F.array_remove("all", F.col("at"))).alias("v"))
    else:
        met = met.select(F.col("all")[0].alias("u"), F.explode(F.slice("all", 2, len(ball))).alias("v"))
    return pairs.unionByName(met)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint string, component_id) for each row of docs.

    Two fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest doc_id
    that can be reached. Equal texts share a fingerprint, and so a class, of which only one member
    takes part in the search. Rows that share a doc_id but not a text are told apart by fingerprint. Null and empty texts have fingerprint zero and link like any other;
    rows without doc_id count in no minimum (a class of such rows alone has component_id null); repeated
    rows each get their row; an empty table gives none; other columns of docs are not looked at.
    """
    marks, _ = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes, _ = written(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    stars = components(links(nodes.select("fp"), radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = nodes.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marks.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
