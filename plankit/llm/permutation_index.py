"""Approximate nearest neighbours by a permutation index (in the manner of the MI-File).

A vector is represented by the order of the pivots by nearness. The index is dealt into blocks of
bounded size; a block posts each of its vectors in the inverted file of each pivot, with the pivot's
place in the vector's order. A query walks the files and adds up footrule distances: how far apart the
places of a pivot are in the two orders. The vectors of a block are ranked by that, and the first SHARE
of them, ties at the end included, are reranked by their exact inner product; of no others it is
computed. Equal vectors are indexed as one, with as many ids as an answer can need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plankit.llm.arrow import map_arrow, ship
from plankit.llm.scratch import written

#: Pivots: a bounded sample, those vectors first in the order of a hash of their id.
PIVOTS = 128
#: The share of a block's vectors, first by footrule distance, that are reranked; and how many at least for each answer.
SHARE, LEAST = 0.25, 4
BLOCK, QUERY_BLOCK = 8192, 4096
#: Vectors of a block that footrule distances are added up for at a time, within a core's cache; an even number.
WIDTH = 2048


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id long, v array<double>): the rows with an id whose vector is not null, not zero, and finite throughout."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0))


def common_length(rows: DataFrame) -> int | None:
    """The most frequent length of the vectors (of equally frequent ones, the longest); None without vectors."""
    found = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return found.n if found else None


def classes(rows: DataFrame, ids: int) -> DataFrame:
    """(cid, v, ids): each different vector, its smallest id, and its ``ids`` smallest ids in order.

    No more than that many copies leave a task: the rank limit is applied before the shuffle too.
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    some = rows.distinct().withColumn("_rank", rank).where(F.col("_rank") <= ids)
    return some.groupBy("v").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 0))


def represented(of: DataFrame, pivots: np.ndarray, extra: str) -> DataFrame:
    """of (cid, v, ...) with v as bytes, and the place of each pivot in the vector's order, the nearest being at 0."""
    names = of.columns
    shared = of.sparkSession.sparkContext.broadcast(pivots)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            points = np.ascontiguousarray(flat, np.float64).reshape(batch.num_rows, -1)
            order = np.argsort(-(points @ shared.value.T), axis=1, kind="stable")
            places = np.argsort(order, axis=1).astype(np.uint8)
            arrays = [pa.array([p.tobytes() for p in points], pa.binary()) if c == "v" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([p.tobytes() for p in places], pa.binary())], [*names, "places"])

    return map_arrow(of, each, f"{extra}, places binary")


def _places(column: pa.ChunkedArray, count: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(count, -1)


def footrule(files: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The footrule distance of each vector of a block to a query: files[p] holds pivot p's place in each one's order.

    |a - b| is 2 max(a, b) - a - b, and the places in any order of the pivots have the same sum, so the
    largest ones are summed alone, of two vectors at a time, as the low and the high bytes of 16-bit words.
    """
    pivots, count = files.shape
    width = min(WIDTH, count + count % 2)
    most = np.zeros((pivots, width), np.uint8)
    two, part = most.view("<u2"), np.empty((pivots, width // 2), np.uint16)
    sums, total = np.empty((2, width // 2), np.uint16), np.empty(count, np.uint16)
    for at in range(0, count, WIDTH):
        here = min(WIDTH, count - at)
        np.maximum(files[:, at : at + here], places[:, None], out=most[:, :here])
        np.add.reduce(np.bitwise_and(two, np.uint16(255), out=part), axis=0, dtype=np.uint16, out=sums[0])
        np.add.reduce(np.right_shift(two, np.uint16(8), out=part), axis=0, dtype=np.uint16, out=sums[1])
        total[at : at + here] = sums.T.ravel()[:here]
    return total * np.uint16(2) - np.uint16(pivots * (pivots - 1))


def _search_block(index: pa.Table, queries: pa.Table, share: float, answers: int) -> pa.Table:
    """The best ``answers`` of the block's reranked vectors for each query: (qid, cid, ids, score)."""
    points, asked = _matrix(index["v"]), _matrix(queries["v"])
    cids = index["cid"].to_numpy()
    files = np.ascontiguousarray(_places(index["places"], len(cids)).T)  # the inverted files
    wanted = min(len(cids), max(LEAST * answers, math.ceil(share * len(cids))))
    found = []
    for number, (query, places) in enumerate(zip(asked, _places(queries["places"], len(asked)))):
        distance = footrule(files, places)
        near_by = np.flatnonzero(distance <= np.partition(distance, wanted - 1)[wanted - 1])
        scores = points[near_by] @ query
        if len(scores) > answers:
            least = np.partition(scores, len(scores) - answers)[len(scores) - answers]
            kept = np.flatnonzero(scores >= least)
            kept = kept[np.lexsort((cids[near_by[kept]], -scores[kept]))[:answers]]
        else:
            kept = np.arange(len(scores))
        found.append((np.full(len(kept), number), near_by[kept]))
    asking, rows = map(np.concatenate, zip(*found))
    # the final measure, of each pair by itself, so that it depends on nothing else in the block
    score = np.einsum("ij,ij->i", points[rows], asked[asking])
    return pa.table([queries["qid"].take(pa.array(asking)), pa.array(cids[rows]), index["ids"].take(pa.array(rows)), pa.array(score)], schema=_FOUND)


_FOUND = pa.schema([("qid", pa.int64()), ("cid", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, share: float = SHARE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries, its k nearest found rows of vectors, itself left out.

    Largest inner product first, ties to the smaller vec_id. Rows without id, and vectors that are
    null, zero, or hold a null, NaN or infinite component take no part, as queries nor as candidates;
    nor do vectors, of either table, of another length than the most frequent one of vectors.
    Rows that repeat an id and vector count once; a row repeating an id with another vector is another
    candidate of that id. Fewer candidates than k: all that were found. Empty tables give no rows.
    Up to 256 pivots; with a share of 1 the answers are exact.
    """
    spark = vectors.sparkSession
    rows, asking = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    length = common_length(rows)
    rows, asking = (r.where(F.size("v") == F.lit(length)) for r in (rows, asking))
    index, _ = written(classes(rows, k + 1), "vectors")
    size = index.count()
    chosen = index.orderBy(F.xxhash64("cid"), "cid").limit(pivots).select("v").collect()
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = np.asarray([r.v for r in chosen])
    members = asking.select(F.col("vec_id").alias("query_id"), "v").distinct()
    asked, _ = written(members.groupBy("v").agg(F.min("query_id").alias("qid"), F.count("*").alias("n")).drop("n"), "queries")
    blocks, query_blocks = math.ceil(size / BLOCK), max(1, math.ceil(asked.count() / QUERY_BLOCK))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = represented(index, base, "v binary, cid long, ids array<long>")
    left = left.withColumn("block", dealt("cid", blocks)).withColumn("query_block", every(query_blocks))
    right = represented(asked, base, "v binary, qid long")
    right = right.withColumn("query_block", dealt("qid", query_blocks)).withColumn("block", every(blocks))

    def cell(some: pa.Table, them: pa.Table) -> pa.Table:
        return _search_block(some, them, share, k + 1) if some.num_rows and them.num_rows else _FOUND.empty_table()

    ship(spark)
    keys = ["block", "query_block"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "qid long, cid long, ids array<long>, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    top = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).select("qid", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    top = top.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).drop("_r")
    who = members.join(asked, "v").select("query_id", "qid")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    full = who.join(top, "qid").where("vec_id <> query_id").withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
    return full.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
