"""Sharding by Karmarkar-Karp differencing: shards of near-equal bytes, groups of equal texts whole.

A partial partition is a sum for each shard. The two of largest spread are combined, the largest sums
of one with the smallest of the other, again and again, until one is left. That works on partial
partitions of any size, a group being one with a single sum. Partitions that are even already leave
nothing to set against a large group, so groups are never differenced apart from one another: each
task puts its small groups into bundles, single sums of at most a small part of a shard, a large
group being a bundle by itself. Bundles are of bounded number, and the driver differences all of them
together, and so learns which bundle goes to which shard. A task's first bundles are smaller, to set
against what the others leave.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plankit.llm.arrow import map_arrow
from plankit.llm.scratch import starts, written

SHARDS = 16
#: Bundles of groups that a shard's bytes are dealt in, about.
BUNDLES = 512
#: Bundles of a task that are smaller, from 2**-FIRST of the others' size on.
FIRST = 12


def differencing(parts: list[list[int]]) -> list[list[int]]:
    """For each partial partition (a list of k sums), the final place of each of its sums.

    Deterministic: ties of spread go by the order of the list. No parts, no places.
    """
    if not parts:
        return []
    k = len(parts[0])
    # a node: (sums largest first, for each place its trees); a tree is (part, index), or a pair of trees
    heap = []
    for i, sums in enumerate(parts):
        order = sorted(range(k), key=lambda j: (-sums[j], j))
        ordered = [sums[j] for j in order]
        heap.append((ordered[-1] - ordered[0], i, ordered, [(i, j) for j in order]))
    heapq.heapify(heap)
    fresh = len(parts)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        merged = sorted(((x + y, j) for j, (x, y) in enumerate(zip(a, reversed(b)))), key=lambda m: (-m[0], m[1]))
        sums = [m[0] for m in merged]
        heapq.heappush(heap, (sums[-1] - sums[0], fresh, sums, [((ta[j], tb[k - 1 - j]),) for _, j in merged]))
        fresh += 1
    places = [[0] * k for _ in parts]
    for shard, tree in enumerate(heap[0][3]):
        stack = [tree]
        while stack:
            node = stack.pop()
            if len(node) == 1:
                stack += node[0]
            else:
                places[node[0]][node[1]] = shard
    return places


def _bundled(cap: int):
    """Groups in, groups with their bundle out: of at most ``cap`` bytes together, or one group of more.

    Two bundles in turn are of more than ``cap`` bytes, but for a task's first ones, of which each may
    be twice as large as the one before. A task holds nothing but the bundle that is open.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        made = room = now = 0
        for batch in batches:
            found = []
            for size in batch.column(1).to_pylist():
                most = cap >> max(0, FIRST - made)
                if size > most:
                    found.append(made)
                    made += 1
                    continue
                if size > room:
                    now, room, made = made, most, made + 1
                room -= size
                found.append(now)
            arrays = [batch.column(0), batch.column(1), pa.array(np.full(len(found), task)), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["grp", "bytes", "task", "bundle"])

    return each


def _counted(shards: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            nth = np.empty(len(shard), np.int64)
            for s in np.unique(shard):
                mine = shard == s
                nth[mine] = seen[s] + np.arange(mine.sum())
                seen[s] += mine.sum()
            arrays = [*batch.columns, pa.array([task] * len(shard), pa.int64()), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "part", "nth"])

    return each


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (bytes), shard, slot and grown_shard (null) for each row of docs.

    size: UTF-8 bytes of the text plus 1. Rows of equal text share a shard; null and empty texts are
    equal. Slots are gapless from 0 in each shard, in no particular order. Shards may stay empty if
    there are fewer groups; a group larger than a shard's share makes its shard as large as it is.
    Rows without doc_id and repeated rows are placed like others; an empty table gives no rows; other
    columns are not looked at.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    digest = F.concat(F.md5(text.cast("binary")), F.lit("-"), size.cast("string"))
    rows, _ = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), digest.alias("grp")), "rows")
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    cap = (rows.agg(F.sum("size")).first()[0] or 0) // (shards * BUNDLES)
    local, _ = written(map_arrow(groups, _bundled(cap), "grp string, bytes long, task long, bundle long"), "groups")
    sums = sorted(map(tuple, local.groupBy("task", "bundle").agg(F.sum("bytes")).collect()))
    places = differencing([[n] + [0] * (shards - 1) for _, _, n in sums])
    final = spark.createDataFrame([(t, b, p[0]) for (t, b, _), p in zip(sums, places)], "task long, bundle long, shard int")
    placed = local.join(F.broadcast(final), ["task", "bundle"]).select("grp", "shard")
    sized = rows.join(placed, "grp").drop("grp")
    dealt, _ = written(map_arrow(sized, _counted(shards), "doc_id long, size long, text_crc32 long, shard int, part long, nth long"), "dealt")
    counts = dealt.groupBy("part", "shard").agg(F.count("*").alias("_n"))
    base = starts(counts, ["part"], "_n", "_base", by=["shard"]).select("part", "shard", "_base")
    slotted = dealt.join(base, ["part", "shard"])
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_base") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
