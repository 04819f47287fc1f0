import itertools
import zlib

import numpy as np

from plankit.llm import sharding


def test_differencing_places_every_sum_once_and_evenly():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 1000, 4).tolist() for _ in range(50)]
    places = sharding.differencing(parts)
    assert all(sorted(p) == [0, 1, 2, 3] for p in places)
    sums = [0] * 4
    for part, place in zip(parts, places):
        for value, at in zip(part, place):
            sums[at] += value
    assert max(sums) - min(sums) <= 20
    assert sharding.differencing([]) == [] and sharding.differencing([[3, 9]]) in ([[0, 1]], [[1, 0]])


def test_differencing_beats_greedy_on_the_classic_case():
    places = sharding.differencing([[x, 0] for x in (8, 7, 6, 5, 4)])
    sums = [0, 0]
    for x, p in zip((8, 7, 6, 5, 4), places):
        sums[p[0]] += x
    assert sorted(sums) == [14, 16]


def test_groups_are_whole_and_shards_even(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "x" * int(rng.integers(0, 400)) + str(i)) for i in range(400)] + [(1000 + i, "copy") for i in range(150)] + [(None, None), (7, None), (8, ""), (9, "é")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, size int, shard int").repartition(5)
    found = sharding.shard(docs, 8).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in found), key=repr) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    texts = {}
    by_key = {(i, len((t or "").encode()) + 1): t or "" for i, t in rows}
    for r in found:
        texts.setdefault(by_key[r.doc_id, r["size"]], set()).add(r.shard)
    assert all(len(s) == 1 for s in texts.values())
    sums = []
    for _, some in itertools.groupby(sorted(found, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        some = list(some)
        assert [r.slot for r in some] == list(range(len(some)))
        sums.append(sum(r["size"] for r in some))
    assert len(sums) == 8 and max(sums) - min(sums) <= 8
    assert {(r.law, r.grown_shard) for r in found} == {("bytes", None)}


def test_one_group_and_none(spark):
    same = spark.createDataFrame([(i, "t") for i in range(5)], "doc_id long, text string")
    assert {r.shard for r in sharding.shard(same).collect()}.__len__() == 1
    assert sharding.shard(same.limit(0)).count() == 0


def test_large_groups_over_many_batches_leave_shards_even(spark):
    """Hot groups, with the others in more than one Arrow batch of each task; no shard is above the bound."""
    rng = np.random.default_rng(3)
    rows = [(i, f"{i} " + "x" * int(n)) for i, n in enumerate(rng.integers(0, 200, 12_000))]
    for copies, text in ((600, "hot " * 60), (300, "warm " * 50)):
        rows += [(len(rows) + i, text) for i in range(copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = sharding.shard(docs).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted(r.doc_id for r in found) == list(range(len(rows)))
    assert len({r.shard for r in found if rows[r.doc_id][1].startswith("hot")}) == 1
    sums = np.bincount([r.shard for r in found], [r["size"] for r in found], 16)
    assert sums.max() <= 1.001 * max(sums.mean(), 600 * 241)
