import time
from pathlib import Path

import numpy as np
import pytest

from plankit.llm import permutation_index


def brute(rows, asked, k=20):
    """{query id: [(vec_id, score)]} in order."""
    ok = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    dims = [len(v) for _, v in ok]
    length = max(set(dims), key=lambda d: (dims.count(d), d))
    ok = [(i, v) for i, v in ok if len(v) == length]
    out = {}
    for q, v in ok:
        if asked(q):
            near = sorted(((-float(v @ x), i) for i, x in ok if i != q))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def test_everything_reranked_is_exact_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(150)]
    rows += [(200 + i, rows[5][1]) for i in range(70)]  # a third are one vector
    rows += [(400, None), (420, [0.0] * 8), (440, [1.0] * 7 + [None]), (460, [float("nan")] * 8), (480, [float("inf")] + [1.0] * 7), (500, [1.0] * 5), (520, []), (None, rows[1][1])]
    rows += [rows[20]]
    vectors = frame(spark, rows)
    asked = vectors.where("vec_id % 20 = 0")
    found = found_of(permutation_index.search(vectors, asked, share=1.0))
    wanted = brute(rows[:-1], lambda i: i % 20 == 0)
    assert found.keys() == wanted.keys()
    for q, near in wanted.items():
        assert [i for i, _ in found[q]] == [i for i, _ in near]
        assert np.allclose([s for _, s in found[q]], [s for _, s in near], rtol=1e-12)


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(10, 64))
    points = centres[rng.integers(0, 10, 1500)] * 0.5 + rng.normal(size=(1500, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = [(i, p.astype("float32").tolist()) for i, p in enumerate(points)]
    vectors = frame(spark, rows)
    found, wanted = found_of(permutation_index.search(vectors, vectors.where("vec_id % 20 = 0"))), brute(rows, lambda i: i % 20 == 0)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in near}) for q, near in wanted.items())
    assert hits / sum(map(len, wanted.values())) >= 0.9


def test_many_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = frame(spark, [(i, rng.normal(size=6).tolist()) for i in range(120)])
    asked = vectors.where("vec_id % 20 = 0")
    one = found_of(permutation_index.search(vectors, asked, share=1.0))
    monkeypatch.setattr(permutation_index, "BLOCK", 17)
    monkeypatch.setattr(permutation_index, "QUERY_BLOCK", 2)
    assert found_of(permutation_index.search(vectors, asked, share=1.0)) == one


def test_footrule_is_the_sum_over_all_pivots():
    rng = np.random.default_rng(3)
    places = np.argsort(rng.random((40, 256)), axis=1).astype(np.uint8)
    wanted = np.abs(places.astype(int) - places[7].astype(int)).sum(axis=1)
    assert permutation_index.footrule(np.ascontiguousarray(places.T), places[7]).tolist() == wanted.tolist()


@pytest.mark.parametrize("count", [1, 2, 2047, 2049, 5001])
def test_footrule_of_any_number_of_vectors_in_little_time(count):
    """Equal to the sum pivot by pivot; for many vectors in less than 0.7 of that one's time."""
    rng = np.random.default_rng(4)
    places = np.argsort(rng.random((count, 128)), axis=1).astype(np.uint8)
    files = np.ascontiguousarray(places.T)

    def plain(files, query):
        total = np.zeros(files.shape[1], np.uint16)
        for file, place in zip(files, query):
            total += np.maximum(file, place) - np.minimum(file, place)
        return total

    def least(of):
        taken = []
        for _ in range(15):
            began = time.perf_counter()
            of(files, places[0])
            taken.append(time.perf_counter() - began)
        return min(taken)

    assert permutation_index.footrule(files, places[0]).tolist() == plain(files, places[0]).tolist()
    if count > 4000:
        assert least(permutation_index.footrule) < 0.7 * least(plain)


def test_queries_of_other_lengths_take_no_part(spark):
    vectors = frame(spark, [(i, [float(i), 1.0, 2.0]) for i in range(1, 6)] + [(20, [1.0, 2.0])])
    asked = frame(spark, [(1, [1.0, 1.0, 2.0]), (20, [1.0, 2.0]), (40, [3.0, 4.0])])
    assert found_of(permutation_index.search(vectors, asked)).keys() == {1}


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_recall_on_the_table(spark):
    """The whole table of sf0.1 against brute force."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    found, wanted = found_of(permutation_index.search(vectors, vectors.where("vec_id % 20 = 0"))), brute(rows, lambda i: i % 20 == 0)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in near}) for q, near in wanted.items())
    assert hits / sum(map(len, wanted.values())) >= 0.95


def test_few_or_no_vectors(spark):
    few = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    assert found_of(permutation_index.search(few, few.where("vec_id = 0"))) == {0: [(1, 0.0)]}
    assert permutation_index.search(few.limit(0), few.limit(0)).count() == 0
    assert permutation_index.search(few, few.limit(0)).count() == 0
