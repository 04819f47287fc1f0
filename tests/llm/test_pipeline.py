import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plankit.llm import arrow, queries, tokens
from plankit.llm.scratch import CLEANUP, starts, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean, symbol-ridden, repetitive and short documents, with exact copies of clean ones; half are labelled."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghilmnorst"), rng.integers(2, 8))) for _ in range(800)]
    rows, labels = [], []
    for i in range(600):
        kind = ("clean", "clean", "clean", "symbols", "repeats", "short")[i % 6]
        some = list(rng.choice(words, 90 if kind != "short" else 20))
        if kind == "symbols":
            some = [w + "***" for w in some]
        if kind == "repeats":
            some = [w for w in some[:9] for _ in range(10)]
        rows.append((i, " ".join(some), "en", kind, 0))
        if i % 2 == 0 or kind == "symbols" and i % 4 == 1:
            labels.append((i, int(kind in ("clean", "short")), 0))
    rows += [(1000 + r[0], r[1], *r[2:]) for r in rows[:60]]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_keep_clean_documents_once(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {tuple(r) for r in docs.collect()}
        docs, _ = corpus_pipeline.written(stage(spark, docs, folder), name)
        assert docs.columns == COLUMNS and {tuple(r) for r in docs.collect()} <= before
    kept = docs.collect()
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").where("source = 'clean' and doc_id < 1000").collect())


def test_run_packs_what_the_stages_keep(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(found.columns)
    assert {r.doc_id for r in found.collect()} == {i for i in range(600) if i % 6 < 3}


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_documents(spark, folder, tmp_path, labelled):
    """Nulls in any column, empty texts, repeated rows and ids, and columns whose names the operators use."""
    clean = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").where("source = 'clean'").orderBy("doc_id").limit(4).collect()]
    rows = [(1, clean[0], None), (None, clean[1], "x"), (3, None, "x"), (4, "", None), (5, clean[2], "x"), (5, clean[2], "x"), (5, clean[3], "x"), (6, clean[0], "x"), (None, None, None)]
    docs = spark.createDataFrame([(*r, 1.5, 7, "k") for r in rows], "doc_id long, text string, lang string, score double, part int, key string")
    if labelled:
        spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    else:
        spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now, _ = corpus_pipeline.written(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns
    if not labelled:  # the labels are of other texts
        assert sorted(((r.doc_id, r.text) for r in now.collect()), key=repr) == sorted([(1, clean[0]), (None, clean[1]), (5, clean[2]), (5, clean[3])], key=repr)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in packed if not r.piece), key=repr) == sorted((r[0] for r in rows), key=repr)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_running_totals(spark):
    rows = [(p, p % 3, p + 1) for p in range(50)]
    sums = spark.createDataFrame(rows, "part long, kind long, n long")
    found = {(r.part, r.kind): r.before for r in starts(sums, ["part"], "n", "before", by=["kind"], block=7).collect()}
    assert found == {(p, k): sum(n for q, j, n in rows if q < p and j == k) for p, k, _ in rows}


def test_what_a_written_table_shuffled_is_removed(spark):
    """Its shuffle files go at once, not with the driver's garbage; the session's setting stays as it was."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files() -> set[str]:
        return {f.rsplit("/", 1)[-1] for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    before, setting = files(), spark.conf.get(CLEANUP, None)
    grouped = spark.range(1000).repartition(3).groupBy((F.col("id") % 10).alias("k")).count()
    found, _ = written(grouped, "shuffled")
    for _ in range(100):
        left = files() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP, None) == setting
    assert sorted(map(tuple, found.collect())) == [(k, 100) for k in range(10)]


def test_workers_forget_encoders():
    """Encoders that a worker remembers last until a stage that does not encode; it gives the rows that it gave."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens.encoder.cache_clear()
    first = tokens.encoder(path, "byte_level", 5)
    assert list(arrow.lean(lambda rows: rows, encodes=True)(iter([1, 2]))) == [1, 2]
    assert tokens.encoder(path, "byte_level", 5) is first
    assert list(arrow.lean(lambda rows: rows)(iter([1, 2]))) == [1, 2]
    assert tokens.encoder.cache_info().currsize == 0
