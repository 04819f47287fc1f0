import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plankit.llm import classifier, quality_rules
from plankit.llm.texts import Words

DOCS = "doc_id long, text string, n_words string, score string, kept int"
TEXTS = ["", None, "a b c a b c a", "x\ny\nx\n \n\nx", "# $% é|<>&* " * 30, "one two three " * 40, "w " * 49, " ".join(f"w{i}" for i in range(60)), "\x0b\x1c a b 　c\x85d", "q" * 200_000]


def brute(text):
    """The base counts, as the contract words them."""
    import re

    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated)


@pytest.mark.parametrize("text", TEXTS)
def test_base_counts(text):
    raw = (text or "").encode()
    assert quality_rules.base_counts(raw, Words(raw)) == brute(text)


def test_rules_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[7]), (7, TEXTS[7])]
    docs = spark.createDataFrame([(*r, "n", "s", 1) for r in rows], DOCS)
    trusted = spark.createDataFrame([(7,), (7,), (None,), (99,)], "doc_id long")
    found = quality_rules.apply_rules(docs, trusted).collect()
    assert len(found) == len(rows)

    size = 1 << quality_rules.BITS
    grams = {t: quality_rules.grams(Words((t or "").encode())) for t in set(TEXTS)}
    raw, target = np.zeros(size), np.zeros(size)
    for i, t in rows:
        np.add.at(raw, grams[t], 1)
        if i == 7:
            np.add.at(target, grams[t], 1)
    p = (raw + 1) / (raw.sum() + size)
    ratios = np.log((target + size * p) / (target.sum() + size) / p)
    by_id = {r.doc_id: r for r in found}
    for i, t in rows:
        row, counts = by_id[i], brute(t)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        llr = ratios[grams[t]].mean() if len(grams[t]) else 0.0
        assert row.base_failed == failed and abs(row.llr - llr) < 1e-9 and row.kept == (not failed and llr >= quality_rules.THRESHOLD)
    kept = quality_rules.keep(docs, trusted)
    assert kept.columns == docs.columns
    assert sorted(kept.select("doc_id").collect(), key=repr) == sorted([(r.doc_id,) for r in found if r.kept], key=repr)


def test_rules_without_trusted_or_documents(spark):
    docs = spark.createDataFrame([(1, TEXTS[7])], "doc_id long, text string")
    none = docs.select("doc_id").limit(0)
    assert [r.kept for r in quality_rules.apply_rules(docs, none).collect()] == [True]
    assert quality_rules.apply_rules(docs.limit(0), none).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    good = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows = []
    for i in range(400):
        words = list(rng.choice(good, 80))
        label = int(i % 4 != 0)
        if not label:
            words = [w + "***" for w in words] if i % 8 else [w for w in words[:8] for _ in range(10)]
        rows.append((i, " ".join(words), label))
    docs = spark.createDataFrame([(i, t, "z") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(5, 1), (None, 1), (6, None), (10**6, 0)], "doc_id long, quality int")
    return docs, labels


def test_classifier_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    model = classifier.fit(docs, labels)
    found = classifier.score(docs, model).join(labels.where("quality is not null").distinct(), "doc_id").collect()
    assert {r.doc_id: r.held_out for r in found} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found}
    held = [r for r in found if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


def test_classifier_never_learns_from_held_out_labels(spark, labelled):
    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = classifier.fit(docs, labels), classifier.fit(docs, turned)
    assert a.bias == b.bias and np.array_equal(a.moves, b.moves)


def test_classifier_sample_is_bounded(spark, labelled, monkeypatch):
    docs, labels = labelled
    seen = []
    monkeypatch.setattr(classifier, "train", lambda texts, *_: seen.append(texts))
    classifier.fit(docs, labels, sample=10)
    classifier.fit(docs, labels, sample_bytes=3000)
    classifier.fit(docs, labels, sample_bytes=1)
    assert len(seen[0]) == 20 and 0 < len(seen[1]) and sum(map(len, seen[1])) <= 6000 and seen[2] == []
    assert set(seen[1]) <= {r.text for r in docs.collect()}


def test_classifier_edges(spark, labelled):
    docs, labels = labelled
    model = classifier.fit(docs, labels)
    odd = spark.createDataFrame([(None, "a b"), (1, None), (1, ""), (2, "x" * 100_000), (2, "é " * 50_000)], "doc_id long, text string")
    found = classifier.score(odd, model).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found) and not found[0].held_out
    empty = classifier.fit(docs, labels.limit(0))
    assert not empty.trained and {r.score for r in classifier.score(odd, empty).collect()} == {0.5}
    assert classifier.score(docs.limit(0), model).count() == 0
    assert not classifier.fit(docs.limit(0), labels).trained
    kept = classifier.keep(docs, model)
    assert kept.columns == docs.columns and 280 < kept.count() < 320


def test_scores_are_those_of_the_model(labelled, spark):
    """The look-up by word and pair gives what the mean of all feature vectors does."""
    docs, labels = labelled
    model = classifier.fit(docs, labels)
    texts = [*(r.text for r in docs.limit(3).collect()), " lead é trail \n", "", "one"]
    odds = [model.bias + share @ model.moves[ids] for ids, share in map(classifier.features, texts)]
    assert np.allclose(classifier.scores(pa.array([*texts, None]), model), 1 / (1 + np.exp(-np.asarray([*odds, model.bias]))), atol=1e-5)


@pytest.mark.parametrize("bits", [64, 1 << 27])
def test_target_is_that_of_the_trusted_ids_whatever_the_table_lets_through(spark, monkeypatch, bits):
    """With a table of 64 bits all ids pass it; with a large one, texts of trusted documents are not shuffled."""
    monkeypatch.setattr(quality_rules, "MOST_BITS", bits)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{x:x}" for x in rng.integers(0, 1 << 62, 1000)) for _ in range(300)]
    rows = [(i * 977, t) for i, t in enumerate(texts)] + [(None, "nobody trusts me"), (0, "a second text of the first"), (977, None)]
    good = {i * 977 for i in range(250)} | {-5}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in [*good, *list(good)[:3], None]], "doc_id long")
    raw, target = Counter(), Counter()
    for i, t in rows:
        found = Counter(quality_rules.grams(Words((t or "").encode())).tolist())
        raw.update(found)
        if i in good:
            target.update(found)

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        found = quality_rules.multinomials(docs, trusted).collect()
        moved = shuffled() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {r.bucket: (r.raw, r.target) for r in found} == {b: (n, target[b]) for b, n in raw.items()}
    assert bits == 64 or moved < 0.5 * sum(map(len, texts))


def test_no_task_counts_in_two_python_workers(spark, monkeypatch):
    """One that reads its rows from another would hold two workers, and each executor twice as many from then on."""
    monkeypatch.setattr(quality_rules, "MOST_BITS", 64)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    found = quality_rules.multinomials(docs, spark.range(200).withColumnRenamed("id", "doc_id"))

    def chained(plan):
        below = plan.children()
        return (plan.nodeName() == "MapInArrow") + max([chained(below.apply(i)) for i in range(below.size())], default=0)

    assert chained(found._jdf.queryExecution().optimizedPlan()) == 1
