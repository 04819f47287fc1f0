import random

import pytest

import corpus_pipeline
from plankit.llm import similar


def brute(texts, least=0.8, candidates=False):
    """The root of each text, by all pairs; or by those alone that are near in a fingerprint."""
    marks = [similar.prints((t or "").encode()) for t in texts]
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            near = not candidates or any(((a ^ b) % (1 << 64)).bit_count() <= similar.RADIUS for a, b in zip(marks[i], marks[j]))
            if near and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return root


def test_stage_keeps_one_of_texts_that_are_similar(spark):
    """Copies with words changed, of similarity from 0.4 to 1; a large group; rows that share or lack a doc_id."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghil") for _ in range(6)) for _ in range(3000)]
    texts = []
    for edits in range(12):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(300)]
            texts.append(" ".join(base))
            for at in rng.sample(range(300), edits):
                base[at] = rng.choice(words)
            texts.append(" ".join(base))
    hot = [rng.choice(words) for _ in range(200)]
    texts += [" ".join([*hot, f"end{i}"]) for i in range(150)]
    texts += [None, "", " \n", "one two", "One  two", "one two three"]
    rows = [(i * 7 % 401, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "a text without id"), (None, "a text  without ID"), (7, "another text of the second doc")]
    wanted = {}
    for (i, t), r in zip(rows, brute([t for _, t in rows])):
        wanted.setdefault(r, []).append(i)
    wanted = [min((i for i in ids if i is not None), default=None) for ids in wanted.values()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.near_dedup(spark, docs, None)
    assert found.columns == docs.columns
    assert sorted((r.doc_id for r in found.collect()), key=repr) == sorted(wanted, key=repr)


def test_rows_that_share_a_doc_id_are_told_apart(spark):
    rows = [(1, "alpha one two three four five", 1), (5, "alpha one two three four five", 2), (5, "beta six seven eight nine ten", 3), (5, "beta six seven eight nine ten", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    assert sorted(map(tuple, similar.keep_first(docs).collect())) == [rows[0], rows[2]]


@pytest.mark.parametrize("rounds, block", [(0, 1024), (0, 3), (1, 4)])
def test_groups_without_a_middle_are_whole(spark, monkeypatch, rounds, block):
    """Chains, of which neighbours alone are similar, without hubs and with few, in one block and in many."""
    monkeypatch.setattr(similar, "ROUNDS", rounds)
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(4)
    texts = []
    for chain in range(4):
        words = [f"w{chain}.{i}" for i in range(120)]
        for i in range(10):
            words[rng.randrange(120)] = f"new{i}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = {}
    for i, r in enumerate(brute(texts, candidates=True)):
        wanted.setdefault(r, i)
    assert len(wanted) < 8
    assert sorted(r.doc_id for r in similar.keep_first(docs).collect()) == sorted(wanted.values())


def test_no_documents(spark):
    assert similar.keep_first(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tables_are_posted_by_many_tasks(spark, monkeypatch):
    """Nodes in one file, of which one task would post 189 rows each; all nodes stay, and the result too."""
    monkeypatch.setattr(similar, "POSTED", 10_000)
    nodes = spark.range(3000).coalesce(1).withColumnRenamed("id", "node")
    sizes = [len(part) for part in similar.dealt(nodes, 189).rdd.glom().collect()]
    assert sum(sizes) == 3000 and max(sizes) * 189 < 2.5 * similar.POSTED
    assert similar.dealt(nodes.limit(0), 189).count() == 0
    texts = [f"{' '.join(f'w{i}.{k}' for k in range(60))}{end}" for i in range(80) for end in ("", " x")]
    found = similar.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == list(range(0, 160, 2))


@pytest.mark.parametrize("turn, crowd, block", [(1000, 256, 512), (1500, 1, 3), (30_000_000, 3, 4)])
def test_masks_in_turns_and_buckets_by_size_give_the_same(spark, monkeypatch, turn, crowd, block):
    """Chains without hubs: open buckets are compared in pairs, or in the cells of a cluster; masks in one turn or in many."""
    monkeypatch.setattr(similar, "ROUNDS", 0)
    monkeypatch.setattr(similar, "TURN", turn)
    monkeypatch.setattr(similar, "CROWD", crowd)
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(5)
    texts = []
    for chain in range(3):
        words = [f"w{chain}.{i}" for i in range(120)]
        for i in range(5):
            words[rng.randrange(120)] = f"new{i}"
            texts.append(" ".join(words))
    shared, turns = similar.written, []
    monkeypatch.setattr(similar, "written", lambda df, name, *a: (turns.append(name), shared(df, name, *a))[1])
    found = similar.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    wanted = {}
    for i, r in enumerate(brute(texts, candidates=True)):
        wanted.setdefault(r, i)
    assert sorted(r.doc_id for r in found.collect()) == sorted(wanted.values())
    assert turns.count("members") == 1 + 15 * 189 // turn


def test_what_was_posted_is_never_broadcast(spark, monkeypatch):
    """Nodes are few bytes, but each posts a row to each table: Spark sizes what it posts by the nodes."""
    plans = []
    shared = similar.written

    def seen(df, name, *a):
        if name == "members":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return shared(df, name, *a)

    monkeypatch.setattr(similar, "written", seen)
    docs = spark.createDataFrame([(i, f"a text of {i % 4} and {i}") for i in range(40)], "doc_id long, text string")
    assert similar.keep_first(docs).count() > 0
    assert plans and not any("Broadcast" in p for p in plans)
