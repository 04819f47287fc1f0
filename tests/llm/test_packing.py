import itertools
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plankit.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_uses_each_piece_once_and_overfills_nothing(counts):
    made, used = packing.plan(counts, 64), Counter()
    for lengths, times in made:
        assert times > 0 and sum(lengths) <= 64
        for length in lengths:
            used[length] += times
    assert used == Counter(counts)


@pytest.mark.parametrize("seed", range(3))
def test_plan_is_near_the_lower_bound(seed):
    lengths = np.random.default_rng(seed).integers(1, 1025, 5000)
    made = packing.plan(Counter(lengths.tolist()))
    assert sum(t for _, t in made) <= -(-int(lengths.sum()) // 1024) * 1.01 + 1


def test_exact_combinations_of_one_two_and_three():
    assert packing.plan({60: 2, 4: 1, 3: 1, 1: 1}, 64) == [((60, 4), 1), ((60, 3, 1), 1)]
    assert packing.plan({50: 1, 8: 1, 4: 1, 2: 1}, 64) == [((50, 8, 4, 2), 1)]
    sums = packing._Sums(np.array([0, 0, 2, 0, 1, 0, 1, 0, 0]))
    assert [sums.longer[a:b].tolist() for a, b in itertools.pairwise(sums.pair_at)] == [[], [], [], [], [2], [], [4], [], [6, 4]]
    assert sums.pair(4) == (2, 2) and sums.pair(8) == (6, 2) and sums.triple(8) == (4, 2, 2) and sums.triple(6) is None


def test_pieces_lie_gapless_and_hold_the_library_ids(spark):
    texts = ["", None, "word " * 3000, "a", "the quick brown fox " * 20, "  two  spaces\n", "é" * 900, "a", "a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|>  y"]
    rows = list(enumerate(texts * 6)) + [(None, "x y"), (3, "a")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, piece int").repartition(3)
    placed, made = packing.pack(docs, PATH)
    found = [r.asDict() for r in placed.collect()]
    library = Tokenizer.from_file(PATH)
    wanted = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for n, (a, b) in enumerate(itertools.pairwise(cuts)):
            wanted[i, n, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted
    for _, some in itertools.groupby(sorted(found, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in some:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert made.count() == len(found)


def test_no_documents(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH)[0].count() == 0
