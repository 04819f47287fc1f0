import base64
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plankit.llm import bpe_sql, token_files, tokens
from plankit.llm.scratch import new_path

BYTE, WORD, RANKS = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
ODD = ["", "  \n\t x  ", "'s don't ΣΣ \n\n  ", "<|endoftext|> hi", "a <|endoftext|> b", "é<|startoftext|>  <|endoftext|>y z", "<|EndOfText|> <| endoftext |>", "é é\ńz", " 　x  \x00\x01", "ΑΣ ΑΣ. İI ﬁ", "\r\n\tfoo\x0b\x0cbar ", "a  b", "a  b", "a  b"]
ODD += ["ab\x1c cd", " x", "x ", "\n", "a b\n", "♥ x ♥y", "\nfoo bar", "\n\nfoo", "a​b c", "x" * 5000, " " * 3000 + "y", "á ́b", "\U0001f600 \U0001f468‍\U0001f469", "﻿a ﻿ b"]


def as_bytes(ids):
    return np.asarray(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library(path):
    return Tokenizer.from_file(path)


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte_level"), (WORD, "words")])
def test_units_give_the_ids_of_whole_texts(path, kind):
    whole, units = library(path), tokens.KINDS[kind](path)
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab .,é\n'1 ") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    for _ in range(2):  # the second time from memory
        assert units.many(pa.array([*texts, None])) == [as_bytes(whole.encode(t, add_special_tokens=False).ids) for t in [*texts, ""]]
    if kind == "words":  # every letter that counts as simple, alone and with signs
        letters = [chr(c) for c in range(0x250) if units.SIMPLE(chr(c))]
        words = [a + b + s for a, b, s in zip(letters, [*letters[1:], "a"], ["", ".", "!?", "-"] * len(letters))]
        assert units.apart(words) == [as_bytes(whole.encode(w, add_special_tokens=False).ids) for w in words]
    units.remembered = 10
    assert units.many(pa.array(texts)) == [as_bytes(whole.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_units_of_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for path, kind in ((BYTE, "byte_level"), (WORD, "words")):
        whole = library(path)
        assert tokens.encoder(path, kind).many(pa.array(texts, pa.string())) == [as_bytes(whole.encode(t, add_special_tokens=False).ids) for t in texts]


def test_slices_cover_a_batch():
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4], "text": ["x" * (7 << 20), None, "", "y" * (7 << 20)]})
    assert [s.column(0).to_pylist() for s in tokens.slices(batch, 1)] == [[1], [2, 3], [4]] or sum((s.column(0).to_pylist() for s in tokens.slices(batch, 1)), []) == [1, 2, 3, 4]
    assert list(tokens.slices(batch.slice(0, 0), 1)) == []


def test_recursive_queries_equal_the_library(reference):
    worker = bpe_sql.Bpe(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(6)
    texts = ODD + ["a" * 1000, "=-" * 200, "é" * 200, "ab" * 150, "the" * 60, "日本語テキスト" * 20]
    texts += ["".join(rng.choice("aetionsrhl") for _ in range(rng.choice((5, 30, 300)))) for _ in range(120)]
    ids = worker.many(pa.array([*texts, None]))
    assert ids == [as_bytes(reference.encode_ordinary(t)) for t in [*texts, ""]]
    assert worker.decode(ids) == [t.encode() for t in [*texts, ""]]


LETTERS = {"letters": "abcdefghijklmnopqrstuvwxyz", "genes": "ACGT", "pairs": ["ab", "ba", "a"], "marks": "=-", "syllables": ["intern", "ation", "al", "ing", "the", "wh", "x"], "signs": "éü日本語"}


@pytest.mark.parametrize("kind", [*LETTERS, "run", "long run"])
def test_long_parts_equal_the_library(reference, kind):
    rng = random.Random(9)
    text = "".join(rng.choice(LETTERS[kind]) for _ in range(20_000)) if kind in LETTERS else "a" * 20_001 if kind == "run" else "-" * 40_003
    worker = bpe_sql.Bpe(RANKS, public_tokenizers.PATTERN)
    began = time.perf_counter()
    assert worker.many(pa.array([text])) == [as_bytes(reference.encode_ordinary(text))]
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("window", [4, 10, 32])
def test_windows_of_any_size_join(reference, monkeypatch, window):
    monkeypatch.setattr(bpe_sql, "_WINDOW", window)
    rng = random.Random(window)
    kinds = [*LETTERS.values(), "a", "ing", "aA", "etaoin"]
    texts = ["".join(rng.choice(kinds[i % len(kinds)]) for _ in range(rng.randint(1, 150))) for i in range(300)]
    worker = bpe_sql.Bpe(RANKS, public_tokenizers.PATTERN)
    assert worker.many(pa.array(texts)) == [as_bytes(reference.encode_ordinary(t)) for t in texts]


def test_encoded_and_decoded_documents(spark, reference):
    rows = [(1, "Hello  wörld\n"), (2, ""), (3, None), (None, "x y"), (1, "Hello  wörld\n")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, ids int")
    found = bpe_sql.digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    wanted = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        wanted.append((i, len(ids), hashlib.sha256(as_bytes(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    assert bpe_sql.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**7), min_size=1, max_size=700), st.integers(0, 10**6))
def test_boundaries_select(values, more):
    values = np.sort(np.asarray(values))
    made = token_files.EliasFano.encode(values, int(values[-1]) + more)
    assert made.selected(0, len(values)).tolist() == values.tolist()
    assert [made.select(i) for i in range(0, len(values), 13)] == values[::13].tolist()
    for first in {0, 1, len(values) // 2, len(values) - 1}:
        for count in (1, 7, 300, 1000):
            assert made.selected(first, count).tolist() == values[first : first + count].tolist()


def test_doc_ids_of_any_size():
    docs = [None, None, -(2**63), -5, 0, 0, 7, 2**40, 2**63 - 1]
    for some in (docs, docs[:2], docs[2:3], [], docs[4:7]):
        file = token_files.TokenFile(token_files.pack_file(0, 0, some, [1] * len(some), b"ab" * len(some), 2) + b"\n")
        assert file.docs(0, 100).to_pylist() == some and file.docs(1, 3).to_pylist() == some[1:4]


def test_boundaries_are_near_minimal():
    values = np.arange(0, 10_000_000, 1000)
    made = token_files.EliasFano.encode(values, 10_000_000)
    bits = 8 * sum(map(len, made.parts()))
    assert bits / len(values) < 2.2 + np.log2(1000)


@pytest.mark.parametrize("file_ids", [10**6, 40])
def test_files_round_trip(spark, file_ids):
    texts = ["", None, "Some words here, and more.", "É ﬁ 123", "w " * 500]
    rows = [(i * 3 % 50, f"{texts[i % 5] or ''} {i}" if i % 7 else texts[i % 5]) for i in range(50)] + [(None, "null id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, start string").repartition(4)
    path = new_path(spark, "tokens")
    token_files.write_files(docs, path, WORD, file_ids=file_ids)
    whole = library(WORD)
    ids = [(i, [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    found = sorted(map(tuple, token_files.offsets(spark, path).collect()), key=lambda r: r[1])
    assert sorted(((i, len(x), zlib.crc32(as_bytes(x))) for i, x in ids), key=repr) == sorted(((r[0], r[2], r[3]) for r in found), key=repr)
    order = [-1 if r[0] is None else r[0] for r in found]
    assert order == sorted(order)
    assert [r[1] for r in found] == [0, *np.cumsum([r[2] for r in found])[:-1].tolist()]
    one = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").first()
    file = token_files.TokenFile(bytes(one.content))
    offsets = file.starts(0, file.n).tolist()
    assert all(file.tokens(i).tolist() == file.ids[offsets[i] : offsets[i + 1]].tolist() for i in range(file.n))


def test_no_files_for_no_documents(spark):
    path = new_path(spark, "tokens")
    token_files.write_files(spark.createDataFrame([], "doc_id long, text string"), path, WORD)
    assert token_files.offsets(spark, path).count() == 0
