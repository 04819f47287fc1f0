"""Quality classifier: supervised subword embeddings, in the manner of fastText.

A document is the mean of learned vectors, one for each of its features: every word, every character
3- to 5-gram of a word with its edges marked, and every pair of neighbouring words, all hashed into
one table. Two softmax outputs stand on that mean. Training is stochastic gradient descent in numpy,
on the driver, over a bounded sample of labelled documents. Scoring needs from the table only the
difference of the two outputs for each hash bucket, one float each: a table of fixed size that is
broadcast, so the score of a document of any length is a sum of look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plankit.llm.arrow import give_back, lean, map_arrow
from plankit.llm.texts import bucket, pair_hashes
from plankit.llm.tokens import slices

#: The hash table has 2**18 rows.
BITS = 18
#: Labelled documents of each class that training may take, and their bytes; the bound of what comes to the driver.
SAMPLE, SAMPLE_BYTES = 1200, 32 << 20
THRESHOLD = 0.7
#: All pairs of a word and itself are one feature: that a word repeats matters more than which.
_SAME = np.int64((1 << BITS) - 1)
_GRAMS = (3, 4, 5)
#: Bytes of text that are scored at a time; and where rows are kept or not, whole.
_SLICE_BYTES, _KEPT_BYTES = 3 << 20, 3 << 19
# Odd multipliers of the polynomial hashes: by place in a gram, and by place in a word.
_GRAM_PLACES = np.random.default_rng(1).integers(1, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_PLACES = np.random.default_rng(2).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some words: their hashes; and the features of all of them, as hash buckets and numbers of their words.

    A word's features are itself and its character 3- to 5-grams, with < and > as its edges.
    """
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - start[word]
    hashes = np.add.reduceat(points * _WORD_PLACES[place % len(_WORD_PLACES)], start)
    ids, of = [bucket(hashes, BITS)], [np.arange(len(words))]
    left = sizes[word] - place
    for size in _GRAMS:
        first = np.flatnonzero(left >= size)
        found = points[first] * _GRAM_PLACES[0]
        for k in range(1, size):
            found += points[first + k] * _GRAM_PLACES[k]
        ids.append(bucket(found ^ _GRAM_PLACES[size], BITS))
        of.append(word[first])
    return hashes, np.concatenate(ids), np.concatenate(of)


class Words:
    """The words of some texts: the distinct ones with their features, and where they stand."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        text = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        if "" in words:  # before a first and behind a last space
            some = at != words.index("")
            at, text = at[some], text[some]
        self.texts, self.at, self.text = len(lists), at, text
        self.hashes, self.ids, self.of = word_features(words) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The features of two neighbouring words, as hash buckets, and the text of each."""
        near = self.text[1:] == self.text[:-1]
        found = bucket(pair_hashes(self.hashes[self.at]), BITS) if len(self.at) else np.zeros(0, np.int64)
        found[self.at[1:] == self.at[:-1]] = _SAME
        return found[near], self.text[1:][near]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a text, and the share of each among all its features."""
    words = Words(pa.array([text], pa.string()))
    times = np.bincount(words.at, minlength=len(words.hashes))
    pairs, _ = words.pairs()
    ids, inverse = np.unique(np.concatenate([words.ids, pairs]), return_inverse=True)
    weights = np.bincount(inverse, np.concatenate([times[words.of], np.ones(len(pairs))]), len(ids))
    return ids, (weights / max(1.0, weights.sum())).astype(np.float32)


class Model:
    """What scoring needs: by bucket, how far a feature moves the log-odds of class 1; and the bias."""

    def __init__(self, moves: np.ndarray, bias: float, trained: bool):
        self.moves, self.bias, self.trained = moves, bias, trained


def train(texts: list[str], labels: list[int], weights: list[float], dim: int = 16, epochs: int = 8, rate: float = 4.0, seed: int = 7) -> Model:
    """Fit on the given texts by stochastic gradient descent, in an order that the seed fixes.

    With one class alone the score is that class's smoothed share; with no text it is 1/2.
    """
    ones, total = sum(labels), len(labels)
    if not total or ones in (0, total):
        share = (ones + 1) / (total + 2)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))), False)
    rng = np.random.default_rng(seed)
    table = ((rng.random((1 << BITS, dim), np.float32) - 0.5) * (2.0 / dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    bias = np.zeros(2, np.float32)
    made = [(ids.astype(np.int32), share) for ids, share in map(features, texts)]
    steps, done = epochs * total, 0
    for _ in range(epochs):
        for i in rng.permutation(total):
            ids, share = made[i]
            rows = table[ids]
            mean = share @ rows
            logits = out @ mean + bias
            odds = np.exp(logits - logits.max())
            odds /= odds.sum()
            odds[labels[i]] -= 1
            step = np.float32(rate * (1 - done / steps) * weights[i])
            down = odds @ out
            out -= step * np.outer(odds, mean)
            bias -= np.float32(0.1) * step * odds
            # each feature's share of the mean is small, so its own step is scaled up by their number
            table[ids] = rows - step * np.minimum(share * len(ids), 50)[:, None] * down / np.sqrt(len(ids))
            done += 1
    return Model((table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]), True)


def held_out(id_column: Column) -> Column:
    """Whether a document's label is never learned from: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on up to ``sample`` documents of each class, those first in the order of a hash of the id; whole ones.

    Of these, those are taken that together have at most ``sample_bytes`` bytes of text, counted in that order.

    Labels of held-out ids, nulls and values other than 0 and 1 are never used; of different labels
    for an id the larger counts; an id that docs repeats is taken once. Classes weigh as they do among
    all labels that may be learned from.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    known = known.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    known = known.join(docs.select(F.col(id_col).cast("long").alias("_id")).distinct(), "_id", "left_semi")
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    taken = [r for c in (0, 1) for r in known.where(F.col("_label") == c).orderBy(F.xxhash64("_id"), "_id").limit(sample).collect()]
    chosen = F.broadcast(spark.createDataFrame(taken, "_id long, _label int"))  # at most 2 * sample rows
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = slim.join(chosen, "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    so_far = F.sum(F.octet_length("_text")).over(Window.partitionBy("_label").orderBy(F.xxhash64("_id"), "_id"))
    rows = rows.withColumn("_bytes", so_far).where(F.col("_bytes") <= sample_bytes).orderBy(F.xxhash64("_id"), "_id").collect()
    of = {c: sum(r._label == c for r in rows) for c in (0, 1)}
    total, used = sum(counts.values()), max(1, len(rows))
    weights = [(counts[r._label] / total) / (of[r._label] / used) for r in rows]
    texts, wanted = [r._text for r in rows], [r._label for r in rows]
    del rows, taken
    model = train(texts, wanted, weights)
    del texts
    give_back()
    return model


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """The probability of class 1 for each text: the bias, and the mean of what its features add to the log-odds."""
    words = Words(texts)
    n = len(words.hashes)
    moves, counts = np.bincount(words.of, model.moves[words.ids], n), np.bincount(words.of, minlength=n)
    pairs, text = words.pairs()
    moved = np.bincount(words.text, moves[words.at], words.texts) + np.bincount(text, model.moves[pairs], words.texts)
    total = np.bincount(words.text, counts[words.at], words.texts) + np.bincount(text, minlength=words.texts)
    return 1 / (1 + np.exp(-np.clip(model.bias + moved / np.maximum(total, 1), -500, 500)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    The score is the softmax probability of class 1. A null or empty text has no features and gets
    the bias alone. Rows without doc_id are scored (held_out false), repeated rows each get their row,
    an empty table gives none; a score equal to the threshold is predicted 1; labels, language,
    source and id are never looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1, _SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(scores(some.column(1), shared.value), pa.float64())], ["doc_id", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = map_arrow(slim, each, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold. They are judged where they lie: no shuffle.

    Null and empty texts have the score of the bias alone; rows without id, and repeated ones, are
    judged like others, each by its text; an empty table gives none. Ties are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, place, _KEPT_BYTES):
                yield some.filter(pa.array(scores(some.column(place), shared.value) >= threshold))

    return map_arrow(docs, lean(each), docs.schema)
