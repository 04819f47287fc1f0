"""Quality rules: plain counts of a text, then a hashed n-gram log-likelihood ratio.

Two multinomials over hash buckets of token 1- and 2-grams are counted over the whole corpus: of all
documents (raw), and of the trusted ones (target). A document's score is the mean over its n-grams
of log(p_target / p_raw), so that long and short texts compare; it is kept at the threshold or above.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plankit.llm.arrow import lean, map_arrow
from plankit.llm.scratch import written
from plankit.llm.texts import Words, bucket, pair_hashes
from plankit.llm.tokens import slices

#: Buckets of the multinomials: 2**14, of fixed size whatever the corpus.
BITS = 14
#: Mean log-ratio below which a document goes: its n-grams are, in the mean, 1.4 times as frequent in the raw corpus as
#: in the target. About midway between the labelled good documents (from -0.03 up) and bad ones (up to -0.56) of the
#: tables at hand; neither class comes near it.
THRESHOLD = -0.35
#: Bits for each trusted id in the table that is broadcast, its bits at most (16 MB), and the places of an id there.
ID_BITS, MOST_BITS, PLACES = 16, 1 << 27, 4
SYMBOLS = b"#*$%&|<>"
_TOKENS = re.compile(rb"[!-/:-@\[-`{-~]+|[^!-/:-@\[-`{-~]+").findall
_NOT_COUNTED = bytes(range(0x80, 0xC0)) + b" \t\n\r\x0b\x0c"  # the later bytes of a code point; white space
_SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"


def grams(words: Words) -> np.ndarray:
    """The bucket of each token and of each two neighbouring tokens.

    A word's tokens are its runs of ASCII punctuation and of other characters.
    """
    if not len(words.at):
        return np.zeros(0, np.int64)
    split = list(map(_TOKENS, words.distinct))
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = list(chain.from_iterable(split))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, flat, repeat(0)), np.uint64, len(flat))
    each = sizes[words.at]
    first = (np.cumsum(sizes) - sizes)[words.at]
    hashes = hashes[np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())]
    return bucket(np.concatenate([hashes, pair_hashes(hashes)]), BITS)


def base_counts(text: bytes, words: Words) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words.at),
        len(text.translate(None, _NOT_COUNTED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        words.repeated(),
    )


def _table(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the hashes of the ids (_id long, distinct), as 64-bit words: at most MOST_BITS come to the driver."""
    size = min(MOST_BITS, 1 << max(6, (ID_BITS * ids.count() - 1).bit_length()))
    hashed = F.xxhash64("_id")
    low, high = hashed.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(hashed, 32)
    at = ids.select(F.explode(F.array(*[(low + high * i).bitwiseAND(F.lit(size - 1)) for i in range(PLACES)])).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint64)


def _let_through(table: np.ndarray, hashes: pa.Array) -> np.ndarray:
    """Which hashes of ids the table lets through: all that it was made of, and few others; no nulls."""
    known = hashes.is_valid().to_numpy(zero_copy_only=False)
    hashed = hashes.fill_null(0).to_numpy().view(np.uint64)
    low, high = hashed & np.uint64((1 << 32) - 1), hashed >> np.uint64(32)
    for i in range(PLACES):
        at = (low + high * np.uint64(i)) & np.uint64(64 * len(table) - 1)
        known &= (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return known


def _passed(*tables):
    """Rows in, hash of the id first; those that all tables let through out, without the hash."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = np.logical_and.reduce([_let_through(t.value, batch.column(0)) for t in tables])
            yield pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:]).filter(pa.array(some))

    return each


def _counted(table):
    """Hashes of ids and texts in, the n-grams of a task by bucket out: of all texts, and of those the table lets through."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in (some for b in batches for some in slices(b, 1)):
            for text, likely in zip(batch.column(1).cast(pa.binary()).to_pylist(), _let_through(table.value, batch.column(0))):
                found = np.bincount(grams(Words(text or b"")), minlength=1 << BITS)
                raw += found
                if likely:
                    target += found
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    return count


def multinomials(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket long, raw long, target long): n-grams by bucket, of all documents and of the trusted ones.

    Each task counts into arrays of 2**BITS and sends those of its sums that are not zero. Documents are
    counted where they lie, as trusted if a table of bounded size lets their id through. The trusted ids
    grow with the corpus, so they are not broadcast: ids alone meet them in a join, which finds the ids
    that the table lets through though nobody trusts them. The texts of those are counted once more, and
    taken off the target; they alone are written and shuffled, with what few others a second table lets through.
    """
    context = docs.sparkSession.sparkContext
    good, _ = written(trusted.select(F.col(id_col).cast("long").alias("_id")).where("_id is not null").distinct(), "trusted")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    hashed = F.when(F.col("_id").isNotNull(), F.xxhash64("_id")).alias("_hash")
    table = context.broadcast(_table(good))
    counts = map_arrow(texts.select(hashed, "_text"), _counted(table), "bucket long, raw long, target long")
    passed = map_arrow(texts.select(hashed, "_id"), _passed(table), "_id long")
    wrong, _ = written(passed.join(good, "_id", "left_anti").distinct(), "untrusted")
    wrong_table = _table(wrong)
    if wrong_table.any():
        again = map_arrow(texts.select(hashed, "_id", "_text"), _passed(table, context.broadcast(wrong_table)), "_id long, _text string")
        again, _ = written(again, "again")  # else a task would run two Python workers, and both would live on
        again = again.join(wrong, "_id", "left_semi").select(F.lit(None).cast("long").alias("_hash"), "_text")
        again = map_arrow(again, _counted(table), "bucket long, raw long, target long")
        counts = counts.unionByName(again.select("bucket", F.lit(0).cast("long").alias("raw"), (-F.col("raw")).alias("target")))
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log(p_target / p_raw) by bucket; all zero if nothing is trusted. At most 2**BITS rows come to the driver.

    The raw multinomial has one added to each bucket. The target one has 2**BITS n-grams added, dealt
    out as the raw one is, so that a bucket of which little is known counts for little.
    """
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for row in counts.collect():
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    if not target.sum():
        return np.zeros(1 << BITS)
    p = (raw + 1) / (raw.sum() + len(raw))
    return np.log((target + len(raw) * p) / (target.sum() + len(raw)) / p)


def judge(text: bytes, ratios: np.ndarray) -> tuple[int, int, int, int, int, float]:
    """The base counts of a text, and the mean log-ratio of its n-grams (0 if it has none)."""
    words = Words(text)
    found = grams(words)
    return (*base_counts(text, words), float(ratios[found].mean()) if len(found) else 0.0)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def apply_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and llr for each row.

    trusted names the documents of the target (its id_col; repeats and nulls are ignored; empty: every
    llr is 0, so the base rules alone decide). A null or empty text has no words and fails the base
    rules. Rows without doc_id are scored like others, and repeated rows each get their row; an empty
    table gives none; other columns are not looked at. Ties with the threshold are kept.
    """
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(multinomials(docs, trusted, id_col, text_col)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for b in batches for some in slices(b, 1)):
            rows = [judge(t or b"", ratios.value) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = list(zip(*rows)) or [[]] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = map_arrow(slim, score, _SCORED).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )


def keep(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that apply_rules() keeps, by the statistics of docs. They are judged where they lie: no shuffle of the kept.

    Null and empty texts fail the base rules and go; rows without id, and repeated ones, are judged like
    others, each by its text; without trusted documents the base rules alone decide; an empty table
    gives none. Ties with the threshold are kept.
    """
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(multinomials(docs, trusted, id_col, text_col)))
    place = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for b in batches for some in slices(b, place)):
            found = [judge(t or b"", ratios.value) for t in batch.column(place).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array([not base_failed(x[0], x[4]) and x[5] >= threshold for x in found], pa.bool_()))

    return map_arrow(docs, lean(each), docs.schema)
