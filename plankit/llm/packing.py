"""Best-fit packing by exact-complement hashing.

Pieces of token sequences are packed into sequences of a fixed capacity. What matters of a piece is
its length alone, so the plan is made from the count of pieces of each length: a table of at most
``capacity`` rows, however large the corpus. For each length, longest first, the plan looks up in its
index of single, pair and triple length sums a combination that fills the gap exactly, and consumes
it as often as its counts allow. What is left is packed by best fit. The plan is a list of patterns
(lengths, times). The n-th piece of a length takes the n-th place the plan has for that length; that
rank comes from counts per task and their running totals, so no length's pieces meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plankit.llm.arrow import lean, map_arrow
from plankit.llm.scratch import starts, written
from plankit.llm.tokens import encoder, slices

CAPACITY = 1024
END_ID = 2
#: Bytes of text that are encoded at a time: the more, the fewer times a unit is looked up.
_SLICE_BYTES = 12 << 20


def cut(length: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a sequence: full ones, the first the shorter one if there is one."""
    full, rest = divmod(length, capacity)
    return ([rest] if rest else []) + [capacity] * full


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", remembered: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids binary, part, nth): each document's ids and end id, cut into pieces.

    part is the number of the task that made the row, nth the row's rank there among pieces of its
    length. A null text is empty, and a piece of the end id alone. The rows have to be written before
    part and nth are used.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, "byte_level", remembered).many, TaskContext.get().partitionId()
        end, seen = np.asarray([end_id], "<u4").tobytes(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in slices(batch, 1, _SLICE_BYTES if remembered is None else _SLICE_BYTES // 2):
                rows = []
                for doc, ids in zip(some.column(0).to_pylist(), encode(some.column(1))):
                    ids, start = ids + end, 0
                    for i, length in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((doc, i, start, length, ids[4 * start : 4 * (start + length)], part, int(seen[length])))
                        seen[length] += 1
                        start += length
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _PIECE)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(slim, each if remembered is None else lean(each, encodes=True), "doc_id long, piece int, start long, length long, ids binary, part long, nth long")


_PIECE = ["doc_id", "piece", "start", "length", "ids", "part", "nth"]


class _Sums:
    """An index of the lengths at hand by what one, two or three of them add up to, and how many are left of each.

    The entries of a sum lie side by side, the longest member first. Those of three are a length and a
    sum of two, which is looked up in turn. Built once; counts only fall, so an entry's check is
    against what is left.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()
        top = len(counts) - 1
        have = np.flatnonzero(counts)
        longer, shorter = (x.ravel() for x in np.meshgrid(have, have, indexing="ij"))
        some = (longer >= shorter) & (longer + shorter <= top)
        self.longer, self.shorter, self.pair_at = self._by_sum(longer[some], shorter[some], top)
        sums = np.unique(self.longer + self.shorter)
        single, of_two = (x.ravel() for x in np.meshgrid(have, sums, indexing="ij"))
        some = (single + of_two <= top) & (2 * single >= of_two)
        self.single_of, self.pair_of, self.triple_at = self._by_sum(single[some], of_two[some], top)

    @staticmethod
    def _by_sum(first: np.ndarray, second: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((-first, first + second))
        first, second = first[order], second[order]
        return first, second, np.searchsorted(first + second, np.arange(top + 2))

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if self.left[total] else None

    def pair(self, total: int, most: int | None = None) -> tuple[int, ...] | None:
        """The pair with the longest member, of at most ``most``."""
        some = slice(self.pair_at[total], self.pair_at[total + 1])
        longer, shorter = self.longer[some], self.shorter[some]
        found = np.flatnonzero((self.left[longer] > 0) & (self.left[shorter] > (longer == shorter)) & (longer <= (most or total)))
        return (int(longer[found[0]]), int(shorter[found[0]])) if len(found) else None

    def triple(self, total: int) -> tuple[int, ...] | None:
        """The triple with the longest member, then the longest second one."""
        for at in range(self.triple_at[total], self.triple_at[total + 1]):
            longest, rest = int(self.single_of[at]), int(self.pair_of[at])
            if not self.left[longest]:
                continue
            self.left[longest] -= 1
            found = self.pair(rest, longest)
            self.left[longest] += 1
            if found:
                return (longest, *found)
        return None

    def take(self, lengths: tuple[int, ...]) -> int:
        """Consume the combination as often as the counts allow; that number."""
        kinds, uses = np.unique(lengths, return_counts=True)
        times = int((self.left[kinds] // uses).min())
        self.left[kinds] -= uses * times
        return times


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; they consume exactly the counts of pieces by length.

    Combinations that use up short pieces can leave long ones alone, so the plan is made with up to
    three, two and one pieces in a gap; that of fewest sequences is taken, of equals the first. Each
    step exhausts a length or a group of open sequences, so there are a few patterns for each length
    at most, whatever the counts.
    """
    made = [_plan(counts, capacity, most) for most in (3, 2, 1)]
    return min(made, key=lambda patterns: sum(times for _, times in patterns))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan with exact combinations of up to ``most`` pieces in a gap."""
    given = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        given[length] = n
    made: list[tuple[tuple[int, ...], int]] = [((capacity,), int(given[capacity]))] if given[capacity] else []
    given[capacity] = 0
    sums = _Sums(given)
    for length in range(capacity - 1, 0, -1):
        for find in (sums.single, sums.pair, sums.triple)[:most]:
            while sums.left[length]:
                sums.left[length] -= 1
                rest = find(capacity - length)
                sums.left[length] += 1
                if not rest:
                    break
                made.append(((length, *rest), sums.take((length, *rest))))
    return made + _best_fit(sums.left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of groups of like sequences: those with the least gap that holds the piece."""
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g in gaps if g >= length), default=capacity)
            pattern, times = gaps[gap].pop() if gap in gaps else ((), n)
            if gap in gaps and not gaps[gap]:
                del gaps[gap]
            fit = gap // length
            used = min(times, n // fit)
            if used:
                gaps.setdefault(gap - fit * length, []).append((pattern + (length,) * fit, used))
                n, times = n - used * fit, times - used
            if n and times:  # fewer are left than one sequence holds
                gaps.setdefault(gap - n * length, []).append((pattern + (length,) * n, 1))
                n, times = 0, times - 1
            if times and pattern:
                gaps.setdefault(gap, []).append((pattern, times))
    return [x for groups in gaps.values() for x in groups]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For look-up by length and rank: the sorted keys length << 40 | first rank, and there the sequence and the offset."""
    rows, ranks, sequence = [], {}, 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            first = ranks.get(length, 0)
            rows.append(((length << 40) | first, sequence, offset))
            ranks[length] = first + times
            offset += length
        sequence += times
    rows.sort()
    keys, sequences, offsets = zip(*rows) if rows else ((), (), ())
    return np.asarray(keys, np.int64), np.asarray(sequences, np.int64), np.asarray(offsets, np.int64)


def place(found: DataFrame, capacity: int = CAPACITY, forgets: bool = False) -> DataFrame:
    """The rows of found (written; length, part and nth are looked at, other columns pass), with sequence_id and offset.

    In each sequence the pieces lie one after another from offset 0. An empty table gives no rows.
    forgets: whether workers forget their encoders here.
    """
    sums = found.groupBy("part", "length").agg(F.count("*").alias("_n"))
    counts = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # at most capacity rows
    keys, sequences, offsets = places(plan(counts, capacity))
    base = starts(sums, ["part"], "_n", "_base", by=["length"]).select("part", "length", "_base")
    ranked = found.join(base, ["part", "length"]).withColumn("_rank", F.col("_base") + F.col("nth")).drop("_base", "part", "nth")
    names = [c for c in ranked.columns if c != "_rank"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = (batch.column("length").to_numpy() << 40) | batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, wanted, "right") - 1
            arrays = [batch.column(c) for c in names] + [pa.array(sequences[at] + wanted - keys[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    schema = ranked.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return map_arrow(ranked, lean(each) if forgets else each, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", remembered: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Where each piece of each document lies, and the written table of pieces with their ids.

    The first has doc_id, piece, start, length, ids_crc32, sequence_id and offset. A null or empty text
    is a piece of the end id alone. Rows without doc_id are packed too; repeated rows are packed each; an
    empty table gives no rows; other columns of docs are not looked at. remembered: units that a worker
    remembers at most, and only until these are encoded, for less memory at more time.
    """
    made, _ = written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, remembered), "pieces")
    slim = made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth")
    return place(slim, capacity, forgets=remembered is not None), made
