"""Byte-level BPE by DuckDB queries: recursive contraction to encode, ordered aggregation to decode.

Each worker process keeps an in-memory DuckDB with the merge table (left id, right id, new id; the
new id is the rank). The distinct parts of a slice of texts that the worker has not met go in as
token-position rows, one for each byte. The recursive query joins each token and its right neighbour
with the merge table, contracts each part's leftmost pair of minimum rank, and repeats until no part
has a pair left. A text's ids are those of its parts. Decoding joins id-position rows with the
vocabulary and aggregates the bytes in order of position.

A part of many bytes would need as many rounds, so it goes into the query as overlapping windows. Ids
are the encoding of a text if and only if each two neighbours are that of their own bytes. So where
the encodings of two windows have a token in common, at one place, what the first has up to there
and what the second has from there on together are the encoding of both. Windows without such a token
are made anew, twice as long.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plankit.llm.arrow import map_arrow
from plankit.llm.tokens import REMEMBERED as _REMEMBERED
from plankit.llm.tokens import Encoder, slices, spaced_units, unit_text

#: Bytes of parts in one recursive query, rows that it may make, and ids in one decoding query: they bound its memory.
_CHUNK_BYTES, _CHUNK_ROWS, _CHUNK_IDS = 500_000, 6_000_000, 1_000_000
#: Bytes of a window, of which half lie in the next one too.
_WINDOW = 256

# A token's key is its part's number and its byte's place there, so that one order serves all parts.
_ENCODE = """
WITH RECURSIVE steps AS (
  SELECT w, w::BIGINT * {room} + pos AS key, tok, false AS done FROM parts
  UNION ALL
  SELECT * FROM (
    WITH paired AS MATERIALIZED (
      SELECT s.w, s.key, s.next_key, s.tok, m.new, m.new::BIGINT * 1099511627776 + s.key AS mine
      FROM (SELECT w, key, tok, lead(tok) OVER o AS next_tok, lead(key) OVER o AS next_key, lead(w) OVER o AS next_w
            FROM steps WHERE NOT done WINDOW o AS (ORDER BY key)) s
      LEFT JOIN merges m ON m.l = s.tok AND m.r = s.next_tok AND s.next_w = s.w),
    least AS (SELECT w, min(mine) AS best, arg_min(next_key, mine) AS gone FROM paired GROUP BY w)
    SELECT p.w, p.key, CASE WHEN p.mine = l.best THEN p.new ELSE p.tok END AS tok, l.best IS NULL AS done
    FROM paired p JOIN least l ON l.w = p.w WHERE l.gone IS NULL OR p.key <> l.gone))
SELECT w, tok FROM steps WHERE done ORDER BY w, key"""

_DECODE = "SELECT d, string_agg(b, '' ORDER BY pos) AS s FROM (SELECT d, pos, b FROM tokens JOIN vocabulary USING (id)) GROUP BY d"


class Bpe(Encoder):
    """Encodes and decodes by the ranks in a file of lines "base64 rank"."""

    remembered = 900_000

    def __init__(self, path: str, pattern: str):
        import duckdb

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.known, self.parts = {}, {}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))
        self.first = np.asarray([ranks[bytes([i])] for i in range(256)], np.int32)
        merges = [(ranks[t[:i]], ranks[t[i:]], n) for t, n in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.base = duckdb.connect(":memory:")
        self.base.execute("SET threads = 1").fetchall()
        tables = {
            "merges": dict(zip(("l", "r", "new"), map(list, zip(*merges)))),
            "vocabulary": {"id": list(ranks.values()), "b": [t.decode("latin-1") for t in ranks]},
        }
        for name, columns in tables.items():
            self.base.register("given", pa.table({k: pa.array(v, pa.string() if k == "b" else pa.int32()) for k, v in columns.items()}))
            self.base.execute(f"CREATE TABLE {name} AS SELECT * FROM given").fetchall()
            self.base.unregister("given")

    def _rows(self, parts: list[bytes]) -> pa.Table:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        word = np.repeat(np.arange(len(parts)), sizes)
        place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        tokens = self.first[np.frombuffer(b"".join(parts), np.uint8)]
        return pa.table({"w": pa.array(word, pa.int32()), "pos": pa.array(place, pa.int64()), "tok": pa.array(tokens, pa.int32())})

    def _contract(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part, as little-endian unsigned 32-bit bytes."""
        self.base.register("parts", self._rows(parts))
        found = self.base.sql(_ENCODE.format(room=1 << max(map(len, parts)).bit_length())).to_arrow_table()
        self.base.unregister("parts")
        ends = np.searchsorted(found["w"].to_numpy(), np.arange(len(parts) + 1)).tolist()
        raw = found["tok"].to_numpy().astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]

    def _contracted(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each part, of some distinct ones, by as many queries as memory asks for."""
        made, ordered = {}, sorted(parts, key=len)
        at = 0
        while at < len(ordered):
            to, size, rows = at, 0, 0
            while to < len(ordered) and (to == at or (size + len(ordered[to]) <= _CHUNK_BYTES and rows + len(ordered[to]) ** 2 <= 2 * _CHUNK_ROWS)):
                size, rows, to = size + len(ordered[to]), rows + len(ordered[to]) ** 2, to + 1
            made |= zip(ordered[at:to], self._contract(ordered[at:to]))
            at = to
        return made

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        made, left, window = {}, {p: p.encode() for p in fresh if p}, _WINDOW
        while left:
            step = window // 2
            cut = {p: [x[i : i + window] for i in range(0, max(1, len(x) - step), step)] for p, x in left.items()}
            found = self._contracted(list(dict.fromkeys(chain.from_iterable(cut.values()))))
            made |= {p: x for p, windows in cut.items() if (x := self._joined([found[w] for w in windows], step)) is not None}
            left, window = {p: x for p, x in left.items() if p not in made}, 2 * window
        return made

    def _joined(self, windows: list[bytes], step: int) -> bytes | None:
        """The ids of a part from those of its windows; None if two of them have no token in common."""
        if len(windows) == 1:
            return windows[0]
        ids = [np.frombuffer(w, "<u4").astype(np.int64) for w in windows]
        # a token by where it ends and its id, so that equal ones begin at one place too
        tokens = [(np.cumsum(self.sizes[x]) + i * step << 32) | x for i, x in enumerate(ids)]
        parts, first = [], 0
        for i, (here, there) in enumerate(zip(tokens, tokens[1:])):
            common = np.intersect1d(here[first:], there, assume_unique=True)
            if not len(common):
                return None
            last, after = np.searchsorted(here, common[-1]) + 1, np.searchsorted(there, common[-1]) + 1
            parts.append(ids[i][first:last])
            first = after
        parts.append(ids[-1][first:])
        return np.concatenate(parts).astype("<u4").tobytes()

    def split(self, texts: pa.Array) -> pa.ListArray:
        return spaced_units(texts)

    def apart(self, units: list[str]) -> list[bytes]:
        """The ids of each unit: those of its parts by the pattern, each encoded once."""
        split = [self.pattern.findall(unit_text(u)) for u in units]
        parts = list(dict.fromkeys(chain.from_iterable(split)))
        ids = {p: self.parts[p] for p in parts if p in self.parts}
        learnt = self._learn([p for p in parts if p not in ids])
        if len(self.parts) + len(learnt) > self.remembered:
            self.parts = dict(islice(self.parts.items(), self.remembered * 4 // 5))
        room = max(0, self.remembered - len(self.parts))
        self.parts |= {p: x for p, x in islice(learnt.items(), room) if len(p) <= _REMEMBERED}
        ids |= learnt
        return [b"".join([ids[p] for p in unit]) for unit in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each array of ids (as encode() gives them) stands for."""
        made = [b""] * len(ids)
        sizes = [len(x) // 4 for x in ids]
        at = 0
        while at < len(ids):
            to, held = at + 1, sizes[at]
            while to < len(ids) and held + sizes[to] <= _CHUNK_IDS:
                held, to = held + sizes[to], to + 1
            if held:
                flat = np.frombuffer(b"".join(ids[at:to]), "<u4").astype(np.int32)
                doc = np.repeat(np.arange(at, to), sizes[at:to])
                self.base.register("tokens", pa.table({"d": pa.array(doc), "pos": pa.array(np.arange(len(flat))), "id": pa.array(flat)}))
                for d, text in self.base.sql(_DECODE).fetchall():
                    made[d] = text.encode("latin-1")
                self.base.unregister("tokens")
            at = to
        return made


@cache
def bpe(path: str, pattern: str) -> Bpe:
    """One for each worker process, kept from task to task."""
    return Bpe(path, pattern)


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded binary) for each row of docs: its ids, and the bytes that decoding them gives.

    ids are little-endian unsigned 32-bit. Null and empty texts have none. Special tokens are not
    looked for. Rows without doc_id and repeated rows are encoded like others; an empty table gives
    none; other columns are not looked at.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = bpe(ranks, pattern)
        for batch in batches:
            for some in slices(batch, 1):
                ids = worker.many(some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.binary()), pa.array(worker.decode(ids), pa.binary())], ["doc_id", "ids", "decoded"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(slim, each, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs; digests of nothing for empty texts."""
    made = encode(docs, ranks, pattern, id_col, text_col)
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
