"""Encoding whole texts unit by unit, each distinct unit once.

A tokenizer that first splits a text, and then merges inside each part alone, gives a text the ids of
its parts, one after another. So a slice of texts is split at spaces by Arrow, its units are
dictionary-encoded, the distinct ones are encoded (or remembered from before), and an Arrow take()
lays the ids of all texts side by side. What is remembered is bounded; when full, the last
fifth is forgotten.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of a unit, at most, that is remembered.
REMEMBERED = 64
#: Bytes of text that are encoded at a time.
_SLICE_BYTES = 6 << 20
# All that any of the libraries at hand takes for white space.
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_UNEVEN = rf"^$|^{_SPACE}|{_SPACE}$| {_SPACE}|{_SPACE} "


def slices(batch: pa.RecordBatch, column: int, size: int = _SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``size`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        pa.default_memory_pool().release_unused()
        at = to


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes."""

    #: Units, at most, that are remembered.
    remembered = 1_000_000
    known: dict[str, bytes]

    def split(self, texts: pa.Array) -> pa.ListArray:
        """The units of each text."""
        raise NotImplementedError

    def apart(self, units: list[str]) -> list[bytes]:
        """The ids of each of some distinct units."""
        raise NotImplementedError

    def many(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null is empty."""
        lists = self.split(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        units = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist() takes several times as long
        found = list(map(self.known.get, units))
        fresh = [u for u, x in zip(units, found) if x is None]
        if fresh:
            learnt = dict(zip(fresh, self.apart(fresh)))
            found = [learnt[u] if x is None else x for u, x in zip(units, found)]
            if len(self.known) + len(learnt) > self.remembered:  # the frequent ones came first, and stay
                self.known = dict(islice(self.known.items(), self.remembered * 4 // 5))
            room = max(0, self.remembered - len(self.known))
            self.known |= {u: x for u, x in islice(learnt.items(), room) if len(u) <= REMEMBERED}
        laid = pa.array(found, pa.large_binary()).take(coded.indices)
        _, offsets, data = laid.buffers()
        starts = np.frombuffer(offsets, np.int64)[laid.offset : laid.offset + len(laid) + 1] if len(laid) else np.zeros(1, np.int64)
        ends = starts[np.asarray(lists.offsets) - lists.offsets[0].as_py()].tolist()
        raw = memoryview(data) if data else b""
        return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]


def spaced_units(texts: pa.Array) -> pa.ListArray:
    """Units for a byte-level tokenizer, by whose pattern a word takes a space before it along.

    A space between two characters that are not white space always begins a part of the pattern's. A
    text whose spaces are all like that is split there; its first unit, which has no space before it,
    is marked by a line break in front. Another text is a unit by itself, marked by two.
    """
    marks = pc.if_else(pc.match_substring_regex(texts, _UNEVEN), "\n\n", "\n")
    uneven = pc.equal(marks, "\n\n").to_numpy(zero_copy_only=False)
    if not uneven.any():
        return pc.split_pattern(pc.binary_join_element_wise("\n", texts, ""), " ")
    rows = [["\n\n" + t] if odd else ("\n" + t).split(" ") for t, odd in zip(texts.to_pylist(), uneven)]
    return pa.array(rows, pa.list_(pa.string()))


def unit_text(unit: str) -> str:
    """What a unit of spaced_units() stands for."""
    return unit[2:] if unit[:2] == "\n\n" else unit[1:] if unit[:1] == "\n" else " " + unit


def cut_at(raw: bytes, ends: list[int]) -> list[bytes]:
    return [raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]


class _Library(Encoder):
    """By the tokenizers library, as it encodes by default. Texts with strings of added tokens, which it looks for first, are encoded whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.post_processor = None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = {}

    def many(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts, "")
        # one look for what all of them begin with, then for each
        whole = pc.match_substring(texts, os.path.commonprefix(self.added)).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(texts), bool)
        if whole.any():
            whole = np.any([pc.match_substring(texts, content).to_numpy(zero_copy_only=False) for content in self.added], axis=0)
        if not whole.any():
            return super().many(texts)
        made = super().many(pc.if_else(pa.array(whole), "", texts))
        for i in np.flatnonzero(whole):
            made[i] = self.ids(texts[i].as_py()).tobytes()
        return made

    def largest(self) -> int:
        """The largest id there is."""
        return max(self.tokenizer.get_vocab(with_added_tokens=True).values())

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


class WordEncoder(_Library):
    """For a tokenizer that drops white space, and so never merges across ASCII white space.

    New words are encoded together. Of words that are Latin letters and then perhaps ASCII signs, the
    tokenizer makes one part or two, and each part ends in a token marked as an end; counting those
    tells the words apart. Between other words stands a mark that is one token, and that none holds.
    """

    remembered = 800_000
    #: Characters to mark the end of a word with; the first that is one token is taken.
    MARKS = "♥♦☀★✨☕♫"
    #: What a token that ends a part ends in. A fixed value of the format.
    END = "</w>"
    # letters that stay letters, one each, in lower case and composed; signs but for the apostrophe
    SIMPLE = re.compile(r"[A-Za-zÀ-ÖØ-öø-įĲ-ɏ]+([!-&(-/:-@\[-`{-~]*)").fullmatch

    def __init__(self, path: str):
        super().__init__(path)
        self.mark, self.mark_id = next((m, int(x[0])) for m in self.MARKS if len(x := self.ids(m)) == 1)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.END)]] = True

    def split(self, texts: pa.Array) -> pa.ListArray:
        return pc.ascii_split_whitespace(texts)

    def apart(self, units: list[str]) -> list[bytes]:
        kinds = list(map(self.SIMPLE, units))
        simple, other = [u for u, k in zip(units, kinds) if k], [u for u, k in zip(units, kinds) if not k]
        parts = np.fromiter((2 if k[1] else 1 for k in kinds if k), np.int64, len(simple))
        made = {}
        for at in range(0, len(simple), 1000):
            some = simple[at : at + 1000]
            ids = self.ids(" ".join(some))
            stops, wanted = np.flatnonzero(self.ends[ids]), np.cumsum(parts[at : at + 1000])
            if len(stops) == wanted[-1]:
                made |= zip(some, cut_at(ids.tobytes(), (stops[wanted - 1] + 1).tolist()))
            else:
                other += some
        made |= zip(other, self.marked(other))
        return [made[u] for u in units]

    def marked(self, units: list[str]) -> list[bytes]:
        made = []
        for at in range(0, len(units), 1000):
            some = units[at : at + 1000]
            if any(self.mark in u for u in some):
                made += [self.ids(u).tobytes() for u in some]
                continue
            ids = self.ids(f" {self.mark} ".join([*some, ""]))
            marks = np.flatnonzero(ids == self.mark_id)
            made += cut_at(np.delete(ids, marks).tobytes(), (marks - np.arange(len(marks))).tolist())
        return made


class ByteLevelEncoder(_Library):
    """For a byte-level tokenizer. New units are encoded together, and told apart by the bytes that each token stands for."""

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # each character of a token stands for one byte
            self.sizes[i] = len(token)

    def split(self, texts: pa.Array) -> pa.ListArray:
        return spaced_units(texts)

    def apart(self, units: list[str]) -> list[bytes]:
        first, rest = [u for u in units if u[:1] == "\n"], [u for u in units if u[:1] != "\n"]
        made = {}
        for at in range(0, len(first), 1000):
            some = first[at : at + 1000]
            made |= {u: np.asarray(x.ids, "<u4").tobytes() for u, x in zip(some, self.tokenizer.encode_batch_fast([unit_text(u) for u in some], add_special_tokens=False))}
        for at in range(0, len(rest), 1000):
            some = rest[at : at + 1000]
            ids = self.ids(" " + " ".join(some))
            ends = np.cumsum([len(u.encode()) + 1 for u in some])
            made |= zip(some, cut_at(ids.tobytes(), (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1).tolist()))
        return [made[u] for u in units]


KINDS: dict[str, type[_Library]] = {"byte_level": ByteLevelEncoder, "words": WordEncoder}


@cache
def encoder(path: str, kind: str, remembered: int | None = None) -> _Library:
    """One encoder for each worker process, kept from task to task. remembered: units at most, if not as many as is usual."""
    made = KINDS[kind](path)
    made.remembered = remembered or made.remembered
    return made
