"""Words of a text as arrays, shared by the operators that count n-grams."""

from __future__ import annotations

import numpy as np


class Words:
    """The words of one text: runs of bytes other than the six ASCII white-space characters.

    ``distinct`` holds each different word once, in order of first appearance; ``at`` is the place in
    it of each word of the text.
    """

    __slots__ = ("at", "distinct")

    def __init__(self, text: bytes):
        words = text.split()
        self.distinct = dict.fromkeys(words)
        for i, word in enumerate(self.distinct):
            self.distinct[word] = i
        self.at = np.fromiter(map(self.distinct.__getitem__, words), np.int64, len(words))

    def repeated(self, size: int = 3) -> int:
        """Words that lie in a window of ``size`` words found twice or more in the text."""
        n = len(self.at)
        if n <= size:
            return 0
        window = self.at[: n - size + 1]
        for i in range(1, size):
            if (int(window.max()) + 1) * len(self.distinct) >= 1 << 62:
                window = np.unique(window, return_inverse=True)[1]
            window = window * len(self.distinct) + self.at[i : n - size + 1 + i]
        ordered = np.sort(window)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return 0
        twice = np.append(np.unique(twice), np.iinfo(np.int64).max)
        hit = twice[np.searchsorted(twice, window)] == window
        covered = np.zeros(n, bool)
        for i in range(size):
            covered[i : n - size + 1 + i] |= hit
        return int(covered.sum())


_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each two neighbours, from the hashes of the words in text order."""
    mixed = (words[:-1] * _MIX) ^ (words[1:] * _TURN)
    return (mixed ^ (mixed >> np.uint64(29))) * _MIX


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The top bits of a multiplicative hash: a number below 2**bits."""
    return ((hashes * _MIX) >> np.uint64(64 - bits)).astype(np.int64)
