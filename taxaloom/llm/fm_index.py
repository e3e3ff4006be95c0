"""A compressed full-text index of word sequences: order-bounded BWT, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np

#: Suffixes are sorted by this many words, so patterns up to this length are found.
ORDER = 16


class Bits:
    """A bit vector with constant-time rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.uint32 if len(bits) < 1 << 32 else np.int64)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Ranks of symbols 0 .. size - 1 in a sequence."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels = max(1, int(size - 1).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        rest = symbols
        for level in range(self.levels - 1, -1, -1):
            one = (rest >> level & 1).astype(bool)
            self.bits.append(Bits(one))
            self.zeros.append(int(len(rest) - np.count_nonzero(one)))
            rest = np.concatenate([rest[~one], rest[one]])
        self.first = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            ones = bits.ones(at)
            at = np.where(symbol >> (self.levels - 1 - k) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._walk(symbol, at) - self.first[symbol]


class FMIndex:
    """Index of a sequence of symbols 1 .. size - 1 with separators 0."""

    def __init__(self, text: np.ndarray, size: int) -> None:
        n = len(text)
        self.text = text
        rank, width, self.blocks = text.astype(np.int64), 1, {}
        while True:
            self.blocks[width] = rank
            if width >= ORDER:
                break
            ahead = np.full(n, -1, np.int64)
            ahead[: n - width] = rank[width:]
            key = rank * (n + 2) + ahead + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            width *= 2
        self.order = order
        self.bwt = WaveletMatrix(text[order - 1], size)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])

    def seed(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the 8 words at each position of the text, from the sort's own blocks."""
        block = self.blocks[8]
        if not hasattr(self, "_ends"):
            counts = np.bincount(block, minlength=len(block))
            self._ends = np.arange(len(block)) + counts
        lo = block[at]
        return lo, self._ends[lo]

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        base = self.smaller[symbol]
        return base + self.bwt.rank(symbol, lo), base + self.bwt.rank(symbol, hi)

    def matches(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the ``length`` words (8 to ORDER) at each start in the text; one of size 1 may be left early
        and then stands for an own occurrence alone."""
        lo, hi = self.seed(starts + length - 8)
        for k in range(length - 9, -1, -1):
            live = np.flatnonzero(hi - lo > 1)
            if not len(live):
                break
            lo[live], hi[live] = self.back(self.text[starts[live] + k], lo[live], hi[live])
        return lo, hi
