"""Elias-Fano sequences and a two-level n-gram trie in one flat buffer of levels."""

from __future__ import annotations

import mmap

import numpy as np

_ONE = np.uint64(1)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Fixed-width numbers in 64-bit words, with one word to spare."""
    words = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width and len(values):
        bit = np.arange(len(values), dtype=np.int64) * width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        np.bitwise_or.at(words, word, values << shift)
        over = shift.astype(np.int64) + width > 64
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return words


class Ranked:
    """A packed bit vector with counts of ones before each word; selects ones and zeros."""

    def __init__(self, words: np.ndarray):
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.arange(len(words) + 1, dtype=np.int64) * 64 - self.ones

    def _select(self, k: np.ndarray, counts: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(counts, k, side="right") - 1
        rest = k - counts[word]
        bits = ~self.words[word] if flip else self.words[word]
        place = np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(bits & ((_ONE << np.uint64(step)) - _ONE)).astype(np.int64)
            right = rest >= low
            rest = np.where(right, rest - low, rest)
            bits = np.where(right, bits >> np.uint64(step), bits)
            place += step * right
        return word * 64 + place

    def select1(self, k: np.ndarray) -> np.ndarray:
        return self._select(k, self.ones, False)

    def select0(self, k: np.ndarray) -> np.ndarray:
        return self._select(k, self.zeros, True)


class EliasFano:
    """A non-decreasing sequence of unsigned numbers: low bits packed, high parts in unary."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, Ranked(high)
        self.mask = (_ONE << np.uint64(width)) - _ONE

    @staticmethod
    def parts(values: np.ndarray) -> list[np.ndarray]:
        """The flat arrays a sequence consists of: (n, width), low words, high words."""
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = min(63, max(0, (top // max(n, 1)).bit_length() - 1)) if n else 0
        high = (values >> np.uint64(width)).astype(np.int64)
        ones = high + np.arange(n)
        bits = (int(high[-1]) if n else 0) + n + 1
        words = np.zeros(bits // 64 + 2, np.uint64)
        np.bitwise_or.at(words, ones >> 6, _ONE << (ones & 63).astype(np.uint64))
        return [np.array([n, width], np.uint64), _pack(values & ((_ONE << np.uint64(width)) - _ONE), width), words]

    @classmethod
    def of(cls, head: np.ndarray, low: np.ndarray, high: np.ndarray) -> EliasFano:
        return cls(int(head[0]), int(head[1]), low, high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        # Two shifts, as a shift by 64 is not defined.
        over = (self.low[word + 1] << _ONE) << (np.uint64(63) - shift)
        return ((self.low[word] >> shift) | over) & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        high = self.high.select1(i) - i
        return (high.astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each x the place of the first value that is not below it (n if there is none)."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        x = x.astype(np.uint64)
        high = x >> np.uint64(self.width)
        last = int(self.high.select1(np.array([self.n - 1]))[0]) - (self.n - 1)
        inside = high <= np.uint64(last)
        h = np.where(inside, high, np.uint64(0)).astype(np.int64)
        begin = np.where(h > 0, self.high.select0(np.maximum(h - 1, 0)) - (h - 1), 0)
        end = self.high.select0(h) - h
        begin, end = np.where(inside, begin, self.n), np.where(inside, end, self.n)
        low = x & self.mask
        while True:
            todo = np.flatnonzero(begin < end)
            if not len(todo):
                return begin
            mid = (begin[todo] + end[todo]) >> 1
            below = self._low(mid) < low[todo]
            begin[todo] = np.where(below, mid + 1, begin[todo])
            end[todo] = np.where(below, end[todo], mid)


#: Counts are kept in 16 bits: exactly up to EXACT, then in equal steps of the logarithm.
EXACT, CODES = 32_767, 65_535
_STEP = np.log(2.0**40 / EXACT) / (CODES - EXACT)


def quantise(counts: np.ndarray) -> np.ndarray:
    far = EXACT + np.rint(np.log(np.maximum(counts, EXACT) / EXACT) / _STEP)
    return np.where(counts <= EXACT, counts, np.minimum(far, CODES)).astype(np.uint16)


def restore(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.float64)
    return np.where(codes <= EXACT, codes, EXACT * np.exp((np.maximum(codes, EXACT) - EXACT) * _STEP))


class BigramTrie:
    """Contexts, monotone pointers to their successors, successors and quantised weights.

    Successors are numbers of a word level; a context's successors are kept as
    ``context * words + word``, so that the whole level is one increasing sequence and a successor is
    searched relative to its context. The levels lie in one buffer, mapped into memory.
    """

    LEVELS = ("contexts", "pointers", "words", "successors")

    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.uint64, 15)
        arrays, at = [], 15 * 8
        for size in head[:14].tolist():
            arrays.append(np.frombuffer(buffer, np.uint64, int(size), at))
            at += 8 * int(size)
        parts = [EliasFano.of(*arrays[k : k + 3]) for k in (0, 3, 6, 9)]
        self.contexts, self.pointers, self.words, self.successors = parts
        self.totals, self.followers = arrays[12], arrays[13]
        self.codes = np.frombuffer(buffer, np.uint16, int(head[14]), at)

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, count: np.ndarray) -> mmap.mmap:
        """From distinct (context, word) pairs in ascending order and their counts."""
        contexts, start, n = np.unique(context, return_index=True, return_counts=True)
        words, number = np.unique(word, return_inverse=True)
        owner = np.repeat(np.arange(len(contexts)), n)
        successors = owner.astype(np.uint64) * np.uint64(max(1, len(words))) + number.astype(np.uint64)
        totals = np.add.reduceat(count, start) if len(start) else np.zeros(0, np.int64)
        arrays = [
            *EliasFano.parts(contexts), *EliasFano.parts(np.append(start, len(word))), *EliasFano.parts(words),
            *EliasFano.parts(successors), totals.astype(np.uint64), n.astype(np.uint64),
        ]
        codes = quantise(count)
        head = np.array([len(a) for a in arrays] + [len(codes)], np.uint64)
        raw = b"".join([head.tobytes(), *(a.tobytes() for a in arrays), codes.tobytes()])
        buffer = mmap.mmap(-1, max(1, len(raw)))
        buffer.write(raw)
        return buffer

    def context(self, v: np.ndarray) -> np.ndarray:
        """The number of each context, or -1."""
        at = self.contexts.successor(v)
        known = at < self.contexts.n
        known[known] = self.contexts.access(at[known]) == v[known]
        return np.where(known, at, -1)

    def weights(self, context: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The codes of the pairs (number of a context, word); 0 if a pair is unknown."""
        out = np.zeros(len(w), np.uint16)
        word = self.words.successor(w)
        ask = np.flatnonzero((context >= 0) & (word < self.words.n))
        ask = ask[self.words.access(word[ask]) == w[ask]]
        x = context[ask].astype(np.uint64) * np.uint64(max(1, self.words.n)) + word[ask].astype(np.uint64)
        at = self.successors.successor(x)
        end = self.pointers.access(context[ask] + 1).astype(np.int64)
        found = at < end
        found[found] = self.successors.access(at[found]) == x[found]
        out[ask[found]] = self.codes[at[found]]
        return out
