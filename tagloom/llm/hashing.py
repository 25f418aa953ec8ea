"""64-bit hashes of all words of many texts at once, without a loop over words."""

from __future__ import annotations

import numpy as np

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_BASE = 0x9FB21C651E98DF25 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time; a longer word is hashed whole.
SEGMENT = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """Hashes words, the runs of bytes that are not white space (0x20, 0x09 to 0x0D).

    A word's hash is a polynomial in an odd base over random numbers of its bytes, modulo 2**64, taken
    from prefix sums and mixed with its length. ``lower`` hashes A-Z as a-z.
    """

    def __init__(self, lower: bool):
        self.code = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _M3)
        if lower:
            self.code[65:91] = self.code[97:123]
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        powers = np.empty((2, n), np.uint64)
        powers[0], powers[1], powers[:, 0] = np.uint64(_BASE), np.uint64(_INVERSE), 1
        self.powers, self.inverses = np.multiply.accumulate(powers, axis=1)

    def __call__(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of the words of a byte array that ends in white space."""
        space = self.space[raw]
        edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        out, at = np.empty(len(start), np.uint64), 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + SEGMENT, side="right")))
            low, high = int(start[at]), int(end[to - 1])
            if high - low > len(self.powers):
                self._grow(max(SEGMENT, high - low))
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.code[raw[low:high]] * self.powers[: high - low], out=sums[1:])
            a, b = start[at:to] - low, end[at:to] - low
            out[at:to] = mix((sums[b] - sums[a]) * self.inverses[a] + (b - a).astype(np.uint64) * _M3)
            at = to
        return out, start, end


def parts(texts: list[str], most: int = 3_000_000, rows: int = 2000) -> list[slice]:
    """Runs of texts of about ``most`` characters in all (one text more at most), so that arrays stay small."""
    out, first, held = [], 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= most or k + 1 - first >= rows:
            out.append(slice(first, k + 1))
            first, held = k + 1, 0
    if first < len(texts):
        out.append(slice(first, len(texts)))
    return out


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts, each closed by a line feed, and where each text ends."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    return np.frombuffer(b"\n".join([*parts, b""]), np.uint8), ends


def words_of(hasher: WordHasher, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and how many words each text has."""
    raw, ends = joined(texts)
    hashes, start, _ = hasher(raw)
    return hashes, np.diff(np.searchsorted(start, ends), prepend=0)
