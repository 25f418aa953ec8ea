"""Periodic runs of words, by the branching-tandem test on an enhanced suffix array.

A run is a maximal stretch with a smallest period that it repeats several times. Every run ends with a
branching square: two equal halves of its period's length, followed by a word that breaks the period. Such
a square is two suffixes a period apart that part company exactly a period deep, so they lie on different sides
of an LCP interval of that depth. For each interval the suffixes of the smaller side look up the inverse
suffix array at their place plus and minus the depth; each is met at most log n times. Squares are then
rotated to the left as far as the period holds, which gives the run, and squares of one run are merged.
Intervals are pairs of bounds in the LCP array; no tree is built.

All steps are array operations over the words of many documents at once. A symbol is a word within its
own stretch, so suffixes of different documents share nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagloom.llm.common import batch, map_arrow, texts
from tagloom.llm.hashing import parts

#: Suffixes looked up at a time.
LOOKUPS = 1_000_000
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


class SuffixArray:
    """Suffix array, inverse and LCPs of symbols, by prefix doubling over the suffixes that still tie.

    ``levels[k]`` names the substrings of 2**k symbols: equal names, equal substrings. Every stretch must end in
    a symbol that occurs once.
    """

    def __init__(self, symbols: np.ndarray):
        n, width = len(symbols), 1
        self.order = np.argsort(symbols, kind="stable")
        tied, key = np.arange(n), symbols[self.order]
        names, self.levels = np.empty(n, np.int64), []
        while True:
            first = np.concatenate([[True], key[1:] != key[:-1]])
            names = names.copy()
            names[self.order[tied]] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
            self.levels.append(names)
            alone = first & np.concatenate([first[1:], [True]])
            tied = tied[~alone]
            if not len(tied):
                break
            at = self.order[tied]
            key = names[at] * n + names[at + width]
            sort = np.argsort(key, kind="stable")
            self.order[tied], key, width = at[sort], key[sort], 2 * width
        self.place = names
        self.lcp = np.full(n + 1, -1, np.int64)
        self.lcp[1:n] = self._common(self.order[:-1], self.order[1:], 0, 1)

    def _common(self, a: np.ndarray, b: np.ndarray, shift: int, step: int) -> np.ndarray:
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            names, width = self.levels[k], 1 << k
            x, y = a - shift * width, b - shift * width
            more = (names[np.maximum(x, 0)] == names[np.maximum(y, 0)]) & (x >= 0)
            add = np.where(more, width, 0)
            a, b, out = a + step * add, b + step * add, out + add
        return out

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before places ``a`` and ``b``, with a < b, agree."""
        return self._common(a, b, 1, -1)

    def intervals(self) -> tuple[np.ndarray, np.ndarray]:
        """For each LCP value the nearest smaller one before it and the nearest not larger one after it."""
        lcp, n = self.lcp, len(self.lcp) - 1
        before, after = np.arange(-1, n), np.arange(1, n + 2)
        for hop, past in ((before, lambda x, y: lcp[x] >= lcp[y]), (after, lambda x, y: lcp[x] > lcp[y])):
            todo = np.arange(1, n)
            while len(todo):
                todo = todo[past(hop[todo], todo)]
                hop[todo] = hop[hop[todo]]
        return before, after


def branching_squares(sa: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all squares that the next symbol breaks."""
    lcp, n = sa.lcp, len(sa.order)
    before, after = sa.intervals()
    nodes = np.flatnonzero(lcp > 0)
    low, high = before[nodes], after[nodes]
    smaller_left = nodes - low <= high - nodes
    first, last = np.where(smaller_left, low, nodes), np.where(smaller_left, nodes, high)
    other, end = np.where(smaller_left, nodes, low), np.where(smaller_left, high, nodes)
    sums = np.concatenate([[0], np.cumsum(last - first)])
    starts, periods, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(nodes):
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + LOOKUPS, side="right")) - 1)
        size = last[at:to] - first[at:to]
        which = np.repeat(np.arange(at, to), size)
        i = sa.order[np.arange(len(which)) - np.repeat(sums[at:to] - sums[at], size) + np.repeat(first[at:to], size)]
        d = lcp[nodes[which]]
        for start, mate in ((i, i + d), (i - d, i - d)):
            found = sa.place[np.clip(mate, 0, n - 1)]
            hit = (mate >= 0) & (found >= other[which]) & (found < end[which])
            starts.append(start[hit]), periods.append(d[hit])
        at = to
    return np.concatenate(starts), np.concatenate(periods)


def _stretches(owner: np.ndarray, word: np.ndarray, times: int, least: int):
    """(place, stretch, symbol) of the words that may lie in a run.

    A word of a run occurs in it at least ``times`` times, so rarer words part a text into stretches, and short
    stretches hold no run; what is left is parted again until nothing changes.
    """
    place, part = np.arange(len(word)), owner
    while len(place):
        _, symbol, counts = np.unique(part * (word.max() + 1) + word, return_inverse=True, return_counts=True)
        good = counts[symbol] >= times
        cut = np.concatenate([[True], (part[1:] != part[:-1]) | (place[1:] != place[:-1] + 1) | ~good[1:] | ~good[:-1]])
        now = np.cumsum(cut) - 1
        keep = good & (np.bincount(now)[now] >= least)
        if keep.all() and (now == part).all():
            return place, now, symbol
        place, word, part = place[keep], word[keep], now[keep]
        part = np.unique(part, return_inverse=True)[1]
    return place, part, word


def runs_of(owner: np.ndarray, word: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, end, period), sorted, of the runs of at least ``least`` words and ``times`` periods.

    ``word`` numbers the words of texts laid end to end, ``owner`` the text of each, ascending.
    """
    place, part, symbol = _stretches(owner, word, times, least)
    if not len(place):
        return np.zeros((0, 3), np.int64)
    # A closing symbol of its own after each stretch.
    spot = np.arange(len(part)) + part
    flat = np.arange(len(part) + part[-1] + 1) + len(part)
    flat[spot] = symbol
    sa = SuffixArray(flat)
    start, period = branching_squares(sa)
    end = start + 2 * period
    start = start - sa.common_before(start, start + period)
    enough = end - start >= np.maximum(least, times * period)
    found = np.stack([start, end, period], axis=1)[enough]
    # A square of twice the period gives the same run; the smallest period comes first.
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if len(found):
        found = found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])]
    back = np.zeros(len(flat), np.int64)
    back[spot] = place
    found[:, 1] = back[found[:, 1] - 1] + 1
    found[:, 0] = back[found[:, 0]]
    return found


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    keep = np.ones(len(words), bool)
    for start, end, period in runs.tolist():
        keep[start + period : end] = False
    return b" ".join([words[k] for k in np.flatnonzero(keep).tolist()])


def _finder(least: int, times: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUNS), ("text", pa.string())])

    def rows(ids, raw):
        split = [t.encode("utf-8", "surrogatepass").split() for t in raw]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        flat = pa.array([w for s in split for w in s], pa.large_binary()).dictionary_encode()
        found = runs_of(np.repeat(np.arange(len(split)), counts), flat.indices.to_numpy().astype(np.int64), least, times)
        ends = np.cumsum(counts)
        cuts = np.searchsorted(found[:, 0], ends)
        runs, kept, at = [], [], 0
        for words, end, to in zip(split, ends.tolist(), cuts.tolist()):
            own = found[at:to] - np.array([end - len(words), end - len(words), 0])
            runs.append([(s, e - s, p) for s, e, p in own.tolist()])
            kept.append((_collapsed(words, own) if to > at else b" ".join(words)).decode("utf-8", "replace"))
            at = to
        return batch(schema, doc_id=ids, n_words=counts, runs=[[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs], text=kept)

    def run(batches):
        for b in batches:
            ids, raw = b.column(0).to_pylist(), b.column(1).to_pylist()
            for part in parts(raw):
                yield rows(ids[part], raw[part])

    return run


def find_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, runs by start, and the text without repeats.

    Words are what white space (0x20, 0x09 to 0x0D) separates, numbered from 0. A run is a maximal stretch of at
    least ``least`` words and ``times`` (two or more) of its smallest period. ``text`` keeps a run's first
    period, and of words in several runs those that none of them drops; words are joined by one space.

    Null or empty texts have no words, no runs and an empty text. Repeated rows each give a row, null ids are
    kept, an empty table gives no rows; other columns are not read. Nothing is shuffled. A task holds about
    three million characters at a time, or one longer text: some 30 numbers for each of its words that may lie
    in a run.
    """
    if times < 2:
        raise ValueError("a run repeats its period at least twice")
    return map_arrow(texts(docs, id_col, text_col), lambda: _finder(least, times), SCHEMA)
