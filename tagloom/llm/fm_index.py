"""Benchmark decontamination: an FM-index per shard of documents, searched for test phrases.

A shard is a run of documents in one task. Its words become numbers of the benchmark's
vocabulary; words outside it, and runs too short for any window, cannot take part in a match
and collapse to a separator, so the index holds only text that could match. Every window of
the benchmark is searched backwards at once, one symbol a step, with ranks from a wavelet
matrix; occurrences are located through sampled suffix positions and merged into spans.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.llm.common import batch, map_arrow, texts, where_text
from tagloom.sources.staging import stage

#: Words are runs of digits, ASCII letters and everything beyond ASCII.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
    "contaminated boolean, spans array<struct<start:long,end:long>>"
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class WaveletMatrix:
    """Ranks of symbols: one packed bit vector per bit of a symbol, with counts per 64 bits."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.levels = len(symbols), max(1, int(sigma - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        now = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(np.uint8)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]))
            self.zeros.append(int(self.n - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        below = self.bits[k][at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.counts[k][at] + np.bitwise_count(below).astype(np.int64)

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """For each end, how many of the first ``end`` symbols equal ``symbol``."""
        at = [np.zeros(len(symbol), np.int64), *ends]
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            ones = [self._ones(k, i) for i in at]
            at = [np.where(one, self.zeros[k] + o, i - o) for i, o in zip(at, ones)]
        return [i - at[0] for i in at[1:]]

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            one = (self.bits[k][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(k, i)
            i = np.where(one.astype(bool), self.zeros[k] + ones, i - ones)
            out = (out << 1) | one.astype(np.int64)
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the end of the text sorts first."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], (np.diff(key[order]) != 0).astype(np.int64)]))
        if new[order[-1]] == n:
            return order
        rank, step = new, step * 2


class FMIndex:
    """Backward search and location over one array of symbols (0 is the separator)."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        symbols = np.append(symbols + 1, 0)  # one end mark below all symbols, so that stepping back is exact
        order = suffix_array(symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma + 1))])
        self.bwt = WaveletMatrix(symbols[order - 1], sigma + 1)
        self.rows = len(symbols)
        self.sampled = np.where(order % sample == 0, order, -1)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns (rows of ``patterns``, right-aligned) at once."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.rows, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, patterns.shape[1] - 1 - step] + 1
            a, b = self.bwt.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.before[c] + a, self.before[c] + b
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a sampled position."""
        out, steps, todo = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            found = self.sampled[rows[todo]]
            done = found >= 0
            out[todo[done]] = found[done] + steps
            todo = todo[~done]
            if len(todo):
                c = self.bwt.access(rows[todo])
                rows[todo] = self.before[c] + self.bwt.rank(c, rows[todo])[0]
            steps += 1
        return out


class Phrases:
    """The windows of a block of benchmark items, with the items each window stands for."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.vocabulary, seen = window, {}, {}
        for item, text in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            size = min(window, len(numbers))
            for i in range(len(numbers) - size + 1) if numbers else ():
                seen.setdefault(tuple(numbers[i : i + size]), set()).add(item)
        self.lengths = np.array([len(k) for k in seen], np.int64)
        self.patterns = np.zeros((len(seen), window), np.int64)
        for row, k in enumerate(seen):
            self.patterns[row, window - len(k) :] = k
        self.items = [sorted(v) for v in seen.values()]
        self.shortest = int(self.lengths.min(initial=window))


def _runs(numbers: np.ndarray, least: int) -> np.ndarray:
    """Positions of the words that lie in runs of at least ``least`` non-zero numbers."""
    edge = np.diff(np.concatenate([[0], (numbers != 0).astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= least
    inside = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(inside, start[long], 1)
    np.add.at(inside, end[long], -1)
    return np.flatnonzero(np.cumsum(inside)[:-1])


def _shard(phrases: Phrases, doc_words: list[list[bytes]]) -> tuple[list, list]:
    """Per document: positions of hit words, and the items found."""
    get = phrases.vocabulary.get
    parts = [np.zeros(1, np.int64)]
    for w in doc_words:
        parts += [np.fromiter(map(get, w, repeat(0)), np.int64, len(w)), np.zeros(1, np.int64)]
    numbers = np.concatenate(parts)
    starts = np.cumsum([1] + [len(w) + 1 for w in doc_words])
    hits, items = [()] * len(doc_words), [()] * len(doc_words)
    kept = _runs(numbers, phrases.shortest)
    if not len(kept):
        return hits, items
    # Between two runs one separator stays; the position of each symbol in the shard is kept beside it.
    gap = np.flatnonzero(np.diff(kept) > 1) + 1
    where = np.insert(kept, gap, -1)
    symbols = np.where(where >= 0, numbers[where], 0)
    index = FMIndex(symbols, len(phrases.vocabulary) + 1)
    lo, hi = index.search(phrases.patterns, phrases.lengths)
    count = np.maximum(hi - lo, 0)
    if not count.sum():
        return hits, items
    which = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(lo, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    at = index.locate(rows)
    cover = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + phrases.lengths[which], -1)
    hit = where[np.flatnonzero(np.cumsum(cover)[:-1])]
    doc = np.searchsorted(starts, hit, side="right") - 1
    for piece in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1):
        hits[doc[piece[0]]] = hit[piece] - starts[doc[piece[0]]]
    pairs = np.unique(np.stack([np.searchsorted(starts, where[at], side="right") - 1, which]), axis=1)
    found: dict[int, set] = {}
    for d, w in pairs.T.tolist():
        found.setdefault(d, set()).update(phrases.items[w])
    for d, names in found.items():
        items[d] = sorted(names)
    return hits, items


def _char_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Hit words as merged character spans: neighbouring hit words join, with what lies between."""
    places = [m.span() for m in _WORD.finditer(text)]
    cuts = np.flatnonzero(np.diff(hit) > 1) + 1
    return [{"start": places[p[0]][0], "end": places[p[-1]][1]} for p in np.split(hit, cuts)]


def _shards(rows, shard_words: int):
    """Lists of (row, words of its text), each cut when ``shard_words`` words are held (one text more at most).

    ``rows`` end in a text; it is split when its turn comes, so the words of a batch are never held together.
    """
    held, out = 0, []
    for row in rows:
        w = words(row[-1] or "")
        out.append((row, w))
        held += len(w) + 1
        if held >= shard_words:
            yield out
            held, out = 0, []
    if out:
        yield out


def _finder(phrases: Phrases, shard_words: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64())]
        + [("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", _SPANS)]
    )

    def flush(ids, raw, split):
        hits, items = _shard(phrases, split)
        n, h = [len(w) for w in split], [len(x) for x in hits]
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        spans = [_char_spans(t, x) if len(x) else [] for t, x in zip(raw, hits)]
        return batch(
            schema, doc_id=ids, n_words=n, n_hit=h, n_items=[len(x) for x in items], items_sha256=sha,
            contaminated=[a > 0 and 20 * a >= b for a, b in zip(h, n)], spans=spans,
        )

    def run(batches):
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for shard in _shards(rows, shard_words):
            yield flush(*zip(*(row for row, _ in shard)), [w for _, w in shard])

    return run


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    shard_words: int = 500_000,
    block_chars: int = 4_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document row: its words, words hit by benchmark windows, items and spans.

    A window is ``window`` consecutive words of an item, or a whole shorter item. A document
    is contaminated when it has a hit and at least a twentieth of its words are hit. ``spans``
    are the merged stretches of characters to remove. Only the benchmark is broadcast: its
    size is counted first and it is taken in blocks of ``block_chars`` characters, each against all
    documents; a document's shard stays in the task that read it, so nothing is shuffled unless
    the benchmark needs several blocks. Then the hits of a block are staged and the block is released
    before the next is read, so the driver and the tasks hold one. A benchmark item is never cut between blocks.

    Null or wordless texts: no words, no hits, not contaminated. Null item ids or texts take
    no part. Repeated document rows each give a row; repeated items count once by id. An empty
    benchmark hits nothing. Other columns are not read.
    """
    read = texts(docs, id_col, text_col)
    n, block = _phrase_blocks(benchmark, window, block_chars)
    if n == 1:
        return map_arrow(read, lambda p=block(0): _finder(p.value, shard_words), SCHEMA)
    return _merge_blocks(read, _block_hits(read, n, block, shard_words))


def _phrase_blocks(benchmark: DataFrame, window: int, block_chars: int):
    """How many blocks the benchmark's measured size asks for, and a function that broadcasts the windows of one."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").dropna()
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // block_chars))
    context = benchmark.sparkSession.sparkContext

    def block(k: int):
        part = bench.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        return context.broadcast(Phrases([tuple(r) for r in part.toLocalIterator()], window))

    return n, block


def keep_uncontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_words: int = 500_000, block_chars: int = 4_000_000,
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated; nothing is shuffled.

    The blocks of a large benchmark are searched one after the other, and only one is held; then the hits
    are shuffled by a hash of the text.
    """
    n, block = _phrase_blocks(benchmark, window, block_chars)
    if n > 1:
        text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
        hits = _all_hits(_block_hits(docs.select(text.alias("text")), n, block, shard_words))
        bad = hits.where(20 * F.size("hit") >= F.col("n_words")).select(F.col("key").alias("__key"))
        return docs.join(bad, F.sha2(text, 256) == F.col("__key"), "left_anti")
    phrases = block(0)

    def make():
        def passes(raw):
            out = []
            for shard in _shards(zip(raw), shard_words):
                split = [w for _, w in shard]
                found = _shard(phrases.value, split)[0]
                out += [len(f) == 0 or 20 * len(f) < len(w) for f, w in zip(found, split)]
            return out

        return passes

    return where_text(docs, make, text_col)


_HITS = "key string, n_words long, hit array<long>, items array<string>"


def _block_hits(read: DataFrame, n: int, block, shard_words: int) -> DataFrame:
    """Rows of ``_word_hits`` for all blocks, one for each distinct text and block; a block is released before the next."""
    keyed, found = read.select(F.sha2("text", 256).alias("key"), "text"), None
    for k in range(n):
        phrases = block(k)
        one = stage(map_arrow(keyed, lambda p=phrases: _word_hits(p.value, shard_words), _HITS).dropDuplicates(["key"]))
        phrases.destroy()
        found = one if found is None else found.unionAll(one)
    return found


def _all_hits(found: DataFrame) -> DataFrame:
    """The hits of all blocks, one row for each text (by its hash) that has any."""
    return found.groupBy("key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def _word_hits(phrases: Phrases, shard_words: int):
    """The texts with hits: their words, the positions of hit words and the items, for one block."""
    schema = pa.schema(
        [("key", pa.string()), ("n_words", pa.int64()), ("hit", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]
    )

    def run(batches):
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for shard in _shards(rows, shard_words):
            split = [w for _, w in shard]
            hits, items = _shard(phrases, split)
            keep = [k for k in range(len(shard)) if len(hits[k])]
            yield batch(
                schema, key=[shard[k][0][0] for k in keep], n_words=[len(split[k]) for k in keep],
                hit=[hits[k] for k in keep], items=[list(items[k]) for k in keep],
            )

    return run


def _merge_blocks(read: DataFrame, found: DataFrame) -> DataFrame:
    """Joins the hits of several blocks to the documents, by a hash of the text."""
    merged = _all_hits(found).drop("n_words")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64())]
        + [("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", _SPANS)]
    )

    def run(batches):
        for b in batches:
            ids, raw, hits, items = (b.column(k).to_pylist() for k in range(4))
            n, h = [len(words(t)) for t in raw], [len(x or ()) for x in hits]
            yield batch(
                schema, doc_id=ids, n_words=n, n_hit=h, n_items=[len(x or ()) for x in items],
                items_sha256=[hashlib.sha256(",".join(x or ()).encode()).hexdigest() for x in items],
                contaminated=[a > 0 and 20 * a >= c for a, c in zip(h, n)],
                spans=[_char_spans(t, np.array(x)) if x else [] for t, x in zip(raw, hits)],
            )

    joined = read.join(merged, F.sha2("text", 256) == F.col("key"), "left").select("doc_id", "text", "hit", "items")
    return map_arrow(joined, lambda: run, SCHEMA)


def remove_spans(text: str, spans: list) -> str:
    """``text`` without the given (start, end) spans, which must be sorted and apart."""
    out, last = [], 0
    for s in spans:
        out.append(text[last : s["start"]])
        last = s["end"]
    return "".join([*out, text[last:]])
