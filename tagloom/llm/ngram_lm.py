"""Language-model scores from bigrams in Elias-Fano tries, one trie per shard of contexts.

Neither the counts of a corpus nor its vocabulary fit a broadcast, so texts do not look words up in a
model; blocks of documents ask the shards of the model. A block is a run of documents of one task. It sends
each shard its distinct bigrams, with their counts in training documents. The shard adds the
counts of all blocks, builds a trie (contexts, monotone pointers, successors, quantised weights) and
answers every block's bigrams by successor search within the context. The block then scores its documents.

The model is an interpolated Witten-Bell bigram: with c the counts of training tokens, T(v) the
number of distinct followers of v, and p(w) = (c(w) + 1) / (N + V + 1),

    p(w | v) = (c(v w) + T(v) p(w)) / (c(v) + T(v)),    or p(w) after an unknown v.

A document's tokens are its words and one end, and the end also stands before its first word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm.common import batch, map_arrow, texts
from tagloom.llm.elias_fano import BigramTrie, restore
from tagloom.llm.hashing import WordHasher, mix, parts, words_of
from tagloom.sources.staging import stage

#: Tokens of a block (one document more at most) and of a shard on average.
BLOCK_TOKENS = 1_000_000
SHARD_TOKENS = 1_500_000
#: Contexts that are spread over all shards, the most frequent ones; a bound of memory only.
MOST_SPREAD = 200_000
END = np.uint64(0x27D4EB2F165667C5)


class _Words:
    """Tokens of texts as 64-bit hashes, each text closed by END."""

    def __init__(self):
        self.hasher = WordHasher(lower=True)

    def many(self, raw: list[str]) -> tuple[np.ndarray, np.ndarray]:
        hashes, sizes = words_of(self.hasher, raw)
        return np.insert(hashes, np.cumsum(sizes), END), sizes + 1


def _blocks(batches, tokens: int):
    """(number, ids, held out, hashes, sizes) of runs of documents with about ``tokens`` tokens."""
    words, number, held = _Words(), 0, []
    count = 0
    for b in batches:
        ids, raw, out = (b.column(k).to_pylist() for k in range(3))
        for part in parts(raw):
            h, sizes = words.many(raw[part])
            held.append((ids[part], out[part], h, sizes))
            count += len(h)
            if count >= tokens:
                yield _joined(number, held)
                number, held, count = number + 1, [], 0
    if held:
        yield _joined(number, held)


def _joined(number, held):
    ids, out = ([x for h in held for x in h[k]] for k in (0, 1))
    name = (TaskContext.get().partitionId() << 32) + number
    return name, ids, np.array(out, bool), np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])


class _Block:
    """The distinct bigrams of a block in the order shard, context, word, and where each token's is."""

    def __init__(self, out: np.ndarray, h: np.ndarray, sizes: np.ndarray, shards: int, spread: np.ndarray):
        word, code = np.unique(h, return_inverse=True)
        end = np.searchsorted(word, END)
        before = np.concatenate([[end], code[:-1]])
        pair, of_pair = np.unique(before * len(word) + code, return_inverse=True)
        training = np.repeat(~out, sizes)
        count = np.bincount(of_pair[training], minlength=len(pair))
        v, w = word[pair // len(word)], word[pair % len(word)]
        spot = np.minimum(np.searchsorted(spread, v), max(0, len(spread) - 1))
        wide = spread[spot] == v if len(spread) else np.zeros(len(v), bool)
        shard = (mix(np.where(wide, v ^ mix(w), v)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((w, v, shard))
        self.shard, self.v, self.w = shard[order], v[order], w[order]
        self.wide, self.count = wide[order], count[order]
        slot = np.empty(len(order), np.int64)
        slot[order] = np.arange(len(order))
        self.slots = slot[of_pair]
        # A context entry is a run of bigrams of one shard and context.
        edge = (np.diff(self.v) != 0) | (np.diff(self.shard) != 0)
        self.entry_start = np.flatnonzero(np.concatenate([[True], edge]))
        self.entry = np.cumsum(np.concatenate([[0], edge.astype(np.int64)]))

    def requests(self):
        """(shard, contexts, followers of each, words, training counts) for every shard asked."""
        cuts = np.flatnonzero(np.diff(self.shard)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(self.shard)]):
            start = self.entry_start[(self.entry_start >= a) & (self.entry_start < b)]
            yield int(self.shard[a]), self.v[start], np.diff(np.append(start, b)), self.w[a:b], self.count[a:b]


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers as one compressed blob; small numbers shrink to almost nothing."""
    head = np.array([len(a) for a in arrays], np.int64)
    raw = b"".join([head.tobytes(), *(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unzip(blob: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    sizes, at, out = raw[: 8 * n].copy().view(np.int64), 8 * n, []
    for size in sizes.tolist():
        out.append(np.ascontiguousarray(raw[at : at + 8 * size].reshape(8, size).T).view(np.uint64).ravel())
        at += 8 * size
    return out


def _frequent(tokens: int):
    """(word, n): the words that make up a noticeable part of a block, and (null, tokens of the block)."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for _, _, _, h, _ in _blocks(batches, tokens):
            word, n = np.unique(h, return_counts=True)
            often = n > max(1, len(h) // 20_000)
            yield batch(schema, word=[None, *word[often].view(np.int64).tolist()], n=[len(h), *n[often].tolist()])

    return run


def _ask(tokens: int, shards: int, spread: np.ndarray):
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("blob", pa.binary())])

    def run(batches):
        for name, _, out, h, sizes in _blocks(batches, tokens):
            for shard, *arrays in _Block(out, h, sizes, shards, spread).requests():
                yield batch(schema, block=[name], shard=[shard], blob=[_zip(*[a.view(np.uint64) if a.dtype != np.uint64 else a for a in arrays])])

    return run


_ANSWER = "block long, shard long, word long, c long, t long, blob binary"
_ANSWER_ARROW = pa.schema([(n, pa.int64()) for n in ("block", "shard", "word", "c", "t")] + [("blob", pa.binary())])


def _answer(spread: np.ndarray):
    """Builds a shard's trie from all requests and answers each; adds totals and parts of spread contexts."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        blocks = table.column("block").to_pylist()
        asked = [_unzip(b, 4) for b in table.column("blob").to_pylist()]
        v = np.concatenate([np.repeat(a[0], a[1].astype(np.int64)) for a in asked])
        w, n = np.concatenate([a[2] for a in asked]), np.concatenate([a[3] for a in asked]).astype(np.int64)
        v, w, n = v[n > 0], w[n > 0], n[n > 0]
        order = np.lexsort((w, v))
        v, w, n = v[order], w[order], n[order]
        new = np.flatnonzero(np.concatenate([[len(v) > 0], (np.diff(v) != 0) | (np.diff(w) != 0)]))
        total = np.add.reduceat(n, new) if len(new) else np.zeros(0, np.int64)
        trie = BigramTrie(BigramTrie.build(v[new], w[new], total))
        contexts = trie.contexts.access(np.arange(trie.contexts.n))
        wide = np.isin(contexts, spread)
        rows = [(-1, shard, None, int(total.sum()), int((~wide).sum()), None)]
        rows += [
            (-2, shard, int(x), int(c), int(t), None)
            for x, c, t in zip(contexts[wide].view(np.int64), trie.totals[wide], trie.followers[wide])
        ]
        for block, (cv, followers, cw, _) in zip(blocks, asked):
            entry = trie.context(cv)
            codes = trie.weights(np.repeat(entry, followers.astype(np.int64)), cw)
            c = np.where(entry >= 0, trie.totals[np.maximum(entry, 0)], 0) if trie.contexts.n else np.zeros(len(cv), np.uint64)
            t = np.where(entry >= 0, trie.followers[np.maximum(entry, 0)], 0) if trie.contexts.n else np.zeros(len(cv), np.uint64)
            rows.append((block, shard, None, len(cw), 0, _zip(c.astype(np.uint64), t.astype(np.uint64), codes.astype(np.uint64))))
        return pa.table([pa.array(list(x), f.type) for x, f in zip(zip(*rows), _ANSWER_ARROW)], schema=_ANSWER_ARROW)

    return run


def _places(tokens: int, shards: int, spread: np.ndarray):
    """One row a block: its documents and, packed, the places of their bigrams among the block's."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("blob", pa.binary())])

    def run(batches):
        for name, ids, out, h, sizes in _blocks(batches, tokens):
            b = _Block(out, h, sizes, shards, spread)
            first = np.cumsum(sizes) - sizes
            order = np.lexsort((b.slots, np.repeat(np.arange(len(sizes)), sizes)))
            slots = b.slots[order]
            steps = np.diff(slots, prepend=0)
            steps[first] = slots[first]
            followers = np.diff(np.append(b.entry_start, len(b.v)))
            # Every word of a block is the context of an entry too.
            words = b.v[b.entry_start]
            by_word = np.argsort(words, kind="stable")
            entry_of_word = by_word[np.searchsorted(words[by_word], b.w)]
            wide = np.flatnonzero(b.wide[b.entry_start])
            arrays = (sizes, steps, followers, entry_of_word, wide, words[wide].view(np.int64))
            yield batch(schema, block=[name], ids=[ids], held_out=[out.tolist()], blob=[_zip(*[a.view(np.uint64) for a in arrays])])

    return run


SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)
_SCORES = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64())]
    + [("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def _score(total: int, vocabulary: int, spread: np.ndarray, spread_c: np.ndarray, spread_t: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for ids, held, blob in zip(*(left.column(n).to_pylist() for n in ("ids", "held_out", "blob"))):
            sizes, steps, followers, entry_of_word, wide, wide_names = (a.view(np.int64) for a in _unzip(blob, 6))
            answers = [_unzip(a, 3) for _, a in sorted(zip(right.column("shard").to_pylist(), right.column("blob").to_pylist()))]
            c, t, codes = (np.concatenate([a[k] for a in answers]).astype(np.float64) for k in range(3))
            if len(codes) != followers.sum() or len(c) != len(followers):
                raise RuntimeError("a block was dealt differently when it asked and when it scored; stage the documents first")
            at = np.searchsorted(spread, wide_names.view(np.uint64))
            c[wide], t[wide] = spread_c[at], spread_t[at]
            base = (c + 1) / (total + vocabulary + 1)
            entry = np.repeat(np.arange(len(followers)), followers)
            p = base[entry_of_word]
            both = c[entry] + t[entry]
            weight = np.minimum(restore(codes), c[entry])  # a rounded count must not pass its context's
            p = np.where(both > 0, (weight + t[entry] * p) / np.maximum(both, 1), p)
            first = np.cumsum(sizes) - sizes
            steps = np.cumsum(steps)
            slots = steps - np.repeat(np.where(first > 0, steps[first - 1], 0), sizes)
            word = entry_of_word[slots]
            out.append(
                batch(
                    _SCORES, doc_id=ids, held_out=held, n_tokens=sizes, n_known=np.add.reduceat((c[word] > 0).astype(np.int64), first),
                    train_tokens=np.full(len(ids), total), base_score=np.add.reduceat(np.log10(base[word]), first),
                    score=np.add.reduceat(np.log10(p[slots]), first),
                )
            )
        return pa.Table.from_batches(out, _SCORES)

    return run


def score_documents(
    docs: DataFrame,
    held_out: Column,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where ``held_out`` (a condition on doc_id) is false. ``base_score`` is the
    add-one unigram score, ``score`` the model's log10 probability of the text. Counts are exact; the
    bigram weights have 16 bits (exact to 32,767, within 0.1 % beyond). Words are compared by 64-bit hashes.

    Shards grow in number with the tokens. A context too frequent for one shard is spread over all of
    them by the following word, and its parts are added up; at most ``MOST_SPREAD`` contexts are. Null and
    empty texts are one end token; repeated rows count and score each; without training rows all
    counts are zero; an empty table gives no rows. Other columns are not read. The documents are read
    several times and must come in the same partitions each time, as files do; other
    frames should be staged first (a difference is an error, not a wrong score).
    """
    context = docs.sparkSession.sparkContext
    read = texts(docs, id_col, text_col).select("doc_id", "text", held_out.alias("held_out"))
    often = map_arrow(read, lambda: _frequent(block_tokens), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    often = stage(often)
    tokens = sum(r.n for r in often.where("word IS NULL").collect())
    shards = max(1, -(-tokens // shard_tokens))
    wide = often.where("word IS NOT NULL").where(F.col("n") >= shard_tokens // 8).orderBy(F.desc("n"), "word").limit(MOST_SPREAD)
    spread = np.sort(np.array([r.word for r in wide.collect()], np.int64).view(np.uint64))
    shared = context.broadcast(spread)

    asked = map_arrow(read, lambda: _ask(block_tokens, shards, shared.value), "block long, shard long, blob binary")

    def answer(table):
        return _answer(shared.value)(table)

    answers = stage(asked.groupBy("shard").applyInArrow(answer, _ANSWER))
    sums = answers.where("block = -1").agg(F.sum("c"), F.sum("t")).first()
    parts = answers.where("block = -2").groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).collect()
    seen = {r.word: (r.c, r.t) for r in parts}
    total, vocabulary = sums[0] or 0, (sums[1] or 0) + len(seen)
    stats = np.array([seen.get(int(x), (0, 0)) for x in spread.view(np.int64)], np.float64).reshape(-1, 2)
    known = context.broadcast((spread, stats[:, 0], stats[:, 1]))

    places = map_arrow(
        read, lambda: _places(block_tokens, shards, shared.value), "block long, ids array<long>, held_out array<boolean>, blob binary"
    )

    def score(left, right):
        return _score(total, vocabulary, *known.value)(left, right)

    replies = answers.where("block >= 0").select("block", "shard", "blob")
    return places.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, SCHEMA)
