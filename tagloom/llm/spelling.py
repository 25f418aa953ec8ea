"""Spelling variants: words one edit apart, by dynamic programming along the sorted vocabulary.

A word of m or m + 1 letters and its near word of m letters agree in their first m // 2 letters or in their last
ones. So the sorted list is searched twice, once as it is and once with all words reversed, and each word
only where the list has the beginning it must share. The search runs down the list with a stack of edit matrix rows
(the band of three cells that one edit can reach): the rows of the prefix that a list word shares with the one before
it are kept, and once a row's cells all exceed one edit, the list words with that prefix are skipped. Many words
are searched side by side, each with its own stack.

The list is cut into blocks by a range sort; a block's first and last word say which words may have near words in
it, and those are sent there. Words and blocks are rows of Spark tables; only the blocks' bounds are broadcast.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm.common import batch, map_arrow, texts
from tagloom.sources.staging import stage

#: Words of one block of the sorted list, about; the bounds of all blocks are a 20,000th of the vocabulary.
BLOCK = 20_000
#: Cells of the stacks of rows held at a time.
CELLS = 6_000_000
LETTERS = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Words:
    """Words as code points laid end to end."""

    def __init__(self, words: list[str]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size
        # One zero more, so that a place just behind the last word can be read.
        self.codes = np.frombuffer("".join([*words, "\0"]).encode("utf-32-le", "surrogatepass"), np.uint32)

    def letter(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The letter at place ``at``, 0 outside the word."""
        inside = (at >= 0) & (at < self.size[word])
        return np.where(inside, self.codes[np.where(inside, self.start[word] + at, 0)], 0)


def common_prefixes(a: Words, i: np.ndarray, b: Words, j: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """How many first letters words ``i`` of ``a`` and ``j`` of ``b`` share (counted up to ``most``)."""
    limit = np.minimum(a.size[i], b.size[j])
    if most is not None:
        limit = np.minimum(limit, most)
    out, open_ = np.zeros(len(i), np.int64), np.flatnonzero(limit > 0)
    while len(open_):
        at = out[open_]
        same = a.codes[a.start[i[open_]] + at] == b.codes[b.start[j[open_]] + at]
        open_ = open_[same]
        out[open_] += 1
        open_ = open_[out[open_] < limit[open_]]
    return out


class SortedList:
    """A sorted list of words with the prefixes neighbours share and, for each, the next shorter one."""

    def __init__(self, words: list[str]):
        self.words, n = Words(words), len(words)
        self.lcp = np.zeros(n + 1, np.int64)
        self.lcp[1:n] = common_prefixes(self.words, np.arange(n - 1), self.words, np.arange(1, n))
        self.lcp[n] = -1
        self.shorter = np.arange(1, n + 2)
        todo = np.arange(1, n)
        while len(todo):
            todo = todo[self.lcp[self.shorter[todo]] >= self.lcp[todo]]
            self.shorter[todo] = self.shorter[self.shorter[todo]]

    def behind(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The next word that does not share the first ``depth`` letters of the word at ``at``."""
        out = at + 1
        todo = np.flatnonzero(self.lcp[out] >= depth)
        while len(todo):
            out[todo] = self.shorter[out[todo]]
            todo = todo[self.lcp[out[todo]] >= depth[todo]]
        return out


def near_words(listed: SortedList, asked: Words, low: np.ndarray, high: np.ndarray, shared: np.ndarray):
    """(asked, listed) numbers of words exactly one edit apart.

    Word k is searched among the list words from ``low[k]`` to ``high[k]``, all of which have its first
    ``shared[k]`` letters.
    """
    order = np.argsort(asked.size, kind="stable")
    order = order[low[order] < high[order]]
    found, at = [np.zeros((2, 0), np.int64)], 0
    while at < len(order):
        widths = asked.size[order[at : at + CELLS]] + 3
        to = at + max(1, int(np.searchsorted(np.arange(1, len(widths) + 1) * widths, CELLS // 3, side="right")))
        some = order[at:to]
        found.append(_scan(listed, asked, some, low[some], high[some], shared[some]))
        at = to
    return np.concatenate(found, axis=1)


def _scan(listed: SortedList, asked: Words, query: np.ndarray, low: np.ndarray, high: np.ndarray, shared: np.ndarray) -> np.ndarray:
    words, size = listed.words, asked.size[query]
    # rows[k, d]: edits that turn the first d letters of the list word into the first d - 1, d, d + 1 of word k.
    rows = np.full((len(query), int(size.max()) + 3, 3), 2, np.uint8)
    rows[np.arange(len(query)), shared] = (1, 0, 1)
    rows[shared == 0, 0, 0] = 2
    live, at, depth, out = np.arange(len(query)), low.copy(), shared.copy(), [np.zeros((2, 0), np.int64)]
    while len(live):
        # A list word may end at the depth it shares with the one before or begin with; then its row is there.
        ended = words.size[at] == depth
        q, d, n = query[live], depth, size[live]
        letter = words.letter(at, d)
        left, mid, right = rows[live, d].T
        a = np.minimum(mid + 1, left + (letter != asked.letter(q, d - 1)))
        b = np.minimum(np.minimum(mid + (letter != asked.letter(q, d)), right + 1), a + 1)
        c = np.minimum(right + (letter != asked.letter(q, d + 1)), b + 1)
        # Cells beyond the asked word's end.
        b, c, a = np.where(d + 1 > n, 2, b), np.where(d + 2 > n, 2, c), np.where(d > n, 2, a)
        step = ~ended
        s, e = live[step], d[step] + 1
        rows[s, e, 0], rows[s, e, 1], rows[s, e, 2] = np.minimum(a[step], 2), np.minimum(b[step], 2), np.minimum(c[step], 2)
        depth = d + step
        row = rows[live, depth]
        ended = words.size[at] == depth
        # The cell of the whole asked word: n - depth is -1, 0 or 1 when it is in the band.
        cell = n - depth + 1
        inside = ended & (cell >= 0) & (cell <= 2)
        edits = np.where(inside, row[np.arange(len(row)), np.clip(cell, 0, 2)], 2)
        hit = edits == 1
        out.append(np.stack([q[hit], at[hit]]))
        # A word that goes on with a live row is followed; else the next word is taken up where it parts from this one.
        dead = row.min(axis=1) > 1
        move = ended | dead
        m = np.flatnonzero(move)
        ahead = listed.behind(at[m], np.where(dead[m], depth[m], words.size[at[m]] + 1))
        at[m] = ahead
        depth[m] = np.minimum(np.maximum(listed.lcp[ahead], 0), depth[m])
        left_over = at < high[live]
        if not left_over.all():
            live, at, depth = live[left_over], at[left_over], depth[left_over]
    return np.concatenate(out, axis=1)


def _shared(sizes: np.ndarray, back: bool) -> np.ndarray:
    """The letters that every near word of a word must share in this list: half of the shorter one's."""
    return np.maximum(sizes - 1, 0) // 2 + (np.maximum(sizes - 1, 0) % 2 if back else 0)


def _below(prefix: str) -> str:
    """A text that sorts behind all words with the prefix (as code points; none is larger than this letter)."""
    return prefix + "\U0010ffff"


def _send(bounds: list[tuple[int, str, str]], back: bool):
    """(block, kind, word, n): every listed word in its own block (kind 0) and where it must ask (kind 1)."""
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
    first, last = [f for _, f, _ in bounds], [x for _, _, x in bounds]
    numbers = [b for b, _, _ in bounds]
    # The prefix all words of a block share.
    common = Words([_common(f, x) for f, x in zip(first, last)])

    def run(batches):
        for b in batches:
            own, words, ns = (c.to_pylist() for c in b.columns)
            halves = _shared(np.fromiter(map(len, words), np.int64, len(words)), back).tolist()
            ask, where = [], []
            for k, (w, h) in enumerate(zip(words, halves)):
                lo, hi = bisect_left(last, w[:h]), bisect_right(first, _below(w[:h]))
                ask += [k] * (hi - lo)
                where += range(lo, hi)
            ask, where = np.array(ask, np.int64), np.array(where, np.int64)
            ok = _may_hold(common, where, Words(words), ask)
            ask, where = ask[ok].tolist(), where[ok].tolist()
            yield batch(
                schema, block=own + [numbers[x] for x in where], kind=[0] * len(own) + [1] * len(ask),
                word=words + [words[k] for k in ask], n=ns + [ns[k] for k in ask],
            )

    return run


def _common(a: str, b: str) -> str:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def _may_hold(prefixes: Words, i: np.ndarray, asked: Words, j: np.ndarray) -> np.ndarray:
    """Whether a word with prefix i can be at most one edit from word j: some row cell of the prefix is at most one."""
    out = np.ones(len(i), bool)
    size = prefixes.size[i]
    same = common_prefixes(prefixes, i, asked, j)
    todo = np.flatnonzero(same < size)
    p, q, at = i[todo], j[todo], same[todo]
    # One edit at the first difference (replaced, inserted, deleted); the rest must agree as far as both reach.
    out[todo] = False
    for skip_p, skip_q in ((1, 1), (1, 0), (0, 1)):
        left, right = at + skip_p, at + skip_q
        good, step = np.ones(len(todo), bool), 0
        while True:
            x, y = left + step, right + step
            both = good & (x < size[todo]) & (y < asked.size[q])
            if not both.any():
                break
            good &= ~both | (prefixes.letter(p, x) == asked.letter(q, y))
            step += 1
        # The word may end before the prefix does only by the one edit that was spent or by none left to spend.
        over = (size[todo] - left) - (asked.size[q] - right)
        out[todo] |= good & (over <= 0)
    return out


def _search(back: bool):
    """From sorted rows (block, kind, word, n): (word, n_near, best, n) of every asked word with near words there."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])

    def answer(words: list[str], counts: np.ndarray, listed: SortedList, questions: list[str]):
        asked = Words(questions)
        shared = _shared(asked.size, back)
        heads = [w[:h] for w, h in zip(questions, shared.tolist())]
        low = np.array([bisect_left(words, h) for h in heads], np.int64)
        high = np.array([bisect_right(words, _below(h)) for h in heads], np.int64)
        q, k = near_words(listed, asked, low, high, shared)
        # Each pair counts in one of the lists: here if half of the shorter word is shared from this side.
        shorter = np.minimum(asked.size[q], listed.words.size[k])
        if back:
            ends = [w[::-1] for w in questions], [w[::-1] for w in words]
            half = shorter // 2
            mine = common_prefixes(Words(ends[0]), q, Words(ends[1]), k, half) < half
        else:
            mine = common_prefixes(asked, q, listed.words, k, shorter // 2) >= shorter // 2
        q, k = q[mine], k[mine]
        n = counts[k]
        # The most frequent first; among equals the smallest word as it is read.
        tie = np.argsort(np.argsort(np.array([w[::-1] for w in words], object), kind="stable")) if back else np.arange(len(words))
        order = np.lexsort((tie[k], -n, q))
        q, k, n = q[order], k[order], n[order]
        head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate([head, [len(q)]]))
        turn = (lambda w: w[::-1]) if back else (lambda w: w)
        return batch(
            schema, word=[turn(questions[x]) for x in q[head].tolist()], n_near=sizes,
            best=[turn(words[x]) for x in k[head].tolist()], best_n=n[head],
        )

    def run(batches):
        block, words, counts, listed, open_ = None, [], [], None, []

        def flush():
            nonlocal listed, counts
            if listed is None:
                listed, counts = SortedList(words), np.array(counts, np.int64)
            out = answer(words, counts, listed, open_)
            open_.clear()
            return out

        for b in batches:
            for at, kind, word, n in zip(*(c.to_pylist() for c in b.columns)):
                if at != block:
                    if open_:
                        yield flush()
                    block, words, counts, listed = at, [], [], None
                if kind == 0:
                    words.append(word), counts.append(n)
                else:
                    open_.append(word)
                    if len(open_) >= BLOCK:
                        yield flush()
        if open_:
            yield flush()

    return run


def _near(vocabulary: DataFrame, back: bool) -> DataFrame:
    """(word, n_near, best, best_n) from one of the two lists; words without near words give no row."""
    words = vocabulary.select(F.reverse("word").alias("word") if back else F.col("word"), "n")
    count = words.count()
    if not count:
        return vocabulary.sparkSession.createDataFrame([], "word string, n_near long, best string, best_n long")
    listed = words.repartitionByRange(-(-count // BLOCK), "word").select(F.spark_partition_id().cast("long").alias("block"), "word", "n")
    listed = stage(listed)
    bounds = listed.groupBy("block").agg(F.min("word").alias("first"), F.max("word").alias("last")).orderBy("first").collect()
    bounds = vocabulary.sparkSession.sparkContext.broadcast([tuple(r) for r in bounds])
    sent = map_arrow(listed, lambda: _send(bounds.value, back), "block long, kind int, word string, n long")
    dealt = sent.repartition(len(bounds.value), "block").sortWithinPartitions("block", "kind", "word")
    return map_arrow(dealt, lambda: _search(back), "word string, n_near long, best string, best_n long")


def variants(vocabulary: DataFrame, ratio: int = 2, most_rounds: int = 64) -> DataFrame:
    """Groups a vocabulary (word, n; words distinct) by near words: word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point; n_near counts them. ``form`` is the
    near word of largest n (ties: the smallest) if its n is at least ``ratio`` (two or more) times the word's, else
    null; ``root`` is reached by following forms. Chains at least double n at every step; they are followed in rounds
    that each double the distance, each written to the shared folder.

    A null word is dropped; an empty vocabulary gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms must be at least twice as frequent, or chains need not end")
    vocabulary = stage(vocabulary.select("word", F.col("n").cast("long").alias("n")).where(F.col("word").isNotNull()))
    both = _near(vocabulary, False).unionAll(_near(vocabulary, True))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    near = both.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    joined = vocabulary.join(near, "word", "left")
    is_form = -F.col("best.n") >= ratio * F.col("n")
    found = stage(
        joined.select(
            "word", F.when(is_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, -F.col("best.n")).alias("form_n"),
        )
    )
    # Words with a form point to it; a word without one is its own root and ends a chain.
    chains = found.where("form IS NOT NULL").select("word", F.col("form").alias("up"))
    for _ in range(most_rounds):
        further = chains.select(F.col("word").alias("via"), F.col("up").alias("beyond"))
        longer = stage(chains.join(further, F.col("up") == F.col("via"), "left").select("word", F.coalesce("beyond", "up").alias("up"), "beyond"))
        chains = longer.select("word", "up")
        if not longer.where("beyond IS NOT NULL").limit(1).count():
            break
    root = chains.select("word", F.col("up").alias("root"))
    return found.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary_of(
    docs: DataFrame, change=None, least_letters: int = 5, least: int = 3, letters: str = LETTERS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, n): the runs of ``letters`` in all texts, A-Z lower-cased, that occur ``least`` times and are long enough.

    ``change(doc_id, run)`` may turn a run into another word first, as column expressions. Runs are counted in the
    task that reads them before anything is shuffled.
    """
    # The quick lower-casing does for texts in which A-Z are the only letters that it changes.
    others = F.col("text").rlike(r"[^\x00-\xBF\xDF-\xFF]")
    low = F.when(others, F.translate("text", _UPPER, _LOWER)).otherwise(F.lower("text"))
    runs = texts(docs, id_col, text_col).select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(letters), F.lit(0))).alias("run"))
    word: Column = change(F.col("doc_id"), F.col("run")) if change else F.col("run")
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= least_letters) & (F.col("n") >= least))


def spelling_variants(docs: DataFrame, change=None, ratio: int = 2, **vocabulary) -> DataFrame:
    """One row per word of the documents' vocabulary: word, form, root, n, n_near, form_n (see ``variants``).

    Null and empty texts have no words; repeated rows count again; null ids are texts to ``change`` as empty;
    an empty table gives no rows; other columns are not read.
    """
    return variants(vocabulary_of(docs, change, **vocabulary), ratio)
