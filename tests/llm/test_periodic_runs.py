import hashlib
import random
import zlib

import numpy as np
import pytest

from tagloom.llm.periodic_runs import SuffixArray, find_runs, runs_of
from tagloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def split(text):
    return (text or "").encode().split()


def naive_runs(words, least, times):
    """Every period on its own: maximal stretches in which words a period apart agree."""
    found = {}
    for p in range(1, len(words) // times + 1):
        k = 0
        while k + p < len(words):
            if words[k] != words[k + p]:
                k += 1
                continue
            start = k
            while k + p < len(words) and words[k] == words[k + p]:
                k += 1
            if k + p - start >= max(least, times * p):
                found.setdefault((start, k + p), p)
    return sorted((s, e, p) for (s, e), p in found.items())


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(doc_id, words, least=24, times=3):
    found = naive_runs(words, least, times)
    drop = {k for s, e, p in found for k in range(s + p, e)}
    best = (None,) * 4
    if found:
        from fractions import Fraction

        s, e, p = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]))
        best = (s, e - s, p, 1000 * (e - s) // p)
    lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in found)
    text = b" ".join(w for k, w in enumerate(words) if k not in drop)
    return (doc_id, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


def test_suffix_array():
    rng = np.random.default_rng(1)
    symbols = np.concatenate([rng.integers(0, 2, 60), [100], np.zeros(40, int), [101]])
    sa, flat = SuffixArray(symbols), symbols.tolist()
    assert sa.order.tolist() == sorted(range(len(flat)), key=lambda k: flat[k:])

    def common(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    order = sa.order.tolist()
    assert sa.lcp[1:-1].tolist() == [common(flat[a:], flat[b:]) for a, b in zip(order, order[1:])]
    a, b = np.array([5, 70, 61]), np.array([20, 90, 80])
    assert sa.common_before(a, b).tolist() == [common(flat[:x][::-1], flat[:y][::-1]) for x, y in zip(a, b)]


@pytest.mark.parametrize("least,times,letters", [(2, 2, 2), (4, 2, 3), (6, 3, 2), (24, 3, 2)])
def test_random_words(least, times, letters):
    rng = random.Random(least)
    for _ in range(150):
        lists = []
        for _ in range(rng.randint(1, 5)):
            words = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
            for _ in range(rng.randint(0, 2)):
                unit = [rng.randrange(letters + 2) for _ in range(rng.randint(1, 9))]
                words += (unit * rng.randint(1, 8))[: rng.randint(1, 40)]
            lists.append(words)
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = np.array([w for x in lists for w in x], np.int64)
        want, at = [], 0
        for x in lists:
            want += [[s + at, e + at, p] for s, e, p in naive_runs(x, least, times)]
            at += len(x)
        assert runs_of(owner, flat, least, times).tolist() == want


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(digest(r.doc_id, planted(r.doc_id, split(r.text))) for r in docs.collect())
    got = sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect())
    assert got == want
    assert sum(r[1] for r in want) > 50


def test_edges(spark):
    long = "a " * 200_000
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "x y " * 13), (4, "x y " * 13), (5, "x y " * 11), (None, long), (6, "é b " * 30)]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, runs int, n_words int")
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.text) for r in find_runs(df).collect()))
    assert got == [
        (0, 200_000, [(0, 200_000, 1)], "a"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 26, [(0, 26, 2)], "x y"),
        (4, 26, [(0, 26, 2)], "x y"), (5, 22, [], " ".join(["x y"] * 11)), (6, 30, [(0, 30, 1)], "é b"),
    ]
    assert find_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        find_runs(df, times=1)
