import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tagloom.llm import spelling
from tagloom.llm.queries import QUERIES
from tagloom.llm.spelling import SortedList, Words, near_words, spelling_variants, variants

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def neighbours(vocabulary):
    """Pairs one edit apart, by words that are equal once a letter is left out."""
    holes = {}
    for w in vocabulary:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1 :]), []).append(w)
    near = {w: set() for w in vocabulary}
    for w in vocabulary:
        for k in range(len(w)):
            near[w].update(x for x in holes[w[:k], w[k + 1 :]] if x != w)
            shorter = w[:k] + w[k + 1 :]
            if shorter in near:
                near[w].add(shorter), near[shorter].add(w)
    return near


def by_hand(counts, ratio=2):
    near, form = neighbours(counts), {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), counts.get(form[w], 0)) for w, n in counts.items())


def columns(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def words_of(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if n >= 3 and len(w) >= 5}


@pytest.mark.parametrize("letters,most,cells", [("ab", 6, 100), ("abc", 9, 6_000_000), ("aé\U0001f600", 7, 1000), ("a", 30, 500)])
def test_scan(monkeypatch, letters, most, cells):
    monkeypatch.setattr(spelling, "CELLS", cells)
    rng = random.Random(most)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(300)})
    listed, asked = SortedList(words), Words(words)
    n = len(words)
    q, k = near_words(listed, asked, np.zeros(n, np.int64), np.full(n, n), np.zeros(n, np.int64))
    near = neighbours(words)
    assert sorted((words[a], words[b]) for a, b in zip(q, k)) == sorted((w, x) for w in words for x in near[w])


def test_may_hold():
    rng = random.Random(3)
    some = lambda n: ["".join(rng.choice("ab") for _ in range(rng.randint(0, n))) for _ in range(400)]
    prefixes, words = some(5), some(6)

    def least_row(p, w):
        row = list(range(len(w) + 1))
        for i, c in enumerate(p, 1):
            new = [i]
            for j, x in enumerate(w, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
            row = new
        return min(row)

    i = np.arange(400)
    got = spelling._may_hold(Words(prefixes), i, Words(words), i).tolist()
    assert got == [least_row(p, w) <= 1 for p, w in zip(prefixes, words)]


def test_whole_table(spark, monkeypatch):
    want = by_hand(words_of([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]))
    assert sum(r[4] > 0 for r in want) > 1000 and any(r[1] and r[1] != r[2] for r in want)
    for block in (20_000, 700):
        monkeypatch.setattr(spelling, "BLOCK", block)
        assert columns(QUERIES["op11_spelling_variants"](spark, SF)) == want


def test_crowded_vocabulary(spark, monkeypatch):
    """A third of the words share their first half, in many blocks; short words and ties as well."""
    monkeypatch.setattr(spelling, "BLOCK", 40)
    rng = random.Random(5)
    counts = {"prefix" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 6))): rng.randint(1, 40) for _ in range(400)}
    counts |= {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): rng.randint(1, 5) for _ in range(400)}
    df = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, form int")
    assert columns(variants(df)) == by_hand(counts)
    assert columns(variants(df, ratio=5)) == by_hand(counts, 5)
    with pytest.raises(ValueError):
        variants(df, ratio=1)


def test_long_chain(spark):
    counts = {"abcdefghij"[:k] + "z" * (24 - k): 3 * 2**k for k in range(11)}
    assert columns(variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == by_hand(counts)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "Hello hello HELLO hallo"), (3, "Hello hello HELLO hallo"), (None, "hallo Ünter Ünter Ünter ünter " * 2)]
    rows += [(4, "İstanbul İstanbul İstanbul Kelvin Kelvin Kelvin x×y÷z x×y÷z x×y÷z"), (5, "w" * 30_000 + " ")] + [(6, "w" * 29_999)] * 3 + [(7, "w" * 30_000)] * 2
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, word int, n int")
    plain = Counter(w for _, t in rows for w in (x.translate(LOWER) for x in re.findall("[A-Za-zÀ-ÿ]+", t or "")))
    want = by_hand({w: n for w, n in plain.items() if n >= 3 and len(w) >= 5})
    assert columns(spelling_variants(df)) == want and any(len(w) > 29_000 and r[4] for r in want for w in r[:1])
    assert spelling_variants(df.limit(0)).collect() == []
