import random

import numpy as np
import pytest

from tagloom.llm import jaccard_join
from tagloom.llm.components import components
from tagloom.llm.jaccard_join import jaccard_groups

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = [x for x in (text or "").translate(LOWER).replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def by_hand(rows, size=4, percent=85):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    return sorted((i, len(s), find(i)) for i, s in sets)


def columns(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def test_components(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(1, 5), (5, 1), (7, 5), (9, 9), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {1: 1, 5: 1, 7: 1}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = by_hand(rows)
    assert len({w[2] for w in want}) < len(rows)
    assert columns(jaccard_groups(docs)) == want


def edited(rng, n_groups, copies, words=40):
    rows = []
    for g in range(n_groups):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 60)) for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = str(rng.randint(0, 999))
            rows.append((len(rows), " ".join(w[: rng.choice([words, words, words - 2])])))
    return rows


@pytest.mark.parametrize("size,percent,block", [(4, 85, 20_000), (5, 80, 3), (2, 60, 5)])
def test_edited_copies(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(size)
    shared = " ".join(f"common{k}" for k in range(12))
    rows = edited(rng, 12, 10) + [(1000 + k, f"{shared} {rng.randint(0, 9)} tail{k} x") for k in range(40)]
    assert columns(jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), size, percent)) == by_hand(rows, size, percent)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two\t"), (8, "a b c d"), (8, "a b c d"), (9, "x y z " * 20_000), (10, "x y z " * 20_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, component_id int, class int")
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (8, 1, 8), (8, 1, 8), (9, 3, 9), (10, 3, 9)]
    assert columns(jaccard_groups(df)) == want
    assert jaccard_groups(df.limit(0)).collect() == []
    null = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_groups(null).collect()} == {None: None, 3: 3}


@pytest.mark.parametrize("followers,most_ids", [(3, 20_000_000), (1, 0)])
def test_blocks_of_followers_and_filters(spark, monkeypatch, followers, most_ids):
    monkeypatch.setattr(jaccard_join, "FOLLOWERS", followers)
    monkeypatch.setattr(jaccard_join, "MOST_IDS", most_ids)
    rows = edited(random.Random(9), 8, 12)
    repeated = rows + rows[:30]
    assert columns(jaccard_groups(spark.createDataFrame(repeated, "doc_id long, text string"))) == sorted(
        r for r in by_hand(rows) for _ in range(2 if r[0] < 30 else 1)
    )


def test_filter_holds_its_ids(spark):
    ids = [(k * 7919 - 3_000_000,) for k in range(5000)]
    made = jaccard_join._filter_of(spark.createDataFrame(ids, "id long"))
    assert made.holds(np.array(ids, np.int64).ravel()).all()
    others = np.arange(10**12, 10**12 + 20_000)
    assert made.holds(others).mean() < 0.05
    empty = jaccard_join._filter_of(spark.createDataFrame([], "id long"))
    assert not empty.holds(others).any()


def test_maps_of_different_widths():
    """What the maps keep apart is never more than what the sets do, and large sets are told apart."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 300, 500, 513, 700, 1100, 2047, 2049, 9000)]
    sets[3] = np.unique(np.concatenate([sets[2], sets[3][:13]]))
    maps = jaccard_join.BitMaps(jaccard_join._maps(sets))
    a, b = np.triu_indices(len(sets), 1)
    only_a, only_b = maps.apart(a, b)
    for x, y, n, m in zip(a, b, only_a, only_b):
        assert n <= len(np.setdiff1d(sets[x], sets[y])) and m <= len(np.setdiff1d(sets[y], sets[x]))
    pair = (a == 7) & (b == 8)
    assert only_b[pair] > 2000 and only_b[(a == 2) & (b == 3)] <= 13
