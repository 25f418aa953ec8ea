import hashlib
import re

import numpy as np
import pytest

from tagloom.llm import fm_index
from tagloom.llm.fm_index import FMIndex, find_passages, keep_uncontaminated, remove_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def by_hand(docs, items, size=13):
    windows = {}
    for item, text in items:
        if item is None or text is None:
            continue
        w = WORD.findall(text.translate(LOWER))
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lengths, out = {len(k) for k in windows}, []
    for doc, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= names
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def columns(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 500)
    index = FMIndex(text, 4, sample=5)
    patterns = rng.integers(1, 4, (60, 5))
    lengths = rng.integers(1, 6, 60)
    lo, hi = index.search(patterns, lengths)
    for p, n, a, b in zip(patterns, lengths, lo, hi):
        want = [i for i in range(500 - n + 1) if list(text[i : i + n]) == list(p[5 - n :])]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_whole_table(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    assert sum(r[5] for r in want) > 0
    assert columns(find_passages(docs, bench, shard_words=5000)) == want


@pytest.mark.parametrize("block_chars", [50_000_000, 60])
def test_edges(spark, block_chars):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, "Only three words"), (3, None), (None, "x"), (4, "..."), (5, "É ß-9"), (1, "again again")]
    docs = [
        (1, f"Intro. {long}! End", "a"), (2, None, "b"), (3, "", "c"), (4, "only THREE, words", "d"),
        (5, "x " * 3000 + long, "e"), (6, "é ß 9 É ß 9", "f"), (7, "again again again", "g"),
        (8, "only three", None), (None, "only three words", "h"), (9, long[:40], "i"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_passages(df, bench, block_chars=block_chars)
    want = by_hand([d[:2] for d in docs], items)
    if block_chars == 60:  # a null id joins with nothing
        got, want = got.where("doc_id is not null"), [w for w in want if w[0] is not None]
    assert columns(got) == want
    spans = {r.doc_id: r.spans for r in got.collect()}
    assert remove_spans(docs[0][1], spans[1]) == "Intro. ! End"


def test_repeated_rows_and_empty_tables(spark):
    one = [(1, "only three words")] * 3
    df, none = spark.createDataFrame(one, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert len(columns(find_passages(df, spark.createDataFrame([(2, "three words")], none.schema)))) == 3
    assert [r[2] for r in columns(find_passages(df, none))] == [0, 0, 0]
    assert columns(find_passages(df.limit(0), none)) == []


def test_one_block_is_held_at_a_time(spark, monkeypatch):
    held, most, make = [], [], spark.sparkContext.broadcast

    def broadcast(value):
        out = make(value)
        release = out.destroy
        out.destroy = lambda: (held.remove(out), release())
        held.append(out), most.append(len(held))
        return out

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    bench = spark.createDataFrame([(k, f"item number w{k} has these words") for k in range(20)], "item_id long, text string")
    rows = [(k, f"before item number w{k} has these words after " + "x " * 30 * k) for k in range(30)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (3, "other words"), (40, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = columns(find_passages(df, bench, block_chars=100))
    assert len(most) > 3 and max(most) == 1 and not held
    assert got == by_hand(rows, [tuple(r) for r in bench.collect()])
    kept = [sorted(map(tuple, keep_uncontaminated(df, bench, block_chars=n).collect()), key=str) for n in (100, 50_000_000)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < len(rows)


def test_words_of_a_shard_are_all_that_is_held(monkeypatch):
    """A text is split when its shard takes it; what is held never exceeds a shard and one text."""
    live, most, split = [0], [0], fm_index.words

    def words(text):
        out = split(text)
        live[0] += len(out)
        most[0] = max(most[0], live[0])
        return out

    monkeypatch.setattr(fm_index, "words", words)
    rows = [(k, "a b c " * (k % 50)) for k in range(500)]
    seen = []
    for shard in fm_index._shards(iter(rows), 300):
        seen += [row for row, _ in shard]
        live[0] -= sum(len(w) for _, w in shard)
    assert seen == rows and live[0] == 0 and most[0] <= 300 + 150
