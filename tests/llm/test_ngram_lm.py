import math
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tagloom.llm.common import remainder
from tagloom.llm.ngram_lm import score_documents

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = str.maketrans("\t\n\x0b\x0c\r", "     ")


def by_hand(rows):
    tokens = {}
    for k, (doc, text, held) in enumerate(rows):
        tokens[k] = [w for w in (text or "").translate(LOWER).translate(SPACE).split(" ") if w] + ["</s>"]
    one, two, follow = Counter(), Counter(), Counter()
    for k, (_, _, held) in enumerate(rows):
        if not held:
            t = tokens[k]
            one.update(t)
            two.update(zip(["</s>"] + t, t))
    follow.update(v for v, _ in two)
    n, size = sum(one.values()), len(one)
    out = []
    for k, (doc, _, held) in enumerate(rows):
        t, base, score = tokens[k], 0.0, 0.0
        for v, w in zip(["</s>"] + t, t):
            p = (one[w] + 1) / (n + size + 1)
            base += math.log10(p)
            if one[v]:
                p = (two[v, w] + follow[v] * p) / (one[v] + follow[v])
            score += math.log10(p)
        out.append((doc, held, len(t), sum(one[w] > 0 for w in t), n, base, score))
    return sorted(out, key=str)


def check(df, rows, exact_to=32_767):
    got = sorted((tuple(r) for r in df.collect()), key=str)
    want = by_hand(rows)
    assert [g[:5] for g in sorted(got, key=lambda r: str(r[:5]))] == [w[:5] for w in sorted(want, key=lambda r: str(r[:5]))]
    for g, w in zip(sorted(got, key=lambda r: str(r[:5])), sorted(want, key=lambda r: str(r[:5]))):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9, abs=2.5e-4 * (w[2] if exact_to < w[4] else 1e-6))


@pytest.mark.parametrize("block,shard", [(2_000_000, 4_000_000), (20_000, 40_000)])
def test_whole_table(spark, block, shard):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, crc32(str(r.doc_id).encode()) % 7 == 2) for r in docs.collect()]
    df = score_documents(docs, remainder("doc_id", 7) == 2, block, shard)
    check(df, rows)
    held = [r for r in df.collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark, tmp_path):
    rows = [(1, None, False), (2, "", False), (3, "A b\tc", False), (4, "a B c d", True), (5, "x " * 30_000, False), (5, "x " * 30_000, False), (None, "é É", False)]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "doc_id long, text string, out boolean, score int").write.parquet(path)
    df = spark.read.parquet(path)
    check(score_documents(df, F.coalesce(F.col("doc_id") == 4, F.lit(False)), 1000, 2000), rows)
    check(score_documents(df, F.lit(True)), [(a, b, True) for a, b, _ in rows])
    assert score_documents(df.where("doc_id > 99"), F.lit(False)).collect() == []
