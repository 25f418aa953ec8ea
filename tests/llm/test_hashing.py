import numpy as np
import pytest

from tagloom.llm import hashing
from tagloom.llm.hashing import WordHasher, words_of

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("segment", [2_000_000, 50])
def test_equal_words_have_equal_hashes(spark, monkeypatch, segment):
    monkeypatch.setattr(hashing, "SEGMENT", segment)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect()]
    texts += ["", " ", "one", "\tTwo\x0bthree\x0c\r", "É é", "x" * 300_000, "aa a aaa aaaa"]
    hashes, sizes = words_of(WordHasher(lower=True), texts)
    split = [t.encode().lower().split() for t in texts]
    assert sizes.tolist() == [len(s) for s in split]
    words = [w for s in split for w in s]
    seen = dict(zip(words, hashes.tolist()))
    assert [seen[w] for w in words] == hashes.tolist()
    assert len(set(seen.values())) == len(seen)


def test_case_and_nothing():
    a, _ = words_of(WordHasher(lower=False), ["Abc abc"])
    assert a[0] != a[1]
    none, sizes = words_of(WordHasher(lower=True), [])
    assert len(none) == len(sizes) == 0
