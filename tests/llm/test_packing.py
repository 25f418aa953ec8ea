import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tagloom.llm.packing import WordwiseEncoder, pack, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def plain(texts):
    t = Tokenizer.from_file(PATH)
    return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def check(rows, docs, capacity):
    """Every id of every document lies in exactly one piece; sequences have no gaps or overflow."""
    want = [b + np.array([1], "<u4").tobytes() for b in plain([t or "" for _, t in docs])]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for (doc, _), ids in zip(docs, want):
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and {r.sequence_tokens for r in pieces} == {at}


def test_encoder_equals_the_library(spark):
    odd = ["", " ", "a  b", "a \n b", "x\n y", "x\n  y", " lead", "tail ", "a <|endoftext|> b", "<|endoftext|>", "é 　 z", "it's I'LL 12 3", "a  b"]
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for encoder in (WordwiseEncoder(PATH), WordwiseEncoder(PATH, remembered=50)):
        for texts in (odd + docs, docs[:3], docs):
            assert [x.tobytes() for x in encoder.encode(texts)] == plain(texts)


@pytest.mark.parametrize("lengths", [[], [1], [2048], [2049, 2047], [5000, 1, 1, 1], [1500] * 7, list(range(1, 300))])
def test_pack_fills_sequences(lengths):
    pieces = pack(lengths, 2048, 1.0, 0.01)
    assert sum(p[2] for p in pieces) == sum(lengths)
    used = {p[3] for p in pieces}
    assert len(used) == -(-sum(lengths) // 2048) or len(used) <= sum(n // 2048 + 1 for n in lengths)
    assert len(used) <= sum(n // 2048 for n in lengths) - (-sum(n % 2048 for n in lengths) // 2048)


def test_costs_are_balanced():
    lengths = np.random.default_rng(3).integers(20, 900, 4000).tolist()
    cost = defaultdict(float)
    for _, _, n, s, _ in pack(lengths, 2048, 6144.0, 1.0):
        cost[s] += 6144.0 * n + n * n
    values = np.array(list(cost.values()))
    assert np.percentile(values, 95) < 1.1 * np.percentile(values, 5)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pack_documents(docs, PATH).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    sequences = {r.sequence_id: r.sequence_tokens for r in rows}
    parts = len({s >> 40 for s in sequences})
    assert sum(2048 - n for n in sequences.values()) < 2048 * parts


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "long word " * 30_000), (4, "tie one"), (5, "tie one"), (None, "x")]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, length int, sequence_id string")
    check(pack_documents(df, PATH, capacity=256).collect(), docs, 256)
    assert pack_documents(df.limit(0), PATH).collect() == []
    twice = spark.createDataFrame([(1, "same row")] * 2, "doc_id long, text string")
    assert len(pack_documents(twice, PATH).collect()) == 2
