import os

import pytest

import __spark_entry__
import corpus_pipeline
from tagloom.llm.common import remainder
from tagloom.llm import toxicity
from test_fm_index import by_hand as contaminated_by_hand
from test_jaccard_join import by_hand as groups_by_hand
from test_line_templates import by_hand as lines_by_hand
from test_packing import check as check_packing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before and after each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = os.path.join(tmp_path_factory.mktemp("stages"), name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]


def test_stages_keep_the_columns(steps):
    for before, after in steps[:-1]:
        assert after.dtypes == before.dtypes
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "packing"]
    assert "pipeline" in __spark_entry__.queries()


def test_toxicity(spark, steps):
    before, after = steps[0]
    held = remainder("doc_id", 5) == 0
    scored = toxicity.score(before, toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"), ~held), held)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scored.where("predicted = 0").collect()}
    assert 0 < after.count() < before.count()


def test_lines(steps):
    before, after = (pairs(x) for x in steps[1])
    dropped, want = lines_by_hand(before), []
    for doc, text in before:
        lines = text.split("\n")
        kept = "\n".join(x for k, x in enumerate(lines) if (doc, k) not in dropped)
        if kept == text or kept.split():
            want.append((doc, kept))
    assert after == want and dropped
    assert all(r.n_chars == len(r.text) for r in steps[1][1].collect())


def test_copies(steps):
    before, after = (pairs(x) for x in steps[2])
    keep = {doc for doc, _, group in groups_by_hand(before, 5, 80) if doc == group}
    assert after == [r for r in before if r[0] in keep]


def test_benchmark(spark, steps):
    before, after = (pairs(x) for x in steps[3])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated_by_hand(before, items) if r[5]}
    assert after == [r for r in before if r[0] not in bad] and bad


def test_packing(steps):
    check_packing(steps[4][1].collect(), pairs(steps[4][0]), 2048)


def test_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = "word " * 50_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words without an id", "en", "s", 3), (4, long, "en", "s", 3), (5, long, "en", "s", 3), (5, long, "en", "s", 3)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, SF)
            assert after.dtypes == docs.dtypes
            docs = spark.createDataFrame(after.collect(), schema)
        assert docs.count() == (4 if n else 0)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert len({r.doc_id for r in packed}) == (4 if n else 0)
