import numpy as np
from pyspark.sql import functions as F

from tagloom.llm.common import remainder
from tagloom.llm.compression_quality import CompressionModel, fit, logistic, score

SF = "/root/testdata/sf0.1"


def test_logistic_separates():
    x = np.random.default_rng(0).normal(size=(400, 2))
    y = (x[:, 0] > 0).astype(float)
    w = logistic(x, y)
    assert ((x @ w[1:] + w[0] > 0) == (y > 0)).mean() > 0.98


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = remainder("doc_id", 3) == 1
    scored = score(docs, fit(docs, labels, ~held, per_class=600), held)
    assert scored.count() == docs.count()
    both = scored.where("held_out").join(labels.where("quality is not null"), "doc_id").collect()
    good = [r.score for r in both if r.quality == 1]
    bad = [r.score for r in both if r.quality == 0]
    assert len(bad) > 100 and all(0 <= s <= 1 for s in good + bad)
    assert np.mean([r.predicted == r.quality for r in both]) > 0.95
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "plain words here"), (4, "%% && ## " * 60_000), (4, "%% && ## " * 60_000), (None, "x")]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (9, 1, None), (3, None, 1)], "doc_id long, quality int, toxic int")
    everywhere = F.lit(True)
    out = score(df, fit(df, labels, everywhere, per_class=5), F.lit(False)).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    model = fit(df, labels.limit(0), everywhere)
    assert {r.score for r in score(df, model, F.lit(False)).collect()} == {0.5}
    assert score(df.limit(0), model, F.lit(False)).collect() == []
    assert isinstance(fit(df.limit(0), labels, everywhere), CompressionModel)
