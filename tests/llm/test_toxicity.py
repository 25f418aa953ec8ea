import random

import numpy as np
from pyspark.sql import functions as F

from tagloom.llm.common import remainder
from tagloom.llm.toxicity import LexiconAutomaton, ToxicityFeatures, allowed_edits, fit, learn_lexicon, score

SF = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def by_hand(token, entries):
    hits = []
    for e in entries:
        word = e.removesuffix("*")
        ends = range(len(token) + 1) if e.endswith("*") else [len(token)]
        d = min(distance(token[:n], word) for n in ends)
        if d <= allowed_edits(e):
            hits.append((d, e))
    return min(hits, default=None)


def test_automaton_equals_edit_distances():
    entries = ["idiot", "moron", "scum", "disgusting", "mor*", "disgus*", "pathetics*", "stupid", "stupor"]
    rng = random.Random(2)
    automaton = LexiconAutomaton(entries)
    for _ in range(4000):
        word = list(rng.choice(entries).removesuffix("*"))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(word))
            word[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "o", "s", "1"])
        token = "".join(word) + rng.choice(["", "", "ing", "s"])
        got, want = automaton.match(token), by_hand(token, entries)
        assert (got and got[0]) == (want and want[0]), token


def test_context_and_misspellings():
    f = ToxicityFeatures(["idiot", "moron"])
    plain, quoted, direct, odd, none = f.many(
        ["a real idiot here", 'he said "idiot" aloud', "you are an idiot", "an id1ot and a m*ron, idot!", "nothing"]
    )
    assert plain == (1, 0, 0, 0, 4) and quoted[2] == 1 and direct[3] == 1
    assert odd[:2] == (0, 3) and none == (0, 0, 0, 0, 1)


def test_lexicon_takes_stems_and_words():
    toxic = [f"ab cd {w}" for w in ["idiot", "gruma", "grumbe", "grumce", "grumde"] * 10]
    assert set(learn_lexicon(toxic, ["ab cd ef"] * 50)) == {"idiot", "grum*"}


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = remainder("doc_id", 5) == 0
    scored = score(docs, fit(docs, labels, ~held), held)
    assert scored.count() == docs.count()
    rows = scored.where("held_out").join(labels.where("toxic is not null"), "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) > 0.85 and np.mean([r.predicted for r in clean]) < 0.01


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "fine words"), (4, "idiot " * 50_000), (4, "idiot " * 50_000), (5, "idiot"), (6, "idiot moron"), (None, "idiot"), (7, "fine")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 0), (7, 0), (5, 1), (6, 1), (8, None), (8, 1)], "doc_id long, toxic int")
    out = score(df, fit(df, labels, F.lit(True)), F.lit(False)).collect()
    assert len(out) == 9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert {r.score for r in score(df, fit(df, labels.limit(0), F.lit(True)), F.lit(False)).collect()} == {0.5}
    assert score(df.limit(0), fit(df.limit(0), labels, F.lit(True)), F.lit(False)).collect() == []


def test_misspelled_inflections(spark):
    toxic = [f"ab cd {w}" for w in ["idiot", "idiots", "gruma", "grumbe"] * 10]
    entries = learn_lexicon(toxic, ["ab cd ef"] * 50, inflected=True)
    assert set(entries) == {"idiot*", "idiot", "idiots", "grum*", "gruma", "grumbe"}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*sorted(toxic * 2), *["ab cd ef"] * 80])], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id < 80) AS toxic")
    f = ToxicityFeatures(list(fit(docs, labels, F.lit(True)).entries))
    found = f.many(["idi0t", "idot", "idi0ts", "iidiots", "gr0ma", "idiotic", "grumce", "ab cd ef", "radiator"])
    assert [x[:2] for x in found] == [(0, 1)] * 5 + [(1, 0)] * 2 + [(0, 0)] * 2


def test_a_full_lexicon_keeps_the_greatest_odds(spark):
    toxic, clean = ["ab cd noise"] * 40 + ["ab cd moron"] * 20, ["ab cd ef"] * 49 + ["ab cd noise"]
    assert learn_lexicon(toxic, clean) == ["noise", "moron"]
    assert learn_lexicon(toxic, clean, most=1) == ["moron"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*toxic, *clean])], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id < 60) AS toxic")
    assert len(fit(docs, labels, F.lit(True), most=1).entries) == 1
