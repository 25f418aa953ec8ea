import numpy as np
import pytest

from tagloom.llm import embedding_links
from tagloom.llm.embedding_links import link_embeddings

SF = "/root/testdata/sf0.1"


def by_hand(ids, x, threshold=0.9):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.array([min(label[k], *(label[near[k]].tolist() or [label[k]])) for k in range(len(ids))])
        if (new == label).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), label)}
        label = new


def columns(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("crowd,block", [(2000, 4096), (200, 64)])
def test_recall(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(embedding_links, "CROWD", crowd)
    monkeypatch.setattr(embedding_links, "BLOCK", block)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x, rng = np.array([r.embedding for r in rows], np.float64), np.random.default_rng(9)
    # Near copies at many distances: of one vector 300, of others up to 12.
    copies = np.concatenate([np.zeros(300, int), np.repeat(np.arange(1, 90), rng.integers(1, 12, 89))])
    noise = rng.normal(size=(len(copies), x.shape[1])) * rng.uniform(0.0, 0.05, (len(copies), 1))
    x = np.concatenate([x, x[copies] + noise, x[:40]])
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = by_hand(range(len(x)), x)
    got = columns(link_embeddings(vectors))
    assert set(got) == set(want)
    total = sum(n for n, _ in want.values())
    assert total > 0 and all(got[k][0] <= want[k][0] for k in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * total
    assert np.mean([got[k] == want[k] for k in want]) > 0.99


def test_loose_links(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 24))
    x = np.concatenate([b + rng.normal(size=(12, 24)) * rng.uniform(0.05, 0.35, (12, 1)) for b in base])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    want, got = by_hand(range(len(x)), x), columns(link_embeddings(df))
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())


def test_edges(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]),
        (9, [float("inf"), 1.0]), (10, [1.0, 0.0, 0.0]), (11, [0.0, 1e300]), (12, [0.0, 1e-300]), (3, [1.0, 0.1]), (None, [1.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, dim int")
    out = link_embeddings(df).collect()
    assert len(out) == 14
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10)) and got[None] == (0, None, True)
    assert got[11] == (1, 11, True) and got[12] == (1, 11, False)
    assert link_embeddings(df.limit(0)).collect() == []


def beside_a_hot_group(bands, dim=64, pairs=150, hot=1500, others=2700):
    """Vectors of which a third are one group at cosine 0.99, and pairs (a, b) of each band of cosines."""
    rng = np.random.default_rng(17)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)

    def at(base, cosine):
        off = rng.normal(size=base.shape)
        off = unit(off - (off * base).sum(1)[:, None] * base)
        return cosine[:, None] * base + np.sqrt(1 - cosine**2)[:, None] * off

    centre = unit(rng.normal(size=(1, dim)))
    parts, found = [at(np.repeat(centre, hot, 0), np.full(hot, 0.995)), unit(rng.normal(size=(others, dim)))], {}
    for low, high in bands:
        base, first = unit(rng.normal(size=(pairs, dim))), sum(map(len, parts))
        parts += [base, at(base, rng.uniform(low + 1e-6, high, pairs))]
        found[low] = [(first + k, first + pairs + k) for k in range(pairs)]
    return np.concatenate(parts), found


@pytest.mark.parametrize("threshold,bands", [(0.9, [(0.9, 0.91), (0.91, 0.95), (0.95, 1)]), (0.98, [(0.98, 0.982), (0.982, 0.99), (0.99, 1)])])
def test_recall_of_bands_beside_a_hot_group(spark, monkeypatch, threshold, bands):
    monkeypatch.setattr(embedding_links, "CROWD", 50)  # so that a table of this size is cut into cells
    x, found = beside_a_hot_group(bands)
    assert embedding_links.calibrate(len(x), 64, threshold).groups > 1
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = columns(link_embeddings(df, threshold))
    for low, links in found.items():
        assert np.mean([got[b][1] == got[a][1] and got[a][0] > 0 for a, b in links]) >= 0.99, low


def test_calibration_passes_links_at_the_threshold():
    rng = np.random.default_rng(1)
    for dim in (2, 3, 8, 64, 768):
        plan = embedding_links.calibrate(15_000_000, dim, 0.9)
        off = rng.normal(size=(20_000, dim))
        off *= np.sqrt(0.2) / np.linalg.norm(off, axis=1)[:, None]
        at = np.abs(off @ plan.directions.T)
        assert ((at[:, :24] <= plan.window).sum(1) >= plan.least).mean() >= 0.9995
        assert (at[:, 24:] <= plan.reach).all(1).mean() >= 0.9995


@pytest.mark.parametrize("dim", [2, 16, 64, 768])
@pytest.mark.parametrize("threshold", [0.9, 0.98])
def test_links_at_the_threshold_meet_and_few_others(dim, threshold):
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    a, other = unit(rng.normal(size=(3000, dim))), unit(rng.normal(size=(3000, dim)))
    off = unit(other - (other * a).sum(1)[:, None] * a)
    b = threshold * a + np.sqrt(1 - threshold**2) * off
    plan = embedding_links.calibrate(50_000, dim, threshold)
    assert plan.groups > 1

    def marks(x):
        place = np.floor((x @ plan.cuts.T + plan.starts) / plan.width).astype(np.int64)
        return place.reshape(len(x), plan.groups, plan.each)

    shared = lambda x, y: (marks(x) == marks(y)).all(axis=2)
    assert shared(a, b).any(axis=1).mean() >= 0.98
    if dim >= 16:  # pairs that a group counts, summed over groups, before the sorted window
        assert shared(a, other).sum(axis=1).mean() < (0.18 if threshold == 0.9 else 0.05)


def test_windows_of_the_sorted_projection_lose_no_pair():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 16))
    x[350:] = x[:350] + rng.normal(size=(350, 16)) * 0.08
    x /= np.linalg.norm(x, axis=1)[:, None]
    plan = embedding_links.calibrate(len(x), 16, 0.9)
    at = x @ plan.directions.T
    bins = np.floor(at[:, :24].T * ((embedding_links.STEPS - 1) / plan.window)).astype(np.int64).astype(np.uint8)
    every, half = np.arange(700), np.arange(350)
    near = np.triu(x @ x.T >= 0.9, 1)
    for sides, want in (((every, None), near), ((half, half + 350), near[:350, 350:])):
        found = [(min(i, j), max(i, j)) for a, b in embedding_links._counted(plan, bins, at[:, 24], *sides) for i, j in zip(a, b)]
        assert len(found) == len(set(found))
        linked = {(i, j) for i, j in found if near[i, j]}
        assert len(linked) >= 0.999 * want.sum() > 300


@pytest.mark.parametrize("kind", ["float", "double"])
def test_a_pair_that_meets_in_many_cells_counts_once(spark, monkeypatch, kind):
    monkeypatch.setattr(embedding_links, "CROWD", 5)
    monkeypatch.setattr(embedding_links, "BLOCK", 100)  # crowded cells are dealt out in several blocks
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1, 32)) + rng.normal(size=(400, 32)) * 0.05, rng.normal(size=(800, 32))]).astype(np.float32)
    assert embedding_links.calibrate(len(x), 32, 0.9).groups > 3
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    want, got = by_hand(range(len(x)), x.astype(np.float64)), columns(link_embeddings(df))
    assert all(got[k] == want[k] for k in range(400)) and want[0][0] == 399
    assert all(got[k][0] <= want[k][0] for k in want)
