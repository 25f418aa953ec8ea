import numpy as np
import pytest

from tagloom.llm.elias_fano import BigramTrie, EliasFano, quantise, restore


@pytest.mark.parametrize("top", [1, 50, 10_000, 2**40, 2**64 - 1])
@pytest.mark.parametrize("n", [0, 1, 2, 700])
def test_sequences(top, n):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    ef = EliasFano.of(*EliasFano.parts(values))
    assert (ef.access(np.arange(n)) == values).all()
    x = np.concatenate([rng.integers(0, top, 300, dtype=np.uint64, endpoint=True), values, np.array([0, top], np.uint64)])
    assert (ef.successor(x) == np.searchsorted(values, x)).all()


def test_counts_are_kept_within_a_thousandth():
    counts = np.unique(np.geomspace(1, 2**39, 5000).astype(np.int64))
    back = restore(quantise(counts))
    assert (back[counts <= 32_767] == counts[counts <= 32_767]).all()
    assert np.abs(back / counts - 1).max() < 0.001
    assert restore(quantise(np.array([0]))) == 0


def test_trie():
    rng = np.random.default_rng(1)
    names = rng.integers(0, 2**64 - 1, 300, dtype=np.uint64)
    pairs = np.unique(rng.choice(names, (4000, 2)), axis=0)
    count = rng.integers(1, 100, len(pairs))
    trie = BigramTrie(BigramTrie.build(pairs[:, 0], pairs[:, 1], count))
    known = {(a, b): c for (a, b), c in zip(pairs.tolist(), count.tolist())}
    ask = np.concatenate([rng.choice(names, (3000, 2)), rng.integers(0, 2**64 - 1, (50, 2), dtype=np.uint64), pairs])
    context = trie.context(ask[:, 0])
    got = restore(trie.weights(context, ask[:, 1]))
    assert got.tolist() == [known.get(tuple(p), 0) for p in ask.tolist()]
    for k, v in zip(context.tolist(), ask[:, 0].tolist()):
        total = sum(c for (a, _), c in known.items() if a == v)
        assert (trie.totals[k] if k >= 0 else 0) == total


def test_empty_trie():
    none = np.zeros(0, np.uint64)
    trie = BigramTrie(BigramTrie.build(none, none, np.zeros(0, np.int64)))
    assert trie.context(np.array([3], np.uint64)).tolist() == [-1]
    assert trie.weights(np.array([-1]), np.array([3], np.uint64)).tolist() == [0]
