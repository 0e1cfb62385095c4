"""Frequent n-grams of a block of sets."""

from collections import Counter

import numpy as np

from lamina.llm import jaccard


def test_frequent_grams_are_looked_up_in_parts(monkeypatch):
    draw = np.random.default_rng(5)
    grams = [np.unique(draw.integers(0, 300, 40).astype(np.uint64)) for _ in range(60)]
    ids = draw.permutation(1000)[:60].tolist()
    monkeypatch.setattr(jaccard, "LOOKED_UP", 7)
    least, often, seen = jaccard.often_seen(grams, [(i, len(g)) for i, g in zip(ids, grams)])
    counts = Counter(g for s in grams for g in s.tolist())
    expected = sorted(g for g, n in counts.items() if n >= jaccard.FREQUENT)
    assert often.tolist() == expected and seen.tolist() == [counts[g] for g in expected]
    assert least.tolist() == [min(i for i, s in zip(ids, grams) if g in s) for g in expected]
    rare = jaccard.often_seen([np.array([1, 2], np.uint64), np.array([3], np.uint64)], [(1, 2), (2, 1)])
    assert [len(x) for x in rare] == [0, 0, 0]
