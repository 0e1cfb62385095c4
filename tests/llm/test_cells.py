"""Cells that a query of the nearest-neighbour search goes to."""

import numpy as np
import pytest

from lamina.llm import hnsw


@pytest.mark.parametrize("count", [10_000, 51_000, 250_000, 500_000])
def test_cells_searched_do_not_grow_with_unclustered_vectors(count):
    sample = np.random.default_rng(3).standard_normal((4000, 64))
    centroids, searched = hnsw.cells_of(sample, float((sample * sample).sum(1).max()), count)
    assert searched <= min(len(centroids), hnsw.MOST_SEARCHED)
    assert count <= len(centroids) * hnsw.SHARD_NODES
