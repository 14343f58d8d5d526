"""Recall of the cap filters at the sizes of large tables, without the tables."""

import numpy as np
import pytest

from twinlink.llm import cap_filters


def filter_sets(vectors, code, height):
    sets = [set() for _ in vectors]
    for owner, own in zip(*(x.tolist() for x in cap_filters.decode(vectors, code, height, cap_filters.LISTS))):
        sets[owner].add(own)
    return sets


@pytest.mark.parametrize("size", [256, 4096])
@pytest.mark.parametrize("cosine", [0.951, 0.99, 0.999])
def test_near_vectors_share_a_filter(size, cosine):
    """256 and 4 096 directions are those of 4 000 and of a million vectors."""
    rng = np.random.default_rng(int(1000 * cosine) + size)
    x, y = rng.standard_normal((2, 1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    code, height = cap_filters._code(64, size), cap_filters._threshold(64, size, cap_filters.LISTS)
    a, b = filter_sets(x, code, height), filter_sets(y, code, height)
    assert min(map(len, a + b)) >= cap_filters.LISTS
    assert sum(s.isdisjoint(t) for s, t in zip(a, b)) <= 1


def test_best_filters_are_the_largest_sums():
    rng = np.random.default_rng(1)
    for least in (1, 5, 64, 5000):
        left, right = rng.standard_normal((2, 64))
        sums = (left[:, None] + right[None, :]).ravel()
        got = cap_filters._best_filters(left, right, least)
        assert len(set(got.tolist())) == min(least, 64 * 64)
        assert np.sort(sums[got]) == pytest.approx(np.sort(sums)[-least:])
