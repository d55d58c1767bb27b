"""Tree contributions against the definition by subsets of features."""

import math
import random
from itertools import combinations

import numpy as np
import pytest

from clientpulse.plans import reasons as R


def grown(rng, depth, features, cover=100.0):
    """A random tree as the arrays of a saved one."""
    nodes = []

    def add(level, cover):
        at = len(nodes)
        nodes.append(None)
        if level == 0 or cover < 2 or rng.random() < 0.15:
            nodes[at] = (-1, -1, -1, 0.0, rng.gauss(0, 1), cover)
            return at
        share = rng.choice([0.5, 0.25, 0.9])
        f, cut = rng.randrange(features), round(rng.uniform(-1, 1), 1)
        left = add(level - 1, cover * share)
        right = add(level - 1, cover * (1 - share))
        nodes[at] = (left, right, f, cut, 0.0, cover)
        return at

    add(depth, cover)
    left, right, feature, threshold, value, weight = map(np.array, zip(*nodes))
    return (rng.uniform(0.5, 2), left, right, feature, threshold, value, weight)


def conditional(tree, x, known, node=0):
    """Expected value when only the known features are looked at, the others followed by cover."""
    weight, left, right, feature, threshold, value, cover = tree
    if left[node] < 0:
        return weight * value[node]
    if feature[node] in known:
        return conditional(tree, x, known, left[node] if x[feature[node]] <= threshold[node] else right[node])
    parts = [(cover[c], conditional(tree, x, known, c)) for c in (left[node], right[node])]
    return sum(w * v for w, v in parts) / cover[node]


def by_subsets(trees, x, n):
    out = np.zeros(n)
    value = lambda known: sum(conditional(t, x, known) for t in trees)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for size in range(n):
            factor = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for known in combinations(others, size):
                out[i] += factor * (value({*known, i}) - value(set(known)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_definition(seed):
    rng = random.Random(seed)
    n, trees = 4, [grown(rng, 5, 4) for _ in range(3)]
    x = np.array([[round(rng.uniform(-1.2, 1.2), 1) for _ in range(n)] for _ in range(12)])
    got = R.attribute(x, trees, np.zeros_like(x))
    base = R.expected_value(trees)
    assert base == pytest.approx(sum(conditional(t, None, set()) for t in trees))
    for row, mine in zip(x, got):
        assert mine == pytest.approx(by_subsets(trees, row, n), abs=1e-9)
        assert base + mine.sum() == pytest.approx(sum(conditional(t, row, set(range(n))) for t in trees), abs=1e-9)


def test_order_of_splits_does_not_matter():
    """Two features that enter alike share alike, whichever is split on first."""
    one = (1.0, *map(np.array, ([1, 3, 5, -1, -1, -1, -1], [2, 4, 6, -1, -1, -1, -1], [0, 1, 1, 0, 0, 0, 0], [0.0] * 7, [0, 0, 0, 0.0, 0.0, 0.0, 1.0], [8, 4, 4, 2, 2, 2, 2])))
    two = (1.0, one[1], one[2], np.array([1, 0, 0, 0, 0, 0, 0]), *one[4:])
    x = np.array([[1.0, 1.0], [-1.0, 1.0]])
    a, b = (R.attribute(x, [t], np.zeros_like(x)) for t in (one, two))
    assert a == pytest.approx(b) and a[0, 0] == pytest.approx(a[0, 1])


def test_leaf_only_and_missing_values():
    leaf = (2.0, *map(np.array, ([-1], [-1], [0], [0.0], [0.5], [7.0])))
    assert R.expected_value([leaf]) == 1.0 and not R.attribute(np.ones((2, 1)), [leaf], np.zeros((2, 1))).any()
    split = (1.0, *map(np.array, ([1, -1, -1], [2, -1, -1], [0, 0, 0], [0.0, 0.0, 0.0], [0.0, 1.0, 3.0], [4.0, 2.0, 2.0])))
    got = R.attribute(np.array([[np.nan], [-1.0]]), [split], np.zeros((2, 1)))
    assert got[:, 0] == pytest.approx([1.0, -1.0])


@pytest.mark.parametrize("width", [1, 5, 62, 63, 70])
def test_rows_are_told_apart_by_all_their_flags(width):
    flags = np.random.default_rng(width).random((300, width)) < 0.5
    flags[10:20] = flags[0]
    patterns, which = R._distinct_rows(flags)
    assert (patterns[which.reshape(-1)] == flags).all()
    assert len(patterns) == len({row.tobytes() for row in flags})
