"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest

from turnout.llm import hard_negatives as H


def brute(rows, every, k=5):
    least: dict = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (label, [float(x) for x in v])
        least[i] = min(least.get(i, key), key)
    q = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in least.items()}
    out = []
    for a, (label, v) in q.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=True)) for i, (_, w) in q.items() if i != a and len(w) == len(v)}
        first = sorted((-s, i) for i, s in score.items() if q[i][0] == label)[:k]
        for p, i in first:
            fit = sorted((-s, j) for j, s in score.items() if q[j][0] != label and 80 * -p <= 100 * s <= 100 * -p)[:k]
            out += [(a, i, r + 1, j, -p, -s) for r, (s, j) in enumerate(fit)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, label, v, 1, "x", 2.0) for i, label, v in rows], "vec_id long, label int, embedding array<float>, rank int, score string, d double").repartition(3)


def vectors(n, d, labels, seed, spread=1.0):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((labels, d))
    out = []
    for i in range(n):
        label = 0 if i % 3 == 0 else int(r.integers(labels))
        x = centre[label] + spread * r.standard_normal(d)
        out.append((i, label, (x / np.linalg.norm(x)).astype("float32").tolist()))
    return out


def odd(d):
    one = [0.5] * d
    return [
        (None, 1, one), (5000, None, one), (5010, 1, None), (5020, 1, [None] * d), (5030, 1, [float("nan")] * d), (5040, 1, [float("inf")] * d),
        (5050, 1, []), (5060, 2, []), (5070, 1, [0.0] * d), (5080, 2, [1.0, 2.0]), (5090, 3, [2.0, 1.0]), (5100, 2, [1.0, 1.0]), (5110, 3, [1.0, 1.0]),
        (5120, 4, one), (5120, 1, one), (5120, 1, one), (5130, 1, one), (5140, 1, one), (5150, 2, one), (5160, 2, one), (5170, 3, [-x for x in one]),
    ]


@pytest.mark.parametrize("spread", [1.0, 0.2])
def test_against_all_pairs(spark, monkeypatch, spread):
    for name, x in (("SHARD", 96), ("BLOCK", 16), ("SHARDS", 2)):  # more slabs and blocks; workers have their own constants
        monkeypatch.setattr(H, name, x)
    rows = vectors(700, 12, 5, 3, spread) + odd(12)
    got = H.hard_negatives(frame(spark, rows), 10).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10) and len(got) > 60


def test_many_equal_vectors_of_one_label(spark):
    rows = [(i, 0 if i % 3 else i % 7, [0.25, 0.5] if i % 2 else [0.25, 0.25 + i / 1000]) for i in range(400)]
    assert sorted(map(tuple, H.hard_negatives(frame(spark, rows), 50).collect())) == brute(rows, 50)


def test_empty(spark):
    assert H.hard_negatives(frame(spark, odd(3)).limit(0)).count() == 0
    assert H.hard_negatives(frame(spark, [(0, 1, [1.0])])).count() == 0


def test_boxes_bound_every_score():
    r = np.random.default_rng(1)
    for d in (1, 3, 20):
        x = np.floor(256 * r.standard_normal((900, d)))
        labels = r.integers(0, 40, 900)
        order, first = H.tiled(x, labels)
        assert sorted(order.tolist()) == list(range(900)) and np.diff(first).max() <= H.LEAF
        tree = H.Tree(order, labels[order], x[order], first)
        q = np.floor(256 * r.standard_normal((7, d)))
        score = q @ tree.x.T
        for level, (lower, upper) in enumerate(tree.bounds(q)):
            size = H.FAN**level
            for j in range(lower.shape[1]):
                a, b = first[min(size * j, len(first) - 1)], first[min(size * (j + 1), len(first) - 1)]
                assert (lower[:, j] <= score[:, a:b].min(axis=1)).all() and (score[:, a:b].max(axis=1) <= upper[:, j]).all()
        assert [len(level[2]) for level in tree.levels][-1] == 1


def test_search_opens_few_leaves_where_vectors_are_clustered():
    random.seed(1)
    rows = vectors(4000, 6, 8, 5, 0.02)
    x = np.floor(256 * np.array([v for _, _, v in rows], np.float64))
    labels = np.array([label for _, label, _ in rows])
    order, first = H.tiled(x, labels)
    tree = H.Tree(order, labels[order], x[order], first)
    bounds = [(lower[0], upper[0]) for lower, upper in tree.bounds(x[:1])]
    opened = []
    tree.best_first, walk = lambda *a: (opened.append(1) or item for item in walk(*a)), tree.best_first
    got = tree.nearest(x[0], 0, labels[0], bounds, 5, [])
    want = sorted((-int(x[i] @ x[0]), i) for i in range(1, 4000) if labels[i] == labels[0])[:5]
    assert got == want and len(opened) < 0.5 * len(first)
    opened.clear()  # with better rows found before, fewer leaves are opened
    assert tree.nearest(x[0], 0, labels[0], bounds, 5, [(-1e12, -i) for i in range(5)]) == [(-1e12, -i) for i in range(5)] and len(opened) <= 1


def test_extreme_components_do_not_fail(spark):
    rows = [(i, i % 2, [3e38 if i % 3 else -3e38, float(i)]) for i in range(30)]
    got = H.hard_negatives(frame(spark, rows), 10).collect()
    assert all(abs(r["positive_score"]) <= 2**63 for r in got)
