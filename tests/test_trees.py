"""Trees, calibration and folds against plain definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnout.operators import models as M
from turnout.operators import trees as T


def data(n=1500, seed=1):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(size=n), r.integers(0, 4, n), np.where(r.random(n) < 0.2, np.nan, r.normal(size=n))])
    words = [r.choice(["a", "b", "c", "rare1"], n, p=[0.5, 0.3, 0.195, 0.005]).tolist()]
    z = 1.5 * x[:, 0] + (x[:, 1] == 2) - 2 * (np.array(words[0]) == "b")
    return x, words, (r.random(n) < 1 / (1 + np.exp(-z))).astype(int)


def test_bins_pool_rare_words_and_fill_medians():
    x, words, _ = data()
    c = T.Columns().fit(x, words)
    bins = c.bins(x, words)
    assert bins.shape == (1500, 4) and c.categories.tolist() == [False, False, False, True]
    assert c.codes[0]["rare1"] == 1 and c.codes[0]["a"] >= 2 and c.bins(x[:1], [["new"]])[0, 3] == 0
    order = np.argsort(x[:, 0])
    assert (np.diff(bins[order, 0].astype(int)) >= 0).all() and bins[:, 1].max() == 3
    assert len(set(bins[np.isnan(x[:, 2]), 2].tolist())) == 1


def loss(y, p):
    return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))


@pytest.mark.parametrize("kind, size", [("boosted", 60), ("forest", 60)])
def test_fitted_models_learn_and_cells_stand_for_rows(kind, size):
    x, words, y = data()
    other, other_words, other_y = data(seed=2)
    held = np.arange(len(y)) % 4 == 0
    model = T.fitted(kind, size, x, words, y, held)
    p = np.clip(model.calibrated(other, other_words), 1e-3, 1 - 1e-3)
    assert loss(other_y, p) < loss(other_y, np.full(len(p), y.mean())) - 0.12 and abs(p.mean() - other_y.mean()) < 0.05
    raw = model.raw(model.columns.bins(other, other_words))
    cal = model.calibrated(other, other_words)
    order = np.argsort(raw, kind="stable")
    assert (np.diff(cal[order]) >= -1e-12).all()


def test_boosting_reduces_the_loss_of_its_rows_each_round():
    x, words, y = data()
    c = T.Columns().fit(x, words)
    bins, pos, neg = T.cells(c.bins(x, words), y)
    seen = []
    for rounds in (1, 5, 25, 80):
        trees, base = T.boost(bins, c.categories, pos, neg, rounds)
        p = 1 / (1 + np.exp(-(base + trees.sums(bins, c.categories))))
        seen.append(-(pos * np.log(p) + neg * np.log(1 - p)).sum())
        sizes = np.diff([*trees.roots, len(trees.feature)])
        assert len(trees.roots) == rounds and sizes.max() <= 2 * 15 - 1
    assert seen == sorted(seen, reverse=True)


def best_stump(bins, category, pos, neg, least):
    """The first split of a boosted tree by trying every one."""
    n = pos + neg
    p = pos.sum() / n.sum()
    g, h = n * p - pos, n * p * (1 - p)
    best = (-1.0, None)
    for f in range(bins.shape[1]):
        for at in range(int(bins[:, f].max()) + 1):
            goes = bins[:, f] == at if category[f] else bins[:, f] <= at
            if min(n[goes].sum(), n[~goes].sum()) < least:
                continue
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (goes, ~goes)) - g.sum() ** 2 / (h.sum() + 1.0)
            if gain > best[0] + 1e-9:
                best = (gain, (f, at))
    return best[1]


def test_the_first_split_is_the_best_of_all():
    for seed in range(5):
        x, words, y = data(400, seed)
        c = T.Columns().fit(x, words)
        bins, pos, neg = T.cells(c.bins(x, words), y)
        trees, _ = T.boost(bins, c.categories, pos, neg, 1, leaves=2)
        assert (trees.feature[0], trees.at[0]) == best_stump(bins, c.categories, pos, neg, 40)


def test_leaves_hold_enough_rows_and_sums_follow_the_nodes():
    x, words, y = data()
    c = T.Columns().fit(x, words)
    bins, pos, neg = T.cells(c.bins(x, words), y)
    trees = T.forest(bins, c.categories, pos, neg, 12)
    got = trees.sums(bins, c.categories)
    for i in range(0, len(bins), 97):
        total = 0.0
        for node in trees.roots:
            while trees.feature[node] >= 0:
                f, b = trees.feature[node], bins[i, trees.feature[node]]
                node = trees.left[node] + (0 if (b == trees.at[node] if c.categories[f] else b <= trees.at[node]) else 1)
            total += trees.value[node]
        assert math.isclose(total, got[i])
    stumps, _ = T.boost(bins, c.categories, pos, neg, 20)
    assert all(0 <= v <= 1 for v in trees.value) and len(stumps.roots) == 20


def test_rising_is_the_nearest_rising_curve():
    r = random.Random(3)
    for _ in range(40):
        x = np.array([round(r.random(), 1) for _ in range(30)])
        y = np.array([float(r.random() < 0.3 + 0.4 * v) for v in x])
        knots, values = T.rising(x, y, np.ones(30))
        assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all()
        fit = np.interp(x, knots, values)
        # min-max formula of isotonic regression on distinct x
        xs = sorted(set(x))
        mean = lambda lo, hi: y[(x >= lo) & (x <= hi)].mean()
        want = {v: max(min(mean(lo, hi) for hi in xs if hi >= v) for lo in xs if lo <= v) for v in xs}
        assert np.allclose(fit, [want[v] for v in x])


@pytest.fixture(scope="module")
def past(inputs):
    return inputs.features.filter("labelled")


@pytest.mark.parametrize("make", [lambda: M.BoostedTrees(12), lambda: M.Forest(8)])
def test_models_keep_shows_whole_and_rows_as_they_are(past, make):
    model = make().fit(past)
    assert len(model.models) == model.folds
    folds = {(r["fold"], r["job"]) for r in model.rows(past).select("fold", "job").distinct().collect()}
    assert folds == {(k, 0) for k in range(1, 5)}
    got = model.predict(past.limit(500))
    assert got.columns == [*past.columns, "p"] and got.dtypes[:-1] == past.dtypes
    p = got.select("p").toPandas()["p"]
    assert len(p) == 500 and p.between(0, 1).all()


def test_sample_bounds_a_fit(past, monkeypatch):
    n = past.count()
    monkeypatch.setattr(T, "SAMPLE", n // 4)
    assert 0.1 * n < M.BoostedTrees(3).rows(past).count() < 0.4 * n


def test_full_size_is_the_default():
    assert M.BoostedTrees().size == 300 and M.Forest().size == 400


def test_an_unseen_show_and_an_unseen_word_can_be_scored(past):
    model = M.Forest(5).fit(past)
    odd = past.limit(3).withColumns({"city": F.lit("nowhere"), "rate_minimum": F.lit(None).cast("double"), "event_id": F.lit(-5).cast(dict(past.dtypes)["event_id"])})
    assert model.predict(odd).filter("p is not null and p between 0 and 1").count() == 3


def test_trees_join_the_fold_loop_of_the_comparison(past):
    """Out-of-fold rows of both, whose training frames have a fold of their own."""

    class Boosted(M.BoostedTrees):
        def __init__(self):
            super().__init__(4)

    class Few(M.Forest):
        def __init__(self):
            super().__init__(3)

    got = M.out_of_fold([Boosted, Few], past)
    n = past.count()
    assert {(r["model"], r["n"]) for r in got.groupBy("model").agg(F.count("p").alias("n")).collect()} == {("M3", n), ("M4", n)}
    assert got.filter("p < 0 or p > 1").count() == 0


def test_a_fit_takes_all_labelled_rows(past, monkeypatch):
    """Whatever the size of a trial; the counts of a node are added up by parts of its rows."""
    n = past.count()
    seen = []
    monkeypatch.setattr(T, "SAMPLE", n // 4)
    monkeypatch.setattr(T, "train", lambda rows, *a, real=T.train: seen.append(rows.count()) or real(rows, *a))
    for make in (M.BoostedTrees, M.Forest):
        model = make(3).fit(past)
        assert seen.pop() == n and len(model.models) == model.folds


def test_parts_of_rows_add_up(monkeypatch):
    x, words, y = data()
    c = T.Columns().fit(x, words)
    bins, pos, neg = T.cells(c.bins(x, words), y)
    whole = T.boost(bins, c.categories, pos, neg, 5)[0], T.forest(bins, c.categories, pos, neg, 5)
    monkeypatch.setattr(T, "ROWS", 100)
    parts = T.boost(bins, c.categories, pos, neg, 5)[0], T.forest(bins, c.categories, pos, neg, 5)
    for a, b in zip(whole, parts):
        assert a.feature == b.feature and a.at == b.at and np.allclose(a.value, b.value)
