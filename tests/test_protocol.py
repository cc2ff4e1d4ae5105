"""The comparison of models against metrics computed row by row, and the fits behind it."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnout.operators import evaluate as E
from turnout.operators import models as M
from turnout.operators import rates as R
from turnout.operators import side_by_side as N
from turnout.operators import splits as SP
from turnout.plans import experiment as X
from turnout.plans import report as RP

from .test_draws import draw

MODELS = ["B0", "B1", "M1", "M4"]


@pytest.fixture(scope="module")
def oof(spark):
    rng = random.Random(2)
    rows = []
    for e in range(24):
        for t in range(rng.randrange(15, 40)):
            y, c = rng.random() < 0.3 + 0.02 * e, rng.random() < 0.5
            for m in MODELS:
                p = {"B0": 1.0, "B1": 0.55}.get(m, round(min(0.98, max(0.02, 0.3 + 0.02 * e + rng.gauss(0, 0.15 if m == "M1" else 0.3))), 2))
                rows.append((m, 1 + e % 5, f"{e:02}-{t:02}", e, y, p, c, e % 3 == 0, None if t % 4 == 0 else y))
    return rows, spark.createDataFrame(rows, "model string, fold int, ticket_id string, event_id int, y boolean, p double, is_courtesy boolean, is_residency boolean, linked boolean")


def metrics(rows, reps):
    y, p = np.array([r[4] for r in rows], float), np.array([r[5] for r in rows])
    q = np.clip(p, 1e-9, 1 - 1e-9)
    out = {"log_loss": -np.mean(np.where(y == 1, np.log(q), np.log(1 - q))), "brier": np.mean((q - y) ** 2)}
    order = sorted(range(len(rows)), key=lambda i: (p[i], rows[i][2]))
    gap = sum(len(b) * abs(p[b].mean() - y[b].mean()) for b in np.array_split(np.array(order), 10))
    out["ece"] = gap / len(rows)
    pos, neg = p[y == 1], p[y == 0]
    out["auc_roc"] = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    prec = {s: y[p >= s].sum() / (p >= s).sum() for s in set(p)}
    out["auc_pr"] = np.mean([prec[s] for s in pos])
    events = sorted({r[3] for r in rows})
    err = {e: sum(r[5] - r[4] for r in rows if r[3] == e) for e in events}
    obs = {e: sum(r[4] for r in rows if r[3] == e) for e in events}
    ae = np.array([abs(err[e]) for e in events])
    out |= {"mae": ae.mean(), "mape": np.mean([abs(err[e]) / max(obs[e], 1) for e in events]), "bias": np.mean(list(err.values())), "n_events": len(events),
            "median_ae": np.median(ae), "p90_ae": np.quantile(ae, 0.9)}
    means = [np.mean([ae[math.floor(draw(E.SEED, "boot", r, i) * len(ae))] for i in range(len(ae))]) for r in range(reps)]
    out["ci_low"], out["ci_high"] = np.quantile(means, [0.025, 0.975])
    fold = {}
    for e in events:
        fold.setdefault(1 + e % 5, []).append(abs(err[e]))
    out["mae_std_folds"] = np.std([np.mean(v) for v in fold.values()], ddof=1)
    return out


def test_cv_table(oof):
    rows, df = oof
    got = {r["model"]: r.asDict() for r in E.cv_table(df, 120).collect()}
    assert sorted(got) == MODELS
    for m in MODELS:
        for k, v in metrics([r for r in rows if r[0] == m], 120).items():
            assert math.isclose(got[m][k], v, abs_tol=1e-9), (m, k)


def test_bootstrap_of_models_without_some_events(oof, monkeypatch):
    rows, df = oof
    some = E.by_event(df).withColumn("x", F.col("pred") - F.col("obs")).filter("model = 'M1' or event_id % 2 = 0")
    want = {}
    value = {(r["model"], r["event_id"]): r["x"] for r in some.collect()}
    for m in MODELS:
        means = []
        for r in range(60):
            drawn = [math.floor(draw(E.SEED, "boot", r, i) * 24) for i in range(24)]
            held = [value[m, e] for e in drawn if (m, e) in value]
            means.append(sum(held) / len(held))
        want[m] = np.quantile(means, [0.025, 0.975])
    monkeypatch.setattr(E, "CHUNK", 13)
    got = {r["model"]: r for r in E.bootstrap_mean(some, "x", 60).collect()}
    assert all(np.allclose([got[m]["ci_low"], got[m]["ci_high"]], want[m]) for m in MODELS)


def test_paired_difference(oof):
    rows, df = oof
    got = {r["model"]: r for r in E.paired_difference(df, "B1", 80).collect()}
    ae = {(m, e): abs(sum(r[5] - r[4] for r in rows if r[0] == m and r[3] == e)) for m in MODELS for e in range(24)}
    for m in ("B0", "M1", "M4"):
        d = np.array([ae[m, e] - ae["B1", e] for e in range(24)])
        means = [np.mean([d[math.floor(draw(E.SEED, "boot", r, i) * 24)] for i in range(24)]) for r in range(80)]
        lo, hi = np.quantile(means, [0.025, 0.975])
        assert math.isclose(got[m]["mean_dif"], d.mean()) and np.allclose([got[m]["ci_low"], got[m]["ci_high"]], [lo, hi])
        assert got[m]["conclusive"] == (lo > 0 or hi < 0)


def test_every_fold_is_fitted_without_its_own_cells(spark):
    """Weights of each fold: the slope of the penalised likelihood of all other folds vanishes."""
    rng = random.Random(3)
    cells = [(f, a, float(x), float(z), float(rng.randrange(6)), float(rng.randrange(6))) for f in range(9) for a in range(4) for x in (0, 1) for z in (0.5, 2.0) if rng.random() < 0.8 or a < 3]
    cells = [c for c in cells if not (c[1] == 3 and c[0] != 4)]  # artist 3 is in one fold only
    df = spark.createDataFrame(cells, "fold int, artist int, x double, z double, pos double, neg double")
    folds = spark.createDataFrame([(f,) for f in range(10)], "fold int")  # fold 9 has no cells
    got = {r["fold"]: np.array(r["w"]) for r in N.fit(df, folds, ["x", "z"], 4, 1e-3, 12.0).collect()}
    assert sorted(got) == list(range(10))
    for f, w in got.items():
        slope = np.zeros(7)
        slope[1:3], slope[3:] = -1e-3 * w[1:3], -12.0 * w[3:]
        for g, a, x, z, pos, neg in cells:
            if g != f:
                p = 1 / (1 + math.exp(-(w[0] + w[1] * x + w[2] * z + w[3 + a])))
                d = pos - (pos + neg) * p
                slope += d * np.array([1, x, z, *(float(a == k) for k in range(4))])
        assert np.abs(slope).max() < 1e-4, f
    assert got[4][6] == 0 and abs(got[5][6]) > 0.01


def test_interaction_logistic_is_optimal(inputs):
    """M2: on its own scaled design the slope of the penalised likelihood vanishes."""
    past = inputs.features.filter("labelled")
    m = M.InteractionLogistic().fit(past)
    rows = m.prep.features(past).select("features", F.col("y").cast("double").alias("t")).toPandas()
    x = np.array([v.toArray() for v in rows["features"]])
    w = m.model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + m.model.intercept)))
    miss = rows["t"].to_numpy() - p
    assert abs(miss.sum()) < 1e-3 * len(x) and np.abs(x.T @ miss - w).max() < 1e-3 * len(x)
    got = m.predict(past).select("p").toPandas()["p"].to_numpy()
    assert np.allclose(sorted(got), sorted(p), atol=1e-9)


def test_rates_out_of_fold_read_the_tickets_once(inputs, monkeypatch):
    """Equal to fitting and predicting fold by fold, which is not done."""
    dev = inputs.dev.withColumn("artist_id", F.when(F.col("artist_id") != 3, F.col("artist_id")))
    x = dev.join(SP.event_folds(dev, 3), "event_id")
    want = {}
    for make in R.BASELINES:
        for fold in (1, 2, 3):
            p = make().fit(x.filter(F.col("fold") != fold)).predict(x.filter(F.col("fold") == fold))
            want |= {(make.name, fold, r["ticket_id"]): r["p"] for r in p.select("ticket_id", "p").collect()}
    monkeypatch.setattr(R, "cells", lambda train: pytest.fail("a model was fitted on tickets"))
    got = {(r["model"], r["fold"], r["ticket_id"]): r["p"] for r in M.out_of_fold(R.BASELINES, dev, 3).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in got)


def test_out_of_fold_never_sees_its_shows(inputs, monkeypatch):
    dev = inputs.features.filter("labelled")
    seen = []

    class Spy(R.GlobalRate):
        def fit(self, train):
            self.train = {r["event_id"] for r in train.select("event_id").distinct().collect()}
            return super().fit(train)

        def predict(self, df):
            seen.append((self.train, {r["event_id"] for r in df.select("event_id").distinct().collect()}))
            return super().predict(df)

    assert M.out_of_fold([Spy], dev).count() == dev.count()
    assert len(seen) == 5 and all(not a & b for a, b in seen) and len(set().union(*(b for _, b in seen))) == dev.select("event_id").distinct().count()


def test_all_eight_models_compete():
    assert [m().name for m in X.ALL_MODELS] == ["B0", "B1", "B2", "B3", "M1", "M2", "M3", "M4"]


def test_experiment_and_its_card(spark, inputs, oof):
    """The protocol over given out-of-fold rows: each stage equals its own operator, and the document holds them all."""
    rows, df = oof
    past = inputs.features.filter("labelled")
    dev, test = past.filter("event_id % 3 > 0"), past.filter("event_id % 3 = 0")
    named = df.withColumn("model", F.when(F.col("model") == "B1", "B2").otherwise(F.col("model")))
    got = X.run(dev, test, oof=named, reps=50).persist()
    facts = {(r["stage"], r["model"], r["metric"]): r["value"] for r in got.collect()}
    table = {r["model"]: r for r in E.cv_table(named, 50).collect()}
    for m, r in table.items():
        assert all(math.isclose(facts["cv", m, k], r[k], abs_tol=1e-9) for k in ("mae", "log_loss", "auc_roc", "ci_low", "mae_std_folds"))
    rival = min(("B0", "B2"), key=lambda m: table[m]["mae"])
    assert {m for s, m, _ in facts if s == "paired_cv"} == {"M1", "M4"} and {m for s, m, _ in facts if s == "test"} == {"M1", rival}
    p = M.SegmentedLogistic().fit(dev).predict(test)
    err = p.groupBy("event_id").agg((F.sum("p") - F.sum(F.col("y").cast("int"))).alias("e")).toPandas()["e"]
    assert abs(facts["test", "M1", "mae"] - err.abs().mean()) < 1e-6 and abs(facts["test", "M1", "bias"] - err.mean()) < 1e-6
    assert sum(v for (s, _, k), v in facts.items() if s == "calibration_test" and k == "n") == test.count()
    back = RP.read_card(RP.model_card(got, X.CHAMPION)).collect()
    assert {(r["stage"], r["model"], r["metric"]): r["value"] for r in back} == facts and {r["champion"] for r in back} == {"M1"}
    got.unpersist()


def test_freshness(spark):
    rows = [("2026-08-01 09:00:00", "2026-08-08 09:00:00"), ("2026-08-01 09:00:00", "2026-08-09 09:00:00"), ("2026-08-01 09:00:00", "2026-08-09 08:59:59")]
    df = spark.createDataFrame(rows, "a string, b string").select(RP.freshness(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")).alias("f"))
    assert [tuple(r["f"]) for r in df.collect()] == [(7, False), (8, True), (7, False)]
