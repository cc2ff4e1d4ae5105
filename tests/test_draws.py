"""Counts drawn at once against their definition: masses summed one by one, tickets one by one."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnout.operators import decide as D
from turnout.operators import draws as W
from turnout.operators import linkage as L
from turnout.operators import simulate as S

P = 2**31 - 1


def hashed(*key):
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:15], 16) % P


def draw(seed, stream, sim, h):
    x = 0
    for k in (3, 2, 1, 0):
        x = (x * h + hashed(seed, stream, sim, f"c{k}")) % P
    return (x + 0.5) / P


def least(masses, u):
    total = Fraction(0)
    for k, m in enumerate(masses):
        total += m
        if total >= u:
            return k
    return len(masses) - 1


@pytest.mark.parametrize("n", [1, 2, 7, 60, 400])
def test_binomial(n):
    r = random.Random(n)
    p = [r.choice([1e-6, 1e-3, 0.02, 0.3, 0.5, 0.9, 0.999, 1 - 1e-6, r.random()]) for _ in range(80)]
    u = [r.choice([1e-9, 1 - 1e-9, r.random(), r.random()]) for _ in range(80)]
    got = W.binomial(np.array(u), n, np.array(p)).tolist()
    for k, x, q in zip(got, u, map(Fraction, p)):
        assert k == least([math.comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(n + 1)], Fraction(x))


def test_binomial_of_cells_side_by_side():
    r = np.random.default_rng(5)
    n, u, p = np.array([[1], [3], [90], [2500]]), r.random((4, 3000)), r.random((4, 3000))
    got = W.binomial(u, n, p)
    assert got.shape == (4, 3000) and all((got[i] == W.binomial(u[i], int(n[i, 0]), p[i])).all() for i in range(4))


def test_binomial_of_a_large_cell():
    u = (np.arange(4000) + 0.5) / 4000
    k = W.binomial(u, 1_000_000, np.full(4000, 0.37))
    assert abs(k.mean() - 370_000) < 1 and abs(k.std() / math.sqrt(1_000_000 * 0.37 * 0.63) - 1) < 0.01 and (np.diff(k) >= 0).all()


def test_hypergeometric():
    r = random.Random(9)
    for _ in range(60):
        total = r.randrange(1, 90)
        good, taken = r.randrange(total + 1), r.randrange(total + 1)
        u = np.array([r.random() for _ in range(20)])
        got = W.hypergeometric(u, total, good, taken)
        masses = [Fraction(math.comb(good, j) * math.comb(total - good, taken - j), math.comb(total, taken)) if j <= taken else Fraction(0) for j in range(good + 1)]
        assert got.tolist() == [least(masses, Fraction(float(x))) for x in u]


def test_uniforms_are_those_of_the_expression():
    h = hashed("x")
    c = np.array([[hashed(5, "t", s, f"c{k}") for s in range(50)] for k in range(4)], np.int64)
    assert W.uniforms(c, h).tolist() == [draw(5, "t", s, h) for s in range(50)]


def shows(spark):
    rng = random.Random(4)
    rows = [(1, f"t{i:03}", i // 3, rng.choice([0.4, 0.7, 0.9]), "A", i % 2 == 0) for i in range(90)]
    rows += [(2, f"s{i:03}", 100 + i, 0.5 + i / 200, "B", True) for i in range(40)] + [(3, "z1", 900, 0.2, "C", False)] + [(4, f"w{i}", 800 + i, 0.9, "D", True) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id int, ticket_id string, sale_id int, p double, artist_name string, is_courtesy boolean")
    sig = {1: 0.2, 2: 0.35, 3: 0.1, 4: 0.1}
    return rows, df, spark.createDataFrame(list(sig.items()), "event_id int, sigma double"), sig


def count_by_hand(rows, sig, event, n_sim, seed):
    equal = {}
    for e, t, _, p, *_ in rows:
        if e == event:
            equal.setdefault(p, []).append(t)
    out = []
    for s in range(n_sim):
        eh = hashed("show", event)
        z = sig[event] * math.sqrt(-2 * math.log(draw(seed, "s", s, eh))) * math.cos(2 * math.pi * draw(seed, "v", s, eh))
        total = 0
        for p, ids in equal.items():
            q = 1 / (1 + math.exp(-(math.log(p / (1 - p)) + z)))
            u = draw(seed, "t", s, hashed("cell", min(ids)))
            cum, k = (1 - q) ** len(ids), 0
            while cum < u and k < len(ids):
                k += 1
                cum += math.comb(len(ids), k) * q**k * (1 - q) ** (len(ids) - k)
            total += k
        out.append((total, z))
    return out


def test_counts_cell_by_cell(spark, monkeypatch):
    rows, df, sigmas, sig = shows(spark)
    want = {e: [n for n, _ in count_by_hand(rows, sig, e, 60, 7)] for e in sig}
    for cells in (512, 3):  # in the second run a show is spread over several tasks
        monkeypatch.setattr(W, "CELLS", cells)
        got = {r["event_id"]: r["counts"] for r in S.counted(df.repartition(5), sigmas, 60, 7).collect()}
        assert got == want


def test_intervals_are_quantiles_of_the_counts(spark):
    rows, df, sigmas, _ = shows(spark)
    counts = {r["event_id"]: r["counts"] for r in S.counted(df, sigmas, 101).collect()}
    for r in S.intervals(df, sigmas, 101).collect():
        c = np.array(counts[r["event_id"]])
        mean = sum(x[3] for x in rows if x[0] == r["event_id"])
        assert math.isclose(r["expected"], mean) and r["n"] == sum(x[0] == r["event_id"] for x in rows)
        assert np.allclose([r["p10"], r["p90"]], np.quantile(c, [0.1, 0.9]) - c.mean() + mean)


def test_group_shock_moves_tickets_of_a_sale_together(spark):
    rows = [(1, f"t{i:04}", i // 4, 0.5, "A", False) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id int, ticket_id string, sale_id int, p double, artist_name string, is_courtesy boolean")
    sig = spark.createDataFrame([(1, 0.0)], "event_id int, sigma double")
    v = [np.var(S.counted(df, sig, 1500, sigma_group=g).first()["counts"]) for g in (0.0, 1.5)]
    z = np.linspace(-8, 8, 4001)
    q = 1 / (1 + np.exp(-1.5 * z))
    shared = np.average((q - 0.5) ** 2, weights=np.exp(-z * z / 2))
    assert abs(v[0] / 100 - 1) < 0.12 and abs(v[1] / (100 * (4 * 0.25 + 12 * shared)) - 1) < 0.12


def over_by_hand(rows, sig, event, capacity, n_sim, most, risk, seed):
    own = sorted((t, p) for e, t, _, p, *_ in rows if e == event)
    base = count_by_hand(rows, sig, event, n_sim, seed)
    count, mean = [n for n, _ in base], sum(p for _, p in own)
    share = lambda: sum(n - sum(count) / n_sim + mean > capacity for n in count) / n_sim
    now = before = share()
    if now > risk:
        return 0, now, None, None
    for j in range(1, most + 1):
        p = own[math.floor((hashed(S.SEED, "pick", event, j) + 0.5) / P * len(own))][1]
        for s in range(n_sim):
            count[s] += draw(seed, "t", s, hashed("extra", event, j)) < 1 / (1 + math.exp(-(math.log(p / (1 - p)) + base[s][1])))
        mean += p
        at = share()
        if at > risk:
            return j - 1, now, before, at
        before = at
    return most, now, None, None


def test_overbooking_level_by_level(spark):
    rows, df, sigmas, sig = shows(spark)
    caps = {1: 75, 2: 24, 3: 0, 4: 60}
    events = spark.createDataFrame(list(caps.items()), "event_id int, capacity int")
    got = {r["event_id"]: r for r in D.overbooking(df, sigmas, events, n_sim=50, max_extra=40).collect()}
    for e, cap in caps.items():
        extra, now, before, at = (0, 0.0, None, None) if not cap else over_by_hand(rows, sig, e, cap, 50, 40, D.RISK, S.SEED)
        r = got[e]
        assert (r["extra"], r["risk_now"], r["risk_at_extra"], r["risk_at_next"]) == (extra, now, before, at), e
        assert r["capped"] == (cap > 0 and at is None and now <= D.RISK)
    assert 0 < got[1]["extra"] < 40 and got[4]["extra"] == 0 or got[4]["extra"] > 0


def test_overbooking_defaults_are_the_full_size():
    import inspect

    d = inspect.signature(D.overbooking).parameters
    assert (d["n_sim"].default, d["max_extra"].default) == (6000, 4000)


def test_group_shock_is_a_fine_quadrature(spark):
    rng = random.Random(6)
    rows = [(s, rng.choice([0.2, 0.5, 0.97]), rng.random() < 0.5) for s in range(60) for _ in range(1 + s % 4)]
    df = spark.createDataFrame([(f"t{i}", s, p, y) for i, (s, p, y) in enumerate(rows)], "ticket_id string, sale_id int, p double, y boolean")
    sales = {}
    for s, p, y in rows:
        sales.setdefault(s, []).append((p, y))
    sales = [x for x in sales.values() if len(x) > 1]
    seen = np.mean([not any(y for _, y in x) for x in sales])
    z = np.linspace(-10, 10, 40_001)
    w = np.exp(-z * z / 2)
    got = {r["sigma"]: r for r in S.group_shock(df, [0.0, 1.0, 3.0]).collect()}
    for sigma, r in got.items():
        stay = [np.average(np.prod([1 - 1 / (1 + np.exp(-np.clip(math.log(p / (1 - p)) + sigma * z, -30, 30))) for p, _ in x], axis=0), weights=w) for x in sales]
        assert abs(r["zero_rate"] - np.mean(stay)) < 1e-8 and abs(r["gap"] - abs(np.mean(stay) - seen)) < 1e-8


def test_permutation_follows_shuffled_labels(spark):
    rng = random.Random(8)
    rows = [(i, round(rng.random(), 3), rng.random() < 0.55) for i in range(260)] + [(900, None, True), (901, 0.5, None)]
    df = spark.createDataFrame(rows, "ticket_id int, r double, y boolean")
    gaps = L.permutation_gap(df, "y", "r", 3000, 5, 0.4, 0.7).collect()
    full = [(r, y) for _, r, y in rows if r is not None and y is not None]
    gap = lambda ys: np.mean([y for (r, _), y in zip(full, ys) if r > 0.7]) - np.mean([y for (r, _), y in zip(full, ys) if r <= 0.4])
    seen = gap([y for _, y in full])
    assert {r["rep"] for r in gaps} == set(range(3001)) and abs(next(r["gap"] for r in gaps if r["rep"] == 0) - seen) < 1e-8
    mine = np.array([r["gap"] for r in gaps if r["rep"]])
    ys = [y for _, y in full]
    other = np.array([gap(rng.sample(ys, len(ys))) for _ in range(3000)])
    assert abs(mine.mean() - other.mean()) < 0.01 and abs(mine.std() / other.std() - 1) < 0.06
    p = L.permutation_p(spark.createDataFrame(gaps)).first()["p_value"]
    assert abs(p - (1 + (np.abs(other) >= abs(seen) - 1e-9).sum()) / 3001) < 0.05
    assert L.permutation_gap(df.filter("r > 0.5"), "y", "r", 3, 5, 0.4, 0.7).filter(F.col("gap").isNotNull()).count() == 0


def test_scored_tickets_are_stored_with_the_columns_that_are_read(inputs):
    from checks.catalog import SCORED

    assert inputs.past3.columns == SCORED and inputs.fut3.columns == SCORED


def test_overselling_uses_all_tasks(spark):
    """Shows in one file, and shows already placed by event_id in few tasks, are spread."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    one = spark.range(40).select(F.col("id").alias("event_id"), F.lit(9).alias("n")).coalesce(1)
    assert "REPARTITION_BY_NUM" in plan(D.picks(one, 10, 1))
    full = one.select("event_id", *[F.lit(1.0).alias(c) for c in ("capacity", "expected", "sigma")], F.array(F.lit(1)).alias("counts"), F.array(F.lit(0.5)).alias("extra"))
    placed = full.groupBy("event_id").agg(*[F.first(c).alias(c) for c in full.columns[1:]])
    assert "REPARTITION_BY_NUM" in plan(W.crossings(placed, S.sim_coefficients(spark, 5), 0.05))


def test_draws_below_are_those_one_by_one(monkeypatch):
    r = np.random.default_rng(2)
    c, h, p = r.integers(0, P, (4, 700)), np.array([0, 1, P - 1, *r.integers(0, P, 300)]), r.random(700)
    p[:3] = 0.0, 1.0, 1e-9
    want = sum((W.uniforms(c, int(x)) < p).astype(int) for x in h)
    for wide in (W.WIDE, 64, 1500):
        monkeypatch.setattr(W, "WIDE", wide)
        assert W.below(c, h, p).tolist() == want.tolist()


def test_every_ticket_has_a_draw_of_its_own(spark, monkeypatch):
    rows, df, sigmas, sig = shows(spark)
    want = {}
    for e in sig:
        want[e] = []
        for s in range(60):
            eh = hashed("show", e)
            z = sig[e] * math.sqrt(-2 * math.log(draw(7, "s", s, eh))) * math.cos(2 * math.pi * draw(7, "v", s, eh))
            want[e].append(sum(draw(7, "t", s, hashed(t)) < 1 / (1 + math.exp(-(math.log(p / (1 - p)) + z))) for x, t, _, p, *_ in rows if x == e))
    for tickets in (W.TICKETS, 7):  # in the second run a show is spread over several tasks
        monkeypatch.setattr(W, "TICKETS", tickets)
        got = {r["event_id"]: r["counts"] for r in S.counted(df.repartition(5), sigmas, 60, 7, each=True).collect()}
        assert got == want
    one = S.count_entries(df, sigmas, 60, 7, each=True).groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("sim", "cnt"))).alias("x")).collect()
    assert {r["event_id"]: [x["cnt"] for x in r["x"]] for r in one} == want
    by_show = {r["event_id"]: r for r in S.intervals(df, sigmas, 60, 7, each=True).collect()}
    for e, c in want.items():
        mean = sum(x[3] for x in rows if x[0] == e)
        assert np.allclose([by_show[e]["p10"], by_show[e]["p90"]], np.quantile(c, [0.1, 0.9]) - np.mean(c) + mean)


def test_group_shock_without_cells(spark):
    rows = [(1, f"t{i:04}", i // 4, 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id int, ticket_id string, sale_id int, p double")
    sig = spark.createDataFrame([(1, 0.0)], "event_id int, sigma double")
    v = [np.var(S.counted(df, sig, 1500, sigma_group=g, each=True).first()["counts"]) for g in (0.0, 1.5)]
    z = np.linspace(-8, 8, 4001)
    shared = np.average((1 / (1 + np.exp(-1.5 * z)) - 0.5) ** 2, weights=np.exp(-z * z / 2))
    assert abs(v[0] / 100 - 1) < 0.12 and abs(v[1] / (100 * (4 * 0.25 + 12 * shared)) - 1) < 0.12


@pytest.mark.parametrize("name", ["simulate_attendance", "forecast_interval", "winkler"])
def test_registered_simulations_draw_tickets(inputs, name, monkeypatch):
    """Neither the query nor its SQL draws a count for several tickets at once."""
    from checks.catalog import QUERIES, SQL

    calls = []
    monkeypatch.setattr(W, "_count", lambda *a: calls.append(a))
    monkeypatch.setattr(W, "drawn", lambda *a, real=W.drawn: calls.append(a[4]) or real(*a))
    QUERIES[name](inputs.spark, inputs.folder)
    assert calls == [True] and "list_reduce" not in SQL[name]


def test_labels_are_dealt_ticket_by_ticket(spark, monkeypatch):
    """Every replicate orders all tickets by a draw of their own; nothing is drawn for a group at once."""
    rng = random.Random(3)
    ids = rng.sample(range(1000, 9999), 150)
    rows = [(f"t{i}", round(rng.random(), 3), rng.random() < 0.55) for i in ids] + [("t1", None, True), ("t2", 0.5, None)]
    df = spark.createDataFrame(rows, "ticket_id string, r double, y boolean").repartition(5)
    full = sorted(x for x in rows if x[1] is not None and x[2] is not None)
    mean = lambda x: sum(x) / len(x)
    want = {}
    for rep in range(41):
        c = [hashed(5, rep, f"c{k}") for k in range(4)]
        at = lambda h: (((c[3] * h + c[2]) * h + c[1]) * h + c[0]) % P
        ys = [y for _, _, y in (sorted(full, key=lambda x: (at(hashed(x[0])), x[0])) if rep else full)]
        want[rep] = round(mean([y for y, x in zip(ys, full) if x[1] > 0.7]) - mean([y for y, x in zip(ys, full) if x[1] <= 0.4]), 9)
    for packed in (L._PACKED, 40):
        monkeypatch.setattr(L, "_PACKED", packed)
        got = {r["rep"]: r["gap"] for r in L.permutation_gap(df, "y", "r", 40, 5, 0.4, 0.7).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_ranges_of_draws_are_sorted_one_after_the_other(monkeypatch):
    r = np.random.default_rng(1)
    h, y, kind = r.integers(0, P, 5000).astype(np.uint32), r.random(5000) < 0.4, r.random(5000) < 0.3
    h[::7] = h[0]  # equal draws
    want = W.dealt(9, 4, h, y, [kind, ~kind])
    c = [hashed(9, 4, f"c{k}") for k in range(4)]
    at = [(((c[3] * int(v) + c[2]) * int(v) + c[1]) * int(v) + c[0]) % P for v in h]
    order = sorted(range(5000), key=lambda i: (at[i], i))
    assert want == [int((y[order] & k).sum()) for k in (kind, ~kind)]
    monkeypatch.setattr(W, "SORTED", 700)
    assert W.dealt(9, 4, h, y, [kind, ~kind]) == want


def test_the_permutation_sql_has_tickets():
    from checks.catalog import SQL

    assert all("list_reduce" not in SQL[n] and "row_number" in SQL[n] for n in ("linkage_permutation", "linkage_p_value"))


def test_counts_of_shows_are_not_broadcast(spark, monkeypatch):
    """Neither arrays of all simulations nor extra tickets are, whatever size the planner guesses."""
    _, df, sigmas, _ = shows(spark)
    events = spark.createDataFrame([(1, 75), (2, 24), (3, 0), (4, 60)], "event_id int, capacity int")
    plans = []
    monkeypatch.setattr(D, "crossings", lambda x, *a, real=W.crossings: plans.append(x._jdf.queryExecution().optimizedPlan().toString()) or real(x, *a))
    D.overbooking(df, sigmas, events, n_sim=20, max_extra=5).collect()
    assert plans[0].count("leftHint=(strategy=merge), rightHint=(strategy=merge)") == 2


def test_group_shock_makes_no_row_for_a_node(spark, monkeypatch):
    """Sales of any size, of equal and of own chances; classes are summed where they are."""
    rng = random.Random(12)
    rows = [(s, 0.5 if s % 3 else rng.random(), rng.random() < 0.5) for s in range(50) for _ in range(rng.choice([1, 2, 5]))] + [(99, rng.random(), False) for _ in range(30)]
    df = spark.createDataFrame([(f"t{i}", s, p, y) for i, (s, p, y) in enumerate(rows)] + [("n1", None, 0.4, True), ("n2", None, 0.41, True)], "ticket_id string, sale_id int, p double, y boolean").repartition(4)
    sales = {}
    for s, p, y in rows:
        sales.setdefault(s, []).append((p, y))
    sales = [x for x in sales.values() if len(x) > 1]
    z = np.linspace(-10, 10, 8001)
    w = np.exp(-z * z / 2)
    want = {s: np.mean([np.average(np.prod([1 / (1 + np.exp(math.log(p / (1 - p)) + s * z)) for p, _ in x], axis=0), weights=w) for x in sales]) for s in (0.0, 1.5)}
    seen = np.mean([not any(y for _, y in x) for x in sales])
    for members in (S._MEMBERS, 4):
        monkeypatch.setattr(S, "_MEMBERS", members)
        out = S.group_shock(df, [0.0, 1.5])
        got = {r["sigma"]: r for r in out.collect()}
        assert all(abs(got[s]["zero_rate"] - want[s]) < 1e-8 and abs(got[s]["gap"] - abs(want[s] - seen)) < 1e-8 for s in want)
    # the rows of the grid are the only ones that are made
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    assert S.group_shock(df.filter("sale_id = 0 and p < 0"), [0.0]).count() == 0
