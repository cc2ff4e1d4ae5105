"""Linkage against brute force over all pairs, also with every block treated as hot."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from turnout.functions import keys as K
from turnout.operators import linkage as L
from turnout.session import CLEANUP, ensure_checkpoint_dir


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def swapped(a, b):
    """Equal but for two neighbouring positions, which are exchanged."""
    off = [i for i in range(len(a)) if a[i] != b[i]] if len(a) == len(b) else []
    return len(off) == 2 and off[1] == off[0] + 1 and (a[off[0]], a[off[1]]) == (b[off[1]], b[off[0]])


def alike(a, b):
    """Equal after leaving out at most one position of each."""
    shorter = lambda t: [t] + ["".join(c for j, c in enumerate(t) if j != i) for i in range(len(t))]
    return any(x == y for x in shorter(a) for y in shorter(b))


def similarity(a, b):
    a, b = set(a), set(b)
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    typo = lambda t: any(len(x) > 3 and lev(x, t) <= 1 for x in a - b)
    init = lambda t: any(len(x) == 1 and t.startswith(x) for x in a - b)
    rest = b - a
    covered = len(a & b) + sum(0.9 if typo(t) else 0.5 if init(t) else 0.0 for t in rest)
    return max(0.0, min(1.0, covered / len(b) - 0.15 * max(0, len(a) - len(b) - 1)))


def brute(sales, users, cfg):
    boxes = {}
    for u in users:
        boxes[u["local"]] = boxes.get(u["local"], 0) + 1
    out = {}
    for s in sales:
        best = []
        for u in users:
            near = s["core"] and u["core"] and alike(s["core"], u["core"])
            phone = s["phone"] and (s["phone"] == u["phone"] or swapped(s["phone"], u["phone"]))
            if not ((s["email"] and s["email"] == u["email"]) or (s["local"] and s["local"] == u["local"]) or near or phone):
                continue
            if s["email"] and s["email"] == u["email"]:
                e = 1.0
            elif s["local"] and s["local"] == u["local"]:
                e = 0.85 if any(c.isdigit() for c in s["local"]) or boxes[u["local"]] == 1 else 0.45
            elif s["local"] and u["local"] and lev(s["local"], u["local"]) <= 1:
                e = 0.85 if s["dom"] and s["dom"] == u["dom"] else 0.65
            else:
                e = 0.25 if s["core"] and s["core"] == u["core"] else 0.0
            p = 0.0 if not s["phone"] or not u["phone"] else 1.0 if s["phone"] == u["phone"] else 0.75 if swapped(s["phone"], u["phone"]) else 0.0
            n = similarity(s["names"], u["names"])
            best.append((cfg.w_email * e + cfg.w_phone * p + cfg.w_name * n, u["user_id"], e, p, n))
        best.sort(reverse=True)
        second = best[1][0] if len(best) > 1 else 0.0
        ok = bool(best) and best[0][0] >= cfg.threshold and best[0][0] - second >= cfg.margin
        ev = tuple(round(x, 2) for x in best[0][2:]) if best else (0.0, 0.0, 0.0)
        out[s["sale_id"]] = (best[0][1] if ok else None, ev)
    return out


@pytest.fixture(scope="module")
def fixture(spark, inputs):
    sales = inputs.t.sales.filter("sale_id % 3 <> 1")
    # two users on one mailbox and phone, and a crowd on one phone
    extra = spark.createDataFrame(
        [(9001 + i, f"caja{i}@gmail.com", "3000000000", n, l, 1, False) for i, (n, l) in enumerate(
            [("Ana", "Ruiz"), ("Luis", "Torres"), ("Ana", "Torres"), ("Jose", "Ruiz"), ("Ana", "Ruiz")])]
        + [(9101, "ana.ruiz@gmail.com", "3000012345", "Ana", "Ruiz", 1, False)]
        # a near mailbox with a shared phone, where both are in blocks of several users and no name agrees
        + [(9201, "contacto@gmail.com", "3015550000", "Eva", "Mora", 1, False)]
        + [(9202 + i, f"contacto@{d}", "3015550000" if i % 2 else "3015550001", "Iris", "Vega", 1, False) for i, d in enumerate(("hotmail.com", "outlook.com", "yahoo.com", "gmail.com"))],
        inputs.t.users.schema,
    )
    base = sales.orderBy("sale_id").limit(2)
    odd = base.withColumns({"sale_id": F.col("sale_id") + 900000, "buyer_email": F.lit("contact@gmail.com"), "buyer_phone": F.when(F.col("sale_id") % 2 == 0, "3015550000").otherwise("3015550001"), "buyer_name": F.lit("Zulma Pardo")})
    sales = sales.unionByName(odd.select(sales.columns))
    return sales, inputs.t.users.unionByName(extra)


@pytest.mark.parametrize("hot", [256, 2])
def test_against_all_pairs(fixture, hot):
    sales, users = fixture
    cfg = L.LinkConfig(hot_block=hot)
    s = [r.asDict() for r in L.normalise_sales(sales).collect()]
    u = [r.asDict() for r in L.normalise_users(users).collect()]
    want = brute(s, u, cfg)
    got = {
        r["sale_id"]: (r["user_id"] if r["via"] == "directo" else None, (r["ev_email"], r["ev_phone"], r["ev_name"]))
        for r in L.link(sales, users, cfg).collect()
    }
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    differing = [k for k in want if any(abs(a - b) > 0.011 for a, b in zip(got[k][1], want[k][1]))]
    assert differing == []


def test_scores_on_the_threshold(spark):
    cfg = L.LinkConfig()
    rows = [(1.0, 0.0, 0.4), (0.0, 1.0, 0.8), (0.25, 1.0, 0.25), (0.65, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "e double, p double, n double")
    got = [r["x"] >= cfg.threshold for r in df.select(L.score(F.col("e"), F.col("p"), F.col("n"), cfg).alias("x")).collect()]
    assert got == [True, True, True, False]


def test_weights_without_exact_plan_are_refused():
    with pytest.raises(ValueError):
        L.LinkConfig(threshold=0.45).check()


def test_propagation(spark):
    sales = spark.createDataFrame(
        [(1, "ana.ruiz7@gmail.com", "3001112233", "Ana Ruiz"), (2, "ana.ruiz7@gmail.com", "", "Zoe Paz"), (3, "", "", "Zoe Paz")],
        "sale_id long, buyer_email string, buyer_phone string, buyer_name string")
    users = spark.createDataFrame([(5, "ana.ruiz7@gmail.com", "3001112233", "Ana", "Ruiz")],
                                  "user_id long, email string, phone string, first_name string, last_name string")
    got = {r["sale_id"]: (r["user_id"], r["confidence"], r["via"]) for r in L.link(sales, users).collect()}
    assert got == {1: (5, 1.0, "directo"), 2: (5, 0.85, "propagado"), 3: (None, 0.0, "")}


def best_of(pairs):
    n = K.name_similarity(F.col("s_names"), F.col("u_names"))
    rows = pairs.withColumn("x", F.struct(F.round(n, 9).alias("n"), "uid")).groupBy("s_key", F.col("s_names").cast("string").alias("name")).agg(F.max("x").alias("x"))
    return {(r["s_key"], r["name"]): (r["x"]["n"], r["x"]["uid"]) for r in rows.collect()}


def named(spark, rows, prefix):
    """(key, tokens[, uid]) rows; a name is a sorted set of tokens."""
    kind = f"{prefix}_key string, {prefix}_names array<string>" + (", uid long" if prefix == "u" else "")
    return spark.createDataFrame([(k, sorted(set(t)), *rest) for k, t, *rest in rows], kind)


def test_names_of_a_hot_core_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    words = ["maria", "mario", "marta", "ana", "garcia", "garzia", "lopez", "m", "g", "ruiz", "ruis"] + ["".join(rng.choices("abcdef", k=5)) for _ in range(60)]
    name = lambda: rng.choices(words, weights=[30] * 5 + [8] * 6 + [1] * 60, k=rng.randrange(0, 5))
    sales = named(spark, {("hot", tuple(sorted(set(name())))) for _ in range(300)}, "s")
    users = named(spark, [("hot", n, i) for i, n in enumerate({tuple(sorted(set(name()))) for _ in range(300)})], "u")
    meets = spark.createDataFrame([("hot", "hot", 0.25)], "s_key string, u_key string, e double")
    want = best_of(sales.join(meets, "s_key").join(users, "u_key"))
    for hot in (3, 20, 1000):
        assert best_of(L.name_pairs(sales, users, meets, L.LinkConfig(hot_block=hot))) == want, hot


def test_names_of_a_core_of_ten_thousand_are_not_multiplied(spark):
    n = 10_000
    word = lambda kind, i: kind + "".join(chr(97 + (i // 26**k) % 26) * 3 for k in range(3))
    sales = named(spark, [("maria", ["maria", word("qq", i) if i % 2 else word("ww", i)]) for i in range(n)], "s")
    users = named(spark, [("maria", ["maria", word("ww", i)], i) for i in range(n)], "u")
    meets = spark.createDataFrame([("maria", "maria", 0.25)], "s_key string, u_key string, e double")
    pairs = L.name_pairs(sales, users, meets, L.LinkConfig()).persist()
    assert pairs.count() < 40 * n
    got = best_of(pairs)
    assert len(got) == n
    for i in range(0, n, 37):
        tokens = sorted(["maria", word("qq", i) if i % 2 else word("ww", i)])
        assert got["maria", "[" + ", ".join(tokens) + "]"] == ((0.5, n - 1) if i % 2 else (1.0, i)), i
    pairs.unpersist()


def test_buyers_and_users_of_near_mailboxes_are_not_multiplied(spark):
    n = 200  # below a hot block, where each buyer once met each user
    phone = lambda start, i: str(start + 1009 * i)
    sales = spark.createDataFrame([(i, "ana.ruiz12@gmail.com", phone(3100000000, i), "Ana Ruiz") for i in range(n)],
                                  "sale_id long, buyer_email string, buyer_phone string, buyer_name string")
    users = spark.createDataFrame([(i, "ana.ruiz1@gmail.com", phone(3200000000, i), "Ana", "Ruiz") for i in range(n)],
                                  "user_id long, email string, phone string, first_name string, last_name string")
    profiles, known = L.buyer_profiles(L.normalise_sales(sales)), L.user_profiles(L.normalise_users(users))
    found = [r["found"] for r in L.candidates(profiles, known, L.LinkConfig()).collect()]
    assert len(found) == n and max(map(len, found)) <= 8
    for x in found:  # all users score alike, so the two largest ids come first
        assert [r["uid"] for r in sorted(x, reverse=True)][:2] == [n - 1, n - 2]


def test_links_leave_one_table(spark, inputs):
    """Neither the tables between the steps nor the shuffle files of a written table outlast it."""
    folders = {x.removeprefix("file:") for x in (ensure_checkpoint_dir(spark), ensure_checkpoint_dir(spark))}
    seen = lambda: {x for at in folders for x in os.listdir(at)}
    root = os.environ.get("SPARK_LOCAL_DIRS", spark.conf.get("spark.local.dir", "/tmp"))
    shuffles = lambda: set(glob.glob(os.path.join(root, "**", "shuffle_*.data"), recursive=True))
    before, files, setting = seen(), shuffles(), spark.conf.get(CLEANUP, None)
    links = L.link(inputs.t.sales, inputs.t.users)
    made = seen() - before
    assert len(made) == 1 and made.pop().startswith("table-")
    assert spark.conf.get(CLEANUP, None) == setting
    left = files
    for _ in range(50):  # files are deleted in the background
        left = {x for x in shuffles() - files if os.path.exists(x)}
        if not left:
            break
        time.sleep(0.1)
    # counts of rows, as `lookup` makes them, leave a number for each task
    assert sum(os.path.getsize(x) for x in left if os.path.exists(x)) < 10_000
    assert links.count() == inputs.t.sales.count()
