"""Numbers drawn as counts: how many of a group of equal tickets are used, in every simulation at once.

A cell of n tickets with one probability p enters a simulation as one binomial number: the
least k whose summed masses P(X <= k) reach the cell's uniform draw. So a show costs its
cells, not its tickets. Tasks hold one vector of counts per show; the coefficients behind
the draws are a table of fixed size, one row per simulation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.functions.hashing import PRIME, hash31, hash31_of
from turnout.functions.scalars import logit
from turnout.session import compute_partitions, stored

PLACES = 12  # probabilities that agree to so many places are one cell
CELLS = 512  # cells of a show that one task counts; a show with more is spread
SINGLES = 32  # cells of one ticket drawn side by side
BLOCK = 8192  # draws that step side by side; their arrays stay in a core's cache
TAIL = 8.0  # deviations below the mean where summing masses begins; less than 1e-13 lies below
WIDE = 65_536  # draws of single tickets side by side; each needs few arrays and no loop
TICKETS = 16_384  # tickets of a show that one task draws one by one; a show with more is spread


def log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n!, by Stirling's series from 16 on."""
    n = np.asarray(n, float)
    small = np.array([math.lgamma(i + 1) for i in range(16)])
    x = np.maximum(n, 16.0)
    series = (x + 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 16, small[np.minimum(n, 15).astype(np.int64)], series)


def climb(u: np.ndarray, k: np.ndarray, mass: np.ndarray, top: np.ndarray, ratio: Callable, args: tuple) -> np.ndarray:
    """Least number from k on, `top` at most, up to which the masses sum to u or more.

    `mass` is that of k; `ratio(k, *args)` is the next mass divided by that of k. Draws that
    have arrived leave the arrays.
    """
    out, sums = k.copy(), mass.copy()
    at = np.flatnonzero((sums < u) & (k < top))
    u, k, mass, sums, top, args = (u[at], k[at], mass[at], sums[at], top[at], tuple(a[at] for a in args))
    while len(at):
        for _ in range(16):
            go = (sums < u) & (k < top)
            mass = np.where(go, mass * ratio(k, *args), mass)
            sums = np.where(go, sums + mass, sums)
            k = k + go
        out[at] = k
        go = np.flatnonzero((sums < u) & (k < top))
        at, u, k, mass, sums, top, args = at[go], u[go], k[go], mass[go], sums[go], top[go], tuple(a[go] for a in args)
    return out


def binomial(u: np.ndarray, n: int | np.ndarray, p: np.ndarray) -> np.ndarray:
    """Least k with P(X <= k) >= u for X binomial (n, p), for arrays u and p and n that fits them."""
    shape = np.broadcast_shapes(np.shape(u), np.shape(n), np.shape(p))
    u, n, p = (np.broadcast_to(x, shape).ravel() for x in (u, n, p))
    out = np.empty(len(u), np.int64)
    for lo in range(0, len(u), BLOCK):
        at = slice(lo, lo + BLOCK)
        out[at] = _climbed(u[at], n[at], p[at])
    return out.reshape(shape)


def _climbed(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """As `climb` for binomial masses: all draws step together, in place, and a step counts for those below u."""
    k = np.clip(np.floor(n * p - TAIL * np.sqrt(n * p * (1 - p)) - TAIL), 0, n).astype(np.int64)
    mass = np.exp(_log_factorials(n) - _log_factorials(k) - _log_factorials(n - k) + k * np.log(p) + (n - k) * np.log1p(-p))
    sums, odds, a, b = mass.copy(), p / (1 - p), (n - k).astype(float), k + 1.0
    out, at = k, np.arange(len(u))
    while True:
        # masses beyond n are zero, so a draw that has arrived there adds nothing
        go = np.flatnonzero((sums < u) & (a > 0))
        if not len(go):
            return np.minimum(out, n)
        if len(go) < len(at):
            at, u, mass, sums, odds, a, b = (x[go] for x in (at, u, mass, sums, odds, a, b))
        below, steps, ratio = np.empty(len(at), bool), np.zeros(len(at), np.int8), np.empty(len(at))
        for _ in range(16):
            np.less(sums, u, out=below)
            steps += below
            np.divide(a, b, out=ratio)
            ratio *= odds
            mass *= ratio
            sums += mass
            a -= 1
            b += 1
        out[at] += steps


def _log_factorials(n: np.ndarray) -> np.ndarray:
    """`log_factorial` of many numbers that lie close together, each value computed once."""
    low, high = int(n.min()), int(n.max())
    return log_factorial(np.arange(low, high + 1))[n - low] if high - low < len(n) else log_factorial(n)


def hypergeometric(u: np.ndarray, total: np.ndarray, good: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Least k with P(X <= k) >= u for X, the good ones among `taken` of `total` that hold `good`."""
    total, good, taken = (np.broadcast_to(np.asarray(x, np.int64), u.shape) for x in (total, good, taken))
    low, top = np.maximum(0, taken + good - total), np.minimum(good, taken)
    share = good / np.maximum(total, 1)
    mean = taken * share
    sd = np.sqrt(np.maximum(mean * (1 - share) * (total - taken) / np.maximum(total - 1, 1), 0))
    k = np.clip(np.floor(mean - TAIL * sd - TAIL), low, top).astype(np.int64)
    choose = lambda n, m: log_factorial(n) - log_factorial(m) - log_factorial(n - m)
    mass = np.exp(choose(good, k) + choose(total - good, taken - k) - choose(total, taken))
    return climb(u, k, mass, top, lambda k, t, g, n: (g - k) * (n - k) / ((k + 1.0) * (t - g - n + k + 1)), (total, good, taken))


# ------------------------------------------------------------------------- draws of a simulation
def collected(coefficients: DataFrame) -> dict[str, np.ndarray]:
    """Coefficients of each stream (4 x simulations); the table has one row per simulation."""
    rows = coefficients.orderBy("sim").toPandas()
    streams = dict.fromkeys(c[0] for c in rows.columns if c != "sim")
    return {s: np.array([rows[f"{s}{i}"].to_numpy(np.int64) for i in range(4)]) for s in streams}


def uniforms(c: np.ndarray, h) -> np.ndarray:
    """As `hashing.poly_uniform`: a draw in (0, 1) for entity hash h in every simulation."""
    x = c[3]
    for k in (2, 1, 0):
        y = x * h
        y += c[k]
        high = y >> 31
        y &= PRIME
        y += high  # the remainder by 2**31 - 1
        np.subtract(y, PRIME, out=y, where=y >= PRIME)
        x = y
    return (x + 0.5) / PRIME


def whole(c: list | np.ndarray, h: np.ndarray) -> np.ndarray:
    """The polynomial of `uniforms` as a whole number below PRIME; c and h are of uint64 and fit each other."""
    prime, bits = np.uint64(PRIME), np.uint64(31)
    y = c[3] * h
    high = np.empty_like(y)
    for k in (2, 1, 0):
        y += c[k]
        # the halves' sum leaves the remainder by 2**31 - 1; below 2**33 after three times, so products stay below 2**64
        np.right_shift(y, bits, out=high)
        y &= prime
        y += high
        if k:
            y *= h
    np.right_shift(y, bits, out=high)
    y &= prime
    y += high
    if len(y) and y.max() >= prime:
        y %= prime
    return y


def below(c: np.ndarray, hashes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """In every simulation how many of some entities have a draw (as `uniforms`) below that simulation's p."""
    c, hashes = c.astype(np.uint64), hashes.astype(np.uint64)
    # (x + 0.5) / PRIME < p as a limit of the whole number x
    limit = np.clip(np.ceil(p * float(PRIME) - 0.5), 0, PRIME).astype(np.uint64)
    out = np.zeros(len(p), np.int64)
    side = max(1, WIDE // max(1, len(p)))  # small vectors are drawn side by side
    for lo in range(0, len(p), WIDE):
        at = slice(lo, lo + WIDE)
        for first in range(0, len(hashes), 255 * side):
            some = np.zeros((side, len(out[at])), np.uint8)  # at most 255 of a row are added
            for i in range(first, min(first + 255 * side, len(hashes)), side):
                x = whole(c[:, at], hashes[i : i + side, None])
                some[: len(x)] += x < limit[at]
            out[at] += some.sum(axis=0, dtype=np.int64)
    return out


def normals(c: dict[str, np.ndarray], streams: str, h) -> np.ndarray:
    return np.sqrt(-2.0 * np.log(uniforms(c[streams[0]], h))) * np.cos(2.0 * math.pi * uniforms(c[streams[1]], h))


def expit(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def cells(tickets: DataFrame, by_sale: bool = False) -> DataFrame:
    """(event_id, p, n, h[, gh]): tickets of a show (and sale) with one probability; h is made of the smallest ticket_id."""
    sale = [F.col("sale_id")] if by_sale else []
    made = tickets.groupBy("event_id", F.round("p", PLACES).alias("key"), *sale).agg(
        F.max("p").alias("p"), F.count(F.lit(1)).alias("n"), hash31(F.lit("cell"), F.min("ticket_id")).alias("h")
    )
    group = hash31(F.lit("sale"), F.col("event_id"), F.col("sale_id")) if by_sale else F.lit(0).cast("bigint")
    return made.select("event_id", "p", "n", "h", group.alias("gh"))


def singles(tickets: DataFrame) -> DataFrame:
    """As `cells`, one for each ticket, with h made of its own id."""
    group = hash31(F.lit("sale"), F.col("event_id"), F.col("sale_id")) if "sale_id" in tickets.columns else F.lit(0).cast("bigint")
    return tickets.select("event_id", "p", F.lit(1).cast("bigint").alias("n"), hash31(F.col("ticket_id")).alias("h"), group.alias("gh"))


def _tossed(c: dict[str, np.ndarray], rows: dict[str, np.ndarray], sigma: float, eh: int, sigma_group: float) -> np.ndarray:
    """Used tickets of one show in every simulation, each ticket by a draw of its own."""
    shock = sigma * normals(c, "sv", eh)
    out = np.zeros(len(shock), np.int64)
    gh = rows["gh"] if sigma_group > 0 else np.zeros_like(rows["gh"])
    order = np.lexsort((gh, rows["lp"]))
    lp, gh, h = rows["lp"][order], gh[order], rows["h"][order]
    cut = [0, *(np.flatnonzero((np.diff(lp) != 0) | (np.diff(gh) != 0)) + 1).tolist(), len(h)]
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):  # tickets of equal chance, drawn one by one
        z = lp[lo] + shock
        out += below(c["t"], h[lo:hi], expit(z + sigma_group * normals(c, "gw", gh[lo]) if sigma_group > 0 else z))
    return out


def _count(c: dict[str, np.ndarray], rows: dict[str, np.ndarray], sigma: float, eh: int, sigma_group: float) -> np.ndarray:
    """Used tickets of some cells of one show in every simulation."""
    shock = sigma * normals(c, "sv", eh)
    out = np.zeros(len(shock), np.int64)

    def p_of(i) -> np.ndarray:
        z = rows["lp"][i] + shock
        return expit(z + sigma_group * normals(c, "gw", rows["gh"][i]) if sigma_group > 0 else z)

    one = np.flatnonzero(rows["n"] == 1)
    for lo in range(0, len(one), SINGLES):
        i = one[lo : lo + SINGLES, None]
        out += (uniforms(c["t"], rows["h"][i]) > 1 - p_of(i)).sum(axis=0)
    several = np.flatnonzero(rows["n"] > 1)
    side = max(1, BLOCK // max(1, len(shock)))  # small vectors are drawn side by side
    for lo in range(0, len(several), side):
        i = several[lo : lo + side, None]
        out += binomial(uniforms(c["t"], rows["h"][i]), rows["n"][i], p_of(i)).sum(axis=0)
    return out


def drawn(tickets: DataFrame, sigmas: DataFrame, coefficients: DataFrame, sigma_group: float = 0.0, each: bool = False) -> DataFrame:
    """(event_id, counts): used tickets of every show in every simulation, as one array.

    `tickets` has event_id, ticket_id, sale_id, p; `sigmas` has event_id, sigma. With a group
    shock cells don't cross sales. Tickets whose p agrees to PLACES places count as equal.
    With `each` there are no cells: every ticket has a draw of its own in every simulation.
    """
    spark = tickets.sparkSession
    shared = spark.sparkContext.broadcast(collected(coefficients))
    made = stored(singles(tickets) if each else cells(tickets, sigma_group > 0))
    count, most = (_tossed, TICKETS) if each else (_count, CELLS)
    sizes = made.groupBy("event_id").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    shows = sigmas.select("event_id", "sigma", hash31(F.lit("show"), F.col("event_id")).alias("eh")).join(sizes, "event_id")
    keyed = made.join(shows, "event_id").select("event_id", "parts", (F.col("h") % F.col("parts")).alias("part"), logit(F.col("p")).alias("lp"), "n", "h", "gh", "sigma", "eh")
    names = ["lp", "n", "h", "gh", "sigma", "eh"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        event, held, total = None, None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([event, pa.array([total.astype(np.int32)], pa.list_(pa.int32()))], ["event_id", "counts"])

        for b in batches:
            part = b.column(1).to_numpy()
            rows = {x: b.column(i + 2).to_numpy() for i, x in enumerate(names)}
            ids = b.column(0).to_pylist()
            cut = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1] or part[i] != part[i - 1]), len(ids)] if ids else []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if held is not None and held != (ids[lo], part[lo]):
                    yield made()
                    total = None
                held, event = (ids[lo], part[lo]), b.column(0).slice(lo, 1)
                own = count(c, {x: v[lo:hi] for x, v in rows.items()}, float(rows["sigma"][lo]), int(rows["eh"][lo]), sigma_group)
                total = own if total is None else total + own
        if total is not None:
            yield made()

    kind = dict(tickets.dtypes)["event_id"]

    def counts(rows: DataFrame) -> DataFrame:
        placed = rows.drop("parts").repartition(compute_partitions(spark), "event_id", "part").sortWithinPartitions("event_id", "part", "h")
        return placed.mapInArrow(run, f"event_id {kind}, counts array<int>")

    # the array of a show counted in one task stays where it is; others have one for each
    # part, which are added place by place
    add = lambda a, x: F.when(F.size(a) == 0, x).otherwise(F.zip_with(a, x, lambda p, q: p + q))
    spread = counts(keyed.filter("parts > 1")).groupBy("event_id").agg(
        F.aggregate(F.collect_list("counts"), F.array().cast("array<int>"), add).alias("counts"))
    return counts(keyed.filter("parts = 1")).unionByName(spread)


def quantile(counts, q: float, n: int):
    """Linear-interpolation quantile of an array column of n numbers that is sorted."""
    at = (n - 1) * q
    low, part = int(math.floor(at)), at - math.floor(at)
    a, b = F.get(counts, F.lit(low)), F.get(counts, F.lit(min(low + 1, n - 1)))
    return a + (b - a) * F.lit(part)


# ----------------------------------------------------------------------------------- permutations
SORTED = 1 << 20  # draws sorted at once


def dealt(seed: int, rep: int, h: np.ndarray, y: np.ndarray, kinds: list[np.ndarray]) -> list[int]:
    """How many positive labels `y` come to the rows of each kind when the labels change their places.

    Place k gets the label of the row whose draw, by its hash and the replicate, is the k-th
    smallest; equal draws keep the order of the rows. A range of draws is sorted at a time.
    """
    c = [np.uint64(hash31_of(seed, rep, f"c{k}")) for k in range(4)]
    x = np.empty(len(h), np.uint32)
    for lo in range(0, len(h), SORTED):
        x[lo : lo + SORTED] = whole(c, h[lo : lo + SORTED].astype(np.uint64))
    parts = max(1, -(-len(h) // SORTED))
    edges = [PRIME * q // parts for q in range(parts + 1)]
    got, first = [0] * len(kinds), 0
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        at = np.flatnonzero((x >= lo) & (x < hi)) if parts > 1 else np.arange(len(x))
        key = (x[at].astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64)
        key.sort()
        label = y[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        got = [g + int(np.count_nonzero(label & kind[first : first + len(at)])) for g, kind in zip(got, kinds, strict=True)]
        first += len(at)
    return got


# ---------------------------------------------------------------------------------- over-selling
def first_crossing(c: dict[str, np.ndarray], event, capacity: float, expected: float, sigma: float, counts: np.ndarray, extra: list[float], risk: float) -> tuple:
    """(risk now, first number of extra tickets above the limit or None, risk before it, risk at it).

    Extra ticket j has probability extra[j - 1] and a draw of its own, and keeps it at every
    level. After each the counts are recentred on the expected attendance.
    """
    def over(count: np.ndarray, mean: float) -> float:
        return float((count - count.mean() + mean > capacity).mean())

    now = over(counts, expected)
    if now > risk:
        return now, None, None, None
    shock = sigma * normals(c, "sv", hash31_of("show", event))
    chances: dict[float, np.ndarray] = {}
    count, mean, before = counts.astype(np.int64), expected, now
    for j, p in enumerate(extra, 1):
        if p not in chances:
            if len(chances) >= CELLS:
                chances.clear()
            q = min(1 - 1e-6, max(1e-6, p))
            chances[p] = expit(math.log(q / (1 - q)) + shock)
        count = count + (uniforms(c["t"], hash31_of("extra", event, j)) < chances[p])
        mean += p
        at = over(count, mean)
        if at > risk:
            return now, j, before, at
        before = at
    return now, None, None, None


def crossings(shows: DataFrame, coefficients: DataFrame, risk: float) -> DataFrame:
    """(event_id, risk_now, stop, risk_before, risk_at) from (event_id, capacity, expected, sigma, counts, extra)."""
    shared = shows.sparkSession.sparkContext.broadcast(collected(coefficients))
    names = ["risk_now", "stop", "risk_before", "risk_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            for i in range(b.num_rows):
                event, capacity, expected, sigma, counts, extra = (x[i] for x in b.columns)
                found = first_crossing(c, event.as_py(), capacity.as_py(), expected.as_py(), sigma.as_py(), counts.values.to_numpy(), extra.as_py(), risk)
                kinds = [pa.float64(), pa.int32(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *(pa.array([x], k) for x, k in zip(found, kinds, strict=True))], ["event_id", *names])

    kind = dict(shows.dtypes)["event_id"]
    # by a hash of its own, as rows that come placed by event_id would stay in few tasks
    spread = shows.select("event_id", "capacity", "expected", "sigma", "counts", "extra").repartition(
        compute_partitions(shows.sparkSession), hash31(F.lit("task"), F.col("event_id")))
    return spread.mapInArrow(run, f"event_id {kind}, risk_now double, stop int, risk_before double, risk_at double")
