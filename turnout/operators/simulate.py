"""Attendance by simulation: show shock, group shock and the luck of the door.

Draws come from `functions.hashing` and depend on keys only, whatever the partitioning.
Tickets of a show with one probability are drawn together, as a binomial count (`draws`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.functions.hashing import coefficients
from turnout.functions.scalars import band, clip, logit, sigmoid
from turnout.operators import draws
from turnout.operators.ordered import quantiles
from turnout.operators.rates import MIX_BANDS

SEED = 20260801


def sim_coefficients(spark, n_sim: int, seed: int = SEED) -> DataFrame:
    """One row per simulation: coefficients for tickets (t), shows (s, v) and groups (g, w)."""
    cols = []
    for stream in ("t", "s", "v", "g", "w"):
        for i, c in enumerate(coefficients(F.lit(seed), F.lit(stream), F.col("id"))):
            cols.append(c.alias(f"{stream}{i}"))
    return spark.range(n_sim).select(F.col("id").alias("sim"), *cols)


def counted(tickets: DataFrame, sigmas: DataFrame, n_sim: int, seed: int = SEED, sigma_group: float = 0.0, each: bool = False) -> DataFrame:
    """(event_id, counts): raw simulated counts of a show as one array, by simulation.

    With `each` every ticket is drawn by itself, otherwise tickets of one probability as a binomial count.
    """
    return draws.drawn(tickets, sigmas, sim_coefficients(tickets.sparkSession, n_sim, seed), sigma_group, each)


def count_entries(tickets: DataFrame, sigmas: DataFrame, n_sim: int, seed: int = SEED,
                  sigma_group: float = 0.0, each: bool = False) -> DataFrame:
    """(event_id, sim, cnt): raw simulated counts.

    `tickets` has event_id, ticket_id, sale_id, p; `sigmas` has event_id, sigma.
    """
    rows = counted(tickets, sigmas, n_sim, seed, sigma_group, each)
    return rows.select("event_id", F.posexplode("counts").alias("sim", "cnt")).select("event_id", F.col("sim").cast("bigint").alias("sim"), F.col("cnt").cast("bigint").alias("cnt"))


def expected(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("event_id").agg(F.sum("p").alias("expected"), F.count(F.lit(1)).alias("n"))


def simulate(tickets: DataFrame, sigmas: DataFrame, n_sim: int, seed: int = SEED,
             sigma_group: float = 0.0) -> DataFrame:
    """Simulated attendance recentred on the sum of probabilities: (event_id, sim, attendance)."""
    rows = counted(tickets, sigmas, n_sim, seed, sigma_group).join(expected(tickets), "event_id")
    mean = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x) / F.lit(n_sim)
    shifted = rows.select("event_id", (F.col("expected") - mean).alias("shift"), F.posexplode("counts").alias("sim", "cnt"))
    return shifted.select("event_id", F.col("sim").cast("bigint").alias("sim"), F.col("cnt").cast("bigint").alias("cnt"), (F.col("cnt") + F.col("shift")).alias("attendance"))


def intervals(tickets: DataFrame, sigmas: DataFrame, n_sim: int, seed: int = SEED,
              sigma_group: float = 0.0, lo: float = 0.1, hi: float = 0.9, each: bool = False) -> DataFrame:
    """(event_id, expected, p10, p90). Recentring moves quantiles by a constant per show."""
    counts = counted(tickets, sigmas, n_sim, seed, sigma_group, each)
    mean = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x) / F.lit(n_sim)
    q = counts.select("event_id", mean.alias("mean_cnt"), F.sort_array("counts").alias("s")).select(
        "event_id", "mean_cnt", draws.quantile(F.col("s"), lo, n_sim).alias("q_lo"), draws.quantile(F.col("s"), hi, n_sim).alias("q_hi")
    )
    shift = F.col("expected") - F.col("mean_cnt")
    return q.join(expected(tickets), "event_id").select(
        "event_id", "n", "expected", (F.col("q_lo") + shift).alias("p10"), (F.col("q_hi") + shift).alias("p90")
    )


def loo_columns(ev: DataFrame) -> DataFrame:
    """Residual and door variance on the logit scale, from (n, obs, pred, var_sum)."""
    a = clip(F.col("obs") / F.col("n"), 1e-3, 1 - 1e-3)
    b = clip(F.col("pred") / F.col("n"), 1e-3, 1 - 1e-3)
    lg = lambda x: F.log(x / (1 - x))
    return ev.withColumns(
        {
            "abs_err": F.abs(F.col("pred") - F.col("obs")),
            "resid": lg(a) - lg(b),
            "door_var": (F.col("var_sum") / (F.col("n") * F.col("n"))) / (b * (1 - b) * b * (1 - b)),
        }
    )


def event_residuals(scored: DataFrame) -> DataFrame:
    """Per past show, from held-out probabilities."""
    yn = F.col("y").cast("int")
    ev = scored.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(yn).alias("obs"),
        F.sum("p").alias("pred"),
        F.sum(F.col("p") * (1 - F.col("p"))).alias("var_sum"),
        F.avg(F.col("is_courtesy").cast("int")).alias("courtesy_share"),
    )
    return loo_columns(ev)


def show_shock(residuals: DataFrame) -> DataFrame:
    """One row: variance line over the courtesy share, its floor, and the single-sigma reference."""
    excess = F.col("resid") * F.col("resid") - F.col("door_var")
    r = residuals.withColumns({"excess": excess, "pos": F.greatest(excess, F.lit(0.0)), "one": F.lit(1)})
    line = r.groupBy("one").agg(
        F.regr_intercept("excess", "courtesy_share").alias("ri"),
        F.regr_slope("excess", "courtesy_share").alias("rs"),
        F.avg("excess").alias("ybar"),
        F.avg("courtesy_share").alias("xbar"),
        F.var_samp("resid").alias("var_resid"),
        F.avg("door_var").alias("mean_door"),
        F.count(F.lit(1)).alias("n_events"),
    )
    floor = quantiles(r, "pos", {"p10_pos": 0.1}, by=["one"])
    # a constant share has no slope: the minimum-norm line through the mean
    norm = 1 + F.col("xbar") * F.col("xbar")
    return line.join(floor, "one").select(
        F.coalesce("ri", F.col("ybar") / norm).alias("intercept"),
        F.coalesce("rs", F.col("xbar") * F.col("ybar") / norm).alias("slope"),
        F.greatest(F.col("p10_pos"), F.lit(1e-4)).alias("floor"),
        F.sqrt(F.greatest(F.col("var_resid") - F.col("mean_door"), F.lit(1e-4))).alias("sigma_single"),
        "n_events",
    )


def show_sigmas(tickets: DataFrame, shock: DataFrame) -> DataFrame:
    """(event_id, courtesy_share, sigma) for every show of `tickets`."""
    share = tickets.groupBy("event_id").agg(F.avg(F.col("is_courtesy").cast("int")).alias("courtesy_share"))
    intercept, slope, floor = (shock.select(c).scalar() for c in ("intercept", "slope", "floor"))
    return share.select(
        "event_id",
        "courtesy_share",
        F.sqrt(F.greatest(intercept + slope * F.col("courtesy_share"), floor)).alias("sigma"),
    )


def zero_show_rate(tickets: DataFrame) -> DataFrame:
    """Among sales of two tickets or more: share where nobody came, and the share
    expected if the tickets were independent."""
    sales = tickets.groupBy("sale_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.col("y").cast("int")).alias("any_in"),
        F.sum(F.log1p(-F.col("p"))).alias("log_none"),
    ).filter("n >= 2")
    return sales.agg(
        F.count(F.lit(1)).alias("n_sales"),
        F.avg((F.col("any_in") == 0).cast("double")).alias("observed_zero"),
        F.avg(F.exp("log_none")).alias("independent_zero"),
    )


#: Nodes of the integral over a standard normal: steps of NODE_STEP up to NODE_END both ways. The
#: rule's error falls as exp(-2 * pi**2 / (sigma * step)), below 1e-10 for a shock of 3.
NODE_STEP, NODE_END = 0.25, 8.5


def normal_nodes(step: float = NODE_STEP, end: float = NODE_END) -> list[tuple[float, float]]:
    """(z, weight) of an integral over the standard normal density; the weights sum to one."""
    zs = [i * step for i in range(-int(end / step), int(end / step) + 1)]
    density = [math.exp(-z * z / 2) for z in zs]
    return [(z, d / sum(density)) for z, d in zip(zs, density, strict=True)]


def group_shock(tickets: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """Group-shock grid: (sigma, zero_rate, gap), smallest gap first.

    The chance that a sale stays away is, given its shock, a product over its tickets, so
    without it an integral over one normal variable, which is summed at fixed nodes. It
    depends only on the multiset of probabilities: equal multisets are one class.
    """
    grid = grid or [i * 0.25 for i in range(13)]
    sales = tickets.groupBy("sale_id").agg(
        F.array_sort(F.collect_list(logit(F.col("p")))).alias("lps"), F.max(F.col("y").cast("int")).alias("any_in")
    ).filter(F.size("lps") >= 2)
    classes = sales.groupBy("lps").agg(
        F.min("sale_id").alias("sale_id"), F.count(F.lit(1)).alias("weight"), F.count_if(F.col("any_in") == 0).alias("away")
    ).filter(F.col("sale_id").isNotNull())
    # a class is summed over all nodes where it is, and leaves nothing but its part of the totals
    names = [f"g{i}" for i in range(len(grid))]
    parts = classes.select("lps", "weight", "away").mapInArrow(_stayed([float(s) for s in grid]), ", ".join(f"{c} double" for c in (*names, "weight", "away")))
    weighted = parts.agg(*[(F.sum(c) / F.sum("weight")).alias(c) for c in names], (F.sum("away") / F.sum("weight")).alias("observed"))
    pairs = F.array(*[F.struct(F.lit(float(s)).alias("sigma"), F.col(f"g{i}").alias("zero_rate")) for i, s in enumerate(grid)])
    rates = weighted.select("observed", F.explode(pairs).alias("r")).select("r.*", "observed").filter(F.col("zero_rate").isNotNull())
    gap = F.abs(F.col("zero_rate") - F.col("observed"))
    return rates.select("sigma", "zero_rate", gap.alias("gap")).orderBy(F.round("gap", 12), "sigma")


_MEMBERS = 256  # tickets whose chances at all nodes are held at once; a sale with more is multiplied up by parts


def _stayed(grid: list[float]):
    """Sums over classes of sales, for each sigma: the chance that nobody comes, times the weight; then the weights and those away."""
    nodes = normal_nodes()
    z, w = (np.array(x) for x in zip(*nodes, strict=True))
    shift = np.exp(np.outer(grid, z)).ravel()
    low, high = math.exp(-30.0), math.exp(30.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(0)
            size = np.diff(lists.offsets.to_numpy())
            odds = np.exp(lists.flatten().to_numpy())
            of = np.repeat(np.arange(b.num_rows), size)
            weight, total = b.column(1).to_numpy().astype(float), np.zeros(len(grid))
            first, stay = 0, None  # the chances of the class that the last part may have cut
            for lo in range(0, len(odds), _MEMBERS):
                at = of[lo : lo + _MEMBERS]
                chance = 1.0 / (1.0 + np.clip(odds[lo : lo + _MEMBERS, None] * shift, low, high))
                starts = np.flatnonzero(np.diff(at, prepend=-1))
                product = np.multiply.reduceat(chance, starts, axis=0)
                if stay is not None and at[0] == first:
                    product[0] *= stay
                elif stay is not None:
                    total += weight[first] * (stay.reshape(len(grid), len(w)) @ w)
                done = product[:-1].reshape(len(starts) - 1, len(grid), len(w)) @ w
                total += weight[at[starts[:-1]]] @ done
                first, stay = at[-1], product[-1]
            total += weight[first] * (stay.reshape(len(grid), len(w)) @ w)
            sums = [*total, weight.sum(), float(b.column(2).to_numpy().sum())]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], [*(f"g{i}" for i in range(len(grid))), "weight", "away"])

    return run


def chosen_group_sigma(tickets: DataFrame, **kw) -> float:
    """0 when no sale has two tickets."""
    first = group_shock(tickets, **kw).limit(1).collect()
    return float(first[0]["sigma"]) if first else 0.0


def back_test(scored: DataFrame, shock: DataFrame, n_sim: int = 4000, seed: int = SEED,
              sigma_group: float = 0.0, each: bool = False) -> DataFrame:
    """Per past show: interval from held-out probabilities against what happened."""
    iv = intervals(scored, show_sigmas(scored, shock), n_sim, seed, sigma_group, each=each)
    facts = scored.groupBy("event_id").agg(
        F.sum(F.col("y").cast("int")).alias("obs"), F.avg(F.col("is_courtesy").cast("int")).alias("courtesy_share")
    )
    edges, labels = MIX_BANDS
    return iv.join(facts, "event_id").withColumns(
        {
            "inside": F.col("obs").between(F.col("p10"), F.col("p90")),
            "width": F.col("p90") - F.col("p10"),
            "band": band(F.col("courtesy_share"), edges, labels),
        }
    )


def coverage_by_band(tested: DataFrame) -> DataFrame:
    """Coverage and width overall and per mix band."""
    return tested.rollup("band").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.avg(F.col("inside").cast("double")).alias("coverage"),
        F.avg("width").alias("width"),
        F.grouping("band").alias("overall"),
    ).filter((F.col("overall") == 1) | F.col("band").isNotNull()).select(
        F.coalesce("band", F.lit("all")).alias("band"), "n_events", "coverage", "width"
    )


def interval_kinds(tested: DataFrame) -> DataFrame:
    """The simulated interval beside three naive ones, as (kind, lo, hi, obs) rows."""
    m = F.col("expected")
    kinds = F.array(
        F.struct(F.lit("simulated").alias("kind"), F.col("p10").alias("lo"), F.col("p90").alias("hi")),
        F.struct(F.lit("zero_to_sold").alias("kind"), F.lit(0.0).alias("lo"), F.col("n").cast("double").alias("hi")),
        F.struct(F.lit("half").alias("kind"), (m * 0.5).alias("lo"), (m * 1.5).alias("hi")),
        F.struct(F.lit("fifth").alias("kind"), (m * 0.8).alias("lo"), (m * 1.2).alias("hi")),
    )
    return tested.select("obs", F.explode(kinds).alias("k")).select("k.*", "obs")


def forecast(tickets: DataFrame, sigmas: DataFrame, n_sim: int = 20000, seed: int = SEED,
             sigma_group: float = 0.0) -> DataFrame:
    """Forecast detail per show, rounded as delivered."""
    iv = intervals(tickets, sigmas, n_sim, seed, sigma_group)
    facts = forecast_facts(tickets)
    return iv.select("event_id", "p10", "p90").join(facts, "event_id").select(
        "event_id",
        "expected_attendance",
        F.bround("p10", 0).cast("int").alias("p10"),
        F.bround("p90", 0).cast("int").alias("p90"),
        "artist_name",
        "n_tickets",
        "n_courtesy",
        "courtesy_share",
        "n_linked",
        "expected_rate",
    )


def forecast_facts(tickets: DataFrame) -> DataFrame:
    """What the forecast needs besides its interval."""
    return tickets.groupBy("event_id").agg(
        F.bround(F.sum("p"), 0).cast("int").alias("expected_attendance"),
        F.first("artist_name").alias("artist_name"),
        F.count(F.lit(1)).alias("n_tickets"),
        F.count_if("is_courtesy").alias("n_courtesy"),
        F.bround(F.avg(F.col("is_courtesy").cast("int")), 4).alias("courtesy_share"),
        (F.count_if("linked") if "linked" in tickets.columns else F.lit(0).cast("bigint")).alias("n_linked"),
        F.bround(F.avg("p"), 4).alias("expected_rate"),
    )
