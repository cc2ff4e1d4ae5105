"""From forecast to decision: whom to invite, what the other levers bring, and how
many tickets can still be sold."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnout.functions.hashing import uniform
from turnout.operators import history as H
from turnout.operators.draws import crossings
from turnout.operators.ordered import running
from turnout.operators.rates import observed_rates
from turnout.operators.simulate import SEED, counted, expected, sim_coefficients
from turnout.session import compute_partitions, frozen, lookup

# Fixed values of the levers.
INVITE_MIN_HISTORY = 2
INVITE_MIN_P = 0.50
CONVERT_MAX = 100
CONVERT_KEEP = 0.7
WEAK_CHANNELS = ["RRPP", "ADMIN"]
RISK = 0.05
MAX_EXTRA = 4000

_RANK_BLOCK = 256


def seats(forecast: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, artist_name, expected_attendance, capacity, free) per upcoming show."""
    cap = events.select("event_id", F.coalesce("capacity", F.lit(0)).alias("capacity"))
    return forecast.select("event_id", "artist_name", "expected_attendance").join(cap, "event_id").withColumn(
        "free", F.greatest(F.lit(0), F.col("capacity") - F.col("expected_attendance"))
    )


def eligible_users(users: DataFrame, history: DataFrame, as_of: str) -> DataFrame:
    """Users with enough history today, with that history."""
    stats = H.at_cut(history, as_of).filter(F.col("n_minimum") >= INVITE_MIN_HISTORY)
    return users.select("user_id", "city", "has_membership").join(stats, "user_id")


def holders(features: DataFrame) -> DataFrame:
    """Distinct (event_id, user_id) already holding a ticket."""
    return features.filter(F.col("user_id").isNotNull()).select("event_id", "user_id").distinct()


def hypothetical_tickets(pairs: DataFrame, events: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """A courtesy per (event_id, user_id) pair, with every column a model may read."""
    e = events.select("event_id", "artist_id", "artist_name", "month", "starts_at", "capacity", "venue",
                      F.col("city").alias("e_city"), "is_residency", "is_paid", "weekday")
    days = (F.unix_micros(F.col("starts_at").cast("timestamp")) - F.unix_micros(F.lit(as_of).cast("timestamp"))) / F.lit(86400e6)
    return pairs.join(e, "event_id").join(users, "user_id").select(
        F.concat(F.lit("sim_"), F.col("event_id").cast("string"), F.lit("_"), F.col("user_id").cast("string")).alias("ticket_id"),
        F.lit("sim").alias("sale_id"), "event_id", "artist_id", "artist_name", "month",
        F.lit("Cortesía").alias("ticket_type"), F.lit(True).alias("is_courtesy"), F.lit(0.0).alias("price"),
        F.lit("WEB").alias("channel"), F.lit(1).alias("qty"), F.greatest(F.lit(0.0), days).alias("lead_days"),
        "starts_at", "capacity", "venue", F.col("e_city").alias("city"), "is_residency", "is_paid", "weekday",
        F.lit(0).alias("iso_week"), F.lit(None).cast("boolean").alias("y"), F.lit(False).alias("labelled"),
        F.lit(True).alias("linked"), "user_id", F.lit(1.0).alias("confidence"),
        "n_history", "rate_history", "n_minimum", "rate_minimum", "n_membership", "rate_membership",
        "has_membership", (F.col("city") == F.col("e_city")).alias("same_city"),
    )


def invite_candidates(
    eligible: DataFrame,
    shows: DataFrame,
    held: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    min_p: float = INVITE_MIN_P,
    reads: list[str] | None = None,
) -> DataFrame:
    """The people to invite to each show, best first, just enough to fill its free seats.

    `shows` has event_id, city, free. `score` adds `p` to (event_id, user_id) pairs, where
    p may depend on the show and on any column of `eligible` but user_id, in any way.
    `reads` names those it depends on besides the city; without it all count. Users of a city
    with the same such columns form a cell, and one of them is scored for it: a score costs
    shows times cells, which grows with the product of shows and users only if all users
    differ to it. A show takes its cells by falling p. Every invitation counts at least `min_p`, so
    free / min_p + 1 of them suffice, plus as many as there are local ticket holders to
    skip: no cell has to give more of its users, and none is read after the cells before
    it have filled the show. What is left is ranked one by one.
    """
    traits = [c for c in eligible.columns if c != "user_id"] if reads is None else ["city", *reads]
    ranked = running(eligible.select("user_id", F.xxhash64(*traits).alias("cell"), "city"), [F.col("user_id")], by=["cell"], rank="cell_rank")
    members = ranked.drop("cell_rank")
    cells = members.groupBy("cell").agg(F.min("user_id").alias("user_id"), F.first("city").alias("city"), F.count(F.lit(1)).alias("n"))
    local_held = (
        held.join(members, "user_id")
        .join(shows.select("event_id", "city"), ["event_id", "city"])
        .groupBy("event_id")
        .agg(F.count(F.lit(1)).alias("n_held"))
    )
    need = shows.filter("free > 0").join(local_held, "event_id", "left").select(
        "event_id", "city", "free", F.coalesce("n_held", F.lit(0)).alias("n_held"),
        (F.ceil(F.col("free") / F.lit(min_p)) + 1 + F.coalesce("n_held", F.lit(0))).alias("need"),
    )
    tried = need.join(cells, "city").select("event_id", "user_id", "cell", "n", "free", "n_held", "need")
    p = score(tried.select("event_id", "user_id")).select("event_id", "user_id", "p")
    good = frozen(tried.join(p, ["event_id", "user_id"]).filter(F.col("p") >= min_p).drop("user_id"))
    # all users of a level may be invited before those of the next; holders among them don't fill seats
    levels = good.groupBy("event_id", "p").agg(F.sum("n").alias("level_n"), F.first("need").alias("need"))
    upto = running(levels, [F.desc("p")], by=["event_id"], sums={"upto": "level_n"})
    open_levels = upto.filter(F.col("upto") - F.col("level_n") < F.col("need")).select("event_id", "p")
    blocks = good.join(open_levels, ["event_id", "p"]).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.least("need", "n") / _RANK_BLOCK)))
    )
    by_block = ranked.withColumn("block", F.floor((F.col("cell_rank") - 1) / _RANK_BLOCK)).drop("city")
    pairs = (
        blocks.join(by_block, ["cell", "block"])
        .filter(F.col("cell_rank") <= F.col("need"))
        .select("event_id", "user_id", "free", "p")
        .join(held, ["event_id", "user_id"], "left_anti")
    )
    taken = running(pairs, [F.desc("p"), F.col("user_id")], by=["event_id"], rank="place", sums={"cum": "p"})
    return taken.filter(F.col("cum") - F.col("p") < F.col("free")).select(
        "event_id", "user_id", "free", "p", "place", "cum"
    )


def invite_lever(chosen: DataFrame, shows: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    agg = chosen.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("reach"), F.sum("p").alias("sum_p"), F.avg("p").alias("mean_p")
    )
    margin = (F.unix_micros(F.col("starts_at").cast("timestamp")) - F.unix_micros(F.lit(as_of).cast("timestamp"))) / F.lit(86400e6)
    return (
        shows.select("event_id", "free").join(agg, "event_id", "left")
        .join(events.select("event_id", "starts_at"), "event_id")
        .select(
            "event_id",
            F.lit("invitar").alias("lever"),
            F.lit("fuerte").alias("strength"),
            F.least(F.coalesce("sum_p", F.lit(0.0)), F.col("free").cast("double")).alias("impact"),
            F.coalesce("reach", F.lit(0).cast("bigint")).alias("reach"),
            F.coalesce("mean_p", F.lit(0.0)).alias("mean_p"),
            F.bround(F.greatest(F.lit(0.0), margin), 1).alias("days_margin"),
        )
    )


def channel_lever(tickets: DataFrame, shows: DataFrame, labelled: DataFrame) -> DataFrame:
    """Upper bound of moving weak-channel courtesies to the box office."""
    rates = frozen(observed_rates(labelled))  # a handful of rows, read several times
    pick = lambda k: rates.filter(F.col("rate_key") == k).select("rate").scalar()
    weak = (
        tickets.filter(F.col("is_courtesy") & F.col("channel").isin(WEAK_CHANNELS))
        .groupBy("event_id", "channel").agg(F.count(F.lit(1)).alias("n"))
        .join(rates.withColumnRenamed("rate_key", "channel"), "channel", "left")
        .withColumn("rate", F.coalesce("rate", pick("WEB")))
        .groupBy("event_id")
        .agg(F.sum("n").alias("reach"), F.sum(F.col("n") * F.col("rate")).alias("current"))
        .withColumn("impact", F.col("reach") * pick("BOX_OFFICE") - F.col("current"))
    )
    return shows.select("event_id").join(weak, "event_id", "left").select(
        "event_id", F.lit("canal").alias("lever"), F.lit("débil").alias("strength"),
        F.when(F.col("reach").isNull(), F.lit(0.0)).otherwise(F.col("impact")).alias("impact"),
        F.coalesce("reach", F.lit(0).cast("bigint")).alias("reach"),
    )


def convert_lever(tickets: DataFrame, shows: DataFrame, labelled: DataFrame) -> DataFrame:
    """Turning up to 100 courtesies into paid tickets, keeping 70 % of the observed gap."""
    rates = frozen(observed_rates(labelled))  # a handful of rows, read several times
    pick = lambda k: rates.filter(F.col("rate_key") == k).select("rate").scalar()
    n = tickets.filter("is_courtesy").groupBy("event_id").agg(
        F.least(F.count(F.lit(1)), F.lit(CONVERT_MAX)).alias("reach")
    )
    gap = pick("pagada") - pick("cortesia")
    return shows.select("event_id").join(n, "event_id", "left").select(
        "event_id", F.lit("convertir").alias("lever"), F.lit("medio").alias("strength"),
        F.coalesce(F.col("reach") * gap * F.lit(CONVERT_KEEP), F.lit(0.0)).alias("impact"),
        F.coalesce("reach", F.lit(0).cast("bigint")).alias("reach"),
    )


def actions(invite: DataFrame, channel: DataFrame, convert: DataFrame, shows: DataFrame) -> DataFrame:
    """Three levers per show with its seats, strongest first (ties keep invite, channel, convert)."""
    cols = ["event_id", "lever", "strength", "impact", "reach"]
    stacked = (
        invite.select(*cols, F.lit(1).alias("ord"))
        .unionByName(channel.select(*cols, F.lit(2).alias("ord")))
        .unionByName(convert.select(*cols, F.lit(3).alias("ord")))
    )
    place = Window.partitionBy("event_id").orderBy(F.desc("impact"), "ord")  # three rows
    return shows.join(stacked.withColumn("place", F.row_number().over(place)), "event_id").select(
        "event_id", "artist_name", F.col("expected_attendance"), "capacity", "free", "place",
        "lever", "strength", F.bround("impact", 1).alias("impact"), "reach",
    )


def top_invites(acts: DataFrame, k: int = 5) -> DataFrame:
    return acts.filter(F.col("lever") == "invitar").orderBy(F.desc("impact"), "event_id").limit(k)


def picks(shows: DataFrame, max_extra: int, seed: int) -> DataFrame:
    """(event_id, n, j, pos): the hashed ticket whose probability extra ticket j of a show takes."""
    # the table of shows is one small file; what it unfolds into needs all cores
    spread = shows.select("event_id", "n").repartition(compute_partitions(shows.sparkSession), "event_id")
    return spread.select("event_id", "n", F.explode(F.sequence(F.lit(1), F.lit(max_extra))).alias("j")).withColumn(
        "pos", F.floor(uniform(F.lit(seed), F.lit("pick"), F.col("event_id"), F.col("j")) * F.col("n")) + 1
    )


def overbooking(
    tickets: DataFrame,
    sigmas: DataFrame,
    events: DataFrame,
    n_sim: int = 6000,
    risk: float = RISK,
    max_extra: int = MAX_EXTRA,
    seed: int = SEED,
) -> DataFrame:
    """Extra tickets that keep P(attendance > capacity) within `risk`, for all shows at once.

    Extra ticket j of a show takes the probability of a hashed ticket of the same show and
    keeps its draw, so adding tickets only adds arrivals. The answer is one less than the
    first level above the limit. A show is one row, with its counts by simulation and the
    probabilities of its extra tickets; a task reads its levels one by one. `capped` says
    that no level up to `max_extra`, which is then the answer, is above the limit.
    """
    cap = events.select("event_id", F.coalesce("capacity", F.lit(0)).alias("capacity"))
    live = frozen(expected(tickets).join(cap, "event_id").join(sigmas.select("event_id", "sigma"), "event_id"))
    usable = live.filter("capacity > 0")
    base = counted(tickets.join(usable.select("event_id"), "event_id", "left_semi"), sigmas, n_sim, seed)
    ranked = running(tickets.select("event_id", "ticket_id", "p"), [F.col("ticket_id")], by=["event_id"], rank="pos")
    # what a show unfolds into is far larger than the planner takes it for, so none of it may be broadcast;
    # picks come placed by event_id, and what one ticket is picked for is gathered before it moves
    wanted = picks(usable, max_extra, seed).groupBy("event_id", "pos").agg(F.collect_list("j").alias("js")).hint("merge")
    taken = wanted.join(ranked.select("event_id", "pos", "p").hint("merge"), ["event_id", "pos"])
    of_j = F.flatten(F.transform(F.collect_list(F.struct("js", "p")), lambda x: F.transform(x["js"], lambda j: F.struct(j.alias("j"), x["p"].alias("p")))))
    extra = taken.groupBy("event_id").agg(F.transform(F.array_sort(of_j), lambda x: x["p"]).alias("extra"))
    arrays = base.hint("merge").join(extra.hint("merge"), "event_id")
    shows = arrays.join(lookup(usable.select("event_id", "capacity", "expected", "sigma")), "event_id")
    at = frozen(crossings(shows, sim_coefficients(tickets.sparkSession, n_sim, seed), risk))
    facts = tickets.groupBy("event_id").agg(
        F.first("artist_name").alias("artist_name"),
        F.bround(F.avg(F.col("is_courtesy").cast("int")), 3).alias("courtesy_share"),
    )
    extra_n = (
        F.when((F.col("capacity") <= 0) | (F.col("risk_now") > risk), F.lit(0))
        .when(F.col("stop").isNotNull(), F.col("stop") - 1)
        .otherwise(F.lit(max_extra))
    )
    return live.join(facts, "event_id").join(at, "event_id", "left").select(
        "event_id", "artist_name", "capacity", F.col("n").alias("n_tickets"),
        F.bround("expected", 0).cast("int").alias("expected_attendance"),
        "courtesy_share", extra_n.cast("int").alias("extra"),
        F.bround(F.coalesce("risk_now", F.lit(0.0)), 4).alias("risk_now"),
        F.bround("risk_before", 4).alias("risk_at_extra"),
        F.bround("risk_at", 4).alias("risk_at_next"),
        (F.col("stop").isNull() & (F.col("capacity") > 0) & (F.col("risk_now") <= risk)).alias("capped"),
    )


def top_overbooking(ob: DataFrame, k: int = 10) -> DataFrame:
    return ob.orderBy(F.desc("extra"), "event_id").limit(k)
