"""One row per ticket: what was known about it before the show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.functions.scalars import denan, iso_week, lead_days
from turnout.operators import history as H
from turnout.session import stored
from turnout.sources.tables import Tables

COURTESY = "Cortesía"

STATS = ["n_history", "rate_history", "n_minimum", "rate_minimum", "n_membership", "rate_membership"]
EVENT_COLUMNS = ["starts_at", "capacity", "venue", "city", "is_residency", "is_paid", "weekday"]


def ticket_base(t: Tables, as_of: str, facts: DataFrame | None = None) -> DataFrame:
    """Ticket x sale x show, with the label and the calendar week; `facts` of a sale, if any, come along."""
    shows = t.events.select("event_id", "artist_id", "artist_name", "month", *EVENT_COLUMNS)
    sales = t.sales.select("sale_id", "channel", "qty", "purchased_at")
    if facts is not None:
        sales = sales.join(facts, "sale_id", "left")
    tickets = t.tickets.select("ticket_id", "sale_id", "event_id", "ticket_type", "price", "checked_in")
    # shows come last: their columns, the widest, are not shuffled with the tickets of a sale
    joined = tickets.join(sales, "sale_id").join(shows, "event_id")
    return joined.select(
        "ticket_id",
        "sale_id",
        "event_id",
        "artist_id",
        "artist_name",
        "month",
        "ticket_type",
        (F.col("ticket_type") == COURTESY).alias("is_courtesy"),
        F.coalesce(denan(F.col("price").cast("double")), F.lit(0.0)).alias("price"),
        "channel",
        "qty",
        lead_days(F.col("starts_at"), F.col("purchased_at")).alias("lead_days"),
        F.least(F.col("starts_at").cast("timestamp"), F.lit(as_of).cast("timestamp")).alias("cut"),
        *EVENT_COLUMNS,
        iso_week(F.col("starts_at")).alias("iso_week"),
        F.col("checked_in").alias("y"),
        F.col("checked_in").isNotNull().alias("labelled"),
        *([c for c in facts.columns if c != "sale_id"] if facts is not None else []),
    )


def histories(t: Tables, links: DataFrame, as_of: str) -> DataFrame:
    """(sale_id, user_id, confidence, u_member, u_city, known): the user of a linked sale, with an array of what was known of it at each cut of its tickets."""
    matched = links.filter(F.col("user_id").isNotNull()).select("sale_id", "user_id", "confidence")
    cut = F.least(F.col("starts_at").cast("timestamp"), F.lit(as_of).cast("timestamp")).alias("cut")
    asked = t.tickets.select("sale_id", "event_id").join(matched, "sale_id").join(t.events.select("event_id", "starts_at"), "event_id")
    asked = stored(asked.select("sale_id", "user_id", "confidence", cut).distinct())  # read several times
    stats = H.as_of(asked, t.history)
    users = t.users.select("user_id", F.col("has_membership").alias("u_member"), F.col("city").alias("u_city"))
    facts = F.struct("cut", *STATS).alias("fact")
    return asked.join(stats, ["user_id", "cut"], "left").join(users, "user_id", "left").groupBy("sale_id").agg(
        *[F.first(c).alias(c) for c in ("user_id", "confidence", "u_member", "u_city")], F.collect_list(facts).alias("known")
    )


def ticket_features(t: Tables, links: DataFrame, as_of: str) -> DataFrame:
    """`ticket_base` plus the linked user's history as of the show, or as of today.

    Histories are brought to the sale, as an array with an entry for each cut of its tickets, so
    that tickets move once, by sale, whether linked or not.
    """
    facts = stored(histories(t, links, as_of))  # its shuffles are gone before tickets move
    base = ticket_base(t, as_of, facts)
    joined = base.withColumn(
        "at", F.try_element_at(F.filter("known", lambda x: x["cut"].eqNullSafe(F.col("cut"))), F.lit(1)))
    zero = F.lit(0).cast("bigint")
    return joined.select(
        *[c for c in base.columns if c not in facts.columns or c == "sale_id"],
        F.col("user_id").isNotNull().alias("linked"),
        "user_id",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("at.n_history", zero).alias("n_history"),
        "at.rate_history",
        F.coalesce("at.n_minimum", zero).alias("n_minimum"),
        "at.rate_minimum",
        F.coalesce("at.n_membership", zero).alias("n_membership"),
        "at.rate_membership",
        F.coalesce("u_member", F.lit(False)).alias("has_membership"),
        F.coalesce(F.col("u_city") == F.col("city"), F.lit(False)).alias("same_city"),
    )
