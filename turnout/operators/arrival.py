"""When people arrive, and how many staff the door needs for the peak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnout.functions.scalars import bin_label, minute_bin

# Bin width, minutes per check, planned utilisation, opening hours.
BIN = 15
MINUTES_PER_PERSON = 0.25
UTILISATION = 0.7
HOURS_BEFORE = 6
HOURS_AFTER = 3


def arrival_curve(tickets: DataFrame, events: DataFrame) -> DataFrame:
    """Share of check-ins per 15-minute bin around the start: (minute, n, fraction)."""
    # who did not come is a bin of its own that is dropped at the end: a filter would be
    # pushed below the join and repeat the expressions behind both columns
    came = F.coalesce("checked_in", F.lit(False)) & F.col("checked_in_at").isNotNull()
    bins = (
        tickets.select("event_id", F.when(came, F.col("checked_in_at")).alias("at"))
        .join(events.select("event_id", "starts_at"), "event_id")
        .select("at", minute_bin(F.col("at"), F.col("starts_at"), BIN).alias("minute"))
        .groupBy("minute")
        .agg(F.count("at").alias("n"))
        .filter("n > 0")
    )
    # the bins are few: their number depends on opening hours, not on tickets
    return bins.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def arrival_profile(expected: DataFrame, curve: DataFrame) -> DataFrame:
    """Expected people per show and bin, with the running total.

    `expected` has event_id and expected_attendance; every show gets every bin.
    """
    bins = curve.agg(F.sort_array(F.collect_list(F.struct("minute", "fraction"))).alias("bins"))
    shown = expected.select(
        "event_id", "expected_attendance", F.explode(bins.scalar()).alias("b")
    ).select("event_id", "expected_attendance", "b.minute", "b.fraction")
    people = shown.withColumn("people", F.col("expected_attendance") * F.col("fraction"))
    upto = Window.partitionBy("event_id").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    return people.select(
        "event_id",
        "minute",
        bin_label(F.col("minute")).alias("label"),
        "fraction",
        "people",
        F.sum("people").over(upto).alias("running"),
    )


def staff_for(peak: Column) -> Column:
    return F.greatest(
        F.lit(1), F.ceil(peak * F.lit(MINUTES_PER_PERSON) / F.lit(BIN * UTILISATION))
    ).cast("int")


def door_staffing(expected: DataFrame, curve: DataFrame) -> DataFrame:
    """Peak bin (first on ties) and staff per show; one person when there is no curve."""
    profile = arrival_profile(expected, curve)
    peak = profile.groupBy("event_id").agg(
        F.max_by(F.struct("people", "label", "minute"), F.struct("people", -F.col("minute"))).alias("k")
    )
    return expected.select("event_id").join(peak, "event_id", "left").select(
        "event_id",
        F.coalesce("k.people", F.lit(0.0)).alias("peak"),
        F.col("k.label").alias("peak_label"),
        F.col("k.minute").alias("peak_minute"),
        staff_for(F.coalesce("k.people", F.lit(0.0))).alias("staff"),
    )


def door_state(now: Column, starts_at: Column) -> Column:
    opens = starts_at - F.expr(f"INTERVAL {HOURS_BEFORE} HOURS")
    closes = starts_at + F.expr(f"INTERVAL {HOURS_AFTER} HOURS")
    return F.when(now < opens, "BEFORE").when(now < closes, "DOOR").otherwise("EXPIRED")


def door_warning(share: Column, now: Column, starts_at: Column) -> Column:
    days = F.greatest(
        F.lit(0), F.floor((F.unix_micros(starts_at) - F.unix_micros(now)) / F.lit(86400e6))
    )
    return F.when(share >= 0.5, "mix").when(
        now < starts_at - F.expr(f"INTERVAL {HOURS_BEFORE} HOURS"), F.concat(days.cast("string"), F.lit(" days left"))
    ).otherwise("")


def door_sheet(forecast: DataFrame, events: DataFrame, curve: DataFrame, now: str) -> DataFrame:
    """One row per upcoming show, in date order."""
    at = F.lit(now).cast("timestamp")
    start = F.col("starts_at").cast("timestamp")
    shows = events.select("event_id", "title", "venue", "city", "starts_at")
    return (
        forecast.join(shows, "event_id")
        .join(door_staffing(forecast, curve), "event_id")
        .select(
            "event_id",
            "title",
            "artist_name",
            "venue",
            "city",
            "starts_at",
            (start - F.expr(f"INTERVAL {HOURS_BEFORE} HOURS")).alias("opens_at"),
            (start + F.expr(f"INTERVAL {HOURS_AFTER} HOURS")).alias("expires_at"),
            door_state(at, start).alias("state"),
            "expected_attendance",
            "p10",
            "p90",
            "n_tickets",
            "courtesy_share",
            "staff",
            "peak",
            "peak_label",
            door_warning(F.col("courtesy_share"), at, start).alias("warning"),
        )
        .orderBy("starts_at", "event_id")
    )
