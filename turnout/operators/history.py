"""Point-in-time (as-of) counts of a user's earlier tickets.

The cuts are few compared with the history: each history row is first assigned to
the earliest cut at or after it, counts per (user, cut) are combined before the
shuffle, and a running total over cuts answers every probe. A user holding a third
of the history collapses to one row per cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnout.operators.ordered import running
from turnout.session import frozen

# The two ticket types whose history counts.
COUNTED_TYPES = {"minimum": "consumo_minimo", "membership": "membresia"}

_STEP = 3600  # seconds per calendar slot


def _slot(ts):
    return F.floor(F.unix_micros(ts) / F.lit(_STEP * 1_000_000)).cast("bigint")


def cut_calendar(cuts: DataFrame, changes: DataFrame) -> DataFrame:
    """For each hour in which a change falls: the cuts inside it, and the next one after.

    Only hours with a change or a cut appear, whatever time they span. The next cut is
    found by its number: cuts are counted up to each hour by a distributed running sum.
    """
    at = cuts.select("cut").distinct().withColumn("slot", _slot(F.col("cut")))
    inside = frozen(at.groupBy("slot").agg(F.sort_array(F.collect_set("cut")).alias("inside")))
    asked = changes.select(_slot(F.col("ts")).alias("slot")).distinct().withColumn("c", F.lit(0))
    marks = running(asked.unionByName(inside.select("slot", F.lit(1).alias("c"))), [F.col("slot"), F.desc("c")], sums={"k": "c"})
    # the running sum at an hour with cuts is that hour's number
    ordered = marks.filter("c = 1").select("slot", F.col("k").alias("ix")).join(inside, "slot").select("ix", F.get("inside", F.lit(0)).alias("next"))
    return (
        marks.filter("c = 0").select("slot", (F.col("k") + 1).alias("ix"))
        .join(ordered, "ix", "left").join(inside, "slot", "left").select("slot", "inside", "next")
    )


def _changes(history: DataFrame) -> DataFrame:
    """(user, time, type, bought, used): +1 when bought, +1 when used."""
    known = history.filter(F.col("type").isin(list(COUNTED_TYPES.values())))
    pair = F.array(
        F.struct(F.col("created_at").alias("ts"), F.lit(1).alias("bought"), F.lit(0).alias("used")),
        F.struct(
            F.when(F.col("used"), F.col("date_used")).alias("ts"), F.lit(0).alias("bought"), F.lit(1).alias("used")
        ),
    )
    return (
        known.select("user_id", "type", F.explode(pair).alias("c"))
        .select("user_id", "type", F.col("c.ts").cast("timestamp").alias("ts"), "c.bought", "c.used")
        .filter(F.col("ts").isNotNull())
    )


def _sums(prefix: str = ""):
    out = []
    for name, value in COUNTED_TYPES.items():
        is_type = F.col("type") == value
        out.append(F.sum(F.when(is_type, F.col("bought")).otherwise(0)).alias(f"n_{name}"))
        out.append(F.sum(F.when(is_type, F.col("used")).otherwise(0)).alias(f"u_{name}"))
    return out


_COUNTS = [f"{k}_{name}" for name in COUNTED_TYPES for k in ("n", "u")]


def _rates(df: DataFrame) -> DataFrame:
    """Clamp uses to purchases and derive rates; NULL rate without purchases."""
    out = df
    for name in COUNTED_TYPES:
        n, u = F.col(f"n_{name}"), F.least(F.col(f"u_{name}"), F.col(f"n_{name}"))
        out = out.withColumn(f"u_{name}", u).withColumn(
            f"rate_{name}", F.when(n > 0, F.col(f"u_{name}") / n)
        )
    n_all = sum((F.col(f"n_{x}") for x in COUNTED_TYPES), F.lit(0))
    u_all = sum((F.col(f"u_{x}") for x in COUNTED_TYPES), F.lit(0))
    return out.withColumn("n_history", n_all.cast("bigint")).withColumn(
        "rate_history", F.when(n_all > 0, u_all / n_all)
    )


def as_of(probes: DataFrame, history: DataFrame, user: str = "user_id", cut: str = "cut") -> DataFrame:
    """Counts and rates for each distinct (user, cut) of `probes`; the cut is inclusive."""
    asked = probes.select(F.col(user).alias("user_id"), F.col(cut).cast("timestamp").alias("cut")).filter(
        F.col("user_id").isNotNull() & F.col("cut").isNotNull()
    ).distinct()
    cuts = probes.select(F.col(cut).cast("timestamp").alias("cut")).filter(F.col("cut").isNotNull())
    ends = cuts.agg(F.min("cut").alias("first"), F.max("cut").alias("last"))
    first, last = ends.select("first").scalar(), ends.select("last").scalar()
    changes = _changes(history).filter(F.col("ts") <= last)
    # most of a history is older than the first cut and needs no calendar
    old = changes.filter(F.col("ts") <= first).withColumn("cut", first)
    late = changes.filter(F.col("ts") > first)
    placed = (
        late.withColumn("slot", _slot(F.col("ts")))
        .join(cut_calendar(cuts, late), "slot")
        .withColumn("cut", F.coalesce(F.get(F.filter(F.col("inside"), lambda c: c >= F.col("ts")), F.lit(0)), F.col("next")))
        .filter(F.col("cut").isNotNull())
        .select(*old.columns)
        .unionByName(old)
    )
    per_cut = placed.groupBy("user_id", "cut").agg(*_sums())
    zero = asked.select("user_id", "cut", *[F.lit(0).cast("bigint").alias(c) for c in _COUNTS])
    merged = (
        per_cut.withColumn("asked", F.lit(False))
        .unionByName(zero.withColumn("asked", F.lit(True)))
        .groupBy("user_id", "cut")
        .agg(F.max("asked").alias("asked"), *[F.sum(c).alias(c) for c in _COUNTS])
    )
    # rows per user are at most the number of distinct cuts
    upto = Window.partitionBy("user_id").orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)
    totals = merged.select("user_id", "cut", "asked", *[F.sum(c).over(upto).alias(c) for c in _COUNTS])
    return _rates(totals.filter("asked").drop("asked"))


def at_cut(history: DataFrame, cut: str) -> DataFrame:
    """The same counts for every user with history, at one common cut."""
    upto = _changes(history).filter(F.col("ts") <= F.lit(cut).cast("timestamp"))
    return _rates(upto.groupBy("user_id").agg(*_sums()))
