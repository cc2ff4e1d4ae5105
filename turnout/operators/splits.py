"""Splits that never cut a show in two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.functions.hashing import hash31
from turnout.operators.ordered import equal_count_bins

# ISO weeks of each part in the original season.
WEEKS = {"train": (27, 28), "val": (29,), "test": (30, 31)}
SEED = 20260801


def with_split(df: DataFrame, weeks: dict[str, tuple[int, ...]] | None = None) -> DataFrame:
    """Labelled rows with their part; rows of other weeks get a NULL part."""
    part = None
    for name, ws in (weeks or WEEKS).items():
        cond = F.col("iso_week").isin(list(ws))
        part = F.when(cond, name) if part is None else part.when(cond, name)
    return df.filter(F.col("y").isNotNull()).withColumn("split", part)


def leaks(parts: DataFrame) -> DataFrame:
    """Shows found in more than one part."""
    return (
        parts.filter(F.col("split").isNotNull())
        .groupBy("event_id")
        .agg(F.sort_array(F.collect_set("split")).alias("splits"))
        .filter(F.size("splits") > 1)
    )


def require_no_leak(parts: DataFrame) -> DataFrame:
    bad = leaks(parts).limit(1).collect()
    if bad:
        raise AssertionError(f"leak: event {bad[0]['event_id']} is in {list(bad[0]['splits'])}")
    return parts


def temporal_split(df: DataFrame, weeks=None) -> DataFrame:
    """`with_split` after the leak check, without rows outside the parts."""
    return require_no_leak(with_split(df, weeks)).filter(F.col("split").isNotNull())


def split_summary(parts: DataFrame) -> DataFrame:
    return parts.filter(F.col("split").isNotNull()).groupBy("split").agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_set("iso_week")), lambda w: w.cast("string"))).alias("weeks"),
        F.countDistinct("event_id").alias("n_events"),
        F.count(F.lit(1)).alias("n_tickets"),
        F.round(F.avg(F.col("is_courtesy").cast("int")), 3).alias("courtesy_share"),
        F.round(F.avg(F.col("y").cast("int")), 4).alias("rate"),
    )


def event_folds(df: DataFrame, k: int = 5, seed: int = SEED) -> DataFrame:
    """(event_id, fold 1..k): shuffled shows cut into k near-equal blocks."""
    shows = df.select("event_id").distinct().withColumn("h", hash31(F.lit(seed), F.col("event_id")))
    return equal_count_bins(shows, [F.col("h"), F.col("event_id")], k, "fold").select("event_id", "fold")


def with_folds(df: DataFrame, k: int = 5, seed: int = SEED) -> DataFrame:
    return df.join(event_folds(df, k, seed), "event_id")


def unused_rows(parts: DataFrame) -> DataFrame:
    """Labelled rows that no part takes, which would otherwise vanish silently."""
    return parts.agg(F.count_if(F.col("split").isNull()).alias("n_unused"), F.count(F.lit(1)).alias("n_labelled"))
