"""Exact ranks, running totals, equal-count bins and quantiles over any volume.

A window without a partition key, or with one hot key, sorts everything in one
task. Here the rows are range-partitioned on (group, order), sorted inside each
partition and frozen once; ranks then need only the per-partition counts, whose
number is that of partitions plus groups. A hot group simply spans several
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnout.session import stored

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def running(
    df: DataFrame,
    order: list[Column],
    by: list[str] | None = None,
    sums: dict[str, str] | None = None,
    rank: str | None = "rank",
    total: str | None = None,
) -> DataFrame:
    """Add the 1-based rank within `by` under `order`, and running sums.

    `sums` maps an output name to the column summed up to and including the row.
    `total` names the group size. The order should be total (end with an id), so
    that equal keys can be split between partitions without changing the result.
    """
    by = by or []
    sums = sums or {}
    keys = [F.col(b) for b in by] + order
    placed = stored(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_part", F.shiftright("_pos", _ROW_BITS))
    spans = placed.groupBy(*by, "_part").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_pos").alias("_first"),
        *[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()],
    )
    # one row per (group, partition): the window below never holds more than the
    # number of partitions in a group
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = spans.select(
        *by,
        "_part",
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_total"),
        *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums],
    )
    out = placed.join(offsets, [*by, "_part"])
    if rank:
        out = out.withColumn(rank, F.col("_pos") - F.col("_first") + F.col("_before") + 1)
    if total:
        out = out.withColumn(total, F.col("_total"))
    if sums:
        inside = (
            Window.partitionBy(*by, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
        )
        out = out.withColumns(
            {o: F.col(f"_b_{o}") + F.sum(c).over(inside) for o, c in sums.items()}
        )
    return out.drop("_pos", "_part", "_first", "_before", "_total", *[f"_b_{o}" for o in sums])


def bin_of(rank: Column, total: Column, k: int) -> Column:
    """Equal-count bin 1..k of a 1-based rank: the first total % k bins get one more row."""
    r0 = rank - 1
    small = F.floor(total / k).cast("bigint")
    extra = total % k
    wide = extra * (small + 1)
    return F.when(r0 < wide, F.floor(r0 / (small + 1)) + 1).otherwise(
        F.floor((r0 - wide) / F.greatest(small, F.lit(1))) + extra + 1
    ).cast("int")


def equal_count_bins(
    df: DataFrame, order: list[Column], k: int, name: str, by: list[str] | None = None
) -> DataFrame:
    ranked = running(df, order, by=by, rank="_rank", total="_size")
    return ranked.withColumn(name, bin_of(F.col("_rank"), F.col("_size"), k)).drop("_rank", "_size")


def quantiles(
    df: DataFrame, value: str, qs: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles, one row per group (one row without groups).

    Equal values are counted before they move, so what is ranked is distinct values.
    """
    by = by or []
    known = df.select(*by, value).filter(F.col(value).isNotNull())
    ranked = running(known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")), [F.col(value)],
                     by=by, sums={"_upto": "_n"}, rank=None)
    sizes = ranked.groupBy(*by).agg(F.max("_upto").alias("_size"))
    ranked = ranked.join(sizes, by) if by else ranked.crossJoin(sizes)
    aggs, near = [], F.lit(False)
    for name, q in qs.items():
        pos = (F.col("_size") - 1) * F.lit(q)
        lo, frac = F.floor(pos), pos - F.floor(pos)
        # a value holds the places from _upto - _n to _upto - 1
        at = lambda place: (F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto"))
        here, after = at(lo), at(F.least(lo + 1, F.col("_size") - 1))
        low, high = F.max(F.when(here, F.col(value))), F.max(F.when(after, F.col(value)))
        aggs.append((low + (high - low) * F.max(frac)).alias(name))
        near = near | here | after
    return ranked.filter(near).groupBy(*by).agg(*aggs)
