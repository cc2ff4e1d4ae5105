"""Small scalar expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def denan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


def lead_days(starts_at: Column, purchased_at: Column) -> Column:
    """Days between purchase and show, never negative; NULL without a purchase time."""
    return F.when(
        purchased_at.isNotNull(),
        F.greatest(F.lit(0.0), seconds_between(starts_at, purchased_at) / F.lit(86400.0)),
    )


def minute_bin(at: Column, start: Column, width: int = 15) -> Column:
    """Minutes from the start, rounded down to a multiple of `width` (also below zero)."""
    minutes = seconds_between(at, start) / F.lit(60.0)
    return (F.floor(minutes / width) * width).cast("int")


def bin_label(minute: Column, at_start: str = "hora de inicio") -> Column:
    return F.when(minute == 0, F.lit(at_start)).otherwise(
        F.format_string("%+d min", minute)
    )


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), c))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(z, -30.0, 30.0)))


def band(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bands (edges[i], edges[i+1]]; NULL outside all of them."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        cond = (c > lo) & (c <= hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def iso_week(ts: Column) -> Column:
    return F.weekofyear(ts)


def round_binary(c: Column, places: int) -> Column:
    """Half-even rounding of the binary value, as floating-point languages round."""
    unit = F.lit(10.0**places)
    return F.rint(c * unit) / unit
