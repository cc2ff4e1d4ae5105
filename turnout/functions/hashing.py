"""Seeded pseudo-random numbers that depend only on keys, never on partitioning.

A draw for entity h in simulation s is a cubic polynomial in h over the prime
field of 2**31 - 1 whose four coefficients are hashed from s. Such a family is
four-wise independent over the draws of one simulation, so mean, variance, skew
and kurtosis of simulated counts are those of independent draws. It costs three
integer multiplications per draw inside generated code, and any SQL engine with
64-bit integers reproduces it bit by bit.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def hash31(*cols: Column) -> Column:
    """Key columns to an integer in [0, PRIME), through md5 of their text."""
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(15)), 16, 10).cast("bigint") % PRIME


def hash31_of(*key) -> int:
    """`hash31` of plain values, for code inside tasks."""
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:15], 16) % PRIME


def coefficients(*key: Column) -> list[Column]:
    """Four polynomial coefficients for one simulation key."""
    return [hash31(*key, F.lit(f"c{i}")) for i in range(4)]


def poly_uniform(c: list[Column], h: Column) -> Column:
    """Uniform in (0, 1) for entity hash `h` under coefficients `c`."""
    x = c[3]
    for k in (c[2], c[1], c[0]):
        x = (x * h + k) % PRIME
    return (x + F.lit(0.5)) / F.lit(float(PRIME))


def uniform(*key: Column) -> Column:
    return (hash31(*key) + F.lit(0.5)) / F.lit(float(PRIME))


def normal(u1: Column, u2: Column) -> Column:
    """Standard normal from two uniforms (Box-Muller)."""
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
