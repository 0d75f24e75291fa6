"""Reproducible randomness: every random number is a hash of (seed, tag, key).

Results do not depend on partitioning, and other engines can recompute them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, tag: str, *key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of md5('seed:tag:key:...')."""
    text = F.concat_ws(":", F.lit(f"{seed}:{tag}"), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def index(seed: int, tag: str, n: Column | int, *key: Column) -> Column:
    """A whole number in [0, n)."""
    return F.floor(uniform(seed, tag, *key) * n).cast("long")


def normal(seed: int, tag: str, *key: Column) -> Column:
    """A standard normal number (Box-Muller on two uniform ones, the first moved to (0, 1])."""
    a, b = uniform(seed, f"{tag}:a", *key), uniform(seed, f"{tag}:b", *key)
    return F.sqrt(-2.0 * F.ln(1.0 - a)) * F.cos(2.0 * F.lit(3.141592653589793) * b)


def stochastic_round(value: Column, u: Column) -> Column:
    """Rounded up with the probability of the fraction."""
    return (F.floor(value) + F.when(u < value - F.floor(value), 1).otherwise(0)).cast("long")
