"""Deterministic draws: a hash of (key, seed, purpose) in place of a generator.

Results do not depend on partitioning, task order or retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(key: Column, seed: int, purpose: str) -> Column:
    return F.xxhash64(key, F.lit(seed), F.lit(purpose))


def uniform(key: Column, seed: int, purpose: str, low: float = 0.0, high: float = 1.0) -> Column:
    """A double in [low, high)."""
    unit = F.pmod(draw(key, seed, purpose), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return F.lit(low) + unit * (high - low)


def pick(key: Column, seed: int, purpose: str, n: Column) -> Column:
    """A whole number in [0, n)."""
    return F.pmod(draw(key, seed, purpose), n)


# Purposes of the arithmetic draw below.
PURPOSES = {"word": 1, "speed": 2, "lead": 3, "carrier": 4, "near": 5, "appended": 6, "filler": 7}


def arithmetic_uniform(key: Column, purpose: str) -> Column:
    """A plain whole-number draw that any SQL engine can repeat exactly."""
    return F.pmod(key * 7919 + PURPOSES[purpose] * 104729, F.lit(1_000_003)) / F.lit(1_000_003.0)
