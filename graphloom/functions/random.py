"""Reproducible randomness: uniforms from a hash of (seed, keys), the same on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.spaces import Point, total


def uniform(seed: int, *keys: Column | int) -> Column:
    """In [0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[k if isinstance(k, Column) else F.lit(k) for k in keys]), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def normal(seed: int, *keys: Column | int) -> Column:
    """Standard normal, by Box and Muller."""
    u = F.greatest(uniform(seed, *keys, 1), F.lit(1e-300))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(seed, *keys, 2))


def unit_vector(d: int, seed: int, *keys: Column | int) -> Point:
    parts = [normal(seed, *keys, 100 + k) for k in range(d)]
    n = F.sqrt(total([x * x for x in parts]))
    return [F.when(n > 0, x / n).otherwise(1.0 if k == 0 else 0.0) for k, x in enumerate(parts)]


def ball_vector(d: int, radius: Column | float, seed: int, *keys: Column | int) -> Point:
    reach = F.pow(uniform(seed, *keys, 99), F.lit(1.0 / d)) * radius
    return [x * reach for x in unit_vector(d, seed, *keys)]


def sample(df: DataFrame, k: int, seed: int, key: str = "id") -> DataFrame:
    """k rows without replacement (all, if fewer): the smallest by a hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(k)


def permutation(df: DataFrame, seed: int, key: str = "id") -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key))


def geometric_skip(p: float, seed: int, *keys: Column | int) -> Column:
    """Failures before the first success."""
    if not 0 < p < 1:
        return F.lit(0)
    return F.floor(F.log(1 - uniform(seed, *keys)) / math.log(1 - p))
