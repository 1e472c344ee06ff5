"""Deterministic randomness: every draw is a hash of a seed and a row's own key, so partitions and retries change nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 2016


def order_key(*parts: Column, seed: int = SEED, epoch: Column | int = 0) -> Column:
    """32 hex digits that put rows in a random order; another ``epoch`` gives another order."""
    e = epoch if isinstance(epoch, Column) else F.lit(epoch)
    return F.md5(F.concat_ws(":", F.lit(seed), e, *[p.cast("string") for p in parts]))


def uniform(name: str, *parts: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) for a parameter's ``name`` (operator and parameter) and a row's key."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(name), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def between(name: str, low: Column | float, high: Column | float, *parts: Column, seed: int = SEED) -> Column:
    """Uniform in [low, high)."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return lo + (hi - lo) * uniform(name, *parts, seed=seed)


def integer(name: str, bound: Column | int, *parts: Column, seed: int = SEED) -> Column:
    """A whole number in [0, bound)."""
    n = bound if isinstance(bound, Column) else F.lit(bound)
    return F.floor(uniform(name, *parts, seed=seed) * n).cast("long")
