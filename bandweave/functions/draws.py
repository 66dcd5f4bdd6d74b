"""Repeatable random draws as column expressions.

A draw depends on a seed and a key only, so it gives the same value in every retry,
on every executor, and in a SQL engine that has md5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(parts) -> Column:
    return F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def uniform(seed: int, *key) -> Column:
    """Uniform draw in [0, 1) from the first 32 bits of md5(seed:key)."""
    digest = F.md5(_key([seed, *key]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_between(seed: int, lo: float, hi: float, *key) -> Column:
    return F.lit(lo) + uniform(seed, *key) * F.lit(hi - lo)


def below(seed: int, n: Column, *key) -> Column:
    """Integer draw in 0..n-1."""
    return F.floor(uniform(seed, *key) * n).cast("bigint")


def gaussian(seed: int, *key) -> Column:
    """Standard normal draw, Box-Muller on two uniform draws."""
    u1 = F.lit(1.0) - uniform(seed, *key, "a")
    u2 = uniform(seed, *key, "b")
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def choice(seed: int, words, *key) -> Column:
    """One entry of a fixed list."""
    options = F.array(*[F.lit(w) for w in words])
    return F.element_at(options, (below(seed, F.lit(len(words)), *key) + 1).cast("int"))
