"""Gaussian kernel density without row pairs.

Values are gathered in cells one bandwidth wide and each cell keeps weighted moments about its centre
(the expansion behind the fast Gauss transform). A point then reads the cells near it, so cost grows
with rows + points and not with their product. Truncation stays below 1e-12 of a kernel's peak.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandweave.operators.ranks import value_rank
from bandweave.session import materialize

TERMS = 28
REACH = 8
MOST_CELLS = 16_384  # cells whose moments are sent to every task; the points, which file sizes make look small, never are


def _cell(v: Column) -> Column:
    return F.floor(v).cast("bigint")


def density_at(df: DataFrame, column: str, points: DataFrame, at: str, bandwidth: float) -> DataFrame:
    """Add `density` of `column` over `df` at each row of `points`."""
    scaled = df.where(F.col(column).isNotNull()).select((F.col(column) / F.lit(float(bandwidth))).alias("_v"))
    placed = scaled.select(_cell(F.col("_v")).alias("_cell"), (F.col("_v") - F.floor("_v") - 0.5).alias("_d"))
    weight = F.exp(F.lit(-0.5) * F.col("_d") * F.col("_d"))
    moments = placed.groupBy("_cell").agg(
        *[F.sum(weight * F.pow("_d", F.lit(float(m)))).alias(f"_m{m}") for m in range(TERMS)]
    )
    moments = materialize(moments, "moments")
    few = moments.limit(MOST_CELLS + 1).count() <= MOST_CELLS
    where = points.withColumn("_y", F.col(at) / F.lit(float(bandwidth)))
    spots = where.select(at, "_y").distinct()
    near = spots.withColumn("_cell", F.explode(F.sequence(_cell(F.col("_y")) - REACH, _cell(F.col("_y")) + REACH)))
    met = near.join(F.broadcast(moments) if few else moments.hint("merge"), "_cell").withColumn("_t", F.col("_y") - F.col("_cell") - F.lit(0.5))
    series: Column = F.col(f"_m{TERMS - 1}")
    for m in range(TERMS - 2, -1, -1):
        series = F.col(f"_m{m}") + F.col("_t") / F.lit(float(m + 1)) * series
    kernel = F.exp(F.lit(-0.5) * F.col("_t") * F.col("_t")) * series
    sums = materialize(met.groupBy(at).agg(F.sum(kernel).alias("_k")), "densities")  # as written, its size is known
    n = df.agg(F.count(column)).scalar()
    height = F.coalesce("_k", F.lit(0.0)) / (n * F.lit(bandwidth * math.sqrt(2.0 * math.pi)))
    return points.join(sums, at, "left").withColumn("density", height).drop("_k")


def kde(df: DataFrame, column: str, bandwidth: float, n: int) -> DataFrame:
    """Density on n equally spaced points from minimum to maximum."""
    span = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    grid = span.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("point"))
    at = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / F.lit(float(n - 1))
    return density_at(df, column, grid.select("point", at.alias("at")), "at", bandwidth)


def density_weight(df: DataFrame, column: str, eps: float = 1e-4, alpha: float = 1.0, by: str = "position", bandwidth: float = 1.0, key: str = "sample_index") -> DataFrame:
    """Weight max(1 - alpha * scaled density, eps), scaled to mean 1.

    `by="position"` reads the density at the i-th of n equally spaced points for the i-th row;
    `by="value"` reads it at the row's own value.
    """
    if by == "position":
        span = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
        lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
        ranked = value_rank(df, key, name="_i", total="_n")
        rows = ranked.withColumn("_at", lo + F.coalesce(F.try_divide(F.col("_i") * (hi - lo), F.col("_n") - 1), F.lit(0.0))).drop("_i", "_n")
    else:
        rows = df.withColumn("_at", F.col(column).cast("double"))
    dense = materialize(density_at(df, column, rows, "_at", bandwidth).drop("_at"), "density")
    ends = dense.agg(F.min("density").alias("lo"), F.max("density").alias("hi"))
    low, high = ends.select("lo").scalar(), ends.select("hi").scalar()
    raw = F.greatest(F.lit(1.0) - F.lit(alpha) * F.coalesce(F.try_divide(F.col("density") - low, high - low), F.lit(0.0)), F.lit(eps))
    weighed = dense.withColumn("weight", raw)
    mean = weighed.agg(F.avg("weight")).scalar()
    return weighed.withColumn("weight", F.col("weight") / mean)
