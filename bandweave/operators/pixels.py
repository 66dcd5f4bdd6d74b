"""Masks, sizes, band reducers and set pooling over the long pixel table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandweave import SMALL_EDGE
from bandweave.operators.ranks import exact_quantiles



def by_band(rows: DataFrame) -> DataFrame:
    """One row per pixel and band, out of rows with their bands side by side."""
    return rows.select(*[c for c in rows.columns if c != "bands"], F.posexplode("bands").alias("band", "value"))


def scale_values(df: DataFrame, by: float | Column) -> DataFrame:
    """Divide pixel values by a constant or by a scalar column such as the largest band maximum; of side by side bands, each."""
    divisor = by if isinstance(by, Column) else F.lit(float(by))
    if "bands" in df.columns:
        return df.withColumn("bands", F.transform("bands", lambda x: x / divisor))
    return df.withColumn("value", F.col("value") / divisor)


def largest_value(pixels: DataFrame) -> Column:
    """Largest of the band maxima over unmasked pixels, as a scalar subquery."""
    return mask_drop(pixels).agg(F.max("value")).scalar()


def mask_fill(df: DataFrame, fill: float = 0.0) -> DataFrame:
    return df.withColumn("value", F.when(F.col("masked"), F.lit(fill)).otherwise(F.col("value")))


def mask_drop(df: DataFrame) -> DataFrame:
    return df.where(~F.col("masked"))


def field_size(pixels: DataFrame) -> DataFrame:
    extent = pixels.groupBy("sample_index").agg(
        (F.max("x") + 1).alias("h"), (F.max("y") + 1).alias("w")
    )
    return extent.withColumns({"edge": (F.col("h") + F.col("w")) / 2, "area": F.col("h") * F.col("w")})


def route_by_size(sizes: DataFrame, limit: float = SMALL_EDGE) -> tuple[DataFrame, DataFrame]:
    return sizes.where(F.col("edge") <= limit), sizes.where(F.col("edge") > limit)


def lookup(df: DataFrame, key: int, column: str = "sample_index") -> DataFrame:
    return df.where(F.col(column) == key)


Reducer = Callable[[Column], Column]


def curve(pixels: DataFrame, fn: Reducer | dict[str, Reducer] = F.avg) -> DataFrame:
    """One value per field and band over the unmasked pixels; a fully masked band gives null.

    Several reducers, by output name, share one aggregate.
    """
    valid = F.when(~F.col("masked"), F.col("value"))
    named = fn if isinstance(fn, dict) else {"v": fn}
    return pixels.groupBy("sample_index", "band").agg(*[f(valid).alias(name) for name, f in named.items()])


def curve_array(curves: DataFrame) -> DataFrame:
    """Band order folded into an array; its length is the fixed number of bands."""
    entries = F.array_sort(F.collect_list(F.struct("band", "v")))
    return curves.groupBy("sample_index").agg(F.transform(entries, lambda e: e["v"]).alias("curve"))


def curve_masked_unmasked(pixels: DataFrame) -> DataFrame:
    valid = F.when(~F.col("masked"), F.col("value"))
    return pixels.groupBy("sample_index", "band").agg(
        F.avg(valid).alias("masked_mean"), F.avg("value").alias("full_mean")
    )


def band_stats(pixels: DataFrame) -> DataFrame:
    """Band maximum, then mean and deviation of value / maximum, out of one pass over the pixels."""
    sums = mask_drop(pixels).groupBy("band").agg(
        F.max("value").alias("max"),
        F.avg("value").alias("_m1"),
        F.avg(F.col("value") * F.col("value")).alias("_m2"),
    )
    mean = F.try_divide("_m1", "max")  # null for a band that is all zero
    square = F.try_divide(F.col("_m2"), F.col("max") * F.col("max"))
    return sums.select("band", mean.alias("mean"), F.sqrt(square - mean * mean).alias("std"), "max")


def join_band_stats(pixels: DataFrame, stats: DataFrame) -> DataFrame:
    """Pixel value as a share of its band maximum; the per-band table is broadcast after a look at its size."""
    return pixels.join(stats.select("band", "max"), "band").withColumn("share", F.try_divide("value", "max"))


def _set_sum() -> Column:
    return F.sum("value")


def _set_deviation() -> Column:
    total, squares = F.sum("value"), F.sum(F.col("value") * F.col("value"))
    spread = squares - 2 * total * total + F.count("value") * total * total
    return F.sqrt(F.greatest(spread, F.lit(0.0)) + F.lit(1e-31))


def _masked_mean() -> Column:
    return F.avg(F.when(~F.col("masked"), F.col("value")))


def _masked_deviation() -> Column:
    valid = F.when(~F.col("masked"), F.col("value"))
    alone = F.sqrt(F.lit(1e-31))
    return F.when(F.count(valid) == 1, alone).otherwise(F.sqrt(F.var_samp(valid) + F.lit(1e-31)))


# Pooling by name. "mean" and "std" work on plain sums, without dividing by the set size.
POOLINGS: dict[str, Callable[[], Column]] = {
    "mean": _set_sum,
    "std": _set_deviation,
    "max": lambda: F.max("value"),
    "min": lambda: F.min("value"),
    "maskedmean": _masked_mean,
    "maskedstd": _masked_deviation,
}


def pool(pixels: DataFrame, name: str) -> DataFrame:
    """Pool the pixel set per field and band: `mean_std` gives both columns from one aggregate."""
    parts = name.split("_")
    return pixels.groupBy("sample_index", "band").agg(*[POOLINGS[p]().alias(p) for p in parts])


def channel_max_norm(df: DataFrame, quantities) -> DataFrame:
    """Divide each quantity column by its own maximum over all fields, bands and pixels."""
    peaks = df.agg(*[F.max(q).alias(q) for q in quantities])
    return df.withColumns({q: F.try_divide(F.col(q), peaks.select(q).scalar()) for q in quantities})


def summary(df: DataFrame, cols) -> DataFrame:
    """Min, max, mean, population deviation and exact median, one row per column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).cast("double").alias("v")) for c in cols]))
    long = df.select(pairs.alias("p")).select("p.*")
    plain = long.groupBy("target").agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")
    )
    medians = exact_quantiles(long, ["target"], "v", [0.5])
    return plain.join(medians.select("target", F.get("q", F.lit(0)).alias("median")), "target")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, by, value: str, n: int, ties=()) -> DataFrame:
    """n largest per group; Spark cuts each task's rows to n before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(F.col(value).desc(), *ties)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
