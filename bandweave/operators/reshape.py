"""Geometry of fields: padding, flips, rotations, noise, resampling, flattening.

Every source pixel computes where it lands, so none of these joins pixels with a target grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandweave.functions.draws import gaussian, uniform, uniform_between
from bandweave.operators.pixels import field_size
from bandweave.operators.ranks import group_rank


def with_size(pixels: DataFrame) -> DataFrame:
    return pixels.join(field_size(pixels).select("sample_index", "h", "w"), "sample_index")


def pad_square(pixels: DataFrame, mode: str = "wrap", size: int | None = None) -> DataFrame:
    """Grow each field to a square of its longer edge, or of `size` where that is larger."""
    sized = with_size(pixels)
    side = F.greatest("h", "w") if size is None else F.greatest("h", "w", F.lit(size))
    sized = sized.withColumn("side", side)
    if mode == "wrap":
        rows = sized.withColumn("x", F.explode(F.sequence(F.col("x"), F.col("side") - 1, F.col("h"))))
        cols = rows.withColumn("y", F.explode(F.sequence(F.col("y"), F.col("side") - 1, F.col("w"))))
        return cols.select("sample_index", "x", "y", "band", "value", "masked")
    inside = sized.select("sample_index", "x", "y", "band", "value", "masked")
    shapes = sized.groupBy("sample_index", "band").agg(
        F.max("h").alias("h"), F.max("w").alias("w"), F.max("side").alias("side")
    )
    grid = shapes.where(F.col("side") > F.least("h", "w")).withColumn(
        "x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("side") - 1))
    )
    first = F.when(F.col("x") < F.col("h"), F.col("w")).otherwise(F.lit(0).cast("bigint"))
    grid = grid.where(first < F.col("side")).withColumn("y", F.explode(F.sequence(first, F.col("side") - 1)))
    zeros = grid.select(
        "sample_index", "x", "y", "band", F.lit(0.0).alias("value"), F.lit(False).alias("masked")
    )
    return inside.unionByName(zeros)


def flip(pixels: DataFrame, axis: str = "y") -> DataFrame:
    sized = with_size(pixels)
    extent = {"x": "h", "y": "w"}[axis]
    return sized.withColumn(axis, F.col(extent) - 1 - F.col(axis)).drop("h", "w")


def rotate90(pixels: DataFrame, k: int | Column = 1) -> DataFrame:
    """Turn counter-clockwise k times; k may be a drawn column."""
    turns = F.pmod(k if isinstance(k, Column) else F.lit(k), F.lit(4))
    sized = with_size(pixels).withColumn("_k", turns)
    down, right = F.col("h") - 1 - F.col("x"), F.col("w") - 1 - F.col("y")
    x = F.when(F.col("_k") == 0, F.col("x")).when(F.col("_k") == 1, right).when(F.col("_k") == 2, down)
    y = F.when(F.col("_k") == 0, F.col("y")).when(F.col("_k") == 1, F.col("x")).when(F.col("_k") == 2, right)
    moved = sized.withColumns({"_x": x.otherwise(F.col("y")), "_y": y.otherwise(down)})
    return moved.withColumns({"x": F.col("_x"), "y": F.col("_y")}).drop("_x", "_y", "_k", "h", "w")


def augment_orientation(pixels: DataFrame, seed: int) -> DataFrame:
    """Per field: a quarter turn with probability one half (1-3 turns), then a flip with probability one half."""
    key = F.col("sample_index")
    turns = F.when(uniform(seed, key, "turn") < 0.5, F.floor(uniform(seed, key, "k") * 3) + 1).otherwise(F.lit(0))
    turned = with_size(rotate90(pixels, turns.cast("int")))
    mirrored = F.when(uniform(seed, key, "flip") < 0.5, F.col("w") - 1 - F.col("y")).otherwise(F.col("y"))
    return turned.withColumn("y", mirrored).drop("h", "w")


def add_noise(pixels: DataFrame, kind: str, width: float, seed: int) -> DataFrame:
    """Uniform noise times the field maximum, or normal noise on a random half of the fields."""
    key = [F.col("sample_index"), F.col("band"), F.col("x"), F.col("y")]
    if kind == "uniform":
        peaks = pixels.groupBy("sample_index").agg(F.max("value").alias("_peak"))
        draw = uniform_between(seed, -width, width, *key)
        return pixels.join(peaks, "sample_index").withColumn("value", F.col("value") + draw * F.col("_peak")).drop("_peak")
    chosen = uniform(seed, F.col("sample_index")) < 0.5
    noisy = F.col("value") + F.lit(width) * gaussian(seed, *key)
    return pixels.withColumn("value", F.when(chosen, noisy).otherwise(F.col("value")))


def flatten_wrap(pixels: DataFrame, n: int, lead: int = 5) -> DataFrame:
    """Unmasked values in (y, x, band) order as positions 0..n-1, repeated cyclically after a lead.

    Long form: a field of any size streams through, no field is collected into one array.
    """
    valid = pixels.where(~F.col("masked"))
    ranked = group_rank(valid, ["sample_index"], ["y", "x", "band"], F.col("y"), name="_r", total="_m")
    start = F.pmod(F.col("_r") + F.lit(lead), F.col("_m"))
    slots = F.when(start < n, F.sequence(start, F.lit(n - 1).cast("bigint"), F.col("_m")))
    return ranked.select("sample_index", F.explode(slots).alias("pos"), "value")


def resize_nearest(pixels: DataFrame, side: int) -> DataFrame:
    """Nearest-neighbour resampling to side x side: target i reads source floor(i * h / side)."""
    sized = with_size(pixels)

    def landing(at: Column, extent: Column) -> Column:
        first = F.ceil(at * F.lit(side) / extent).cast("bigint")
        last = (F.ceil((at + 1) * F.lit(side) / extent) - 1).cast("bigint")
        return F.when(first <= last, F.sequence(first, last))

    rows = sized.withColumn("x", F.explode(landing(F.col("x"), F.col("h"))))
    cols = rows.withColumn("y", F.explode(landing(F.col("y"), F.col("w"))))
    return cols.drop("h", "w")


def repeat_rows(df: DataFrame, f: int) -> DataFrame:
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(f - 1))))
