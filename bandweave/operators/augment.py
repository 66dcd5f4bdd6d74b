"""Augmentation: crops, label jitter, row mixing, pixel selection, oversampling of rare targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandweave import TARGETS
from bandweave.functions.draws import below, gaussian, uniform, uniform_between
from bandweave.operators.pixels import field_size
from bandweave.operators.ranks import exact_quantiles, shuffled_rank
from bandweave.session import materialize


def _corners(sizes: DataFrame, edge: int, tries: int, draws: int, seed: int) -> DataFrame:
    """One row per field and draw: the tried corners of edge x edge crops and the fallback of the shorter edge."""
    rows = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    key = [F.col("sample_index"), F.col("draw")]

    def corner(i: Column, side: Column) -> Column:
        return F.struct(
            i.cast("int").alias("try"),
            below(seed, F.col("h") + 1 - side, *key, i.cast("string"), "x").alias("x0"),
            below(seed, F.col("w") + 1 - side, *key, i.cast("string"), "y").alias("y0"),
            side.cast("bigint").alias("side"),
        )

    shorter = F.least("h", "w")
    fallback = corner(F.lit(tries), shorter)
    if tries == 0:
        return rows.select("sample_index", "draw", F.array(fallback).alias("corners"))
    tried = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: corner(i, F.lit(edge)))
    fits = F.when((F.col("h") >= edge) & (F.col("w") >= edge), F.concat(tried, F.array(fallback)))
    return rows.select("sample_index", "draw", F.coalesce(fits, F.array(fallback)).alias("corners"))


def crop_augment(pixels: DataFrame, edge: int, tries: int, draws: int, seed: int, accept: str = "valid", noise: float = 0.01, fallback_noise: float = 0.001) -> DataFrame:
    """Random crops: the first of several corners that passes the mask test, else a crop of the shorter edge.

    `accept="valid"` wants all pixels of the crop unmasked, `"masked"` all of them masked. Uniform noise
    times the field maximum is added; the crop is returned as a pixel table with its own coordinates.
    """
    sizes = field_size(pixels)
    corners = materialize(_corners(sizes.select("sample_index", "h", "w"), edge, tries, draws, seed), "corners")
    inside = lambda c: (
        (F.col("x") >= c["x0"]) & (F.col("x") < c["x0"] + c["side"]) & (F.col("y") >= c["y0"]) & (F.col("y") < c["y0"] + c["side"])
    )
    wanted = ~F.col("masked") if accept == "valid" else F.col("masked")
    if tries:
        first_band = pixels.where(F.col("band") == 0).select("sample_index", "x", "y", wanted.alias("_good"))
        hits = first_band.join(corners, "sample_index").select(
            "sample_index", "draw", "_good", F.explode(F.filter("corners", lambda c: (c["try"] < tries) & inside(c))).alias("c")
        )
        counts = hits.groupBy("sample_index", "draw", "c").agg(F.sum(F.col("_good").cast("int")).alias("_n"))
        passed = counts.where(F.col("_n") == edge * edge).groupBy("sample_index", "draw").agg(F.min("c").alias("_c"))
        chosen = corners.join(passed, ["sample_index", "draw"], "left").select(
            "sample_index", "draw", F.coalesce("_c", F.element_at("corners", -1)).alias("c")
        )
    else:
        chosen = corners.select("sample_index", "draw", F.element_at("corners", -1).alias("c"))
    peaks = pixels.groupBy("sample_index").agg(F.max("value").alias("_peak"))
    cut = pixels.join(chosen, "sample_index").where(inside(F.col("c"))).join(peaks, "sample_index")
    width = F.when(F.col("c.try") < tries, F.lit(noise)).otherwise(F.lit(fallback_noise))
    spot = [F.col(k) for k in ("sample_index", "draw", "band", "x", "y")]
    shift = (F.lit(2.0) * uniform(seed + 1, *spot) - F.lit(1.0)) * width * F.col("_peak")
    return cut.select(
        "sample_index",
        "draw",
        F.col("c.try").alias("attempt"),
        (F.col("x") - F.col("c.x0")).alias("x"),
        (F.col("y") - F.col("c.y0")).alias("y"),
        "band",
        (F.col("value") + shift).alias("value"),
        "masked",
    )


def jitter_targets(df: DataFrame, kind: str, width: float, seed: int, cols=TARGETS, key: str = "sample_index") -> DataFrame:
    """Relative noise per target, or one shared additive draw on a random half of the rows."""
    if kind == "relative":
        return df.withColumns({c: F.col(c) + F.col(c) * uniform_between(seed, -width, width, F.col(key), c) for c in cols})
    shift = F.when(uniform(seed, F.col(key), "on") < 0.5, uniform_between(seed, -width, width, F.col(key))).otherwise(F.lit(0.0))
    return df.withColumns({c: F.col(c) + shift for c in cols})


def mix_rows(df: DataFrame, fraction: float, mix: float, seed: int, vector: str = "curve", cols=TARGETS, key: str = "sample_index") -> DataFrame:
    """Append (1 - mix) * a + mix * b of drawn row pairs; a row may be drawn many times."""
    ranked = shuffled_rank(df.select(key, vector, *cols), key, seed, name="_pos", total="_n")
    draws = ranked.where(F.col("_pos") < F.floor(F.col("_n") * F.lit(fraction))).select(
        F.col("_pos").alias("draw"),
        below(seed, F.col("_n"), "a", F.col("_pos")).alias("_a"),
        below(seed, F.col("_n"), "b", F.col("_pos")).alias("_b"),
    )

    def side(end: str) -> DataFrame:
        return ranked.select(F.col("_pos").alias(f"_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in (vector, *cols)])

    pairs = draws.join(side("a"), "_a").join(side("b"), "_b")
    keep, add = F.lit(1.0 - mix), F.lit(mix)
    mixed = pairs.select(
        F.lit(None).cast("bigint").alias(key),
        "draw",
        F.zip_with(f"{vector}_a", f"{vector}_b", lambda a, b: keep * a + add * b).alias(vector),
        *[(keep * F.col(f"{c}_a") + add * F.col(f"{c}_b")).alias(c) for c in cols],
    )
    plain = df.select(key, F.lit(None).cast("bigint").alias("draw"), vector, *cols)
    return plain.unionByName(mixed)


def select_pixels(rows: DataFrame, n: int, f: int, seed: int, key=("sample_index", "px")) -> DataFrame:
    """n * f random pixels per field, the same for all bands; a short field repeats its pixels and says so.

    Only n * f rows per field pass the shuffle, whatever the size of the field.
    """
    want = n * f
    field = key[0]
    order = Window.partitionBy(field).orderBy("_u", *key[1:])
    drawn = rows.withColumn("_u", uniform(seed, *[F.col(k) for k in key]))
    kept = drawn.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= want)
    kept = kept.withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(field)))
    slots = F.sequence((F.col("_r") - 1).cast("int"), F.lit(want - 1), F.col("_m").cast("int"))
    out = kept.withColumn("slot", F.explode(slots)).withColumn("repeated", F.col("_m") < want)
    return out.withColumns({"draw": F.floor(F.col("slot") / n).cast("int"), "pixel": (F.col("slot") % n).cast("int")}).drop(
        "_u", "_r", "_m"
    )


def select_pixels_per_band(pixels: DataFrame, n: int, seed: int) -> DataFrame:
    """n random pixels of each band, drawn independently, without repeats."""
    drawn = pixels.withColumn("_u", uniform(seed, F.col("sample_index"), F.col("band"), F.col("px")))
    order = Window.partitionBy("sample_index", "band").orderBy("_u", "px")
    return drawn.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= n).drop("_u")


def relevance(df: DataFrame, target: str) -> DataFrame:
    """Distance of a target beyond its whiskers as 0-1: 0 at the median, 1 at or past 1.5 interquartile ranges."""
    one = df.withColumn("_all", F.lit(1))
    q1, q2, q3 = exact_quantiles(one, ["_all"], target, [0.25, 0.5, 0.75]).first()["q"]
    reach = 1.5 * (q3 - q1)
    up = F.coalesce(F.try_divide(F.col(target) - F.lit(q2), F.lit(q3 + reach - q2)), F.lit(0.0))  # without spread nothing is rare
    down = F.coalesce(F.try_divide(F.lit(q2) - F.col(target), F.lit(q2 - (q1 - reach))), F.lit(0.0))
    return df.withColumn("relevance", F.least(F.greatest(up, down, F.lit(0.0)), F.lit(1.0)))


def oversample_rare(df: DataFrame, target: str, k: int, seed: int, vector: str = "curve", key: str = "sample_index", threshold: float = 0.8) -> DataFrame:
    """Add rows near rare targets: between a rare row and one of its k nearest rare rows, or with small noise.

    A neighbour nearer than half the k-th distance is interpolated to, a farther one gives normal noise.
    """
    from bandweave.operators.neighbors import knn_join

    scored = relevance(df.select(key, vector, target), target)
    rare = materialize(scored.where(F.col("relevance") >= threshold).drop("relevance"), "rare")
    near = materialize(knn_join(rare, rare, k, key=key, vector=vector, exclude_self=True), "near")
    far = near.groupBy("query").agg(F.max("distance").alias("_far"), F.count(F.lit(1)).alias("_k"))
    pickable = near.join(far, "query").withColumn("_pick", below(seed, F.col("_k"), F.col("query")) + 1)
    chosen = pickable.where(F.col("place") == F.col("_pick"))
    a = rare.select(F.col(key).alias("query"), F.col(vector).alias("_va"), F.col(target).alias("_ta"))
    b = rare.select(F.col(key).alias("neighbor"), F.col(vector).alias("_vb"), F.col(target).alias("_tb"))
    pairs = chosen.join(a, "query").join(b, "neighbor").withColumn("_s", uniform(seed + 1, F.col("query")))
    close = F.col("distance") <= F.col("_far") / 2
    blend = F.zip_with("_va", "_vb", lambda x, y: x + F.col("_s") * (y - x))
    shaken = F.transform("_va", lambda x, i: x + F.lit(0.02) * gaussian(seed + 2, F.col("query"), i))
    new = pairs.select(
        F.lit(None).cast("bigint").alias(key),
        F.when(close, blend).otherwise(shaken).alias(vector),
        F.when(close, F.col("_ta") + F.col("_s") * (F.col("_tb") - F.col("_ta")))
        .otherwise(F.col("_ta") * (F.lit(1.0) + F.lit(0.02) * gaussian(seed + 3, F.col("query"))))
        .alias(target),
        F.lit(True).alias("synthetic"),
    )
    return df.select(key, vector, target, F.lit(False).alias("synthetic")).unionByName(new)
