"""Resampling of a rare target with exact sizes: value ranges of like relevance get row budgets, and are thinned or added to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandweave.functions.draws import below, gaussian, uniform
from bandweave.operators.augment import relevance
from bandweave.operators.neighbors import knn_join
from bandweave.operators.ranks import shuffled_rank
from bandweave.session import materialize


def bumps(df: DataFrame, target: str, threshold: float = 0.8) -> DataFrame:
    """`relevance` and `bump`: -1 and 1 for the rare ranges below and above the median, 0 for the range between.

    Relevance only grows away from the median, so each bump is one contiguous range of values. A null target is in bump 0.
    """
    scored = relevance(df, target)
    calm = scored.where(F.col("relevance") < threshold).agg(F.min(target).alias("lo"), F.max(target).alias("hi")).first()
    rare = F.coalesce(F.col("relevance") >= threshold, F.lit(False))
    low = F.col(target) < F.lit(calm["lo"]) if calm["lo"] is not None else F.lit(False)
    return scored.withColumn("bump", F.when(rare & low, -1).when(rare, 1).otherwise(0))


def budgets(counts: DataFrame, kind: str = "even") -> DataFrame:
    """bump, n, budget: all rows dealt to the bumps by largest remainder, evenly or (`extreme`) in inverse ratio to their sizes."""
    if kind not in ("even", "extreme"):
        raise ValueError(f"unknown balance {kind}")
    every = Window.partitionBy()  # one row a bump, three at most
    weight = F.lit(1.0) if kind == "even" else F.lit(1.0) / F.col("n")
    shared = counts.withColumn("_w", weight)
    shared = shared.withColumn("_q", F.round(F.sum("n").over(every) * F.col("_w") / F.sum("_w").over(every), 9)).withColumn("_base", F.floor("_q"))
    left = F.sum("n").over(every) - F.sum("_base").over(every)
    place = F.row_number().over(every.orderBy((F.col("_base") - F.col("_q")), "bump"))
    return shared.withColumns({"_left": left, "_place": place}).select("bump", "n", (F.col("_base") + (F.col("_place") <= F.col("_left")).cast("int")).cast("bigint").alias("budget"))


def _synthetic(rows: DataFrame, extra: int, n: int, target: str, k: int, seed: int, vector: str, key: str) -> DataFrame:
    """`extra` rows near the n given ones (with `_pos`), spread evenly over them.

    Each lies between its row and one of the k nearest if that is nearer than half the k-th distance, else it is its row with noise.
    """
    copies = F.lit(extra // n).cast("int") + (F.col("_pos") < extra % n).cast("int")
    some = rows.withColumn("_copies", copies).where("_copies > 0")
    seeds = some.select(F.col(key).alias("query"), F.col(vector).alias("_va"), F.col(target).alias("_ta"), F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))
    near = materialize(knn_join(rows, rows, k, key=key, vector=vector, exclude_self=True), "near")
    reach = near.groupBy("query").agg(F.max("distance").alias("_far"), F.count(F.lit(1)).alias("_k"))
    drawn = seeds.join(reach, "query", "left").withColumn("place", below(seed, F.col("_k"), F.col("query"), F.col("copy")) + 1)
    found = drawn.join(near.select("query", "place", "neighbor", "distance"), ["query", "place"], "left")
    other = rows.select(F.col(key).alias("neighbor"), F.col(vector).alias("_vb"), F.col(target).alias("_tb"))
    pairs = found.join(other, "neighbor", "left").withColumn("_s", uniform(seed + 1, F.col("query"), F.col("copy")))
    close = F.coalesce(F.col("distance") <= F.col("_far") / 2, F.lit(False))
    blend = F.zip_with("_va", "_vb", lambda x, y: x + F.col("_s") * (y - x))
    shaken = F.transform("_va", lambda x, i: x + F.lit(0.02) * gaussian(seed + 2, F.col("query"), F.col("copy"), i))
    return pairs.select(
        F.lit(None).cast("bigint").alias(key),
        F.when(close, blend).otherwise(shaken).alias(vector),
        F.when(close, F.col("_ta") + F.col("_s") * (F.col("_tb") - F.col("_ta")))
        .otherwise(F.col("_ta") * (F.lit(1.0) + F.lit(0.02) * gaussian(seed + 3, F.col("query"), F.col("copy"))))
        .alias(target),
        F.lit(True).alias("synthetic"),
    )


def resample(df: DataFrame, target: str, k: int = 5, seed: int = 0, kind: str = "even", threshold: float = 0.8, vector: str = "curve", key: str = "sample_index") -> DataFrame:
    """key, vector, target, bump, synthetic: as many rows as before, each bump with exactly its budget.

    A bump beyond its budget keeps the first rows of a repeatable shuffle; one below it keeps all and gets synthetic rows, which have
    a null key. Keys must tell rows apart.
    """
    ranked = shuffled_rank(bumps(df.select(key, vector, target), target, threshold), key, seed, by=["bump"], name="_pos")
    rows = materialize(ranked.select(key, vector, target, "bump", "_pos"), "bumps")
    plan = budgets(rows.groupBy("bump").agg(F.count(F.lit(1)).alias("n")), kind).collect()  # three rows at most
    parts = [rows.limit(0).select(key, vector, target, "bump", F.lit(False).alias("synthetic"))]
    for bump, n, budget in plan:
        own = rows.where(F.col("bump") == bump)
        parts.append(own.where(F.col("_pos") < budget).select(key, vector, target, "bump", F.lit(False).alias("synthetic")))
        if budget > n:
            made = _synthetic(own, budget - n, n, target, k, seed, vector, key)
            parts.append(made.select(key, vector, target, F.lit(bump).alias("bump"), "synthetic"))
    return reduce(DataFrame.unionByName, parts)
