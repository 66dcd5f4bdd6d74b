"""Folds, hold-outs and batches: membership is a column computed from a repeatable draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandweave.operators.ranks import shuffled_rank


def _fold_of(pos: Column, n: Column, k: int) -> Column:
    """k consecutive parts of a shuffled order; the first n mod k parts hold one row more."""
    small = F.floor(n / F.lit(k))
    extra = n % F.lit(k)
    longer = extra * (small + 1)
    early = F.floor(pos / (small + 1))
    late = extra + F.floor((pos - longer) / F.greatest(small, F.lit(1)))
    return F.when(pos < longer, early).otherwise(late).cast("bigint")


def kfold(df: DataFrame, k: int, seed: int, key: str = "sample_index") -> DataFrame:
    ranked = shuffled_rank(df, key, seed, name="_pos", total="_n")
    return ranked.withColumn("fold", _fold_of(F.col("_pos"), F.col("_n"), k)).drop("_pos", "_n")


def stratified_kfold(df: DataFrame, label: str, k: int, seed: int, key: str = "sample_index") -> DataFrame:
    """Each class is dealt round-robin over the folds in shuffled order."""
    ranked = shuffled_rank(df, key, seed, by=[label], name="_pos")
    return ranked.withColumn("fold", (F.col("_pos") % k).cast("bigint")).drop("_pos")


def holdout(df: DataFrame, fraction: float, seed: int, key: str = "sample_index") -> DataFrame:
    """Mark the first `floor(n * fraction)` rows of a shuffled order as held out."""
    ranked = shuffled_rank(df, key, seed, name="_pos", total="_n")
    limit = F.floor(F.col("_n") * F.lit(fraction))
    return ranked.withColumn("held_out", F.col("_pos") < limit).drop("_pos", "_n")


def grouped_kfold(df: DataFrame, group: str, k: int, fraction: float, seed: int) -> DataFrame:
    """Hold out a share of the groups and fold the rest; all rows of a group stay together.

    Held-out groups carry fold null.
    """
    ids = df.select(group).distinct()
    marked = shuffled_rank(ids, group, seed, name="_pos", total="_n")
    held = F.floor(F.col("_n") * F.lit(fraction))
    fold = _fold_of(F.col("_pos") - held, F.col("_n") - held, k)
    marked = marked.select(
        group,
        (F.col("_pos") < held).alias("held_out"),
        F.when(F.col("_pos") >= held, fold).alias("fold"),
    )
    return df.join(marked, group)


def complement(df: DataFrame, valid: DataFrame, key: str = "sample_index") -> DataFrame:
    """Training rows: everything that is not in the validation set."""
    return df.join(valid.select(key), key, "left_anti")


def pick(df: DataFrame, ids: DataFrame, key: str = "sample_index") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def complement_means(df: DataFrame, by, fold: str, cols, name: str) -> DataFrame:
    """Mean of each column over the rows of the *other* folds, per group and fold.

    Sums are distributive, so one aggregate serves every fold and no fold is scanned twice.
    """
    by = list(by)
    sums = df.groupBy(*by, fold).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{c}") for c in cols])
    whole = Window.partitionBy(*by)
    rest = F.sum("_n").over(whole) - F.col("_n")
    return sums.select(
        *by, fold, *[((F.sum(f"_{c}").over(whole) - F.col(f"_{c}")) / rest).alias(name.format(c)) for c in cols]
    )


def fill_batches(df: DataFrame, size: int, seed: int, key: str = "sample_index") -> DataFrame:
    """Shuffled batches; the last one is filled with the first rows of the shuffled order."""
    ranked = shuffled_rank(df, key, seed, name="pos", total="_n")
    short = (F.lit(size) - F.col("_n") % size) % size
    # A table smaller than a batch is gone through again and again.
    again = F.sequence(F.col("pos"), F.col("_n") + short - 1, F.col("_n"))
    slots = ranked.withColumn("pos", F.explode(again)).drop("_n")
    return slots.withColumn("batch", F.floor(F.col("pos") / size).cast("bigint"))


def contrastive_pairs(df: DataFrame, size: int, seed: int, key: str = "sample_index") -> DataFrame:
    """Pair rows inside batches: the first half with itself (0), the second half mirrored (1). The last batch is filled up."""
    half = size // 2
    rows = fill_batches(df.select(key), size, seed, key).select(F.col(key).alias("left"), "batch", (F.col("pos") % size).alias("slot"))
    mirror = rows.select("batch", F.col("slot").alias("partner"), F.col("left").alias("right"))
    partner = F.when(F.col("slot") < half, F.col("slot")).otherwise(F.lit(size - 1 + half) - F.col("slot"))
    pairs = rows.withColumn("partner", partner).join(mirror, ["batch", "partner"])
    different = (F.col("slot") >= half).cast("int")
    return pairs.select("batch", "slot", "left", "right", different.alias("different"))


def last_n(df: DataFrame, by, order, n: int) -> DataFrame:
    """Last n rows of each group; the row limit is applied before the shuffle."""
    latest = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= n).drop("_r")
