"""Column-level jobs on target, prediction and curve tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandweave import TARGET_MAXIMA, TARGETS
from bandweave.operators.ranks import value_rank


def scale_targets(df: DataFrame, maxima=TARGET_MAXIMA) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(m) for c, m in maxima.items() if c in df.columns})


def unscale_targets(df: DataFrame, maxima=TARGET_MAXIMA) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(m) for c, m in maxima.items() if c in df.columns})


def select_targets(df: DataFrame, names, key: str = "sample_index") -> DataFrame:
    return df.select(key, *names)


def scatter_targets(df: DataFrame, maxima=TARGET_MAXIMA, key: str = "sample_index") -> DataFrame:
    """Predictions of some targets as a full four-column row: zero where absent, in original units."""
    filled = [
        (F.coalesce(F.col(c), F.lit(0.0)) * F.lit(maxima[c]) if c in df.columns else F.lit(0.0)).alias(c)
        for c in TARGETS
    ]
    return df.select(key, *filled)


def rename_targets(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def join_targets(df: DataFrame, targets: DataFrame, key: str = "sample_index") -> DataFrame:
    return df.join(targets, key)


def join_wavelengths(df: DataFrame, wavelengths: DataFrame) -> DataFrame:
    """Wavelength of each 0-based band. The table has one row per band; Spark checks its size itself."""
    dim = wavelengths.select((F.col("band_no") - 1).alias("band"), "wavelength")
    return df.join(dim, "band")


def join_eval(truth: DataFrame, pred: DataFrame, base: DataFrame, keys=("fold", "sample_index")) -> DataFrame:
    """Truth, prediction and baseline side by side."""
    keys = list(keys)

    def ending(df: DataFrame, end: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"{c}_{end}") for c in TARGETS])

    return truth.join(ending(pred, "hat"), keys).join(ending(base, "base"), keys)


def combine_targets(parts: list[DataFrame], key: str = "sample_index") -> DataFrame:
    """One single-target prediction table per target, put together by key."""
    return reduce(lambda a, b: a.join(b, key), parts)


def gather(df: DataFrame, draws: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows at drawn positions; a position may be drawn many times."""
    return draws.join(df, pos)


def bucket(df: DataFrame, column: str, edges, labels, name: str = "bucket") -> DataFrame:
    """Label of the interval (lo, hi] a value falls into; null outside all of them."""
    spot = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges[:-1], edges[1:], labels))):
        spot = F.when((F.col(column) > lo) & (F.col(column) <= hi), F.lit(label)).otherwise(spot)
    return df.withColumn(name, spot)


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def merge_predictions(small: DataFrame, large: DataFrame, key: str = "sample_index") -> DataFrame:
    """Both size classes in one table, numbered 0..n-1 in sample order."""
    return reindex(small.unionByName(large), key)


def reindex(df: DataFrame, key: str = "sample_index", name: str = "index") -> DataFrame:
    return value_rank(df, key, name=name)


def with_unlabelled(labelled: DataFrame, unlabelled: DataFrame, cols=TARGETS) -> DataFrame:
    return labelled.unionByName(unlabelled, allowMissingColumns=True).fillna(0.0, subset=list(cols))


def distinct_ids(df: DataFrame, key: str = "sample_index") -> DataFrame:
    return df.select(key).distinct()


def order_by_key(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.col(key).cast("bigint"))


def head(df: DataFrame, n: int, key: str = "sample_index") -> DataFrame:
    return df.orderBy(key).limit(n)


def best(df: DataFrame, by, pick: str, score: str, largest: bool = True) -> DataFrame:
    """The entry with the best score per group, first entry on equal scores."""
    sign = F.col(score) if largest else -F.col(score)
    order = F.struct(sign, -F.col(pick))
    return df.groupBy(*by).agg(F.max_by(pick, order).alias(pick), F.max_by(score, order).alias(score))


def ensemble_mean(df: DataFrame, cols=TARGETS, key: str = "sample_index") -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in cols])


def running_row(df: DataFrame, by, order: str) -> Window:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
