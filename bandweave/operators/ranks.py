"""Positions, running values and exact quantiles that survive hot keys.

A plain window sends a whole group to one task. Here every group is cut by a bucket that grows with
the sort order; rows are ranked inside (group, bucket), and the sizes of earlier buckets are added.
The rows are shuffled once, on (group, bucket), as with the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandweave.functions.draws import uniform
from bandweave.session import materialize

HASH_BUCKETS = 4096
ROWS_PER_BUCKET = 200_000
LARGE_GROUP = 100_000  # rows of a group that a single task may still rank


def literal_array(values) -> Column:
    """Array of doubles written as one SQL literal, which is quicker to build than many columns."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def _key(by, bucket: Column) -> Column:
    """Group and bucket as one struct, whose nulls compare as equal, so rows with null keys keep their place."""
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    return F.struct(group.alias("by"), bucket.alias("bucket"))


def group_rank(df: DataFrame, by, order, bucket: Column, name: str = "rank", total: str | None = None) -> DataFrame:
    """0-based position in the group; `bucket` must not decrease along `order`."""
    rows = df.withColumn("_key", _key(by, bucket))
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy("_key.by")
    before = whole.orderBy("_key.bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_key",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(whole).alias("_total"),
    )
    inside = Window.partitionBy("_key").orderBy(*order)
    ranked = rows.withColumn("_row", F.row_number().over(inside))
    joined = ranked.join(offsets.hint("merge"), "_key")  # the rows lie in order of the key already, and are never sent whole
    out = joined.withColumn(name, (F.col("_before") + F.col("_row") - 1).cast("bigint"))
    if total:
        out = out.withColumn(total, F.col("_total").cast("bigint"))
    return out.drop("_key", "_row", "_before", "_total")


def small_group_rank(df: DataFrame, by, order, bucket: Column, name: str = "rank", total: str | None = None, most: int = LARGE_GROUP) -> DataFrame:
    """As `group_rank`, for tables of many small groups: one shuffle of the rows, and only groups of more than `most` rows are cut.

    The group sizes are counted at once, in a job that reads the columns `by` alone.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > most)
    large = materialize(sizes.select(F.struct(*by).alias("_by")), "large-groups")  # at most rows / `most`; a struct, so null groups stay

    def plain(rows: DataFrame) -> DataFrame:
        group = Window.partitionBy(*by)
        ranked = rows.withColumn(name, (F.row_number().over(group.orderBy(*order)) - 1).cast("bigint"))
        return ranked.withColumn(total, F.count(F.lit(1)).over(group)) if total else ranked

    if large.isEmpty():
        return plain(df)
    rows = df.withColumn("_by", F.struct(*by))
    few = plain(rows.join(large, "_by", "left_anti"))
    many = group_rank(rows.join(large, "_by", "left_semi"), by, order, bucket, name, total)
    return few.unionByName(many).drop("_by")


def shuffled_rank(df: DataFrame, key, seed: int, by=(), name: str = "rank", total: str | None = None) -> DataFrame:
    """Position in a repeatable shuffle: order by draw, then by key. The draw itself is the bucket."""
    keys = [key] if isinstance(key, str) else list(key)
    drawn = df.withColumn("_u", uniform(seed, *[F.col(k) for k in keys]))
    bucket = F.floor(F.col("_u") * HASH_BUCKETS).cast("int")  # a few per group for small groups, bounded rows up to 4096 x the task size
    return group_rank(drawn, by, ["_u", *keys], bucket, name, total).drop("_u")


def value_buckets(df: DataFrame, value: str, rows_per_bucket: int = ROWS_PER_BUCKET, most: int = 1024) -> list[float]:
    """Cut points of a numeric column into about equal parts; at most `most` numbers reach the driver.

    The number of parts follows the row count, so a small table is not cut at all.
    """
    probs = literal_array([i / most for i in range(1, most)])
    number = F.col(value).cast("double")
    row = df.agg(F.percentile_approx(number, probs, 10_000).alias("cuts"), F.count(number).alias("n")).first()
    parts = min(most, row["n"] // rows_per_bucket + 1)
    step = most / parts
    return sorted({row["cuts"][int(i * step) - 1] for i in range(1, parts)}) if row["cuts"] else []


def with_bucket(df: DataFrame, value: str, cuts: list[float], descending: bool = False) -> DataFrame:
    """Add `_bucket`, the number of cut points <= value, falling instead of rising where asked."""
    if not cuts:
        return df.withColumn("_bucket", F.lit(0))
    ready = df.withColumns({"_cuts": literal_array(cuts), "_at": F.col(value).cast("double")})
    found = sorted_lookup(ready, "_cuts", "_at", len(cuts), "_bucket").drop("_cuts", "_at")
    return found.withColumn("_bucket", -F.col("_bucket")) if descending else found


def value_rank(df: DataFrame, value: str, ties=(), descending: bool = False, name: str = "rank", total=None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Global position by a numeric column with few equal values."""
    marked = with_bucket(df, value, value_buckets(df, value, rows_per_bucket), descending).withColumnRenamed("_bucket", "_place")
    order = F.col(value).desc() if descending else F.col(value).asc()
    return group_rank(marked, [], [order, *ties], F.col("_place"), name, total).drop("_place")


def running_sums(df: DataFrame, value: str, sums: dict[str, str], descending: bool = False, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Running totals over a globally ordered column of distinct values: {output: input}."""
    rows = with_bucket(df, value, value_buckets(df, value, rows_per_bucket), descending)
    parts = rows.groupBy("_bucket").agg(*[F.sum(src).alias(f"_{out}") for out, src in sums.items()])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "_bucket",
        *[F.coalesce(F.sum(f"_{out}").over(before), F.lit(0)).alias(f"_{out}") for out in sums],
        *[F.sum(f"_{out}").over(Window.partitionBy()).alias(f"{out}_total") for out in sums],
    )
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select("*", *[F.sum(src).over(inside).alias(f"_in_{out}") for out, src in sums.items()])
    joined = running.join(offsets, "_bucket")
    for out in sums:
        joined = joined.withColumn(out, F.col(f"_in_{out}") + F.col(f"_{out}"))
    return joined.drop("_bucket", *[f"_{out}" for out in sums], *[f"_in_{out}" for out in sums])


def sorted_lookup(df: DataFrame, array: str, value: str, size: int, out: str) -> DataFrame:
    """Number of entries of a sorted array column that are <= value, by binary search in the plan."""
    step = 1
    while step * 2 <= size:
        step *= 2
    df = df.withColumn(out, F.lit(0))
    while step >= 1:
        probe = F.get(F.col(array), F.col(out) + F.lit(step - 1))
        df = df.withColumn(out, F.when(probe <= F.col(value), F.col(out) + F.lit(step)).otherwise(F.col(out)))
        step //= 2
    return df


def exact_quantiles(df: DataFrame, by, value: str, probs, name: str = "q", buckets: int = 256) -> DataFrame:
    """Exact linearly interpolated quantiles per group: one row per group with an array column.

    A sketch gives cut points, counting the rows between them finds the buckets that hold the wanted
    positions, and only the distinct values of those buckets are sorted.
    """
    by = list(by)
    if not by:
        raise ValueError("name at least one grouping column; a constant column stands for the whole table")
    probs = [float(p) for p in probs]
    names, by = by, ["_by"]  # one struct, so null groups stay
    rows = df.select(F.struct(*names).alias("_by"), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    grid = literal_array([i / buckets for i in range(1, buckets)])
    cuts = rows.groupBy(*by).agg(
        F.array_distinct(F.percentile_approx("_v", grid, 10_000)).alias("_cuts"), F.count("_v").alias("_n")
    )
    cuts = materialize(cuts, "cuts")  # one row a group; a sketch made again for another reader can differ, and positions would get lost
    placed = sorted_lookup(rows.join(cuts, by), "_cuts", "_v", buckets - 1, "_bucket")
    counted = placed.groupBy(*by, "_bucket", "_v").agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    parts = counted.groupBy(*by, "_bucket").agg(F.sum("_c").alias("_size"), F.max("_n").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    # One row per group with its buckets in order; every wanted position then looks up its bucket.
    entries = F.array_sort(F.collect_list(F.struct("_before", "_bucket")))
    layout = parts.groupBy(*by).agg(entries.alias("_l"), F.max("_n").alias("_n"))
    at = literal_array(probs)
    last = F.col("_n") - 1
    ends = F.transform(at, lambda p: F.array(F.floor(p * last).cast("bigint"), F.ceil(p * last).cast("bigint")))
    wanted = layout.select(
        *by,
        "_n",
        "_l",
        F.explode(F.array_distinct(F.flatten(ends))).alias("_pos"),
    )
    spot = F.element_at(F.filter("_l", lambda e: e["_before"] <= F.col("_pos")), -1)
    wanted = wanted.select(*by, "_n", "_pos", spot["_bucket"].alias("_bucket"), spot["_before"].alias("_before"))
    wanted = wanted.groupBy(*by, "_bucket", "_before", "_n").agg(F.collect_list("_pos").alias("_want"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    needed = counted.drop("_n").join(wanted, [*by, "_bucket"])
    run = needed.withColumn("_end", F.sum("_c").over(inside) + F.col("_before"))
    hits = run.select(
        *by,
        "_v",
        "_n",
        F.explode(
            F.filter("_want", lambda x: (x >= F.col("_end") - F.col("_c")) & (x < F.col("_end")))
        ).alias("_pos"),
    )
    found = hits.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("_pos", "_v"))).alias("_at"), F.max("_n").alias("_n")
    )

    def interpolate(p: Column) -> Column:
        h = p * (F.col("_n") - 1)
        lo = F.element_at(F.col("_at"), F.floor(h).cast("bigint"))
        hi = F.element_at(F.col("_at"), F.ceil(h).cast("bigint"))
        return lo + (hi - lo) * (h - F.floor(h))

    return found.select(*[F.col("_by")[c].alias(c) for c in names], F.transform(at, interpolate).alias(name), F.col("_n").alias("n"))


def group_running(df: DataFrame, by, order, bucket: Column, folds: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running sum or min inside each group: {output: ("sum" | "min", column)}, cut by bucket like ranks."""
    reduce = {"sum": F.sum, "min": F.min}
    rows = df.withColumn("_key", _key(list(by), bucket))
    rows = rows.withColumns({f"_v_{out}": col for out, (_, col) in folds.items()})
    parts = rows.groupBy("_key").agg(*[reduce[k](f"_v_{out}").alias(f"_p_{out}") for out, (k, _) in folds.items()])
    before = Window.partitionBy("_key.by").orderBy("_key.bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = parts.select("_key", *[reduce[k](f"_p_{out}").over(before).alias(f"_e_{out}") for out, (k, _) in folds.items()])
    inside = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumns({f"_r_{out}": reduce[k](f"_v_{out}").over(inside) for out, (k, _) in folds.items()})
    joined = running.join(earlier, "_key")
    for out, (kind, _) in folds.items():
        now, past = F.col(f"_r_{out}"), F.col(f"_e_{out}")
        both = now + past if kind == "sum" else F.when(past <= now, past).otherwise(now)
        joined = joined.withColumn(out, F.when(past.isNull(), now).otherwise(both))
    return joined.drop("_key", *[f"_{p}_{out}" for out in folds for p in "vre"])
