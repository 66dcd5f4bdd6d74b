"""Ranks over a whole table: rows are dealt out by range, numbered in their part, and the sizes of earlier parts are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandweave.session import materialize

PART_BITS = 33  # monotonically_increasing_id holds the part above these bits and the row's number below


def ranked(rows: DataFrame, order: list[Column], name: str, label: str = "ranked") -> DataFrame:
    """The rows with `name`, their position from 1 (long) along `order`, which must tell all rows apart that may not swap.

    The numbered rows are written before sizes are counted, so a task run again can't number them otherwise.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(dealt.withColumn(name, F.monotonically_increasing_id()), label)
    part = F.shiftright(name, PART_BITS)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    joined = numbered.withColumn("_part", part).join(starts, "_part")
    inside = F.col(name).bitwiseAND((1 << PART_BITS) - 1)
    return joined.withColumn(name, F.col("_start") + inside + 1).select(*rows.columns, name)
