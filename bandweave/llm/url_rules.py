"""URL filter rules as a sort-merge range join, in DataFrame operations only.

A rule is a host with its subdomains and a path prefix. Its key is the host's labels in reversed order, a 0 byte and the path
prefix. A url has one such key for each suffix of its host, so a rule fits a url exactly if the rule's key is a prefix of one
of the url's keys. Prefixes are intervals in the byte order of keys, and intervals of prefixes lie inside each other or apart.

All keys, with the start and the end of each rule's interval, are sorted and swept. The number of open intervals is a running
sum of starts less ends; what lies on top of the stack at height h is the last start that reached height h. The order is
cut into ranges; each range is swept for itself, starting from the height and the stack that the ranges before it leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandweave.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ABOVE = bytearray(b"\xff")  # above any byte of UTF-8


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty where there is none."""
    found = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty where there is no `://`."""
    found = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))
    return F.coalesce(found, F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, ".").cast("binary"), F.lit(bytearray(b"\0")), path.cast("binary"))


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", ranges: int | None = None) -> DataFrame:
    """id, host, path, rule, verdict for each url row.

    `rules`: host, path, verdict. The fitting rule of the longest host wins, then that of the longest path; `rule` is host and
    path joined, null where none fits, and `verdict` is then `default`. Rules with a null or empty host, or a null verdict, are
    left out; a null path is empty. Of rules with the same host and path the least verdict counts (allow before block).
    Repeated rows are judged each, null ids and urls too. Empty tables give empty results or `default` for all.
    """
    parsed = urls.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    pairs = parsed.select("host", "path").where("host <> ''").distinct()
    labels = F.reverse(F.split("host", r"\.", -1))
    depth = F.explode(F.sequence(F.lit(1), F.size("_labels")))
    keys = (
        pairs.withColumn("_labels", labels)
        .select("*", depth.alias("_depth"))
        .select(_key(F.slice("_labels", 1, F.col("_depth")), F.col("path")).alias("_key"))
        .distinct()
        .select("_key", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_rule"), F.lit(None).cast("string").alias("_verdict"))
    )
    kept = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host <> '' and verdict is not null")
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("_verdict"))
        .select(_key(F.reverse(F.split("host", r"\.", -1)), F.col("path")).alias("_key"), F.concat("host", "path").alias("_rule"), "_verdict")
    )
    starts = kept.select("_key", F.lit(0).alias("_kind"), "_rule", "_verdict")
    ends = kept.select(F.concat("_key", F.lit(ABOVE)).alias("_key"), F.lit(2).alias("_kind"), "_rule", "_verdict")
    events = keys.unionByName(starts).unionByName(ends)
    cut = events.repartitionByRange("_key") if ranges is None else events.repartitionByRange(ranges, "_key")
    events = materialize(cut.withColumn("_range", F.spark_partition_id()), "url-events")

    step = F.when(F.col("_kind") == 0, 1).when(F.col("_kind") == 2, -1).otherwise(0)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    entry = events.groupBy("_range").agg(F.sum(step).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_entry"))
    order = [F.col("_key"), F.col("_kind")]
    swept = events.join(entry, "_range").withColumn("_height", F.col("_entry") + F.sum(step).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    start = F.when(F.col("_kind") == 0, F.struct("_rule", "_verdict"))
    own = F.last(start, ignorenulls=True).over(Window.partitionBy("_range", "_height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    swept = swept.withColumn("_top", own)

    # The stack a range begins with: of each height the last start in an earlier range. A row for each range and height.
    lasts = swept.where("_kind = 0").groupBy("_range", "_height").agg(F.max_by(F.struct("_rule", "_verdict"), F.struct("_key")).alias("_last"))
    # Bounded by ranges and heights in use: keys that found no start in their own range ask for it.
    asked = swept.where("_kind = 1 and _top is null and _height > 0").select("_range", "_height").distinct()
    both = asked.withColumn("_last", F.lit(None).cast(lasts.schema["_last"].dataType)).unionByName(lasts)
    before = Window.partitionBy("_height").orderBy("_range").rangeBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).where("_last is null").drop("_last")
    tops = (
        swept.where("_kind = 1 and _height > 0")
        .join(carried, ["_range", "_height"], "left")
        .select("_key", F.coalesce("_top", "_carried").alias("_top"))
    )

    fits = (
        pairs.withColumn("_labels", labels)
        .select("host", "path", "_labels", depth.alias("_depth"))
        .withColumn("_key", _key(F.slice("_labels", 1, F.col("_depth")), F.col("path")))
        .join(tops, "_key")
        .groupBy("host", "path")
        .agg(F.max_by("_top", "_depth").alias("_top"))
    )
    out = parsed.join(fits, ["host", "path"], "left")
    return out.select(id_col, "host", "path", F.col("_top._rule").alias("rule"), F.coalesce("_top._verdict", F.lit(default)).alias("verdict"))
