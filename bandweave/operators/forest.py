"""A regression forest with one vector of all targets in each leaf, grown level by level from distributed histograms.

Features are cut once into bins at values of the data. For each level, tasks add up counts and target sums by node, feature and
bin; sums are added over tasks, each (node, feature) finds its best cut, and only the best cut of each node reaches the driver. The
model, which trees and depth bound, is all that is sent to tasks; rows are never sorted or moved.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandweave import TARGETS
from bandweave.functions.arrow import as_lists, as_matrix
from bandweave.session import materialize

BINS = 64
HISTOGRAM = 32 << 20  # bytes of histograms a task holds; more nodes take more jobs

NODE_FIELDS = "tree int, node int, feature int, threshold double, value array<double>, gain double"


@dataclass
class Forest:
    """Nodes by (tree, number): feature, threshold, value, gain. Children of i are 2i + 1 (x <= threshold) and 2i + 2; a leaf has feature -1."""

    targets: list[str]
    trees: int
    nodes: dict[tuple[int, int], tuple[int, float, list[float], float]] = field(default_factory=dict)

    def walk(self, rows: np.ndarray, tree: int) -> np.ndarray:
        """Number of the node in which each row ends."""
        at = np.zeros(len(rows), np.int64)
        todo = {0: np.arange(len(rows))}
        while todo:
            number, some = todo.popitem()
            feature, threshold, *_ = self.nodes[tree, number]
            if feature < 0 or not len(some):
                at[some] = number
                continue
            right = rows[some, feature] > threshold
            todo[2 * number + 1], todo[2 * number + 2] = some[~right], some[right]
        return at

    def values(self, rows: np.ndarray) -> np.ndarray:
        """Mean over trees of the leaves' vectors."""
        out = np.zeros((len(rows), len(self.targets)))
        for tree in range(self.trees):
            leaf, back = np.unique(self.walk(rows, tree), return_inverse=True)
            out += np.array([self.nodes[tree, i][2] for i in leaf.tolist()]).reshape(len(leaf), len(self.targets))[back]
        return out / self.trees

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, n, f, c, v, g) for (t, n), (f, c, v, g) in sorted(self.nodes.items())], NODE_FIELDS)

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).withColumn("targets", F.lit(",".join(self.targets))).write.mode("overwrite").parquet(path)

    def importances(self, spark: SparkSession, width: int) -> DataFrame:
        """Share of each feature in the gain of all splits."""
        gains = np.zeros(width)
        for feature, _, _, gain in self.nodes.values():
            if feature >= 0:
                gains[feature] += gain
        return spark.createDataFrame(list(enumerate((gains / max(gains.sum(), 1e-300)).tolist())), "feature int, importance double")


def load(spark: SparkSession, path: str) -> Forest:
    rows = spark.read.parquet(path).collect()  # as many as the model has nodes
    nodes = {(r["tree"], r["node"]): (r["feature"], r["threshold"], list(r["value"]), r["gain"]) for r in rows}
    return Forest(rows[0]["targets"].split(","), 1 + max(t for t, _ in nodes), nodes)


def cut_points(df: DataFrame, features: str, bins: int) -> list[np.ndarray]:
    """Values at which each feature may be split, at most `bins` - 1: all but its greatest value if it has few, else quantiles."""
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    long = df.select(F.posexplode(features).alias("feature", "x"))
    found = long.groupBy("feature").agg(F.percentile_approx("x", probs, 10_000).alias("cuts"), F.max("x").alias("most"), F.approx_count_distinct("x", 0.02).alias("distinct"))
    rows = found.collect()  # one row a feature
    small = [r["feature"] for r in rows if r["distinct"] < 0.9 * bins]
    exact = {}
    if small:  # features of few values: all of them, at most `bins` each
        for r in long.where(F.col("feature").isin(small)).groupBy("feature").agg(F.array_sort(F.collect_set("x")).alias("x")).collect():
            exact[r["feature"]] = r["x"][:-1]
    out = {r["feature"]: np.unique(exact.get(r["feature"], [x for x in r["cuts"] if x < r["most"]])) for r in rows}
    return [out[i] for i in range(len(out))]


def _weights(keys: np.ndarray, tree: int, seed: int, bootstrap: bool) -> np.ndarray:
    """How often a row counts in a tree: once, or a Poisson draw of mean one that depends on key, tree and seed only."""
    if not bootstrap:
        return np.ones(len(keys))
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed << 20) + tree + 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = (x >> np.uint64(11)).astype(np.float64) / (1 << 53)
    steps = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1, 16)])))
    return np.searchsorted(steps, u, side="right").astype(np.float64)


def _best_cut(hist: np.ndarray, least: float) -> tuple[float, int]:
    """Gain in summed squares over all targets, and bin, of the best cut of a (bins, 1 + targets) histogram; the lowest of equal ones."""
    left = np.cumsum(hist, axis=0)
    total, left = left[-1], left[:-1]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[:, 1:] ** 2).sum(1) / left[:, 0] + (right[:, 1:] ** 2).sum(1) / right[:, 0] - (total[1:] ** 2).sum() / total[0]
    gain[(np.minimum(left[:, 0], right[:, 0]) < least) | ~np.isfinite(gain)] = -np.inf
    best = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[best]) if len(gain) else -np.inf), best


def fit(df: DataFrame, targets=TARGETS, trees: int = 100, depth: int = 10, leaf: float = 1, seed: int = 0, features: str = "features", key: str = "sample_index", bins: int = BINS, bootstrap: bool = True) -> Forest:
    """Grow `trees` trees to at most `depth` splits in a row; a child holds at least `leaf` (weighted) rows.

    The split of a node is the one that lowers the summed squared errors of all targets most; equal ones go by the smaller feature
    and threshold. Rows with a null target or feature array are left out. Without rows there is nothing to fit.
    """
    targets = list(targets)
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(features).cast("array<double>").alias("x"), F.array(*[F.col(c).cast("double") for c in targets]).alias("y"))
    rows = rows.where(F.col("x").isNotNull() & ~F.exists("y", lambda v: v.isNull()))
    cuts = cut_points(rows, "x", bins)
    if not cuts:
        raise ValueError("no rows to fit a forest on")
    width, depth_bins, t_count = len(cuts), max(len(c) for c in cuts) + 1, len(targets)

    def binned(batches):
        for batch in batches:
            x = as_matrix(batch.column(1))
            made = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], 1).astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in made], pa.binary()), batch.column(2)], names=["key", "x", "y"])

    kept = materialize(rows.mapInArrow(binned, "key bigint, x binary, y array<double>"), "forest-rows")
    model = Forest(targets, trees)
    in_bins = Forest(targets, trees)  # the same tree with bins as thresholds
    active = [(t, 0) for t in range(trees)]
    for tree, number in active:
        model.nodes[tree, number] = in_bins.nodes[tree, number] = (-1, 0.0, [0.0] * t_count, 0.0)
    room = max(1, HISTOGRAM // (width * depth_bins * (1 + t_count) * 8))
    for level in range(depth + 1):
        following = []
        for at in range(0, len(active), room):
            group = active[at : at + room]
            slots = {node: i for i, node in enumerate(group)}

            def add_up(batches, group=group, slots=slots):
                sums = np.zeros((len(group), width, depth_bins, 1 + t_count))
                for batch in batches:
                    keys, y = batch.column(0).to_numpy(), as_matrix(batch.column(2))
                    x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(len(keys), -1).astype(np.int64)
                    for tree in sorted({t for t, _ in group}):
                        weight = _weights(keys, tree, seed, bootstrap)
                        node = in_bins.walk(x, tree)
                        slot = np.array([slots.get((tree, i), -1) for i in range(node.max(initial=0) + 1)])[node]
                        some = np.flatnonzero((slot >= 0) & (weight > 0))
                        w = weight[some]
                        per_row = np.concatenate([w[:, None], w[:, None] * y[some]], 1)
                        for f in range(width):
                            place = slot[some] * depth_bins + x[some, f]
                            for c in range(1 + t_count):
                                sums[:, f, :, c] += np.bincount(place, per_row[:, c], len(group) * depth_bins).reshape(len(group), depth_bins)
                used = np.flatnonzero(sums[:, 0, :, 0].any(1))
                for i in used.tolist():
                    raw = [sums[i, f].tobytes() for f in range(width)]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array(raw, pa.binary())], names=["slot", "feature", "raw"])

            def decide(table: pa.Table) -> pa.Table:
                hist = sum(np.frombuffer(x, "<f8") for x in table["raw"].to_pylist()).reshape(depth_bins, 1 + t_count)
                gain, cut = _best_cut(hist, leaf)
                total = hist.sum(0)
                return pa.table([table["slot"][:1], table["feature"][:1], pa.array([gain]), pa.array([cut], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["slot", "feature", "gain", "cut", "total"])

            cuts_found = kept.mapInArrow(add_up, "slot int, feature int, raw binary").groupBy("slot", "feature").applyInArrow(decide, "slot int, feature int, gain double, cut int, total array<double>")
            best = cuts_found.groupBy("slot").agg(F.max_by(F.struct("feature", "gain", "cut", "total"), F.struct(F.col("gain"), -F.col("feature"))).alias("b")).collect()  # one row a node
            for row in best:
                (tree, number), b = group[row["slot"]], row["b"]
                value = [s / b["total"][0] for s in b["total"][1:]]
                split = level < depth and np.isfinite(b["gain"]) and b["gain"] > 1e-12 * (1 + sum(s * s for s in b["total"][1:]) / b["total"][0])
                for made, threshold in ((model, float(cuts[b["feature"]][b["cut"]]) if split else 0.0), (in_bins, float(b["cut"]))):
                    made.nodes[tree, number] = (b["feature"], threshold, value, b["gain"]) if split else (-1, 0.0, value, 0.0)
                if split:
                    for child in (2 * number + 1, 2 * number + 2):
                        following.append((tree, child))
                        model.nodes[tree, child] = in_bins.nodes[tree, child] = (-1, 0.0, value, 0.0)  # until its own turn
        if not following:
            break
        active = following
    return model


def predict(model: Forest, df: DataFrame, features: str = "features") -> DataFrame:
    """Add <target>_hat of each target; one pass gives all of them. A null feature array has no prediction."""

    @F.arrow_udf("array<double>")
    def values(column: pa.Array) -> pa.Array:
        real = column.is_valid()
        out = as_lists(model.values(as_matrix(column.filter(real))))
        place = np.where(real.to_numpy(zero_copy_only=False), np.cumsum(real.to_numpy(zero_copy_only=False)) - 1, -1)
        return out.take(pa.array(place, mask=place < 0))

    marked = df.withColumn("_hat", values(F.col(features).cast("array<double>")))
    return marked.select(*df.columns, *[F.col("_hat")[i].alias(f"{c}_hat") for i, c in enumerate(model.targets)])
