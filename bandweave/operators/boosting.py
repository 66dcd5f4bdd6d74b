"""Boosted trees with any loss of the registry, grown from distributed histograms of gradients and hessians.

The trees of all targets grow side by side: a level of a round is one job, whatever the number of targets. Gradients are column
expressions on truth, prediction and row weight (`scores.LOSSES`); tasks add them up by node, feature and bin, and only the best
cut of each node reaches the driver. Rows are neither sorted nor moved. Predictions are written back every REFRESH rounds; in
between a task walks the few trees grown since.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandweave import TARGETS
from bandweave.functions.arrow import as_lists, as_matrix
from bandweave.operators.forest import BINS, HISTOGRAM, Forest, cut_points
from bandweave.operators.forest import load as load_trees
from bandweave.operators.scores import LOSSES
from bandweave.session import materialize

REFRESH = 10  # rounds after which predictions are written back to the rows


@dataclass
class Boosted:
    """Tree r * len(targets) + t is round r of target t; its leaves hold what they add to the base of that target."""

    targets: list[str]
    base: list[float]
    trees: Forest

    def add(self, rows: np.ndarray, out: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """Add the leaves of trees `first` to `last` (not included) to a rows x targets matrix."""
        for tree in range(first, self.trees.trees if last is None else last):
            ends, back = np.unique(self.trees.walk(rows, tree), return_inverse=True)
            out[:, tree % len(self.targets)] += np.array([self.trees.nodes[tree, i][2][0] for i in ends.tolist()])[back]
        return out

    def values(self, rows: np.ndarray) -> np.ndarray:
        return self.add(rows, np.tile(np.array(self.base), (len(rows), 1)))

    def save(self, spark: SparkSession, path: str) -> None:
        """Two tables under a path: the nodes and, in order of targets, the bases."""
        self.trees.save(spark, f"{path}/trees")
        rows = list(zip(range(len(self.targets)), self.targets, self.base, strict=True))
        spark.createDataFrame(rows, "place int, target string, base double").write.mode("overwrite").parquet(f"{path}/bases")

    def importances(self, spark: SparkSession, width: int) -> DataFrame:
        return self.trees.importances(spark, width)


def load(spark: SparkSession, path: str) -> Boosted:
    bases = spark.read.parquet(f"{path}/bases").orderBy("place").collect()  # one row a target
    return Boosted([r["target"] for r in bases], [r["base"] for r in bases], load_trees(spark, f"{path}/trees"))


def best_cut(hist: np.ndarray, l2: float, least_weight: float) -> tuple[float, int]:
    """Gain and bin of the best cut of a (bins, 2) histogram of gradients and hessians; the lowest of equal ones."""
    left = np.cumsum(hist, axis=0)
    total, left = left[-1], left[:-1]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[:, 0] ** 2 / (left[:, 1] + l2) + right[:, 0] ** 2 / (right[:, 1] + l2) - total[0] ** 2 / (total[1] + l2)
    light = np.minimum(left[:, 1], right[:, 1])
    gain[(light < least_weight) | (light <= 0) | ~np.isfinite(gain)] = -np.inf
    best = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[best]) if len(gain) else -np.inf), best


def fit(
    df: DataFrame,
    targets=TARGETS,
    loss: str = "squared",
    rounds: int = 100,
    depth: int = 6,
    step: float = 0.3,
    l2: float = 1.0,
    least_gain: float = 0.0,
    least_weight: float = 1.0,
    base: float | None = None,
    weight: str | None = None,
    features: str = "features",
    bins: int = BINS,
) -> Boosted:
    """Boost `rounds` trees of at most `depth` splits in a row for each target.

    With G and H the sums of gradients and hessians, a leaf adds -step * G / (H + l2), and a split gains
    G_left^2 / (H_left + l2) + G_right^2 / (H_right + l2) - G^2 / (H + l2). It is made if it gains more than `least_gain` and both
    sides have H >= least_weight; equal ones go by the smaller feature and threshold. `base` is the first prediction, else the
    weighted mean. `weight` names a column that multiplies gradients and hessians of a row. A row without features, or with a
    weight that is null or not positive, is left out; a null or NaN target is left out for that target alone. Without rows
    there is nothing to fit.
    """
    targets = list(targets)
    n_t = len(targets)
    if loss not in LOSSES:
        raise ValueError(f"unknown loss {loss!r}, known are {sorted(LOSSES)}")
    truth = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in targets]
    counted = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.array(*truth).alias("y"), counted.alias("w"))
    rows = rows.where("x is not null and w > 0 and not isnan(w)")
    cuts = cut_points(rows, "x", bins)
    if not cuts:
        raise ValueError("no rows to boost on")
    width, n_bins = len(cuts), max(len(c) for c in cuts) + 1
    if base is None:
        known = [F.when(F.col("y")[i].isNotNull(), F.col("w")) for i in range(n_t)]
        means = rows.agg(*[F.coalesce(F.try_divide(F.sum(F.col("y")[i] * F.col("w")), F.sum(known[i])), F.lit(0.0)).alias(f"m{i}") for i in range(n_t)])
        bases = list(means.first())
    else:
        bases = [float(base)] * n_t

    def binned(batches):
        for batch in batches:
            x = as_matrix(batch.column(0))
            made = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], 1).astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in made], pa.binary()), batch.column(1), batch.column(2)], names=["x", "y", "w"])

    def bins_of(column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), width).astype(np.int64)

    started = rows.mapInArrow(binned, "x binary, y array<double>, w double").withColumn("p", F.array(*[F.lit(float(b)) for b in bases]))
    kept = materialize(started, "boost-rows")
    model = Boosted(targets, bases, Forest(["step"], rounds * n_t))
    in_bins = Boosted(targets, bases, Forest(["step"], rounds * n_t))  # the same trees with bins as thresholds
    room = max(1, HISTOGRAM // (width * n_bins * 2 * 8))
    written = 0  # trees whose leaves are in the written predictions

    def with_trees(df: DataFrame, first: int, last: int) -> DataFrame:
        @F.arrow_udf("array<double>")
        def predicted(x: pa.Array, p: pa.Array) -> pa.Array:
            return as_lists(in_bins.add(bins_of(x), as_matrix(p).copy(), first, last))

        return df.withColumn("p", predicted("x", "p"))

    for turn in range(rounds):
        now = with_trees(kept, written, turn * n_t) if written < turn * n_t else kept
        if turn and turn % REFRESH == 0:
            now = kept = materialize(now, "boost-rows")
            written = turn * n_t
        parts = []
        for i in range(n_t):
            y, w = F.col("y")[i], F.col("w")
            for sums in LOSSES[loss](y, F.col("p")[i], F.lit(1.0), False):
                parts.append(F.when(y.isNotNull(), sums * w).otherwise(F.lit(0.0)))
        pulls = now.select("x", F.array(*parts).alias("pulls"))

        active = [(turn * n_t + i, 0) for i in range(n_t)]
        for node in active:
            model.trees.nodes[node] = in_bins.trees.nodes[node] = (-1, 0.0, [0.0], 0.0)
        for level in range(depth + 1):
            following = []
            wide = width if level < depth else 1  # the last level needs totals only
            for at in range(0, len(active), room):
                group = active[at : at + room]
                slots = {node: i for i, node in enumerate(group)}

                def add_up(batches, group=group, slots=slots, wide=wide):
                    sums = np.zeros((len(group), wide, n_bins, 2))
                    for batch in batches:
                        x, pull = bins_of(batch.column(0)), as_matrix(batch.column(1))
                        for tree in sorted({t for t, _ in group}):
                            ends, back = np.unique(in_bins.trees.walk(x, tree), return_inverse=True)
                            slot = np.array([slots.get((tree, i), -1) for i in ends.tolist()], np.int64)[back]
                            some = np.flatnonzero(slot >= 0)
                            for f in range(wide):
                                place = slot[some] * n_bins + x[some, f]
                                for c in range(2):
                                    values = pull[some, 2 * (tree % n_t) + c]
                                    sums[:, f, :, c] += np.bincount(place, values, len(group) * n_bins).reshape(len(group), n_bins)
                    for i in np.flatnonzero(sums[:, 0].any((1, 2))).tolist():
                        raw = [sums[i, f].tobytes() for f in range(wide)]
                        yield pa.RecordBatch.from_arrays([pa.array([i] * wide, pa.int32()), pa.array(range(wide), pa.int32()), pa.array(raw, pa.binary())], names=["slot", "feature", "raw"])

                def decide(table: pa.Table) -> pa.Table:
                    hist = sum(np.frombuffer(x, "<f8") for x in table["raw"].to_pylist()).reshape(n_bins, 2)
                    gain, cut = best_cut(hist, l2, least_weight)
                    g, h = hist.sum(0).tolist()
                    return pa.table([table["slot"][:1], table["feature"][:1], pa.array([gain]), pa.array([cut], pa.int32()), pa.array([g]), pa.array([h])], names=["slot", "feature", "gain", "cut", "g", "h"])

                found = pulls.mapInArrow(add_up, "slot int, feature int, raw binary").groupBy("slot", "feature").applyInArrow(decide, "slot int, feature int, gain double, cut int, g double, h double")
                best = found.groupBy("slot").agg(F.max_by(F.struct("feature", "gain", "cut", "g", "h"), F.struct(F.col("gain"), -F.col("feature"))).alias("b")).collect()  # one row a node
                for row in best:
                    (tree, number), b = group[row["slot"]], row["b"]
                    held = b["h"] + l2
                    value = [-step * b["g"] / held if held > 0 else 0.0]
                    worth = b["g"] ** 2 / held if held > 0 else 0.0
                    split = level < depth and np.isfinite(b["gain"]) and b["gain"] > max(least_gain, 1e-12 * (1 + worth))
                    for made, threshold in ((model, float(cuts[b["feature"]][b["cut"]]) if split else 0.0), (in_bins, float(b["cut"]))):
                        made.trees.nodes[tree, number] = (b["feature"], threshold, value, b["gain"]) if split else (-1, 0.0, value, 0.0)
                    if split:
                        for child in (2 * number + 1, 2 * number + 2):
                            following.append((tree, child))
                            model.trees.nodes[tree, child] = in_bins.trees.nodes[tree, child] = (-1, 0.0, [0.0], 0.0)  # until its own turn
            if not following:
                break
            active = following
    return model


def predict(model: Boosted, df: DataFrame, features: str = "features") -> DataFrame:
    """Add <target>_hat of each target; one pass gives all of them. A null feature array has no prediction."""

    @F.arrow_udf("array<double>")
    def values(column: pa.Array) -> pa.Array:
        real = column.is_valid()
        out = as_lists(model.values(as_matrix(column.filter(real))))
        seen = real.to_numpy(zero_copy_only=False)
        place = np.where(seen, np.cumsum(seen) - 1, -1)
        return out.take(pa.array(place, mask=place < 0))

    marked = df.withColumn("_hat", values(F.col(features).cast("array<double>")))
    return marked.select(*df.columns, *[F.col("_hat")[i].alias(f"{c}_hat") for i, c in enumerate(model.targets)])
