"""Class reports, ROC, histograms, hexagonal bins and importance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandweave.operators.ranks import running_sums


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (k * n_c) per class."""
    counts = class_counts(df, label)
    whole = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    weight = whole.select(F.col("n") / F.col("k")).scalar() / F.col("n")
    return counts.select(label, "n", weight.alias("weight"))


def confusion(df: DataFrame, truth: str = "truth", pred: str = "pred", normalize: bool = True) -> DataFrame:
    """Long confusion table; shares are of the true class. Only the class counts are windowed."""
    cells = df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    if not normalize:
        return cells
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def class_report(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    cells = df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(
                    F.col(truth).alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("chosen"),
                    F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0).alias("hit"),
                ),
                F.struct(
                    F.col(pred).alias("class"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("chosen"),
                    F.lit(0).cast("bigint").alias("hit"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hit").alias("hit"))
    zero = F.lit(0.0)
    rates = sums.select(
        F.col("class").cast("string").alias("class"),
        F.when(F.col("chosen") > 0, F.col("hit") / F.col("chosen")).otherwise(zero).alias("precision"),
        F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(zero).alias("recall"),
        F.when(F.col("support") + F.col("chosen") > 0, F.lit(2.0) * F.col("hit") / (F.col("support") + F.col("chosen")))
        .otherwise(zero)
        .alias("f1"),
        "support",
    )
    kinds = ("precision", "recall", "f1")
    macro = rates.agg(*[F.avg(k).alias(k) for k in kinds], F.sum("support").alias("support"))
    weighted = rates.agg(
        *[(F.sum(F.col(k) * F.col("support")) / F.sum("support")).alias(k) for k in kinds],
        F.sum("support").alias("support"),
    )
    return rates.unionByName(macro.withColumn("class", F.lit("macro avg"))).unionByName(
        weighted.withColumn("class", F.lit("weighted avg"))
    )


def roc(scores: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """False and true positive rate at each threshold, equal scores taken together."""
    ties = scores.groupBy(score).agg(
        F.sum((F.col(truth) == 1).cast("bigint")).alias("_p"), F.sum((F.col(truth) != 1).cast("bigint")).alias("_f")
    )
    run = running_sums(ties, score, {"tp": "_p", "fp": "_f"}, descending=True)
    return run.select(
        F.col(score).alias("threshold"),
        "tp",
        "fp",
        F.try_divide("fp", "fp_total").alias("fpr"),  # null where a class is missing
        F.try_divide("tp", "tp_total").alias("tpr"),
    )


def equal_error(scores: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """Where false negative and false positive rate meet, and the first threshold of that false positive rate."""
    points = roc(scores, truth, score).withColumn("fnr", F.lit(1.0) - F.col("tpr"))
    firsts = points.groupBy("fpr").agg(
        F.max("threshold").alias("threshold"),
        F.min(F.struct(F.abs(F.col("fnr") - F.col("fpr")).alias("gap"), (-F.col("threshold")).alias("order"), "fnr")).alias("m"),
    )
    at = firsts.agg(F.min(F.struct("m.gap", "m.order", "m.fnr", "fpr", "threshold")).alias("b"))
    return at.select(
        F.col("b.fpr").alias("fpr"),
        F.col("b.fnr").alias("fnr"),
        ((F.col("b.fpr") + F.col("b.fnr")) / 2).alias("error_rate"),
        F.col("b.threshold").alias("threshold"),
    )


def histogram(df: DataFrame, column: str, bins: int, density: bool = False) -> DataFrame:
    """Equal-width bins from minimum to maximum, right edge closed; empty bins are kept."""
    span = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    half = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)  # a constant column gets unit width around it
    span = span.select((F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    place = F.least(F.floor((F.col(column) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = span.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    filled = all_bins.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    width = (F.col("hi") - F.col("lo")) / bins
    out = filled.select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("left"), (F.col("lo") + (F.col("bin") + 1) * width).alias("right"), "n"
    )
    if not density:
        return out
    total = df.agg(F.count(column)).scalar()
    return out.withColumn("density", F.col("n") / total / (F.col("right") - F.col("left")))


def hexbin(df: DataFrame, x: str, y: str, nx: int, ny: int) -> DataFrame:
    """Counts on two offset lattices; a point goes to the lattice whose centre is nearer."""
    span = df.agg(
        F.min(x).alias("x0"), ((F.max(x) - F.min(x)) / nx).alias("sx"), F.min(y).alias("y0"), ((F.max(y) - F.min(y)) / ny).alias("sy")
    )
    span = span.replace(0.0, 1.0, ["sx", "sy"])  # a constant column lies in one cell
    x0, sx, y0, sy = (span.select(c).scalar() for c in ("x0", "sx", "y0", "sy"))
    unit = df.select(((F.col(x) - x0) / sx).alias("u"), ((F.col(y) - y0) / sy).alias("v"))
    corner = [F.floor(F.col(c) + 0.5) for c in "uv"]
    centre = [F.floor(F.col(c)) + F.lit(0.5) for c in "uv"]

    def gap(point):
        du, dv = F.col("u") - point[0], F.col("v") - point[1]
        return du * du + F.lit(3.0) * dv * dv

    near = gap(corner) < gap(centre)
    placed = unit.select(
        F.when(near, corner[0]).otherwise(centre[0]).cast("double").alias("u"),
        F.when(near, corner[1]).otherwise(centre[1]).cast("double").alias("v"),
    )
    counts = placed.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.select((x0 + F.col("u") * sx).alias("x"), (y0 + F.col("v") * sy).alias("y"), "n")


def block_importance(imp: DataFrame, names, width: int = 150) -> DataFrame:
    """Share of each feature block in the summed importances, largest first."""
    block = F.get(F.array(*[F.lit(n) for n in names]), F.floor(F.col("feature") / width).cast("int"))
    sums = imp.groupBy(block.alias("name")).agg(F.sum("importance").alias("_s"))
    total = imp.agg(F.sum("importance")).scalar()
    return rank_importance(sums.select("name", (F.col("_s") / total).alias("weight")), "weight")


def channel_importance(imp: DataFrame, names, exclude=(), width: int = 150) -> DataFrame:
    """Log of the mean importance of each channel over the blocks that are not excluded."""
    block = F.get(F.array(*[F.lit(n) for n in names]), F.floor(F.col("feature") / width).cast("int"))
    kept = imp.where(~block.isin(*exclude)) if exclude else imp
    return kept.groupBy((F.col("feature") % width).alias("channel")).agg(F.ln(F.avg("importance")).alias("log_weight"))


def rank_importance(df: DataFrame, column: str = "importance", descending: bool = True) -> DataFrame:
    return df.orderBy(F.col(column).desc() if descending else F.col(column).asc())
