"""Relative squared error: mean over targets of MSE / MSE of the mean predictor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandweave import FIXED_BASELINE, TARGETS
from bandweave.operators.projections import bucket
from bandweave.operators.ranks import group_running


def baseline_fit(train: DataFrame, cols=TARGETS) -> DataFrame:
    return train.agg(*[F.avg(c).alias(c) for c in cols])


def baseline_predict(base: DataFrame, test: DataFrame, cols=TARGETS, key: str = "sample_index") -> DataFrame:
    """The one-row baseline is a scalar subquery per target, so nothing is joined."""
    return test.select(key, *[base.select(c).scalar().alias(c) for c in cols])


def _errors(cols) -> list[Column]:
    out = []
    for c in cols:
        out.append(F.avg(F.pow(F.col(c) - F.col(f"{c}_hat"), F.lit(2.0))).alias(f"{c}_mse"))
        out.append(F.avg(F.pow(F.col(c) - F.col(f"{c}_base"), F.lit(2.0))).alias(f"{c}_mse_base"))
    return out


def _mean_ratio(cols) -> Column:
    return sum((F.try_divide(f"{c}_mse", f"{c}_mse_base") for c in cols), F.lit(0.0)) / F.lit(float(len(cols)))


def relative_score(ev: DataFrame, by=(), cols=TARGETS) -> DataFrame:
    """One row per target with both errors, change in percent and their ratio, and an "all" row."""
    wide = ev.groupBy(*by).agg(*_errors(cols))
    rows = []
    for c in cols:
        mse, base = F.col(f"{c}_mse"), F.col(f"{c}_mse_base")
        rows.append(
            F.struct(
                F.lit(c).alias("target"),
                mse.alias("mse"),
                base.alias("mse_base"),
                (F.lit(100.0) * (mse - base) / base).alias("change_pct"),
                (mse / base).alias("score"),
            )
        )
    none = F.lit(None).cast("double")
    rows.append(
        F.struct(
            F.lit("all").alias("target"),
            none.alias("mse"),
            none.alias("mse_base"),
            none.alias("change_pct"),
            _mean_ratio(cols).alias("score"),
        )
    )
    return wide.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def with_fixed_baseline(ev: DataFrame, base=FIXED_BASELINE, cols=TARGETS) -> DataFrame:
    return ev.withColumns({f"{c}_base": F.lit(base[c]) for c in cols})


def relative_score_fixed(ev: DataFrame, base=FIXED_BASELINE, by=(), cols=TARGETS) -> DataFrame:
    return relative_score(with_fixed_baseline(ev, base, cols), by, cols)


def batch_score(ev: DataFrame, batch: str, cols=TARGETS) -> DataFrame:
    """Mean over batches of the batch score: a mean of ratios, not the ratio of means."""
    per_batch = ev.groupBy(batch).agg(*_errors(cols)).select(batch, _mean_ratio(cols).alias("score"))
    return per_batch.agg(F.count(F.lit(1)).alias("batches"), F.avg("score").alias("score"))


def score_by_bucket(ev: DataFrame, edges, labels, column: str = "edge", cols=TARGETS) -> DataFrame:
    """Ratio per target and size bucket with the row count, plus the entire set."""
    placed = bucket(ev, column, edges, labels)
    sums = placed.rollup("bucket").agg(
        F.grouping("bucket").alias("_whole"), F.count(F.lit(1)).alias("n"), *_errors(cols)
    )
    named = sums.where((F.col("_whole") == 1) | F.col("bucket").isNotNull())
    label = F.when(F.col("_whole") == 1, F.lit("entire set")).otherwise(F.col("bucket"))
    ratios = [(F.col(f"{c}_mse") / F.col(f"{c}_mse_base")).alias(c) for c in cols]
    return named.select(label.alias("bucket"), "n", *ratios, _mean_ratio(cols).alias("mean"))


def fold_scores(ev: DataFrame, fold: str = "fold", cols=TARGETS) -> DataFrame:
    """Score of each fold and, under fold null, their mean."""
    per_fold = ev.groupBy(fold).agg(*_errors(cols)).select(fold, _mean_ratio(cols).alias("score"))
    return per_fold.rollup(fold).agg(F.avg("score").alias("score"))


def r2(ev: DataFrame, cols=TARGETS) -> DataFrame:
    """1 - SSE / SST per target, and averaged."""
    parts = []
    for c in cols:
        error = F.avg(F.pow(F.col(c) - F.col(f"{c}_hat"), F.lit(2.0)))
        parts.append((F.lit(1.0) - F.try_divide(error, F.var_pop(c))).alias(c))
    one = ev.agg(*parts)
    return one.withColumn("mean", sum((F.col(c) for c in cols), F.lit(0.0)) / float(len(cols)))


def weighted_mean(df: DataFrame, value: str, n: str, by=()) -> DataFrame:
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(n)), F.sum(n)).alias("average"), F.sum(n).alias("count"))


def running_weighted_mean(df: DataFrame, value: str, n: str, by, order: str, block: int = 1024) -> DataFrame:
    """Average after each step of a log; long logs are cut into blocks of steps."""
    run = group_running(
        df,
        by,
        [order],
        F.floor(F.col(order) / block),
        {"_s": ("sum", F.col(value) * F.col(n)), "_n": ("sum", F.col(n))},
    )
    return run.withColumn("average", F.try_divide("_s", "_n")).drop("_s", "_n")


def early_stop(log: DataFrame, patience: int, by=("run",), step: str = "epoch", score: str = "score", block: int = 1024) -> DataFrame:
    """Epoch at which waiting for a better score ends, with the best epoch and score until then."""
    seen = group_running(
        log,
        by,
        [step],
        F.floor(F.col(step) / block),
        {"_best": ("min", F.struct(F.col(score).alias("score"), F.col(step).alias("epoch")))},
    )
    waited = F.col(step) - F.col("_best.epoch") >= patience
    ends = seen.groupBy(*by).agg(
        F.min(F.when(waited, F.struct(F.col(step).alias("at"), F.col("_best").alias("best")))).alias("stop"),
        F.min("_best").alias("overall"),
    )
    best = F.coalesce("stop.best", "overall")
    return ends.select(
        *by, F.col("stop.at").alias("stop_epoch"), best["epoch"].alias("best_epoch"), best["score"].alias("best_score")
    )


# Gradient and hessian by loss name, for a prediction `p` of a truth `y`.
def _squared(y: Column, p: Column, w: Column, legacy: bool):
    d = y - p
    return (w * d if legacy else -w * d), w


def _weighted(y: Column, p: Column, w: Column, legacy: bool):
    d = y - p
    return (F.lit(2.0) * w * d if legacy else F.lit(-2.0) * w * d), F.lit(2.0) * w


def _cubic(y: Column, p: Column, w: Column, legacy: bool):
    d = y - p
    cube = F.lit(4.0) * d * d * d
    return (cube if legacy else -cube), F.lit(12.0) * d * d


def _asymmetric(y: Column, p: Column, w: Column, legacy: bool):
    d = y - p
    steep = F.when(d < 0, F.lit(50.0)).otherwise(F.lit(1.0))
    return F.lit(-2.0) * steep * d, F.lit(2.0) * steep


LOSSES = {"squared": _squared, "weighted": _weighted, "cubic": _cubic, "asymmetric": _asymmetric}


def loss_report(ev: DataFrame, names, by=(), col: str = "P", weight: Column | None = None, legacy_sign: bool = False) -> DataFrame:
    """Summed gradient and hessian of each loss; `legacy_sign` keeps the (y - p) sign of the callbacks."""
    w = F.lit(1.0) if weight is None else weight
    parts = []
    for name in names:
        grad, hess = LOSSES[name](F.col(col), F.col(f"{col}_hat"), w, legacy_sign)
        parts.append(F.struct(F.lit(name).alias("loss"), grad.alias("grad"), hess.alias("hess")))
    long = ev.select(*by, F.explode(F.array(*parts)).alias("l")).select(*by, "l.*")
    return long.groupBy(*by, "loss").agg(F.sum("grad").alias("grad"), F.sum("hess").alias("hess"))
