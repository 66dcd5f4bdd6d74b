"""Stand-in views over the given tables: pixels, curves, targets, folds, predictions, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandweave import TARGETS
from bandweave.operators import folds as fold_ops
from bandweave.operators.ranks import group_rank, small_group_rank
from bandweave.session import materialize

FOLDS = 5
FOLD_SEED = 42


def pixel_values(t) -> DataFrame:
    """Pixels without coordinates: enough for reducers, and free of any shuffle."""
    bands = F.array("l_quantity", "l_extendedprice", "l_discount", F.col("l_tax") + F.lit(0.0))
    return t.lineitem.select(
        F.col("l_orderkey").alias("sample_index"),
        (F.col("l_returnflag") == "R").alias("masked"),
        F.posexplode(bands).alias("band", "value"),
    )


def pixel_rows(t, full: bool = False, of: DataFrame | None = None) -> DataFrame:
    """One row per pixel with its place in the field; bands still side by side. With `of`, of the fields it names alone,
    whose lines are picked once and written.

    The width is the side of the smallest square that holds the field, which may leave the last row short, or with `full`
    the largest divisor of the pixel count up to its root, so that every field is a full rectangle.
    """
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("sample_index"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        (F.col("l_returnflag") == "R").alias("masked"),
        F.array("l_quantity", "l_extendedprice", "l_discount", F.col("l_tax") + F.lit(0.0)).alias("bands"),
    )
    if of is not None:
        lines = materialize(lines.join(of.select("sample_index"), "sample_index", "left_semi"), "lines")
    bucket = F.struct("l_linenumber", F.floor(F.col("l_partkey") / 4096).alias("part_range"))
    ranked = small_group_rank(
        lines, ["sample_index"], ["l_linenumber", "l_partkey", "l_suppkey"], bucket, name="px", total="n"
    )
    root = F.sqrt(F.col("n").cast("double"))
    divisors = F.filter(F.sequence(F.lit(1).cast("bigint"), F.floor(root)), lambda d: F.col("n") % d == 0)
    side = F.array_max(divisors) if full else F.ceil(root).cast("bigint")
    return ranked.withColumn("w", side).select(
        "sample_index",
        "px",
        F.floor(F.col("px") / F.col("w")).alias("x"),
        F.pmod("px", "w").alias("y"),
        "masked",
        "bands",
        "n",
        "w",
    )


def _by_band(rows: DataFrame) -> DataFrame:
    return rows.select(
        "sample_index", "px", "x", "y", F.posexplode("bands").alias("band", "value"), "masked"
    )


def pixels(t) -> DataFrame:
    return _by_band(pixel_rows(t))


def pixels_full(t) -> DataFrame:
    return _by_band(pixel_rows(t, full=True))


def stored_pixels(t, full: bool = False) -> DataFrame:
    """The pixel table as a written table, as ingest leaves it, for jobs that read it more than once."""
    return _by_band(materialize(pixel_rows(t, full), "pixels"))


def curves(t) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("sample_index"), F.col("embedding").cast("array<double>").alias("curve"), "label"
    )


def curve_long(t) -> DataFrame:
    return curves(t).select("sample_index", F.posexplode("curve").alias("band", "v"))


def curves150(t) -> DataFrame:
    """Curves brought to 150 bands by wrapping, for jobs with fixed 150-band slices."""
    wrapped = F.transform(F.sequence(F.lit(0), F.lit(149)), lambda i: F.get("curve", i % F.size("curve")))
    return curves(t).select("sample_index", "label", wrapped.alias("curve"))


def targets(t) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("K"),
        F.avg("l_extendedprice").alias("Mg"),
        (F.lit(5.6) + F.lit(22.0) * F.avg("l_discount")).alias("pH"),
    )
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("sample_index"), F.col("o_totalprice").alias("P"), "K", "Mg", "pH"
    )


def curve_targets(t) -> DataFrame:
    return targets(t).join(curves(t).select("sample_index"), "sample_index")


def wavelengths(t, bands: int = 64) -> DataFrame:
    band = F.col("id").cast("int")
    return t.spark.range(1, bands + 1).select(
        band.alias("band_no"), (F.lit(460.0) + F.lit(3.2) * (band - 1)).alias("wavelength")
    )


def folds(t) -> DataFrame:
    return fold_ops.kfold(t.orders.select(F.col("o_orderkey").alias("sample_index")), FOLDS, FOLD_SEED)


def folded_targets(t) -> DataFrame:
    keyed = t.orders.select(F.col("o_orderkey").alias("sample_index"), "o_orderpriority")
    marked = fold_ops.kfold(keyed, FOLDS, FOLD_SEED)
    return targets(t).join(marked, "sample_index")


def evaluation(t) -> DataFrame:
    """Truth, mean predictor and priority-mean predictor, each fitted on the other folds."""
    truth = materialize(folded_targets(t), "truth")
    base = fold_ops.complement_means(truth, [], "fold", TARGETS, "{}_base")
    model = fold_ops.complement_means(truth, ["o_orderpriority"], "fold", TARGETS, "{}_hat")
    means = model.join(base, "fold")
    return truth.join(means, ["o_orderpriority", "fold"])


def predictions(t) -> DataFrame:
    wide = evaluation(t)
    models = [("baseline", "base"), ("priority", "hat")]
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("model"), *[F.col(f"{c}_{end}").alias(c) for c in TARGETS])
                for m, end in models
            ]
        )
    )
    return wide.select("sample_index", "fold", rows.alias("r")).select("sample_index", "fold", "r.*")


def metric_log(t) -> DataFrame:
    """Runs and epochs out of the event stream; a busy user is ranked by hour first."""
    rows = t.events.select(
        F.col("user_id").alias("run"),
        "ts",
        "event_id",
        F.col("value").alias("score"),
        F.length("props").cast("bigint").alias("n"),
    )
    ranked = group_rank(rows, ["run"], ["ts", "event_id"], F.date_trunc("hour", "ts"), name="epoch")
    return ranked.select("run", "epoch", "score", "n")


def binary_scores(t) -> DataFrame:
    docs = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return t.labels.select("doc_id", F.col("quality").alias("truth")).join(docs, "doc_id")


# ---- the same views for the oracle -------------------------------------------------------------

_U = "(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0)"


def sql_uniform(seed: int, key: str) -> str:
    return _U.format(seed=seed, key=key)


def _list(cols) -> str:
    return ", ".join(cols)


SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "pixel_rows": (
        [],
        """SELECT *, px // w AS x, px % w AS y FROM (
             SELECT l_orderkey AS sample_index,
                    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS px,
                    count(*) OVER (PARTITION BY l_orderkey) AS n,
                    CAST(ceil(sqrt(count(*) OVER (PARTITION BY l_orderkey))) AS BIGINT) AS w,
                    l_returnflag = 'R' AS masked,
                    [l_quantity, l_extendedprice, l_discount, l_tax + 0.0::DOUBLE] AS bands
             FROM lineitem)""",
    ),
    "pixels": (
        ["pixel_rows"],
        """SELECT sample_index, px, x, y, CAST(b AS INTEGER) AS band, bands[b + 1] AS value, masked
           FROM pixel_rows, range(4) AS r(b)""",
    ),
    "pixels_full": (
        ["pixel_rows"],
        """SELECT sample_index, px, px // side AS x, px % side AS y, CAST(b AS INTEGER) AS band, bands[b + 1] AS value, masked
           FROM (SELECT *, list_max([d for d in range(1, CAST(floor(sqrt(n)) AS BIGINT) + 1) if n % d = 0]) AS side FROM pixel_rows), range(4) AS r(b)""",
    ),
    "sizes": (
        ["pixels"],
        """SELECT sample_index, max(x) + 1 AS h, max(y) + 1 AS w FROM pixels GROUP BY sample_index""",
    ),
    "sizes_full": (
        ["pixels_full"],
        """SELECT sample_index, max(x) + 1 AS h, max(y) + 1 AS w FROM pixels_full GROUP BY sample_index""",
    ),
    "curves": ([], "SELECT vec_id AS sample_index, embedding::DOUBLE[] AS curve, label FROM embeddings"),
    "curve_long": (
        ["curves"],
        "SELECT sample_index, label, CAST(b AS INTEGER) AS band, curve[b + 1] AS v FROM curves, range(64) AS r(b)",
    ),
    "curves150": (
        ["curves"],
        """SELECT sample_index, label, list_transform(range(150), lambda i: curve[(i % 64) + 1]) AS curve
           FROM curves""",
    ),
    "targets": (
        [],
        """SELECT o_orderkey AS sample_index, o_totalprice AS P, K, Mg, pH FROM orders JOIN (
             SELECT l_orderkey, sum(l_quantity) AS K, avg(l_extendedprice) AS Mg, 5.6 + 22.0 * avg(l_discount) AS pH
             FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
    ),
    "curve_targets": (["targets", "curves"], "SELECT t.* FROM targets t JOIN curves c USING (sample_index)"),
    "wavelengths": (
        [],
        "SELECT CAST(b AS INTEGER) AS band_no, 460.0::DOUBLE + 3.2::DOUBLE * (b - 1) AS wavelength FROM range(1, 65) AS r(b)",
    ),
    "folds": (
        [],
        f"""SELECT sample_index, CASE WHEN pos < (n % {FOLDS}) * (n // {FOLDS} + 1) THEN pos // (n // {FOLDS} + 1)
               ELSE (n % {FOLDS}) + (pos - (n % {FOLDS}) * (n // {FOLDS} + 1)) // (n // {FOLDS}) END AS fold
             FROM (SELECT o_orderkey AS sample_index, count(*) OVER () AS n,
                   row_number() OVER (ORDER BY {sql_uniform(FOLD_SEED, 'o_orderkey')}, o_orderkey) - 1 AS pos
                   FROM orders)""",
    ),
    "evaluation": (
        ["targets", "folds"],
        "WITH tr AS (SELECT t.*, f.fold, o.o_orderpriority FROM targets t JOIN folds f USING (sample_index)"
        " JOIN orders o ON o.o_orderkey = t.sample_index),"
        " s AS (SELECT fold, count(*) AS n, "
        + _list(f"sum({c}) AS s_{c}" for c in TARGETS)
        + " FROM tr GROUP BY fold),"
        " b AS (SELECT fold, "
        + _list(f"(sum(s_{c}) OVER () - s_{c}) / (sum(n) OVER () - n) AS {c}_base" for c in TARGETS)
        + " FROM s),"
        " sp AS (SELECT o_orderpriority, fold, count(*) AS n, "
        + _list(f"sum({c}) AS s_{c}" for c in TARGETS)
        + " FROM tr GROUP BY ALL),"
        " m AS (SELECT o_orderpriority, fold, "
        + _list(
            f"(sum(s_{c}) OVER w - s_{c}) / (sum(n) OVER w - n) AS {c}_hat" for c in TARGETS
        )
        + " FROM sp WINDOW w AS (PARTITION BY o_orderpriority))"
        " SELECT tr.*, b.* EXCLUDE (fold), m.* EXCLUDE (fold, o_orderpriority) FROM tr JOIN b USING (fold)"
        " JOIN m USING (o_orderpriority, fold)",
    ),
    "predictions": (
        ["evaluation"],
        "SELECT sample_index, fold, 'baseline' AS model, "
        + _list(f"{c}_base AS {c}" for c in TARGETS)
        + " FROM evaluation UNION ALL SELECT sample_index, fold, 'priority', "
        + _list(f"{c}_hat" for c in TARGETS)
        + " FROM evaluation",
    ),
    "metric_log": (
        [],
        """SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch,
                  value AS score, length(props) AS n FROM events""",
    ),
    "binary_scores": (
        [],
        "SELECT l.doc_id, l.quality AS truth, d.n_chars::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id)",
    ),
    "class_pred": (
        ["binary_scores"],
        """SELECT doc_id, truth, CAST(score > (SELECT quantile_cont(score, 0.5) FROM binary_scores) AS INTEGER) AS pred
           FROM binary_scores""",
    ),
}


def oracle(views: str, body: str, **extra: str) -> str:
    """Body with a WITH clause of the named views and whatever they are built on."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in SQL_VIEWS[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in views.split():
        add(name)
    parts = [f"{name} AS MATERIALIZED ({SQL_VIEWS[name][1]})" for name in order]
    parts += [f"{name} AS ({sql})" for name, sql in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body
