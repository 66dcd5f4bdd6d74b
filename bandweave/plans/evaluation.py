"""Registered queries: folds, scores, class reports, histograms, densities and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandweave import FIXED_BASELINE, TARGET_MAXIMA, TARGETS
from bandweave.operators import density as dn
from bandweave.operators import folds as fo
from bandweave.operators import pixels as px
from bandweave.operators import projections as pr
from bandweave.operators import reports as rp
from bandweave.operators import scores as sc
from bandweave.plans import views as v
from bandweave.plans.pixels import rounded
from bandweave.plans.registry import query
from bandweave.plans.views import oracle, sql_uniform
from bandweave.session import materialize

# The stand-in fields have edges of 1 to 4 pixels.
EDGES = (0, 1, 1.5, 2, 2.5, 3, 3.5, 210)
LABELS = ("0-1", "1-1.5", "1.5-2", "2-2.5", "2.5-3", "3-3.5", "3.5+")


def mse_sql(c: str, end: str) -> str:
    return f"avg(pow({c} - {c}_{end}, 2))"


MEAN_RATIO = "(" + " + ".join(f"{mse_sql(c, 'hat')} / {mse_sql(c, 'base')}" for c in TARGETS) + ") / 4"


def score_rows_sql(view: str, group: str = "") -> str:
    by = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    rows = [
        f"SELECT {by}'{c}' AS target, round({mse_sql(c, 'hat')}, {2 if c != 'P' else 0}) AS mse, "
        f"round({mse_sql(c, 'base')}, {2 if c != 'P' else 0}) AS mse_base, "
        f"round(100.0 * ({mse_sql(c, 'hat')} - {mse_sql(c, 'base')}) / {mse_sql(c, 'base')}, 7) AS change_pct, "
        f"round({mse_sql(c, 'hat')} / {mse_sql(c, 'base')}, 9) AS score FROM {view}{tail}"
        for c in TARGETS
    ]
    rows.append(f"SELECT {by}'all', NULL, NULL, NULL, round({MEAN_RATIO}, 9) FROM {view}{tail}")
    return " UNION ALL ".join(rows)


def score_rounding(df):
    digits = F.when(F.col("target") == "P", F.round("mse", 0)).otherwise(F.round("mse", 2))
    base = F.when(F.col("target") == "P", F.round("mse_base", 0)).otherwise(F.round("mse_base", 2))
    df = df.withColumns({"mse": digits, "mse_base": base})
    return rounded(rounded(df, 7, "change_pct"), 9, "score")


@query(
    "a03_baseline",
    oracle(
        "targets folds",
        "SELECT sample_index, "
        + ", ".join(f"round((SELECT avg({c}) FROM targets JOIN folds USING (sample_index) WHERE fold <> 0), 6) AS {c}" for c in TARGETS)
        + " FROM targets JOIN folds USING (sample_index) WHERE fold = 0",
    ),
)
def a03(t):
    marked = v.folded_targets(t)
    base = sc.baseline_fit(marked.where("fold <> 0"))
    return rounded(sc.baseline_predict(base, marked.where("fold = 0")), 6, *TARGETS)


SCORED = """SELECT t.sample_index, f.fold, t.P, t.K, t.Mg, t.pH, c.m0, c.m1, c.m2, c.m3 FROM targets t JOIN folds f USING (sample_index)
   JOIN (SELECT l_orderkey AS sample_index, avg(l_quantity) FILTER (l_returnflag <> 'R') AS m0,
         avg(l_extendedprice) FILTER (l_returnflag <> 'R') AS m1, avg(l_discount) FILTER (l_returnflag <> 'R') AS m2,
         avg(l_tax) FILTER (l_returnflag <> 'R') AS m3 FROM lineitem GROUP BY 1) c USING (sample_index)"""


@query(
    "a05_relative_score",
    oracle(
        "targets folds",
        score_rows_sql("ev"),
        scored=SCORED,
        sized="SELECT *, CAST(coalesce(floor(round(10 * (m0 / 50 + m1 / 100000 + m2 / 0.1 + m3 / 0.08), 6)), -1) AS INTEGER) AS level FROM scored",
        level="SELECT level, " + ", ".join(f"avg({c}) AS {c}_hat" for c in TARGETS) + " FROM sized WHERE fold <> 0 GROUP BY level",
        ev="SELECT s.*, "
        + ", ".join(f"l.{c}_hat" for c in TARGETS)
        + ", "
        + ", ".join(f"(SELECT avg({c}) FROM sized WHERE fold <> 0) AS {c}_base" for c in TARGETS)
        + " FROM sized s JOIN level l USING (level) WHERE fold = 0",
    ),
)
def a05(t):
    """Flagship: curve of the unmasked pixels, joined to targets; predict by the mean of curves whose bands, as shares of their ranges, sum up alike."""
    share = F.element_at(F.map_from_arrays(F.array(*map(F.lit, range(4))), F.array(*map(F.lit, (50.0, 100000.0, 0.1, 0.08)))), F.col("band"))
    curve = px.curve(v.pixel_values(t)).groupBy("sample_index").agg(F.sum(F.col("v") / share).alias("s"))
    level = F.coalesce(F.floor(F.round(10 * F.col("s"), 6)).cast("int"), F.lit(-1))
    joined = v.folded_targets(t).join(curve.select("sample_index", level.alias("level")), "sample_index")
    marked = materialize(joined.select("sample_index", "fold", "level", *TARGETS), "marked")
    train = marked.where("fold <> 0")
    means = train.groupBy("level").agg(*[F.avg(c).alias(f"{c}_hat") for c in TARGETS])
    base = sc.baseline_fit(train)
    test = marked.where("fold = 0").withColumns({f"{c}_base": base.select(c).scalar() for c in TARGETS})
    return score_rounding(sc.relative_score(test.join(means, "level")))


@query(
    "a06_relative_score_fixed",
    oracle(
        "evaluation",
        score_rows_sql("fixed"),
        fixed="SELECT * EXCLUDE (P_base, K_base, Mg_base, pH_base), "
        + ", ".join(f"{FIXED_BASELINE[c]!r}::DOUBLE AS {c}_base" for c in TARGETS)
        + " FROM evaluation",
    ),
)
def a06(t):
    return score_rounding(sc.relative_score_fixed(v.evaluation(t)))


@query(
    "a07_batch_score",
    oracle(
        "evaluation",
        "SELECT count(*) AS batches, round(avg(score), 9) AS score FROM (SELECT batch, "
        + MEAN_RATIO
        + f""" AS score FROM (SELECT *, (row_number() OVER (ORDER BY {sql_uniform(8, 'sample_index')}, sample_index) - 1) // 64 AS batch
             FROM evaluation) GROUP BY batch)""",
    ),
)
def a07(t):
    from bandweave.operators.ranks import shuffled_rank

    ranked = shuffled_rank(materialize(v.evaluation(t), "evaluation"), "sample_index", 8, name="pos")
    return rounded(sc.batch_score(ranked.withColumn("batch", F.floor(F.col("pos") / 64)), "batch"), 9, "score")


@query(
    "a08_score_by_bucket",
    oracle(
        "evaluation sizes",
        "SELECT coalesce(bucket, 'entire set') AS bucket, count(*) AS n, "
        + ", ".join(f"round({mse_sql(c, 'hat')} / {mse_sql(c, 'base')}, 9) AS {c}" for c in TARGETS)
        + f", round({MEAN_RATIO}, 9) AS mean FROM placed GROUP BY ROLLUP (bucket)",
        placed="SELECT e.*, CASE "
        + " ".join(f"WHEN (h + w) / 2.0 > {lo} AND (h + w) / 2.0 <= {hi} THEN '{b}'" for lo, hi, b in zip(EDGES, EDGES[1:], LABELS))
        + " END AS bucket FROM evaluation e JOIN sizes USING (sample_index)",
    ),
)
def a08(t):
    edges = px.field_size(v.pixel_rows(t)).select("sample_index", "edge")
    scored = sc.score_by_bucket(v.evaluation(t).join(edges, "sample_index"), EDGES, LABELS)
    return rounded(scored, 9, *TARGETS, "mean")


@query(
    "a09_fold_scores",
    oracle(
        "evaluation",
        "SELECT fold, round(score, 9) AS score FROM per_fold UNION ALL SELECT NULL, round(avg(score), 9) FROM per_fold",
        per_fold=f"SELECT fold, {MEAN_RATIO} AS score FROM evaluation GROUP BY fold",
    ),
)
def a09(t):
    return rounded(sc.fold_scores(v.evaluation(t)), 9, "score")


@query(
    "a10_weighted_mean",
    oracle("metric_log", "SELECT run, round(sum(score * n) / sum(n), 6) AS average, sum(n)::BIGINT AS count FROM metric_log GROUP BY run"),
)
def a10(t):
    return rounded(sc.weighted_mean(v.metric_log(t), "score", "n", ["run"]), 6, "average")


@query(
    "a10b_running_weighted_mean",
    oracle(
        "metric_log",
        """SELECT run, epoch, round(sum(score * n) OVER w / sum(n) OVER w, 10) AS average FROM metric_log
           WINDOW w AS (PARTITION BY run ORDER BY epoch)""",
    ),
)
def a10b(t):
    run = sc.running_weighted_mean(v.metric_log(t), "score", "n", ["run"], "epoch", block=32)
    return rounded(run.select("run", "epoch", "average"), 10, "average")


@query("a13_class_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def a13(t):
    return rp.class_counts(t.embeddings)


@query(
    "a14_class_weights",
    """SELECT label, n, round(sum(n) OVER () / count(*) OVER () / n, 9) AS weight
       FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)""",
)
def a14(t):
    return rounded(rp.class_weights(t.embeddings), 9, "weight")


def class_pred(t):
    """Truth against "longer than the median", the exact median."""
    from bandweave.operators.ranks import exact_quantiles

    scores = materialize(v.binary_scores(t), "scores")
    median = exact_quantiles(scores.withColumn("_all", F.lit(1)), ["_all"], "score", [0.5])
    cut = F.lit(median.first()["q"][0])
    return scores.select("doc_id", "truth", (F.col("score") > cut).cast("int").alias("pred"))


@query(
    "a16_confusion",
    oracle(
        "class_pred",
        """SELECT truth, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY truth), 9) AS share
           FROM class_pred GROUP BY truth, pred""",
    ),
)
def a16(t):
    return rounded(rp.confusion(class_pred(t)), 9, "share")


@query(
    "a17_class_report",
    oracle(
        "class_pred",
        """SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM rates
           UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support)::BIGINT FROM rates
           UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
             round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), sum(support)::BIGINT FROM rates""",
        hits="""SELECT c.class, count(*) FILTER (truth = c.class) AS support, count(*) FILTER (pred = c.class) AS chosen,
                count(*) FILTER (truth = c.class AND pred = c.class) AS hit
                FROM class_pred, (SELECT DISTINCT truth AS class FROM class_pred UNION SELECT DISTINCT pred FROM class_pred) c GROUP BY 1""",
        rates="""SELECT CAST(class AS VARCHAR) AS class, CASE WHEN chosen > 0 THEN hit / chosen ELSE 0 END AS precision,
                 CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall, 2.0::DOUBLE * hit / (support + chosen) AS f1, support FROM hits""",
    ),
)
def a17(t):
    return rounded(rp.class_report(class_pred(t)), 9, "precision", "recall", "f1")


@query(
    "a18_r2",
    oracle(
        "evaluation",
        "SELECT "
        + ", ".join(f"round(1 - {mse_sql(c, 'hat')} / var_pop({c}), 9) AS {c}" for c in TARGETS)
        + ", round(("
        + " + ".join(f"1 - {mse_sql(c, 'hat')} / var_pop({c})" for c in TARGETS)
        + ") / 4, 9) AS mean FROM evaluation",
    ),
)
def a18(t):
    return rounded(sc.r2(v.evaluation(t)), 9, *TARGETS, "mean")


@query(
    "a20_ensemble_mean",
    oracle(
        "predictions",
        "SELECT sample_index, " + ", ".join(f"round(avg({c}), 5) AS {c}" for c in TARGETS) + " FROM predictions GROUP BY sample_index",
    ),
)
def a20(t):
    return rounded(pr.ensemble_mean(v.predictions(t)), 5, *TARGETS)


NAMES = ("level", "slope", "bend", "ripple")
IMPORTANCE = "SELECT band AS feature, avg(abs(v)) AS importance FROM curve_long GROUP BY band"
NAME_OF = "(['level', 'slope', 'bend', 'ripple'])[feature // 16 + 1]"


def importances(t):
    """Mean magnitude per band stands for the importances of 4 blocks of 16."""
    return v.curve_long(t).groupBy(F.col("band").alias("feature")).agg(F.avg(F.abs("v")).alias("importance"))


@query(
    "a21_block_importance",
    oracle(
        "curve_long",
        f"SELECT {NAME_OF} AS name, round(sum(importance) / (SELECT sum(importance) FROM imp), 9) AS weight FROM imp GROUP BY 1",
        imp=IMPORTANCE,
    ),
)
def a21(t):
    return rounded(rp.block_importance(importances(t), NAMES, 16), 9, "weight")


@query(
    "a21b_channel_importance",
    oracle(
        "curve_long",
        f"SELECT feature % 16 AS channel, round(ln(avg(importance)), 9) AS log_weight FROM imp WHERE {NAME_OF} <> 'slope' GROUP BY 1",
        imp=IMPORTANCE,
    ),
)
def a21b(t):
    return rounded(rp.channel_importance(importances(t), NAMES, ["slope"], 16), 9, "log_weight")


def histogram_sql(column: str, bins: int) -> str:
    return f"""SELECT b::INTEGER AS bin, round(lo + b * ((hi - lo) / {bins}), 6) AS "left", round(lo + (b + 1) * ((hi - lo) / {bins}), 6) AS "right",
        coalesce(n, 0) AS n, round(coalesce(n, 0) / total / ((hi - lo) / {bins}), 12) AS density
        FROM (SELECT min({column}) AS lo, max({column}) AS hi, count(*) AS total FROM targets) s, range({bins}) AS r(b)
        LEFT JOIN (SELECT least(floor(({column} - (SELECT min({column}) FROM targets)) / ((SELECT max({column}) FROM targets) - (SELECT min({column}) FROM targets)) * {bins}), {bins - 1})::INTEGER AS bin,
                   count(*) AS n FROM targets GROUP BY 1) c ON c.bin = b"""


def _histogram(t, column, bins):
    out = rp.histogram(materialize(v.targets(t), "targets"), column, bins, density=True)
    return rounded(rounded(out, 6, "left", "right"), 12, "density")


@query("a22_histogram", oracle("targets", histogram_sql("Mg", 50)))
def a22(t):
    return _histogram(t, "Mg", 50)


@query("a22b_histogram_25", oracle("targets", histogram_sql("P", 25)))
def a22b(t):
    return _histogram(t, "P", 25)


@query(
    "a23_hexbin",
    oracle(
        "evaluation",
        """SELECT round(x0 + u * sx, 6) AS x, round(y0 + v * sy, 6) AS y, count(*) AS n FROM (
             SELECT *, CASE WHEN near THEN floor(a + 0.5) ELSE floor(a) + 0.5 END::DOUBLE AS u,
                    CASE WHEN near THEN floor(b + 0.5) ELSE floor(b) + 0.5 END::DOUBLE AS v FROM (
               SELECT *, pow(a - floor(a + 0.5), 2) + 3 * pow(b - floor(b + 0.5), 2)
                       < pow(a - floor(a) - 0.5, 2) + 3 * pow(b - floor(b) - 0.5, 2) AS near FROM (
                 SELECT (K - x0) / sx AS a, (K_hat - y0) / sy AS b, * FROM (
                   SELECT K, K_hat, min(K) OVER () AS x0, (max(K) OVER () - min(K) OVER ()) / 100 AS sx,
                          min(K_hat) OVER () AS y0, (max(K_hat) OVER () - min(K_hat) OVER ()) / 57 AS sy FROM evaluation)))) GROUP BY ALL""",
    ),
)
def a23(t):
    return rounded(rp.hexbin(materialize(v.evaluation(t), "evaluation"), "K", "K_hat", 100, 57), 6, "x", "y")


@query(
    "a24_kde",
    oracle(
        "targets",
        f"""SELECT point, round(pt, 6) AS "at", round(sum(exp(-0.5 * pow((pt - K) / 8.0, 2)) * c) / (8.0 * sqrt(2 * pi()) * max(n)), 10) AS density
            FROM (SELECT i::INTEGER AS point, lo + i * (hi - lo) / 49.0 AS pt, n FROM
                  (SELECT min(K) AS lo, max(K) AS hi, count(*) AS n FROM targets), range(50) AS r(i)),
                 (SELECT K, count(*) AS c FROM targets GROUP BY K) GROUP BY point, pt""",
    ),
)
def a24(t):
    return rounded(rounded(dn.kde(materialize(v.targets(t), "targets"), "K", 8.0, 50), 6, "at"), 10, "density")


def weight_sql(at: str) -> str:
    return f"""SELECT sample_index, round(greatest(1 - (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()), 1e-4)
                 / avg(w) OVER (), 7) AS weight
       FROM (SELECT *, greatest(1 - (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()), 1e-4) AS w FROM (
         SELECT sample_index, sum(exp(-0.5 * pow(({at} - v), 2)) * c) AS d
         FROM (SELECT sample_index, K, min(K) OVER () + (row_number() OVER (ORDER BY sample_index) - 1) *
                 (max(K) OVER () - min(K) OVER ()) / (count(*) OVER () - 1) AS pos FROM targets),
              (SELECT K AS v, count(*) AS c FROM targets GROUP BY K) GROUP BY sample_index))"""


@query("a25_density_weight", oracle("targets", weight_sql("pos")))
def a25(t):
    weighed = dn.density_weight(materialize(v.targets(t).select("sample_index", "K"), "targets"), "K")
    return rounded(weighed.select("sample_index", "weight"), 7, "weight")


@query("a25b_density_weight_by_value", oracle("targets", weight_sql("K")))
def a25b(t):
    weighed = dn.density_weight(materialize(v.targets(t).select("sample_index", "K"), "targets"), "K", by="value")
    return rounded(weighed.select("sample_index", "weight"), 7, "weight")


def loss_sql(name: str, grad: str, hess: str) -> str:
    return f"SELECT fold, '{name}' AS loss, round(sum({grad}), 6) AS grad, round(sum({hess}), 6) AS hess FROM d GROUP BY fold"


@query(
    "a26_loss_report",
    oracle(
        "evaluation",
        " UNION ALL ".join(
            [
                loss_sql("weighted", "-2.0 * d", "2.0::DOUBLE"),
                loss_sql("cubic", "-4.0 * d * d * d", "12.0 * d * d"),
                loss_sql("asymmetric", "CASE WHEN d < 0 THEN -100.0 * d ELSE -2.0 * d END", "CASE WHEN d < 0 THEN 100.0 ELSE 2.0 END::DOUBLE"),
            ]
        ),
        d="SELECT fold, K / 625.0::DOUBLE - K_hat / 625.0::DOUBLE AS d FROM evaluation",
    ),
)
def a26(t):
    scaled = v.evaluation(t).withColumns({"K": F.col("K") / TARGET_MAXIMA["K"], "K_hat": F.col("K_hat") / TARGET_MAXIMA["K"]})
    return rounded(sc.loss_report(scaled, ["weighted", "cubic", "asymmetric"], ["fold"], "K"), 6, "grad", "hess")


@query(
    "j04_join_eval",
    oracle(
        "evaluation",
        "SELECT sample_index, fold, "
        + ", ".join(f"round({c}{e}, 5) AS {c}{e}" for c in TARGETS for e in ("", "_hat", "_base"))
        + " FROM evaluation",
    ),
)
def j04(t):
    models = materialize(v.predictions(t), "predictions")
    keys = ["sample_index", "fold"]
    pred = models.where("model = 'priority'").drop("model")
    base = models.where("model = 'baseline'").drop("model")
    truth = v.folded_targets(t).select(*keys, *TARGETS)
    out = pr.join_eval(truth, pred, base)
    return rounded(out, 5, *[f"{c}{e}" for c in TARGETS for e in ("", "_hat", "_base")])


@query(
    "j05_combine_targets",
    oracle("evaluation", "SELECT sample_index, " + ", ".join(f"round({c}_hat, 5) AS {c}" for c in TARGETS) + " FROM evaluation"),
)
def j05(t):
    models = materialize(v.predictions(t), "predictions").where("model = 'priority'")
    return rounded(pr.combine_targets([models.select("sample_index", c) for c in TARGETS]), 5, *TARGETS)


@query("j06_complement", oracle("targets folds", "SELECT sample_index, K FROM targets JOIN folds USING (sample_index) WHERE fold <> 2"))
def j06(t):
    rows = v.targets(t).select("sample_index", "K")
    return fo.complement(rows, v.folds(t).where("fold = 2"))


@query(
    "j07_pick",
    oracle("targets", "SELECT sample_index, K FROM targets WHERE sample_index IN (SELECT doc_id FROM labels WHERE quality = 1)"),
)
def j07(t):
    ids = t.labels.where("quality = 1").select(F.col("doc_id").alias("sample_index"))
    return fo.pick(v.targets(t).select("sample_index", "K"), ids)


@query(
    "w02_early_stop",
    oracle(
        "metric_log",
        """SELECT run, stop_epoch, coalesce(arg_min(best_epoch, epoch) FILTER (epoch = stop_epoch), arg_max(best_epoch, epoch)) AS best_epoch,
                  coalesce(arg_min(best, epoch) FILTER (epoch = stop_epoch), arg_max(best, epoch)) AS best_score
           FROM (SELECT *, min(CASE WHEN epoch - best_epoch >= 10 THEN epoch END) OVER (PARTITION BY run) AS stop_epoch FROM (
             SELECT *, max(CASE WHEN score < coalesce(prev, score + 1) THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS best_epoch FROM (
               SELECT *, min(score) OVER (PARTITION BY run ORDER BY epoch) AS best,
                 min(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM metric_log)))
           GROUP BY run, stop_epoch""",
    ),
)
def w02(t):
    return sc.early_stop(v.metric_log(t), 10, block=16)


POINTS = """SELECT score AS threshold, sum(p) OVER w AS tp, sum(f) OVER w AS fp,
  sum(p) OVER () AS p_all, sum(f) OVER () AS f_all FROM (SELECT score, count(*) FILTER (truth = 1) AS p, count(*) FILTER (truth <> 1) AS f
  FROM binary_scores GROUP BY score) WINDOW w AS (ORDER BY score DESC)"""


@query(
    "w03_roc",
    oracle(
        "binary_scores",
        "SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(fp / f_all, 9) AS fpr, round(tp / p_all, 9) AS tpr FROM points",
        points=POINTS,
    ),
)
def w03(t):
    return rounded(rp.roc(materialize(v.binary_scores(t), "scores")), 9, "fpr", "tpr")


@query(
    "w04_kfold",
    oracle("folds", "SELECT sample_index, fold FROM folds"),
)
def w04(t):
    return v.folds(t)


@query(
    "w05_stratified_kfold",
    f"""SELECT vec_id AS sample_index, label, (row_number() OVER (PARTITION BY label ORDER BY {sql_uniform(5, 'vec_id')}, vec_id) - 1) % 5 AS fold
        FROM embeddings""",
)
def w05(t):
    return fo.stratified_kfold(v.curves(t).select("sample_index", "label"), "label", 5, 5)


@query("w06_reindex", oracle("targets", "SELECT sample_index, K, row_number() OVER (ORDER BY sample_index) - 1 AS \"index\" FROM targets"))
def w06(t):
    return pr.reindex(materialize(v.targets(t).select("sample_index", "K"), "targets"))


@query(
    "w07_last_n",
    oracle(
        "folds",
        """SELECT sample_index, fold FROM folds QUALIFY row_number() OVER (PARTITION BY fold ORDER BY sample_index DESC) <= 271""",
    ),
)
def w07(t):
    return fo.last_n(v.folds(t), ["fold"], ["sample_index"], 271)


@query(
    "t03_rank_importance",
    oracle("curve_long", "SELECT feature, round(importance, 9) AS importance FROM imp", imp=IMPORTANCE),
)
def t03(t):
    return rounded(rp.rank_importance(importances(t)), 9, "importance")


@query(
    "t05_best",
    oracle(
        "metric_log",
        """SELECT run, epoch, score FROM metric_log QUALIFY row_number() OVER (PARTITION BY run ORDER BY score, epoch) = 1""",
    ),
)
def t05(t):
    return pr.best(v.metric_log(t), ["run"], "epoch", "score", largest=False)


@query(
    "u02_merge_predictions",
    oracle(
        "evaluation sizes",
        """SELECT sample_index, round(CASE WHEN (h + w) / 2.0 <= 2 THEN K_hat ELSE K_base END, 6) AS "K",
                  row_number() OVER (ORDER BY sample_index) - 1 AS "index" FROM evaluation JOIN sizes USING (sample_index)""",
    ),
)
def u02(t):
    ev = v.evaluation(t).join(px.field_size(v.pixel_rows(t)), "sample_index")
    ev = materialize(ev.select("sample_index", "edge", "K_hat", "K_base"), "evaluation")
    small = ev.where("edge <= 2").select("sample_index", F.col("K_hat").alias("K"))
    large = ev.where("edge > 2").select("sample_index", F.col("K_base").alias("K"))
    return rounded(pr.merge_predictions(small, large), 6, "K")


SHUFFLED = f"""SELECT o_orderkey AS sample_index, count(*) OVER () AS n,
   row_number() OVER (ORDER BY {{u}}, o_orderkey) - 1 AS pos FROM orders"""


@query(
    "u05_fill_batches",
    oracle(
        "",
        """SELECT sample_index, pos, pos // 64 AS batch FROM s UNION ALL
           SELECT sample_index, pos + n, (pos + n) // 64 FROM s WHERE pos < (64 - n % 64) % 64""",
        s=SHUFFLED.format(u=sql_uniform(9, "o_orderkey")),
    ),
)
def u05(t):
    return fo.fill_batches(t.orders.select(F.col("o_orderkey").alias("sample_index")), 64, 9)


@query(
    "m19_holdout",
    oracle("", "SELECT sample_index, pos < floor(n * 0.2) AS held_out FROM s", s=SHUFFLED.format(u=sql_uniform(19, "o_orderkey"))),
)
def m19(t):
    return fo.holdout(t.orders.select(F.col("o_orderkey").alias("sample_index")), 0.2, 19)


@query(
    "m20_grouped_kfold",
    oracle(
        "",
        """SELECT l.l_orderkey AS sample_index, l.l_linenumber, l.l_partkey, l.l_suppkey, pos < held AS held_out,
                  CASE WHEN pos >= held THEN CASE WHEN pos - held < (m % 5) * (m // 5 + 1) THEN (pos - held) // (m // 5 + 1)
                    ELSE m % 5 + (pos - held - (m % 5) * (m // 5 + 1)) // (m // 5) END END AS fold
           FROM lineitem l JOIN g ON g.sample_index = l.l_orderkey""",
        ids="SELECT DISTINCT l_orderkey AS sample_index FROM lineitem",
        g=f"""SELECT *, n - held AS m FROM (SELECT sample_index, row_number() OVER (ORDER BY {sql_uniform(761, 'sample_index')}, sample_index) - 1 AS pos,
              count(*) OVER () AS n, floor(count(*) OVER () * 0.1)::BIGINT AS held FROM ids)""",
    ),
)
def m20(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("sample_index"), "l_linenumber", "l_partkey", "l_suppkey")
    return fo.grouped_kfold(rows, "sample_index", 5, 0.1, 761)


@query(
    "m25_equal_error",
    oracle(
        "binary_scores",
        """SELECT round(fpr, 9) AS fpr, round(fnr, 9) AS fnr, round((fpr + fnr) / 2, 9) AS error_rate,
                  (SELECT max(threshold) FROM r2 WHERE r2.fpr = b.fpr) AS threshold
           FROM (SELECT * FROM r2 ORDER BY abs(fnr - fpr), threshold DESC LIMIT 1) b""",
        points=POINTS,
        r2="SELECT threshold, fp / f_all AS fpr, 1 - tp / p_all AS fnr FROM points",
    ),
)
def m25(t):
    return rounded(rp.equal_error(materialize(v.binary_scores(t), "scores")), 9, "fpr", "fnr", "error_rate")


@query(
    "m29_contrastive_pairs",
    oracle(
        "",
        """SELECT a.pos // 16 AS batch, a.pos % 16 AS slot, a.sample_index AS "left", b.sample_index AS "right", CAST(a.pos % 16 >= 8 AS INTEGER) AS different
           FROM f a JOIN f b ON b.pos = a.pos // 16 * 16 + CASE WHEN a.pos % 16 < 8 THEN a.pos % 16 ELSE 23 - a.pos % 16 END""",
        s=SHUFFLED.format(u=sql_uniform(29, "o_orderkey")),
        f="SELECT sample_index, pos FROM s UNION ALL SELECT sample_index, pos + n FROM s WHERE pos < (16 - n % 16) % 16",
    ),
)
def m29(t):
    return fo.contrastive_pairs(t.orders.select(F.col("o_orderkey").alias("sample_index")), 16, 29)
