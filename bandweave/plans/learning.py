"""Registered queries: neighbours, scalers, models, searches and the class probe."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from bandweave import TARGET_MAXIMA, TARGETS
from bandweave.functions.normal import INVERSE_A, INVERSE_B, INVERSE_C, INVERSE_D, INVERSE_TAIL
from bandweave.operators import augment as au
from bandweave.operators import balance as ba
from bandweave.operators import boosting as bo
from bandweave.operators import folds as fo
from bandweave.operators import forest as ft
from bandweave.operators import hybrid as hy
from bandweave.operators import models as mo
from bandweave.operators import neighbors as nb
from bandweave.operators import pixels as px
from bandweave.operators import projections as pr
from bandweave.operators import reports as rp
from bandweave.operators import trials as tr
from bandweave.operators.ranks import shuffled_rank
from bandweave.operators.scaling import Scaler, long_features
from bandweave.plans import views as v
from bandweave.plans.pixels import rounded
from bandweave.plans.registry import query
from bandweave.plans.views import oracle, sql_uniform
from bandweave.session import materialize, scratch_path

KNOWN = "label < 8"
NOVEL = "label >= 8"


def near_sql(queries: str, base: str, k: int, self_too: bool = True) -> str:
    extra = "" if self_too else " AND q.sample_index <> b.sample_index"
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), neighbor)::INTEGER AS place FROM (
      SELECT q.sample_index AS query, b.sample_index AS neighbor, list_distance(q.curve, b.curve) AS distance
      FROM {queries} q JOIN {base} b ON true{extra})) WHERE place <= {k}"""


SIDES = {
    "train": "SELECT * FROM curves WHERE sample_index % 5 <> 0",
    "test": "SELECT * FROM curves WHERE sample_index % 5 = 0",
}


def sides(t):
    rows = v.curves(t)
    return rows.where("sample_index % 5 <> 0"), rows.where("sample_index % 5 = 0")


@query(
    "j10_pair_distance",
    oracle("curves", "SELECT query, neighbor, round(distance, 7) AS distance, place FROM near", **SIDES, near=near_sql("test", "train", 20)),
)
def j10(t):
    train, test = sides(t)
    return rounded(nb.knn_join(test, train, 20), 7, "distance")


@query(
    "j10b_side_by_side_distance",
    oracle(
        "curves",
        """SELECT a.sample_index AS "left", b.sample_index AS "right", round(list_distance(a.curve, b.curve), 7) AS distance
           FROM curves a JOIN curves b ON b.sample_index = a.sample_index + 1""",
    ),
)
def j10b(t):
    rows = v.curves(t)
    nxt = rows.select((F.col("sample_index") - 1).alias("left"), F.col("sample_index").alias("right"), F.col("curve").alias("other"))
    pairs = rows.select(F.col("sample_index").alias("left"), "curve").join(nxt, "left")
    return rounded(nb.pair_distance(pairs, "curve", "other").select("left", "right", "distance"), 7, "distance")


@query(
    "t04_nearest",
    oracle("curves", "SELECT query, neighbor, place FROM near", near=near_sql("curves", "curves", 7, self_too=False)),
)
def t04(t):
    rows = v.curves(t)
    return nb.knn_join(rows, rows, 7, exclude_self=True).select("query", "neighbor", "place")


WEIGHTED = ", ".join(
    f"round(coalesce(sum({c}) FILTER (distance = 0) / nullif(count(*) FILTER (distance = 0), 0), sum({c} / distance) FILTER (distance > 0) / sum(1 / distance) FILTER (distance > 0)), 4) AS {c}"
    for c in TARGETS
)


@query(
    "m10_knn_regress",
    oracle(
        "curves targets",
        f"SELECT query AS sample_index, {WEIGHTED} FROM near JOIN targets t ON t.sample_index = near.neighbor GROUP BY query",
        train="SELECT c.* FROM curves c JOIN targets USING (sample_index) WHERE sample_index % 5 <> 0",
        test="SELECT c.* FROM curves c JOIN targets USING (sample_index) WHERE sample_index % 5 = 0",
        near=near_sql("test", "train", 170),
    ),
)
def m10(t):
    rows = materialize(pr.join_targets(v.curves(t), v.targets(t)), "labelled")
    predicted = nb.knn_regress(rows.where("sample_index % 5 <> 0"), rows.where("sample_index % 5 = 0"), 170)
    return rounded(predicted, 4, *TARGETS)


LOF = {
    "known": "SELECT * FROM curves WHERE label < 8",
    "novel": "SELECT * FROM curves WHERE label >= 8",
    "inside": near_sql("known", "known", 7, self_too=False),
    "outside": near_sql("novel", "known", 7),
    "radius": "SELECT query AS neighbor, max(distance) AS radius FROM inside GROUP BY 1",
    "dk": "SELECT query, 1 / (avg(greatest(distance, radius)) + 1e-10) AS density FROM inside JOIN radius USING (neighbor) GROUP BY 1",
    "dn": "SELECT query, 1 / (avg(greatest(distance, radius)) + 1e-10) AS density FROM outside JOIN radius USING (neighbor) GROUP BY 1",
    "factor": """SELECT o.query AS sample_index, avg(k.density) / any_value(n.density) AS lof FROM outside o JOIN dk k ON k.query = o.neighbor
                 JOIN dn n ON n.query = o.query GROUP BY 1""",
}
LOF_BODY = "SELECT sample_index, round(lof, 7) AS lof, lof > 1.5 AS novel FROM factor"


@query("m24_lof", oracle("curves", LOF_BODY, **LOF))
def m24(t):
    rows = v.curves(t)
    return rounded(nb.lof(rows.where(KNOWN), rows.where(NOVEL)), 7, "lof")


@query("m26_knn_graph", oracle("curves", "SELECT query, neighbor, place FROM near", near=near_sql("curves", "curves", 30)))
def m26(t):
    return nb.knn_graph(v.curves(t), 30)


BATCHED = f"""SELECT *, pos // 16 AS batch, pos % 16 AS slot FROM (SELECT sample_index, curve,
     row_number() OVER (ORDER BY {sql_uniform(21, 'sample_index')}, sample_index) - 1 AS pos FROM curves)"""
UNIT = "list_transform({x}, lambda e: e / sqrt(list_dot_product({x}, {x})))"


@query(
    "f18_cosine_logits",
    oracle(
        "curves",
        """SELECT sample_index, batch, other AS i, round(logit, 7) AS logit, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY sample_index), 9) AS share FROM (
             SELECT a.sample_index, a.batch, b.slot::INTEGER AS other, 20.0::DOUBLE * list_dot_product(a.u, b.w) AS logit FROM ready a JOIN ready b USING (batch))""",
        batched=BATCHED,
        flipped="SELECT *, list_reverse(curve) AS back FROM batched",
        ready=f"SELECT sample_index, batch, slot, {UNIT.format(x='curve')} AS u, {UNIT.format(x='back')} AS w FROM flipped",
    ),
)
def f18(t):
    """The reversed curve stands in for the second embedding of each row."""
    ranked = shuffled_rank(v.curves(t), "sample_index", 21, name="pos")
    ready = ranked.select(
        "sample_index",
        F.col("curve").alias("left"),
        F.reverse("curve").alias("right"),
        F.floor(F.col("pos") / 16).alias("batch"),
        (F.col("pos") % 16).alias("slot"),
    )
    soft = nb.softmax_rows(nb.cosine_logits(ready, "left", "right", 20.0, "batch", "slot"))
    flat = soft.select("sample_index", "batch", F.posexplode(F.arrays_zip("logits", "share")).alias("i", "e"))
    out = flat.select("sample_index", "batch", "i", F.col("e.logits").alias("logit"), F.col("e.share").alias("share"))
    return rounded(rounded(out, 7, "logit"), 9, "share")


@query(
    "m14_robust_scale",
    oracle(
        "curve_long",
        """SELECT sample_index, band AS feature, round((v - q2) / CASE WHEN q3 = q1 THEN 1 ELSE q3 - q1 END, 8) AS t FROM curve_long JOIN (
             SELECT band, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3
             FROM curve_long WHERE sample_index % 5 <> 0 GROUP BY band) USING (band)""",
    ),
)
def m14(t):
    rows = long_features(v.curves(t))
    scaler = Scaler("robust").fit(rows.where("sample_index % 5 <> 0"))
    return rounded(scaler.transform(rows).select("sample_index", "feature", "t"), 8, "t")


@query(
    "m15_minmax_scale",
    oracle(
        "curve_long",
        """SELECT sample_index, band AS feature, round((v - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 8) AS t FROM curve_long JOIN (
             SELECT band, min(v) AS lo, max(v) AS hi FROM curve_long WHERE sample_index % 5 <> 0 GROUP BY band) USING (band)""",
    ),
)
def m15(t):
    rows = long_features(v.curves(t))
    scaler = Scaler("minmax").fit(rows.where("sample_index % 5 <> 0"))
    return rounded(scaler.transform(rows).select("sample_index", "feature", "t"), 8, "t")


YJ = """CASE WHEN v >= 0 THEN CASE WHEN abs(l) < 1e-12 THEN ln(1 + v) ELSE (pow(v + 1, l) - 1) / l END
        ELSE CASE WHEN abs(2 - l) < 1e-12 THEN -ln(1 - v) ELSE -(pow(1 - v, 2 - l) - 1) / (2 - l) END END"""
BC = "CASE WHEN abs(l) < 1e-12 THEN ln(v) ELSE (pow(v, l) - 1) / l END"


def power_ctes(source: str, transform: str, slope: str) -> dict[str, str]:
    return {
        "lam": "SELECT round(-2.0::DOUBLE + 0.1::DOUBLE * i, 1) AS l FROM range(41) AS r(i)",
        "moved": f"SELECT feature, l, {transform} AS t, {slope} AS s FROM {source}, lam",
        "fits": "SELECT feature, l, avg(t) AS center, sqrt(var_pop(t)) AS scale, -0.5 * count(*) * ln(var_pop(t)) + (l - 1) * sum(s) AS loglik FROM moved GROUP BY feature, l",
        "best": "SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY feature ORDER BY loglik DESC, l DESC) = 1",
    }


@query(
    "m16_yeo_johnson",
    oracle(
        "curve_long",
        f"SELECT sample_index, c.feature, round(({YJ} - center) / scale, 7) AS t FROM long c JOIN best USING (feature)",
        long="SELECT sample_index, band AS feature, v FROM curve_long",
        **power_ctes("long", YJ, "sign(v) * ln(1 + abs(v))"),
    ),
)
def m16(t):
    rows = long_features(v.curves(t))
    out = Scaler("yeo_johnson").fit(rows).transform(rows)
    return rounded(out.select("sample_index", "feature", "t"), 7, "t")


def finer_lambda(transform: str, slope: str, rounds: int) -> dict[str, str]:
    """CTEs peak0 ... peak<rounds>: each feature's best lambda on the grid, then on five times finer ones around it."""
    ctes = {}
    for r in range(rounds + 1):
        step = 0.1 / 5**r
        source = f"""SELECT feature, v, unnest(list_transform(range(-5, 6), lambda j: about + {step!r}::DOUBLE * j)) AS l FROM long JOIN peak{r - 1} USING (feature)"""
        if not r:
            source = "SELECT feature, v, unnest(list_transform(range(41), lambda i: round(-2.0::DOUBLE + 0.1::DOUBLE * i, 1))) AS l FROM long"
        likely = f"SELECT feature, l, -0.5 * count(*) * ln(var_pop({transform})) + (l - 1) * sum({slope}) AS loglik FROM ({source}) GROUP BY feature, l"
        ctes[f"peak{r}"] = f"SELECT feature, max_by(l, loglik) AS about FROM ({likely}) GROUP BY feature"
    return ctes


@query(
    "m16b_finer_lambda",
    oracle(
        "curve_long",
        "SELECT feature, round(about, 4) AS lam FROM peak5",
        long="SELECT band AS feature, v FROM curve_long",
        **finer_lambda(YJ, "sign(v) * ln(1 + abs(v))", 5),
    ),
)
def m16b(t):
    """Each band's lambda to 1e-4."""
    fitted = Scaler("yeo_johnson", precision=1e-4).fit(long_features(v.curves(t))).table
    return fitted.select("feature", F.round("lam", 4).alias("lam"))


def label_rows(t):
    """Scaled targets as (sample_index, feature, v), feature = place of the target."""
    scaled = pr.scale_targets(materialize(v.targets(t), "targets"))
    return scaled.select("sample_index", F.posexplode(F.array(*TARGETS)).alias("feature", "v"))


LABELS = " UNION ALL ".join(
    f"SELECT sample_index, {i} AS feature, {c} / {TARGET_MAXIMA[c]}::DOUBLE AS v FROM targets" for i, c in enumerate(TARGETS)
)


@query(
    "m17_box_cox",
    oracle(
        "targets",
        f"SELECT sample_index, c.feature, round(({BC} - center) / scale, 7) AS t, true AS restored FROM long c JOIN best USING (feature)",
        long=LABELS,
        **power_ctes("long", BC, "ln(v)"),
    ),
)
def m17(t):
    rows = label_rows(t)
    scaler = Scaler("box_cox").fit(rows)
    out = scaler.inverse(scaler.transform(rows), "t", "back")
    restored = F.abs(F.col("back") - F.col("v")) <= F.lit(1e-9) * F.abs(F.col("v"))
    return rounded(out.select("sample_index", "feature", "t", restored.alias("restored")), 7, "t")


def polynomial_sql(coefficients, x: str) -> str:
    text = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def inverse_normal_sql(p: str) -> str:
    low, high, mid = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    square = f"({mid} * {mid})"
    return f"""CASE WHEN {p} < {INVERSE_TAIL} THEN {polynomial_sql(INVERSE_C, low)} / {polynomial_sql(INVERSE_D, low)}
      WHEN {p} > {1 - INVERSE_TAIL} THEN -{polynomial_sql(INVERSE_C, high)} / {polynomial_sql(INVERSE_D, high)}
      ELSE {mid} * {polynomial_sql(INVERSE_A, square)} / {polynomial_sql(INVERSE_B, square)} END"""


@query(
    "m18_quantile_normal",
    oracle(
        "curve_long",
        f"""SELECT sample_index, feature, round({inverse_normal_sql('q')}, 6) AS t, true AS restored FROM (
              SELECT *, least(greatest(CASE WHEN v - 1e-7 < cuts[1] THEN 0 WHEN v + 1e-7 > cuts[n] THEN 1 ELSE (r - 1) / (n - 1) END, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS q
              FROM (SELECT sample_index, band AS feature, v, avg(p) OVER (PARTITION BY band, v) AS r, cuts, len(cuts) AS n
                    FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY v) AS p FROM curve_long) JOIN (SELECT band, list(v ORDER BY v) AS cuts FROM curve_long GROUP BY band) USING (band)))""",
    )
)
def m18(t):
    """900 quantiles as published, fewer where a feature has fewer rows; the cut points are then the ordered values themselves."""
    rows = long_features(v.curves(t))
    scaler = Scaler("quantile", quantiles=900).fit(rows)
    back = scaler.inverse(scaler.transform(rows), "t", "back")
    restored = F.abs(F.col("back") - F.col("v")) < F.lit(1e-4)  # the outermost values are clipped before the inverse
    return rounded(back.select("sample_index", "feature", "t", restored.alias("restored")), 6, "t")


@query(
    "m18b_quantile_labels",
    oracle(
        "targets",
        f"""SELECT sample_index, feature, round({inverse_normal_sql('q')}, 5) AS t FROM (
              SELECT sample_index, feature, least(greatest(CASE WHEN v - 1e-7 < cuts[1] THEN 0 WHEN v + 1e-7 > cuts[900] THEN 1
                WHEN lo <= hi THEN (lo + hi) / 2.0 / 899 ELSE (hi + (v - cuts[hi + 1]) / (cuts[hi + 2] - cuts[hi + 1])) / 899 END, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS q
              FROM (SELECT *, len(list_filter(cuts, lambda c: c <= v)) - 1 AS hi, 900 - len(list_filter(cuts, lambda c: c >= v)) AS lo
                    FROM long JOIN (SELECT feature, quantile_cont(v, {[f'{i / 899!r}' for i in range(900)]}::DOUBLE[]) AS cuts FROM long GROUP BY feature) USING (feature)))""".replace("'", ""),
        long=LABELS,
    ),
)
def m18b(t):
    rows = label_rows(t)
    out = Scaler("quantile", quantiles=900).fit(rows).transform(rows)
    return rounded(out.select("sample_index", "feature", "t"), 5, "t")


# ---- fitted models: rows only, apart from what SQL can say ---------------------------------------


def scored_curves(t):
    """Curves with scaled targets, folds and the curve as an ML vector."""
    rows = pr.join_targets(v.curves(t), pr.scale_targets(v.targets(t)))
    return mo.as_vector(materialize(fo.kfold(materialize(rows, "rows"), 5, 2022), "folded"), "curve")


@query("m09_oversample_rare")
def m09(t):
    rows = materialize(v.curves(t).join(v.targets(t).select("sample_index", "Mg"), "sample_index"), "rows")
    return au.oversample_rare(rows, "Mg", 5, 9, threshold=0.4)


@query(
    "m09b_balanced_rare",
    oracle(
        "curves targets",
        """SELECT r.bump, any_value(r.n) AS n, any_value(budget) AS budget, any_value(budget) AS rows_out,
             round(sum(Mg) FILTER (pos < budget), 4) AS kept_sum FROM placed r JOIN plan USING (bump) GROUP BY r.bump""",
        f="SELECT sample_index, Mg FROM curves JOIN targets USING (sample_index)",
        q="SELECT quantile_cont(Mg, 0.25) AS q1, quantile_cont(Mg, 0.5) AS q2, quantile_cont(Mg, 0.75) AS q3 FROM f",
        scored="SELECT f.*, q2, greatest((Mg - q2) / (q3 + 1.5 * (q3 - q1) - q2), (q2 - Mg) / (q2 - (q1 - 1.5 * (q3 - q1)))) AS rel FROM f, q",
        bumped="SELECT *, CASE WHEN rel < 0.4 THEN 0 WHEN Mg < q2 THEN -1 ELSE 1 END AS bump FROM scored",
        placed=f"""SELECT *, count(*) OVER (PARTITION BY bump) AS n,
             row_number() OVER (PARTITION BY bump ORDER BY {sql_uniform(9, 'sample_index')}, sample_index) - 1 AS pos FROM bumped""",
        sizes="SELECT bump, count(*) AS n FROM bumped GROUP BY bump",
        quota="SELECT *, round(sum(n) OVER () * (1.0::DOUBLE / n) / sum(1.0::DOUBLE / n) OVER (), 9) AS share, sum(n) OVER () AS total FROM sizes",
        plan="""SELECT bump, (floor(share) + CASE WHEN row_number() OVER (ORDER BY floor(share) - share, bump) <= total - sum(floor(share)) OVER ()
             THEN 1 ELSE 0 END)::BIGINT AS budget FROM quota""",
    ),
)
def m09b(t):
    """Sizes and kept originals of each value range after balancing in inverse ratio to the ranges' sizes."""
    rows = materialize(v.curves(t).join(v.targets(t).select("sample_index", "Mg"), "sample_index"), "rows")
    out = materialize(ba.resample(rows, "Mg", 5, 9, "extreme", threshold=0.4), "balanced")
    plan = ba.budgets(ba.bumps(rows, "Mg", 0.4).groupBy("bump").agg(F.count(F.lit(1)).alias("n")), "extreme")
    kept = F.round(F.sum(F.when(~F.col("synthetic"), F.col("Mg"))), 4)
    sums = out.groupBy("bump").agg(F.count(F.lit(1)).alias("rows_out"), kept.alias("kept_sum"))
    return plan.join(sums, "bump")


@query("m11_forest")
def m11(t):
    rows = scored_curves(t)
    models = mo.fit_forest(rows.where("fold <> 0"), TARGETS, trees=20, depth=6, seed=42)
    return mo.predict(models, rows.where("fold = 0")).select("sample_index", *[f"{c}_hat" for c in TARGETS])


@query("m11c_vector_forest")
def m11c(t):
    """One forest whose leaves hold all four targets."""
    rows = pr.join_targets(v.curves(t), pr.scale_targets(v.targets(t)))
    folded = materialize(fo.kfold(materialize(rows, "rows"), 5, 2022), "folded")
    model = ft.fit(folded.where("fold <> 0"), TARGETS, trees=5, depth=5, seed=42, features="curve")
    return ft.predict(model, folded.where("fold = 0"), "curve").select("sample_index", *[f"{c}_hat" for c in TARGETS])


@query("m12_boosted")
def m12(t):
    rows = scored_curves(t)
    models = mo.fit_boosted(rows.where("fold <> 0"), TARGETS, rounds=5, depth=4, step=0.1, seed=42)
    return mo.predict(models, rows.where("fold = 0")).select("sample_index", *[f"{c}_hat" for c in TARGETS])


STEPPED = "greatest(-20.0::DOUBLE, least(20.0::DOUBLE, floor(e * 20)))"
LOSS_NAMES = ("squared", "weighted", "cubic", "asymmetric")


def boosted_round(r: int) -> dict[str, str]:
    """One round of one split for each loss and target, from the predictions of state<r>."""
    steep = "CASE WHEN d < 0 THEN 50.0::DOUBLE ELSE 1.0::DOUBLE END"
    keys = "PARTITION BY loss, target, feature"
    return {
        f"pull{r}": f"""SELECT sample_index, loss, target,
            CASE loss WHEN 'squared' THEN -d WHEN 'weighted' THEN -2 * d WHEN 'cubic' THEN -4 * d * d * d ELSE -2 * {steep} * d END AS g,
            CASE loss WHEN 'squared' THEN 1.0::DOUBLE WHEN 'weighted' THEN 2.0::DOUBLE WHEN 'cubic' THEN 12 * d * d ELSE 2 * {steep} END AS h
            FROM (SELECT *, v - p AS d FROM state{r})""",
        f"hist{r}": f"SELECT loss, target, feature, x, sum(g) AS g, sum(h) AS h FROM stepped JOIN pull{r} USING (sample_index) GROUP BY ALL",
        f"sides{r}": f"""SELECT loss, target, feature, x, sum(g) OVER ({keys} ORDER BY x) AS gl, sum(h) OVER ({keys} ORDER BY x) AS hl,
            sum(g) OVER ({keys}) AS ga, sum(h) OVER ({keys}) AS ha, x < max(x) OVER ({keys}) AS inner_cut FROM hist{r}""",
        f"gains{r}": f"""SELECT *, gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1) AS gain FROM sides{r}
            WHERE inner_cut AND hl >= 1 AND ha - hl >= 1""",
        # Without a gain the tree is one leaf.
        f"best{r}": f"""SELECT loss, target, feature, x AS cut, CASE WHEN gain > 0 THEN gl / (hl + 1) ELSE ga / (ha + 1) END AS low,
            CASE WHEN gain > 0 THEN (ga - gl) / (ha - hl + 1) ELSE ga / (ha + 1) END AS high FROM gains{r}
            QUALIFY row_number() OVER (PARTITION BY loss, target ORDER BY gain DESC, feature, x) = 1""",
        f"state{r + 1}": f"""SELECT s.sample_index, s.loss, s.target, s.v, s.p - 0.3::DOUBLE * CASE WHEN m.x <= b.cut THEN b.low ELSE b.high END AS p
            FROM state{r} s JOIN best{r} b USING (loss, target) JOIN stepped m ON m.sample_index = s.sample_index AND m.feature = b.feature""",
    }


@query(
    "m12c_boosted_losses",
    oracle(
        "curves targets",
        "SELECT loss, sample_index, " + ", ".join(f"round(max(p) FILTER (target = '{c}'), 6) AS {c}_hat" for c in TARGETS) + " FROM state2 GROUP BY loss, sample_index",
        stepped=f"SELECT sample_index, unnest(list_transform(curve, lambda e: {STEPPED})) AS x, generate_subscripts(curve, 1) AS feature FROM curves JOIN targets USING (sample_index)",
        state0="SELECT * FROM ("
        + " UNION ALL ".join(f"SELECT sample_index, '{c}' AS target, {c} / {TARGET_MAXIMA[c]}::DOUBLE AS v, 0.5::DOUBLE AS p FROM targets JOIN (SELECT sample_index FROM curves) USING (sample_index)" for c in TARGETS)
        + f") JOIN (SELECT unnest({list(LOSS_NAMES)}) AS loss) ON true",
        **boosted_round(0),
        **boosted_round(1),
    ),
)
def m12c(t):
    """Two rounds of one split with each loss, on curves in steps of 0.05, so that every value is a cut."""
    rows = pr.join_targets(v.curves(t), pr.scale_targets(v.targets(t)))
    steps = F.transform("curve", lambda e: F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.floor(e * 20).cast("double"))))
    rows = materialize(rows.withColumn("steps", steps), "rows")
    out = None
    for loss in LOSS_NAMES:
        model = bo.fit(rows, TARGETS, loss, rounds=2, depth=1, base=0.5, features="steps")
        part = bo.predict(model, rows, "steps").select(F.lit(loss).alias("loss"), "sample_index", *[f"{c}_hat" for c in TARGETS])
        out = part if out is None else out.unionByName(part)
    return rounded(out, 6, *[f"{c}_hat" for c in TARGETS])


@query("m13_hybrid")
def m13(t):
    """Nearest neighbours for small fields, a forest for large ones; size is that of the order's field."""
    rows = scored_curves(t)
    edges = px.field_size(v.pixel_rows(t, of=rows)).select("sample_index", "edge")
    rows = rows.hint("shuffle_hash").join(edges, "sample_index")  # rows in the order of their fields: the forests draw by place
    train, test = rows.where("fold <> 0"), rows.where("fold = 0")
    return mo.hybrid_predict(train, test, limit=2.0, k=25, trees=10, depth=5, seed=42)


def hybrid_rows(t):
    """Curves as both models' features, with scaled targets, edges of the orders' fields and folds."""
    edges = px.field_size(v.pixel_rows(t)).select("sample_index", "edge")
    rows = pr.join_targets(v.curves(t), pr.scale_targets(v.targets(t))).join(edges, "sample_index")
    rows = rows.select("sample_index", "edge", F.lit(False).alias("crop"), F.col("curve").alias("near_features"), F.col("curve").alias("forest_features"), *TARGETS)
    return materialize(fo.kfold(materialize(rows, "rows"), 5, 2022), "folded")


def stored_hybrid(t, rows, name: str, **settings):
    """The fitted pipeline as it comes back from its folder."""
    path = scratch_path(t.spark, name)
    hy.pipeline(limit=2.0, depth=5, seed=42, **settings).fit(rows).write().overwrite().save(path)
    return PipelineModel.load(path)


@query(
    "m13b_hybrid_neighbors",
    oracle(
        "curves targets pixels",
        "SELECT query AS sample_index, " + ", ".join(f"round(sum({c} / distance) / sum(1 / distance) * {TARGET_MAXIMA[c]}::DOUBLE, 6) AS {c}_hat" for c in TARGETS) + " FROM near GROUP BY query",
        sizes="SELECT sample_index, (max(x) + 1 + max(y) + 1) / 2.0::DOUBLE AS edge FROM pixels GROUP BY sample_index",
        f="SELECT c.sample_index, c.curve, edge, "
        + ", ".join(f"t.{c} / {TARGET_MAXIMA[c]}::DOUBLE AS {c}" for c in TARGETS)
        + f""", count(*) OVER () AS n, row_number() OVER (ORDER BY {sql_uniform(2022, 'c.sample_index')}, c.sample_index) - 1 AS pos
            FROM curves c JOIN targets t USING (sample_index) JOIN sizes USING (sample_index)""",
        rows="""SELECT *, CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1)
                 ELSE (n % 5) + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM f WHERE true""",
        small="SELECT * FROM rows WHERE edge <= 2",
        long="SELECT sample_index, fold, generate_subscripts(curve, 1) AS i, unnest(curve) AS v FROM small",
        q="SELECT i, quantile_cont(v, 0.5) AS center, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS spread FROM long WHERE fold <> 0 GROUP BY i",
        scaled="SELECT sample_index, list((v - center) / CASE WHEN spread = 0 THEN 1 ELSE spread END ORDER BY i) AS w FROM long JOIN q USING (i) GROUP BY sample_index",
        s="SELECT * FROM small JOIN scaled USING (sample_index)",
        near="SELECT a.sample_index AS query, list_distance(a.w, b.w) AS distance, "
        + ", ".join(f"b.{c}" for c in TARGETS)
        + """ FROM s a JOIN s b ON a.fold = 0 AND b.fold <> 0
            QUALIFY row_number() OVER (PARTITION BY a.sample_index ORDER BY round(list_distance(a.w, b.w), 9), b.sample_index) <= 25""",
    ),
)
def m13b(t):
    """The small fields' half of the stored pipeline, with one index over all of them."""
    rows = hybrid_rows(t)
    model = stored_hybrid(t, rows.where("fold <> 0"), "hybrid", k=25, folds=1, trees=1)
    hat = model.transform(rows.where("fold = 0")).where("model = 'neighbors'")
    return rounded(hat.select("sample_index", *[f"{c}_hat" for c in TARGETS]), 6, *[f"{c}_hat" for c in TARGETS])


@query("m13c_hybrid_pipeline")
def m13c(t):
    """The stored pipeline with an index for each fold and a vector forest, over all fields."""
    rows = hybrid_rows(t)
    model = stored_hybrid(t, rows.where("fold <> 0"), "hybrid", k=25, folds=5, trees=5)
    return model.transform(rows.where("fold = 0")).select("sample_index", "model", *[f"{c}_hat" for c in TARGETS])


@query("m21_cross_validate")
def m21(t):
    rows = scored_curves(t)

    def fit_predict(train, test):
        models = mo.fit_forest(train, TARGETS, trees=5, depth=4, seed=1)
        return mo.predict(models, test)

    return mo.cross_validate(rows, fit_predict)


@query(
    "m21b_cross_validate_knn",
    oracle(
        "curves targets",
        """SELECT fold, round(avg(score), 7) AS score FROM scored GROUP BY ROLLUP (fold)""",
        f="SELECT c.sample_index, c.curve, "
        + ", ".join(f"t.{c} / {TARGET_MAXIMA[c]}::DOUBLE AS {c}" for c in TARGETS)
        + f""", count(*) OVER () AS n, row_number() OVER (ORDER BY {sql_uniform(2022, 'c.sample_index')}, c.sample_index) - 1 AS pos
            FROM curves c JOIN targets t USING (sample_index)""",
        rows="""SELECT *, CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1)
                 ELSE (n % 5) + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM f""",
        near="""SELECT * FROM (SELECT q.fold, q.sample_index AS query, b.sample_index AS neighbor, list_distance(q.curve, b.curve) AS distance,
                 row_number() OVER (PARTITION BY q.sample_index ORDER BY round(list_distance(q.curve, b.curve), 9), b.sample_index) AS place
                 FROM rows q JOIN rows b ON b.fold <> q.fold) WHERE place <= 25""",
        hat="SELECT query, "
        + ", ".join(f"sum({c} / distance) / sum(1 / distance) AS {c}_hat" for c in TARGETS)
        + " FROM near JOIN rows r ON r.sample_index = near.neighbor GROUP BY query",
        base="SELECT a.fold, " + ", ".join(f"avg(b.{c}) AS {c}_base" for c in TARGETS) + " FROM (SELECT DISTINCT fold FROM rows) a JOIN rows b ON b.fold <> a.fold GROUP BY a.fold",
        scored="SELECT r.fold, ("
        + " + ".join(f"avg(pow({c} - {c}_hat, 2)) / avg(pow({c} - {c}_base, 2))" for c in TARGETS)
        + ") / 4 AS score FROM rows r JOIN hat ON hat.query = r.sample_index JOIN base USING (fold) GROUP BY r.fold",
    ),
)
def m21b(t):
    rows = fo.kfold(materialize(pr.join_targets(v.curves(t), pr.scale_targets(v.targets(t))), "rows"), 5, 2022)

    def fit_predict(train, test):
        hat = nb.knn_regress(train, test, 25)
        return test.join(hat.select("sample_index", *[F.col(c).alias(f"{c}_hat") for c in TARGETS]), "sample_index")

    return rounded(mo.cross_validate(rows, fit_predict), 7, "score")


@query("m22b_resumed_search")
def m22b(t):
    """Scaler, neighbours and weights drawn for each of three trials; the table is left after one and taken up again."""
    rows = fo.kfold(materialize(pr.join_targets(v.curves(t), pr.scale_targets(v.targets(t))), "rows"), 5, 2022)
    space = {"scaler": ["none", "robust", "minmax"], "k": [10, 25, 60], "weights": ["distance", "uniform"]}

    def objective(params):
        def fit_predict(train, test):
            if params["scaler"] != "none":
                scaler = Scaler(params["scaler"]).fit(long_features(train))
                train, test = (scaled_arrays(scaler, x) for x in (train, test))
            hat = nb.knn_regress(train, test, int(params["k"]), params["weights"])
            return test.join(hat.select("sample_index", *[F.col(c).alias(f"{c}_hat") for c in TARGETS]), "sample_index")

        return mo.cross_validate(rows, fit_predict)

    path, drawn = scratch_path(t.spark, "trials"), tr.draw(t.spark, space, 3, 6)
    tr.run(t.spark, drawn, objective, path, most=1)
    return tr.run(t.spark, drawn, objective, path)


def scaled_arrays(scaler, rows):
    """The rows with their curves scaled feature by feature."""
    moved = scaler.transform(long_features(rows))
    curve = F.transform(F.array_sort(F.collect_list(F.struct("feature", "t"))), lambda e: e["t"])
    return rows.drop("curve").join(moved.groupBy("sample_index").agg(curve.alias("curve")), "sample_index")


@query("m22_search")
def m22(t):
    rows = scored_curves(t)
    space = {"trees": [3, 6], "depth": [2, 3, 4]}

    def objective(params):
        def fit_predict(train, test):
            return mo.predict(mo.fit_forest(train, TARGETS, seed=1, **params), test)

        return mo.cross_validate(rows, fit_predict)

    return mo.search(t.spark, space, 3, objective, seed=7)


@query("m23_linear_probe")
def m23(t):
    rows = mo.as_vector(v.curves(t), "curve")
    rows = fo.stratified_kfold(rows, "label", 5, 1)
    train, test = rows.where("fold <> 0"), rows.where("fold = 0")
    predicted = mo.linear_probe(train, test, 0.5)
    return rp.class_report(predicted.select(F.col("label").alias("truth"), F.col("prediction").cast("int").alias("pred")))


@query("m23b_probe_search")
def m23b(t):
    rows = fo.stratified_kfold(mo.as_vector(v.curves(t), "curve"), "label", 3, 1)
    return mo.probe_search(rows, [0.05, 0.5], 3)


@query("m27_cluster")
def m27(t):
    novel = mo.as_vector(v.curves(t).where(NOVEL), "curve")
    return mo.cluster(novel, 3, seed=1).select("sample_index", "cluster")


@query("m28_forest_importance")
def m28(t):
    """Shares of feature blocks in the forests of all targets."""
    models = mo.fit_forest(scored_curves(t).where("fold <> 0"), TARGETS, trees=10, depth=5, seed=42)
    out = None
    for c in TARGETS:
        part = rp.block_importance(mo.importances(t.spark, models[c]), ["low", "mid", "high", "top"], 16).select(F.lit(c).alias("target"), "name", "weight")
        out = part if out is None else out.unionByName(part)
    return out
