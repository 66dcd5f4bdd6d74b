"""Registered queries: curve transforms, feature rows, augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandweave import TARGETS
from bandweave.functions import arrays as ar
from bandweave.functions.wavelets import CASCADES, TAPS, high_of
from bandweave.operators import augment as au
from bandweave.operators import features as fe
from bandweave.operators import pixels as px
from bandweave.operators import projections as pr
from bandweave.operators.ranks import shuffled_rank
from bandweave.functions.draws import below
from bandweave.plans import views as v
from bandweave.plans.pixels import rounded
from bandweave.plans.registry import query
from bandweave.plans.views import oracle, sql_uniform
from bandweave.session import materialize


def long(df, name: str, out: str = "v", index: str = "i"):
    return df.select("sample_index", F.posexplode(name).alias(index, out))


def gradient_sql(x: str) -> str:
    n = f"len({x})"
    return f"""list_transform(range({n}), lambda i: CASE WHEN i = 0 THEN {x}[2] - {x}[1] WHEN i = {n} - 1 THEN {x}[{n}] - {x}[{n} - 1]
       ELSE ({x}[i + 2] - {x}[i]) / 2 END)"""


@query(
    "w01_derivative",
    oracle(
        "curves",
        """SELECT sample_index, CAST(i AS INTEGER) AS band, round(d1[i + 1], 9) AS d1, round(d2[i + 1], 9) AS d2, round(d3[i + 1], 9) AS d3
           FROM c3, range(64) AS r(i)""",
        c1=f"SELECT sample_index, {gradient_sql('curve')} AS d1 FROM curves",
        c2=f"SELECT *, {gradient_sql('d1')} AS d2 FROM c1",
        c3=f"SELECT *, {gradient_sql('d2')} AS d3 FROM c2",
    ),
)
def w01(t):
    rows = fe.derivative(v.curves(t), 3)
    zipped = rows.select("sample_index", F.posexplode(F.arrays_zip("d1", "d2", "d3")).alias("band", "e"))
    return rounded(zipped.select("sample_index", "band", "e.d1", "e.d2", "e.d3"), 9, "d1", "d2", "d3")


@query(
    "w01b_derivative_long",
    oracle(
        "curve_long",
        """SELECT sample_index, band, round(CASE WHEN b IS NULL THEN a - v WHEN a IS NULL THEN v - b ELSE (a - b) / 2 END, 9) AS d
           FROM (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM curve_long WINDOW w AS (PARTITION BY sample_index ORDER BY band))""",
    ),
)
def w01b(t):
    return rounded(fe.derivative_long(v.curve_long(t)).select("sample_index", "band", "d"), 9, "d")


DFT = """SELECT c.sample_index, CAST(k AS INTEGER) AS i, sum(v * cos(2 * pi() * k * band / 64)) AS re,
         sum(-v * sin(2 * pi() * k * band / 64)) AS im FROM curve_long c, range(64) AS r(k) GROUP BY ALL"""


@query(
    "p11_add_quantities",
    oracle(
        "curves curve_long",
        """SELECT sample_index, i AS band, round(d1[i + 1], 9) AS gradient, round(d2[i + 1], 9) AS curvature,
                  round(re, 8) + 0.0 AS fft_re, round(im, 8) + 0.0 AS fft_im FROM c2 JOIN z USING (sample_index)""",
        c1=f"SELECT sample_index, {gradient_sql('curve')} AS d1 FROM curves",
        c2=f"SELECT *, {gradient_sql('d1')} AS d2 FROM c1",
        z=DFT,
    ),
)
def p11(t):
    rows = fe.add_quantities(v.curves(t), ["gradient", "curvature", "fft"])
    names = ["gradient", "curvature", "fft_re", "fft_im"]
    flat = rows.select("sample_index", F.posexplode(F.arrays_zip(*names)).alias("band", "e")).select("sample_index", "band", "e.*")
    flat = rounded(rounded(flat, 9, "gradient", "curvature"), 8, "fft_re", "fft_im")
    return flat.withColumns({c: F.col(c) + F.lit(0.0) for c in ("fft_re", "fft_im")})


@query("f11_dft", oracle("curve_long", "SELECT sample_index, i, round(re, 8) + 0.0 AS re, round(im, 8) + 0.0 AS im FROM z", z=DFT))
def f11(t):
    rows = v.curves(t).select("sample_index", ar.dft("curve").alias("z"))
    flat = rows.select("sample_index", F.posexplode(F.arrays_zip("z.re", "z.im")).alias("i", "e")).select("sample_index", "i", "e.*")
    return rounded(flat, 8, "re", "im").withColumns({c: F.round(c, 8) + F.lit(0.0) for c in ("re", "im")})


@query(
    "a19_channel_max_norm",
    oracle(
        "curve_long",
        """SELECT sample_index, band, round(v / max(v) OVER (), 9) AS value, round(d / max(d) OVER (), 9) AS gradient FROM (
             SELECT *, CASE WHEN b IS NULL THEN a - v WHEN a IS NULL THEN v - b ELSE (a - b) / 2 END AS d
             FROM (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM curve_long WINDOW w AS (PARTITION BY sample_index ORDER BY band)))""",
    ),
)
def a19(t):
    rows = v.curves(t).withColumn("g", ar.gradient("curve"))
    flat = rows.select("sample_index", F.posexplode(F.arrays_zip("curve", "g")).alias("band", "e"))
    wide = flat.select("sample_index", "band", F.col("e.curve").alias("value"), F.col("e.g").alias("gradient"))
    return rounded(px.channel_max_norm(wide, ["value", "gradient"]), 9, "value", "gradient")


def taps_sql(taps) -> str:
    return "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in taps) + "]"


def dwt_sql(x: str, taps) -> str:
    n, size = f"len({x})", len(taps)
    return f"""list_transform(range(({n} + {size - 1}) // 2), lambda k: list_sum(list_transform(range({size}),
       lambda j: ({taps_sql(taps)})[j + 1] * {x}[greatest(1, least({n}, 2 * k + 2 - j))])))"""


def cascade_ctes(source: str, wavelet: str) -> dict[str, str]:
    low = TAPS[wavelet]
    ctes, frm, x = {}, source, "curve"
    plan = CASCADES[wavelet]
    for level in range(4):
        ctes[f"l{level}"] = f"SELECT *, {dwt_sql(x, low)} AS a{level}, {dwt_sql(x, high_of(low))} AS h{level} FROM {frm}"
        frm = f"l{level}"
        if level < 3:
            lo, hi = plan["next"][level]
            end = f"len(a{level}) - 1" if hi == -1 else str(hi)
            ctes[f"n{level}"] = f"SELECT *, a{level}[{lo + 1}:{end}] AS x{level} FROM {frm}"
            frm, x = f"n{level}", f"x{level}"

    def kept(kind: str) -> str:
        parts = []
        for level, (lo, hi) in enumerate(plan["keep"]):
            parts.append(f"{kind}{level}" if lo is None else f"{kind}{level}[{lo + 1}:{hi}]")
        return " || ".join(parts)

    ctes["done"] = f"SELECT sample_index, {kept('a')} AS approx, {kept('h')} AS detail FROM {frm}"
    return ctes


@query(
    "f12_dwt",
    oracle(
        "curves",
        "SELECT sample_index, CAST(i AS INTEGER) AS i, round(a[i + 1], 9) AS approx, round(h[i + 1], 9) AS detail FROM one, range(34) AS r(i)",
        one=f"SELECT sample_index, {dwt_sql('curve', TAPS['sym3'])} AS a, {dwt_sql('curve', high_of(TAPS['sym3']))} AS h FROM curves",
    ),
)
def f12(t):
    rows = v.curves(t).select("sample_index", ar.dwt("sym3")("curve").alias("w"))
    flat = rows.select("sample_index", F.posexplode(F.arrays_zip("w.approx", "w.detail")).alias("i", "e")).select("sample_index", "i", "e.*")
    return rounded(flat, 9, "approx", "detail")


def _cascade_query(t, wavelet):
    rows = v.curves150(t).select("sample_index", ar.dwt_cascade(wavelet)("curve").alias("w"))
    flat = rows.select("sample_index", F.posexplode(F.arrays_zip("w.approx", "w.detail")).alias("i", "e")).select("sample_index", "i", "e.*")
    return rounded(flat, 9, "approx", "detail")


CASCADE_ROWS = (
    "SELECT sample_index, CAST(i AS INTEGER) AS i, round(approx[i + 1], 9) AS approx, round(detail[i + 1], 9) AS detail"
    " FROM done, range(150) AS r(i)"
)


@query("f13_dwt_cascade_sym3", oracle("curves150", CASCADE_ROWS, **cascade_ctes("curves150", "sym3")))
def f13(t):
    return _cascade_query(t, "sym3")


@query("f14_dwt_cascade_dmey", oracle("curves150", CASCADE_ROWS, **cascade_ctes("curves150", "dmey")))
def f14(t):
    return _cascade_query(t, "dmey")


@query(
    "f15_sigma_ratio",
    oracle(
        "curves",
        """SELECT sample_index, round(abs(curve[1]) / (abs(curve[2]) + 2.220446049250313e-16), 6) AS ratio,
                  round(abs(curve[1]) / abs(curve[2]), 6) AS plain FROM curves""",
    ),
)
def f15(t):
    first, second = F.abs(F.get("curve", F.lit(0))), F.abs(F.get("curve", F.lit(1)))
    rows = v.curves(t).select(
        "sample_index", ar.sigma_ratio(first, second).alias("ratio"), ar.sigma_ratio(first, second, None).alias("plain")
    )
    return rounded(rows, 6, "ratio", "plain")


@query(
    "f16_blocks",
    oracle(
        "curves curves150",
        """SELECT sample_index, CAST(i AS INTEGER) AS i, round(whole[i + 151], 9) AS v, len(whole) AS size FROM (
             SELECT a.sample_index, a.curve || g AS whole FROM curves150 a JOIN (SELECT sample_index, """
        + gradient_sql("curve")
        + """ AS g FROM curves150) USING (sample_index)), range(150) AS r(i)""",
    ),
)
def f16(t):
    rows = v.curves150(t).withColumn("g", ar.gradient("curve"))
    whole = rows.select("sample_index", ar.concat_blocks(["curve", "g"]).alias("whole"))
    second = whole.select("sample_index", F.posexplode(ar.block("whole", 1)).alias("i", "v"), F.size("whole").cast("bigint").alias("size"))
    return rounded(second, 9, "v")


@query(
    "f17_l2_normalize",
    oracle("curve_long", "SELECT sample_index, band, round(v / sqrt(sum(v * v) OVER (PARTITION BY sample_index)), 9) AS v FROM curve_long"),
)
def f17(t):
    rows = v.curves(t).select("sample_index", ar.l2_normalize("curve").alias("u"))
    return rounded(long(rows, "u", index="band"), 9, "v")


@query(
    "f19_dct",
    oracle(
        "curve_long",
        """SELECT sample_index, CAST(k AS INTEGER) AS i, round(2 * sum(v * cos(pi() * k * (2 * band + 1) / 128)), 8) + 0.0 AS v
           FROM curve_long, range(64) AS r(k) GROUP BY ALL""",
    ),
)
def f19(t):
    rows = v.curves(t).select("sample_index", ar.dct("curve").alias("y"))
    return rounded(long(rows, "y"), 8, "v").withColumn("v", F.round("v", 8) + F.lit(0.0))


@query("m01_features_forest")
def m01(t):
    return fe.features(v.pixel_rows(t), "forest")


@query("m01b_features_tuned")
def m01b(t):
    return fe.features(v.pixel_rows(t), "tuned")


CURVE4 = """SELECT sample_index, list(coalesce(v, 0.0) ORDER BY band) AS arr FROM (SELECT sample_index, band,
   avg(value / 2210.0::DOUBLE) FILTER (NOT masked) AS v FROM pixels GROUP BY ALL) GROUP BY sample_index"""


@query(
    "m02_features_knn",
    oracle(
        "pixels",
        """SELECT sample_index, CAST(i AS INTEGER) AS band, round(arr[i + 1], 9) AS arr, round(d1[i + 1], 9) AS d1, round(d2[i + 1], 9) AS d2,
             round(d3[i + 1], 9) AS d3, round((SELECT sum(x) FROM (SELECT unnest(list_transform(range(4), lambda j: arr[j + 1] * cos(2 * pi() * i * j / 4))) AS x)), 8) + 0.0 AS re,
             round(e.energy, 6) AS energy
           FROM c3 JOIN e USING (sample_index), range(4) AS r(i) WHERE e.band = i""",
        c0=CURVE4,
        c1=f"SELECT *, {gradient_sql('arr')} AS d1 FROM c0",
        c2=f"SELECT *, {gradient_sql('d1')} AS d2 FROM c1",
        c3=f"SELECT *, {gradient_sql('d2')} AS d3 FROM c2",
        sz="SELECT sample_index, max(x) + 1 AS h, max(y) + 1 AS w FROM pixels GROUP BY 1",
        e="""SELECT p.sample_index, p.band, sum(CASE WHEN masked THEN 0 ELSE pow(value / 2210.0::DOUBLE, 2) END
                * ((greatest(h, w) - x + h - 1) // h) * ((greatest(h, w) - y + w - 1) // w)) AS energy
             FROM pixels p JOIN sz USING (sample_index) GROUP BY ALL""",
    ),
)
def m02(t):
    """The k-nearest layout; fields are at most 4 x 4 here, so its singular values hold the whole image energy."""
    rows = fe.features(v.pixel_rows(t), "knn")
    flat = rows.select("sample_index", F.posexplode(F.arrays_zip(*fe.BLOCKS["knn"])).alias("band", "e"))
    flat = flat.select("sample_index", "band", "e.*")
    energy = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(5)), F.lit(0.0))
    out = flat.select("sample_index", "band", "arr", "d1", "d2", "d3", (F.round("re", 8) + F.lit(0.0)).alias("re"), energy.alias("energy"))
    return rounded(rounded(out, 9, "arr", "d1", "d2", "d3"), 6, "energy")


@query("m02b_features_boosted")
def m02b(t):
    return fe.features(v.pixel_rows(t), "boosted")


@query(
    "m03_singular_profile",
    oracle(
        "pixels_full",
        """SELECT sample_index, band, round(sum(g) FILTER (y1 = y2), 5) AS trace, round(sqrt(sum(g * g)), 5) AS norm FROM (
             SELECT a.sample_index, a.band, a.y AS y1, b.y AS y2, sum(a.value / 2210.0::DOUBLE * (b.value / 2210.0::DOUBLE)) AS g
             FROM img a JOIN img b ON a.sample_index = b.sample_index AND a.band = b.band AND a.x = b.x GROUP BY ALL) GROUP BY ALL""",
        sz="SELECT sample_index, max(x) + 1 AS h, max(y) + 1 AS w FROM pixels_full GROUP BY 1",
        img="""SELECT p.sample_index, p.band, gx.i AS x, gy.i AS y, CASE WHEN masked THEN 0.0 ELSE value END AS value
               FROM sz s, LATERAL (SELECT unnest(range(greatest(h, w))) AS i) gx, LATERAL (SELECT unnest(range(greatest(h, w))) AS i) gy
               JOIN pixels_full p ON p.sample_index = s.sample_index AND p.x = gx.i % s.h AND p.y = gy.i % s.w""",
    ),
)
def m03(t):
    """Sums of second and fourth powers of the singular values equal the Gram matrix's trace and norm."""
    scaled = px.scale_values(v.pixel_rows(t, full=True), 2210.0)
    sigma = fe.singular_profile(scaled, 5)
    square = F.aggregate("sigma", F.lit(0.0), lambda s, x: s + x * x)
    fourth = F.aggregate("sigma", F.lit(0.0), lambda s, x: s + x * x * x * x)
    return sigma.select("sample_index", "band", F.round(square, 5).alias("trace"), F.round(F.sqrt(fourth), 5).alias("norm"))


@query(
    "m03b_gram",
    oracle(
        "pixels",
        """SELECT sample_index, band, round(sum(g) FILTER (y1 = y2), 5) AS trace, round(sqrt(sum(g * g)), 5) AS norm FROM (
             SELECT a.sample_index, a.band, a.y AS y1, b.y AS y2, sum(a.value / 2210.0::DOUBLE * (b.value / 2210.0::DOUBLE)) AS g
             FROM pixels a JOIN pixels b ON a.sample_index = b.sample_index AND a.band = b.band AND a.x = b.x
             WHERE NOT a.masked AND NOT b.masked GROUP BY ALL) GROUP BY ALL""",
    ),
)
def m03b(t):
    g = fe.gram(px.scale_values(v.pixels(t), 2210.0))
    return g.select("sample_index", "band", F.round("trace", 5).alias("trace"), F.round(F.sqrt("norm2"), 5).alias("norm"))


def crop_sql(tries: int, good: str) -> dict[str, str]:
    """Corners, counts and choice of crops of side 2 with one draw per field."""
    def draw(axis, i):
        return sql_uniform(4, f"sample_index || ':0:' || {i} || ':{axis}'")

    ctes = {
        "tries": f"""SELECT sample_index, h, w, i, CASE WHEN i < {tries} THEN 2 ELSE least(h, w) END AS side,
             floor({draw('x', 'i')} * (h + 1 - CASE WHEN i < {tries} THEN 2 ELSE least(h, w) END))::BIGINT AS x0,
             floor({draw('y', 'i')} * (w + 1 - CASE WHEN i < {tries} THEN 2 ELSE least(h, w) END))::BIGINT AS y0
           FROM sizes_full, range({tries + 1}) AS r(i) WHERE i = {tries} OR (h >= 2 AND w >= 2)""",
        "passed": f"""SELECT t.sample_index, min(i) AS i FROM (
             SELECT t.sample_index, t.i FROM tries t JOIN pixels_full p ON p.sample_index = t.sample_index AND p.band = 0
               AND p.x >= x0 AND p.x < x0 + side AND p.y >= y0 AND p.y < y0 + side
             WHERE t.i < {tries} GROUP BY ALL HAVING count(*) FILTER ({good}) = 4) t GROUP BY 1""",
        "chosen": f"""SELECT t.* FROM tries t LEFT JOIN passed p USING (sample_index) WHERE t.i = coalesce(p.i, {tries})""",
    }
    noise = sql_uniform(5, "p.sample_index || ':0:' || band || ':' || x || ':' || y")
    ctes["cut"] = f"""SELECT p.sample_index, 0 AS draw, i::INTEGER AS attempt, x - x0 AS x, y - y0 AS y, band,
         round(value + (2.0 * {noise} - 1.0) * CASE WHEN i < {tries} THEN 0.01 ELSE 0.001 END::DOUBLE * peak, 4) AS value, masked
       FROM pixels_full p JOIN chosen c ON c.sample_index = p.sample_index AND x >= x0 AND x < x0 + side AND y >= y0 AND y < y0 + side
       JOIN (SELECT sample_index, max(value) AS peak FROM pixels_full GROUP BY 1) m ON m.sample_index = p.sample_index"""
    return ctes


@query("m04_crop_augment", oracle("pixels_full sizes_full", "SELECT * FROM cut", **crop_sql(10, "NOT masked")))
def m04(t):
    return rounded(au.crop_augment(v.stored_pixels(t, full=True), 2, 10, 1, 4), 4, "value")


@query("m04b_crop_augment_masked", oracle("pixels_full sizes_full", "SELECT * FROM cut", **crop_sql(3, "masked")))
def m04b(t):
    return rounded(au.crop_augment(v.stored_pixels(t, full=True), 2, 3, 1, 4, accept="masked"), 4, "value")


@query("m05_min_edge_crop", oracle("pixels_full sizes_full", "SELECT * FROM cut", **crop_sql(0, "true")))
def m05(t):
    return rounded(au.crop_augment(v.stored_pixels(t, full=True), 2, 0, 1, 4), 4, "value")


def jitter_sql(c: str) -> str:
    relative = f"{c} + {c} * (-0.001::DOUBLE + {{r}} * 0.002::DOUBLE)".format(r=sql_uniform(6, f"sample_index || ':{c}'"))
    on, shift = sql_uniform(16, "sample_index || ':on'"), sql_uniform(16, "sample_index")
    added = f"{c} + CASE WHEN {on} < 0.5 THEN -0.01::DOUBLE + {shift} * 0.02::DOUBLE ELSE 0 END"
    return f"round({relative}, 5) AS {c}, round({added}, 5) AS {c}_added"


@query("m06_jitter_targets", oracle("targets", "SELECT sample_index, " + ", ".join(jitter_sql(c) for c in TARGETS) + " FROM targets"))
def m06(t):
    plain = v.targets(t).withColumns({f"{c}_added": F.col(c) for c in TARGETS})
    relative = au.jitter_targets(plain, "relative", 0.001, 6)
    both = au.jitter_targets(relative, "additive", 0.01, 16, cols=[f"{c}_added" for c in TARGETS])
    return rounded(both, 5, *TARGETS, *[f"{c}_added" for c in TARGETS])


NUMBERED = f"""SELECT c.sample_index, c.curve, t.K, t.pH, count(*) OVER () AS n,
    row_number() OVER (ORDER BY {sql_uniform(3, 'c.sample_index')}, c.sample_index) - 1 AS pos FROM curves c JOIN targets t USING (sample_index)"""
DRAWN = f"""SELECT pos AS draw, floor({sql_uniform(3, "'a:' || pos")} * n)::BIGINT AS a, floor({sql_uniform(3, "'b:' || pos")} * n)::BIGINT AS b
    FROM numbered WHERE pos < floor(n * 0.3)"""


@query(
    "m07_mix_rows",
    oracle(
        "curves targets",
        """SELECT m.draw, CAST(i AS INTEGER) AS i, round(0.7::DOUBLE * x.curve[i + 1] + 0.3::DOUBLE * y.curve[i + 1], 9) AS v,
                  round(0.7::DOUBLE * x.K + 0.3::DOUBLE * y.K, 6) AS "K" FROM drawn m JOIN numbered x ON x.pos = m.a JOIN numbered y ON y.pos = m.b, range(64) AS r(i)""",
        numbered=NUMBERED,
        drawn=DRAWN,
    ),
)
def m07(t):
    rows = materialize(v.curves(t).join(v.targets(t).select("sample_index", "K", "pH"), "sample_index"), "rows")
    mixed = au.mix_rows(rows, 0.3, 0.3, 3, cols=["K", "pH"]).where("draw IS NOT NULL")
    flat = mixed.select("draw", "K", F.posexplode("curve").alias("i", "v"))
    return rounded(rounded(flat, 9, "v"), 6, "K")


@query(
    "j09_gather",
    oracle(
        "curves targets",
        """SELECT d.draw, a AS pos, x.sample_index, x.K FROM drawn d JOIN numbered x ON x.pos = d.a""",
        numbered=NUMBERED,
        drawn=DRAWN,
    ),
)
def j09(t):
    rows = v.curves(t).join(v.targets(t).select("sample_index", "K"), "sample_index").select("sample_index", "K")
    ranked = shuffled_rank(materialize(rows, "rows"), "sample_index", 3, name="pos", total="n")
    draws = ranked.where(F.col("pos") < F.floor(F.col("n") * F.lit(0.3))).select(
        F.col("pos").alias("draw"), below(3, F.col("n"), "a", F.col("pos")).alias("pos")
    )
    return pr.gather(ranked.drop("n"), draws)


@query(
    "m08_select_pixels",
    oracle(
        "pixel_rows",
        """SELECT sample_index, px, CAST(slot // 4 AS INTEGER) AS draw, CAST(slot % 4 AS INTEGER) AS pixel, m < 8 AS repeated, bands[2] AS price
           FROM (SELECT *, least(count(*) OVER (PARTITION BY sample_index), 8) AS m,
                   row_number() OVER (PARTITION BY sample_index ORDER BY u, px) - 1 AS r FROM (
                 SELECT *, """
        + sql_uniform(18, "sample_index || ':' || px")
        + """ AS u FROM pixel_rows)), range(8) AS q(slot) WHERE r < 8 AND slot % m = r""",
    ),
)
def m08(t):
    chosen = au.select_pixels(v.pixel_rows(t), 4, 2, 18)
    return chosen.select("sample_index", "px", "draw", "pixel", "repeated", F.get("bands", F.lit(1)).alias("price"))


@query(
    "m08b_select_pixels_per_band",
    oracle(
        "pixels",
        """SELECT sample_index, band, px, value, slot FROM (SELECT *, row_number() OVER (PARTITION BY sample_index, band ORDER BY u, px)::INTEGER AS slot
           FROM (SELECT *, """
        + sql_uniform(28, "sample_index || ':' || band || ':' || px")
        + """ AS u FROM pixels)) WHERE slot <= 3""",
    ),
)
def m08b(t):
    return au.select_pixels_per_band(v.pixels(t), 3, 28).select("sample_index", "band", "px", "value", "slot")
