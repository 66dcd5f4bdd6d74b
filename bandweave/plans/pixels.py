"""Registered queries: projections, masks, sizes, reducers and geometry over the pixel view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandweave import SIZE_EDGES, SIZE_LABELS, TARGET_MAXIMA, TARGETS, VALUE_SCALE
from bandweave.operators import pixels as px
from bandweave.operators import projections as pr
from bandweave.operators import reshape as rs
from bandweave.plans import views as v
from bandweave.plans.registry import query
from bandweave.plans.views import oracle, sql_uniform
from bandweave.session import materialize

FULL = "sample_index, x, y, band, value, masked"
# The stand-in fields are a few pixels wide, so the size classes split at edge 2 here.
SMALL = 2.0


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def target_sql(fmt: str, sep: str = ", ") -> str:
    return sep.join(fmt.format(c=c, m=TARGET_MAXIMA[c]) for c in TARGETS)


@query(
    "p01_scale_targets",
    oracle(
        "targets",
        "SELECT sample_index, " + target_sql("round({c} / {m}::DOUBLE, 9) AS {c}_scaled, round({c} / {m}::DOUBLE * {m}::DOUBLE, 6) AS {c}_back")
        + " FROM targets",
    ),
)
def p01(t):
    scaled = pr.scale_targets(v.targets(t))
    back = pr.unscale_targets(scaled)
    both = scaled.select("sample_index", *[F.col(c).alias(f"{c}_scaled") for c in TARGETS]).join(
        back.select("sample_index", *[F.col(c).alias(f"{c}_back") for c in TARGETS]), "sample_index"
    )
    both = rounded(both, 9, *[f"{c}_scaled" for c in TARGETS])
    return rounded(both, 6, *[f"{c}_back" for c in TARGETS])


@query("p02_select_targets", oracle("targets", 'SELECT sample_index, K, round(pH, 6) AS "pH" FROM targets'))
def p02(t):
    return rounded(pr.select_targets(v.targets(t), ["K", "pH"]), 6, "pH")


@query(
    "p03_scale_values",
    oracle(
        "pixels",
        """SELECT sample_index, px, band, round(value / 2210.0::DOUBLE, 9) AS by_constant,
                  round(value / (SELECT max(value) FROM pixels WHERE NOT masked), 9) AS by_peak FROM pixels""",
    ),
)
def p03(t):
    pixels = v.pixels(t)
    by_constant = px.scale_values(pixels, VALUE_SCALE).withColumnRenamed("value", "by_constant")
    peak = px.largest_value(v.pixel_values(t))
    both = by_constant.withColumn("by_peak", F.col("by_constant") * F.lit(VALUE_SCALE) / peak)
    return rounded(both.select("sample_index", "px", "band", "by_constant", "by_peak"), 9, "by_constant", "by_peak")


@query(
    "p04_mask_fill",
    oracle("pixels", "SELECT sample_index, px, band, CASE WHEN masked THEN 0.0 ELSE value END AS value FROM pixels"),
)
def p04(t):
    return px.mask_fill(v.pixels(t)).select("sample_index", "px", "band", "value")


@query("p05_mask_drop", oracle("pixels", "SELECT sample_index, px, band, value FROM pixels WHERE NOT masked"))
def p05(t):
    return px.mask_drop(v.pixels(t)).select("sample_index", "px", "band", "value")


@query(
    "p06_field_size",
    oracle("sizes", "SELECT sample_index, h, w, (h + w) / 2.0::DOUBLE AS edge, h * w AS area FROM sizes"),
)
def p06(t):
    return px.field_size(v.pixel_rows(t))


@query(
    "p07_route_by_size",
    oracle(
        "sizes",
        """SELECT route, count(*) AS n, sum(h * w)::BIGINT AS area FROM (
             SELECT *, CASE WHEN (h + w) / 2.0 <= 2 THEN 'small' ELSE 'large' END AS route FROM sizes) GROUP BY route""",
    ),
)
def p07(t):
    small, large = px.route_by_size(materialize(px.field_size(v.pixel_rows(t)), "sizes"), SMALL)
    marked = small.withColumn("route", F.lit("small")).unionByName(large.withColumn("route", F.lit("large")))
    return marked.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))


@query(
    "p08_lookup",
    oracle("targets", "SELECT sample_index, P, K, round(Mg, 6) AS \"Mg\", round(pH, 6) AS \"pH\" FROM targets WHERE sample_index = 1210"),
)
def p08(t):
    return rounded(px.lookup(v.targets(t), 1210), 6, "Mg", "pH")


@query(
    "p09_scatter_targets",
    oracle(
        "targets",
        """SELECT sample_index, 0.0::DOUBLE AS "P", round(K / 625.0::DOUBLE * 625.0::DOUBLE, 6) AS "K", 0.0::DOUBLE AS "Mg",
                  round(pH / 7.8::DOUBLE * 7.8::DOUBLE, 6) AS "pH" FROM targets""",
    ),
)
def p09(t):
    part = pr.scale_targets(pr.select_targets(v.targets(t), ["K", "pH"]))
    return rounded(pr.scatter_targets(part), 6, "K", "pH")


@query(
    "p10_rename_targets",
    oracle("targets", 'SELECT sample_index, P AS "ix_0", K AS "ix_1", round(Mg, 6) AS "ix_2", round(pH, 6) AS "ix_3" FROM targets'),
)
def p10(t):
    names = {c: f"ix_{i}" for i, c in enumerate(TARGETS)}
    return rounded(pr.rename_targets(v.targets(t), names), 6, "ix_2", "ix_3")


@query(
    "j01_join_targets",
    oracle(
        "pixels targets",
        """SELECT band, count(*) AS n, round(avg(value * K), 3) AS value_k, round(avg(pH), 6) AS mean_ph
           FROM pixels JOIN targets USING (sample_index) GROUP BY band""",
    ),
)
def j01(t):
    joined = pr.join_targets(v.pixel_values(t), v.targets(t))
    out = joined.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("value") * F.col("K")).alias("value_k"), F.avg("pH").alias("mean_ph")
    )
    return rounded(rounded(out, 3, "value_k"), 6, "mean_ph")


@query(
    "j02_join_wavelengths",
    oracle(
        "curve_long wavelengths",
        """SELECT sample_index, c.band, round(wavelength, 6) AS wavelength, v FROM curve_long c
           JOIN wavelengths w ON w.band_no = c.band + 1""",
    ),
)
def j02(t):
    joined = pr.join_wavelengths(v.curve_long(t), v.wavelengths(t))
    return rounded(joined.select("sample_index", "band", "wavelength", "v"), 6, "wavelength")


STATS = """stats AS (SELECT band, max(value) AS mx, avg(value) AS m1, avg(value * value) AS m2
           FROM pixels WHERE NOT masked GROUP BY band)"""


@query(
    "j03_join_band_stats",
    oracle(
        "pixels",
        "SELECT sample_index, px, p.band, round(value / mx, 9) AS share FROM pixels p JOIN stats s ON s.band = p.band",
        stats="SELECT band, max(value) AS mx FROM pixels WHERE NOT masked GROUP BY band",
    ),
)
def j03(t):
    joined = px.join_band_stats(v.pixels(t), px.band_stats(v.pixel_values(t)))
    return rounded(joined.select("sample_index", "px", "band", "share"), 9, "share")


@query(
    "a01_curve",
    oracle(
        "pixels",
        """SELECT sample_index, band, round(avg(value) FILTER (NOT masked), 6) AS mean,
                  max(value) FILTER (NOT masked) AS top FROM pixels GROUP BY ALL""",
    ),
)
def a01(t):
    return rounded(px.curve(v.pixel_values(t), {"mean": F.avg, "top": F.max}), 6, "mean")


@query(
    "a02_curve_masked_unmasked",
    oracle(
        "pixels",
        """SELECT sample_index, band, round(avg(value) FILTER (NOT masked), 6) AS masked_mean,
                  round(avg(value), 6) AS full_mean FROM pixels GROUP BY ALL""",
    ),
)
def a02(t):
    return rounded(px.curve_masked_unmasked(v.pixel_values(t)), 6, "masked_mean", "full_mean")


@query(
    "a04_band_stats",
    oracle(
        "pixels",
        """SELECT p.band, round(avg(value / mx), 9) AS mean,
                  round(sqrt(avg((value / mx) * (value / mx)) - avg(value / mx) * avg(value / mx)), 8) AS std, max(mx) AS max
           FROM pixels p JOIN stats s ON s.band = p.band WHERE NOT masked GROUP BY p.band""",
        stats="SELECT band, max(value) AS mx FROM pixels WHERE NOT masked GROUP BY band",
    ),
)
def a04(t):
    return rounded(rounded(px.band_stats(v.pixel_values(t)), 9, "mean"), 8, "std")


@query(
    "a11_pool",
    oracle(
        "pixels",
        """SELECT sample_index, band, round(sum(value), 4) AS mean, round(sqrt(greatest(sum(value * value) - 2 * sum(value) * sum(value)
                    + count(*) * sum(value) * sum(value), 0) + 1e-31), 3) AS std,
                  max(value) AS max, min(value) AS min,
                  round(avg(value) FILTER (NOT masked), 6) AS maskedmean,
                  round(CASE WHEN count(*) FILTER (NOT masked) = 1 THEN 0.0
                       ELSE sqrt(var_samp(value) FILTER (NOT masked) + 1e-31) END, 4) AS maskedstd
           FROM pixels GROUP BY ALL""",
    ),
)
def a11(t):
    pooled = px.pool(v.pixel_values(t), "mean_std_max_min_maskedmean_maskedstd")
    pooled = rounded(rounded(pooled, 4, "mean", "maskedstd"), 3, "std")
    return rounded(pooled, 6, "maskedmean")


def summary_sql(view: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS target, min({c}) AS min, max({c}) AS max, avg({c}) AS mean, stddev_pop({c}) AS std, "
        f"quantile_cont({c}, 0.5) AS median FROM {view}"
    )


@query(
    "a12_summary",
    oracle(
        "targets",
        "SELECT target, round(min, 4) AS min, round(max, 4) AS max, round(mean, 4) AS mean, round(std, 4) AS std, round(median, 4) AS median FROM ("
        + " UNION ALL ".join(summary_sql("targets", c) for c in TARGETS)
        + ")",
    ),
)
def a12(t):
    return rounded(px.summary(materialize(v.targets(t), "targets"), TARGETS), 4, "min", "max", "mean", "std", "median")


@query("a15_value_counts", "SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1")
def a15(t):
    return px.value_counts(t.lineitem, "l_quantity")


@query(
    "f09_pad_wrap",
    oracle(
        "pixels_full sizes_full",
        """SELECT s.sample_index, gx.i AS x, gy.i AS y, p.band, p.value, p.masked
           FROM sizes_full s, LATERAL (SELECT unnest(range(greatest(h, w))) AS i) gx,
                LATERAL (SELECT unnest(range(greatest(h, w))) AS i) gy
           JOIN pixels_full p ON p.sample_index = s.sample_index AND p.x = gx.i % s.h AND p.y = gy.i % s.w""",
    ),
)
def f09(t):
    return rs.pad_square(v.stored_pixels(t, full=True), "wrap")


@query(
    "f10_pad_zero",
    oracle(
        "pixels_full sizes_full",
        """SELECT s.sample_index, gx.i AS x, gy.i AS y, CAST(b.b AS INTEGER) AS band, coalesce(p.value, 0.0) AS value,
                  coalesce(p.masked, false) AS masked
           FROM sizes_full s, LATERAL (SELECT unnest(range(greatest(h, w, 4))) AS i) gx,
                LATERAL (SELECT unnest(range(greatest(h, w, 4))) AS i) gy, range(4) AS b(b)
           LEFT JOIN pixels_full p ON p.sample_index = s.sample_index AND p.x = gx.i AND p.y = gy.i AND p.band = b.b""",
    ),
)
def f10(t):
    return rs.pad_square(v.stored_pixels(t, full=True), "zero", size=4)


ORIENT = f"""SELECT p.*, h, w,
   CASE WHEN {sql_uniform(7, "p.sample_index || ':turn'")} < 0.5
        THEN floor({sql_uniform(7, "p.sample_index || ':k'")} * 3)::INTEGER + 1 ELSE 0 END AS k,
   {sql_uniform(7, "p.sample_index || ':flip'")} < 0.5 AS mirrored
   FROM pixels_full p JOIN sizes_full USING (sample_index)"""


@query(
    "f20_flip_rotate",
    oracle(
        "pixels_full sizes_full",
        """SELECT sample_index, tx AS x, CASE WHEN mirrored THEN (CASE WHEN k % 2 = 1 THEN h ELSE w END) - 1 - ty ELSE ty END AS y,
                  band, value, masked
           FROM (SELECT *, CASE k WHEN 0 THEN x WHEN 1 THEN w - 1 - y WHEN 2 THEN h - 1 - x ELSE y END AS tx,
                        CASE k WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN w - 1 - y ELSE h - 1 - x END AS ty FROM turned)""",
        turned=ORIENT,
    ),
)
def f20(t):
    return rs.augment_orientation(v.stored_pixels(t, full=True), 7).select(*FULL.split(", "))


PIXEL_KEY = "sample_index || ':' || band || ':' || x || ':' || y"


@query(
    "f21_noise",
    oracle(
        "pixels",
        f"""SELECT sample_index, px, band,
              round(value + (-0.01::DOUBLE + {sql_uniform(11, PIXEL_KEY)} * 0.02::DOUBLE) * max(value) OVER (PARTITION BY sample_index), 5) AS uniform_noise,
              round(CASE WHEN {sql_uniform(12, 'sample_index')} < 0.5 THEN value + 0.005::DOUBLE *
                sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {sql_uniform(12, PIXEL_KEY + " || ':a'")})) *
                cos(2.0::DOUBLE * pi() * {sql_uniform(12, PIXEL_KEY + " || ':b'")}) ELSE value END, 5) AS normal_noise
            FROM pixels""",
    ),
)
def f21(t):
    # both columns come from one pass over the pixel view
    pixels = v.stored_pixels(t).withColumn("raw", F.col("value"))
    noisy = rs.add_noise(pixels, "uniform", 0.01, 11).withColumnsRenamed({"value": "uniform_noise", "raw": "value"})
    both = rs.add_noise(noisy, "normal", 0.005, 12).withColumnRenamed("value", "normal_noise")
    return rounded(both.select("sample_index", "px", "band", "uniform_noise", "normal_noise"), 5, "uniform_noise", "normal_noise")


@query(
    "f22_flatten_wrap",
    oracle(
        "pixels",
        """SELECT f.sample_index, p.pos, f.value FROM flat f, LATERAL (SELECT unnest(range(24)) AS pos) p
           WHERE (p.pos - 5 + 1000 * m) % m = r""",
        flat="""SELECT sample_index, value, row_number() OVER (PARTITION BY sample_index ORDER BY y, x, band) - 1 AS r,
                count(*) OVER (PARTITION BY sample_index) AS m FROM pixels WHERE NOT masked""",
    ),
)
def f22(t):
    return rs.flatten_wrap(v.stored_pixels(t), 24)


@query(
    "f23_resize_nearest",
    oracle(
        "pixels_full sizes_full",
        """SELECT s.sample_index, gx.i AS x, gy.i AS y, p.band, p.value
           FROM sizes_full s, range(3) AS gx(i), range(3) AS gy(i)
           JOIN pixels_full p ON p.sample_index = s.sample_index AND p.x = gx.i * s.h // 3 AND p.y = gy.i * s.w // 3""",
    ),
)
def f23(t):
    return rs.resize_nearest(v.stored_pixels(t, full=True), 3).select("sample_index", "x", "y", "band", "value")


@query(
    "f24_repeat_rows",
    oracle("targets", "SELECT sample_index, CAST(d AS INTEGER) AS draw, K FROM targets, range(3) AS r(d)"),
)
def f24(t):
    return rs.repeat_rows(v.targets(t).select("sample_index", "K"), 3)


@query(
    "t01_order_by_key",
    "SELECT CAST(o_orderkey AS VARCHAR) || '.npz' AS name, o_orderkey AS key FROM orders",
)
def t01(t):
    named = t.orders.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".npz")).alias("name"))
    keyed = named.withColumn("key", F.regexp_extract("name", r"(\d+)\.npz$", 1).cast("bigint"))
    return pr.order_by_key(keyed, "key")


@query("t02_head", oracle("targets", "SELECT sample_index, P, K FROM targets ORDER BY sample_index LIMIT 100"))
def t02(t):
    return pr.head(v.targets(t).select("sample_index", "P", "K"), 100)


@query(
    "t06_top_values",
    oracle(
        "pixels",
        """SELECT band, value, place FROM (SELECT sample_index, px, band, value,
             row_number() OVER (PARTITION BY band ORDER BY value DESC, sample_index, px)::INTEGER AS place FROM pixels
             WHERE NOT masked) WHERE place <= 5""",
    ),
)
def t06(t):
    top = px.top_values(px.mask_drop(v.pixels(t)), ["band"], "value", 5, ["sample_index", "px"])
    return top.select("band", "value", "place")


@query(
    "u01_append",
    oracle("targets", "SELECT sample_index, K, 0 AS source FROM targets UNION ALL SELECT sample_index, K * 1.5::DOUBLE, 1 FROM targets"),
)
def u01(t):
    base = v.targets(t).select("sample_index", "K")
    more = base.withColumn("K", F.col("K") * 1.5).withColumn("source", F.lit(1))
    return pr.append(base.withColumn("source", F.lit(0)), more)


@query(
    "u03_with_unlabelled",
    oracle(
        "targets",
        """SELECT sample_index, K, round(pH, 6) AS "pH" FROM targets UNION ALL
           SELECT o_orderkey, 0.0, 0.0 FROM orders WHERE o_orderkey NOT IN (SELECT sample_index FROM targets)""",
    ),
)
def u03(t):
    known = v.targets(t).select("sample_index", "K", "pH")
    rest = t.orders.select(F.col("o_orderkey").alias("sample_index")).join(known, "sample_index", "left_anti")
    return rounded(pr.with_unlabelled(known, rest, ["K", "pH"]), 6, "pH")


@query("u04_distinct_ids", "SELECT DISTINCT l_orderkey AS sample_index FROM lineitem")
def u04(t):
    return pr.distinct_ids(t.lineitem.withColumnRenamed("l_orderkey", "sample_index"))


@query(
    "j08_size_bucket",
    oracle(
        "targets",
        "SELECT sample_index, K, CASE "
        + " ".join(
            f"WHEN K > {lo} AND K <= {hi} THEN '{label}'" for lo, hi, label in zip(SIZE_EDGES, SIZE_EDGES[1:], SIZE_LABELS)
        )
        + " END AS bucket FROM targets",
    ),
)
def j08(t):
    return pr.bucket(v.targets(t).select("sample_index", "K"), "K", SIZE_EDGES, SIZE_LABELS)
