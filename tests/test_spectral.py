"""Array transforms, profiles, density and scalers against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandweave.functions import arrays as ar
from bandweave.functions import wavelets as wl
from bandweave.operators import density, features, pixels, reshape
from bandweave.operators import features as fe
from bandweave.operators.scaling import Scaler

PIXELS = "sample_index bigint, band int, x bigint, y bigint, value double, masked boolean"


def curves(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "sample_index bigint, curve array<double>")


def cube_rows(key, cube, mask):
    return [(key, int(b), int(x), int(y), float(cube[b, x, y]), bool(mask[b, x, y])) for b, x, y in np.ndindex(cube.shape)]


def test_gradient_dft_dct(spark):
    rng = np.random.default_rng(0)
    rows = [rng.normal(size=n) for n in (12, 12, 7, 2, 1)]
    df = curves(spark, rows)
    got = {r["sample_index"]: r for r in df.select("*", ar.gradient("curve").alias("g"), ar.dft("curve").alias("z")).collect()}
    for i, x in enumerate(rows):
        want = np.gradient(x) if len(x) > 1 else np.zeros(1)
        np.testing.assert_allclose(got[i]["g"], want, atol=1e-12)
        z = np.fft.fft(x)
        np.testing.assert_allclose(got[i]["z"]["re"], z.real, atol=1e-12)
        np.testing.assert_allclose(got[i]["z"]["im"], z.imag, atol=1e-12)


def test_constant_curve_has_no_slope_and_impulse_a_flat_spectrum(spark):
    df = curves(spark, [np.ones(9), np.eye(1, 9)[0]])
    got = df.select(ar.gradient("curve").alias("g"), ar.dft("curve").alias("z")).collect()
    assert set(got[0]["g"]) == {0.0}
    np.testing.assert_allclose(got[1]["z"]["re"], np.ones(9), atol=1e-12)


def test_wavelet_taps_and_lengths():
    for name, size in (("sym3", 6), ("dmey", 62)):
        low = wl.TAPS[name]
        assert len(low) == size
        assert low.sum() == pytest.approx(np.sqrt(2))
        assert wl.high_of(low).sum() == pytest.approx(0.0, abs=1e-4)
        assert (low**2).sum() == pytest.approx(1.0, abs=1e-5)
    approx, detail = wl.cascade(np.ones((1, 150)), "sym3")
    assert approx.shape == (1, 150) and detail.shape == (1, 150)
    np.testing.assert_allclose(detail, 0.0, atol=1e-9)
    assert wl.cascade(np.ones((1, 150)), "dmey")[0].shape == (1, 150)


@pytest.mark.parametrize("limits", [(1024, 1_000_000), (4, 1_000_000), (4, 6)])
def test_singular_profile_by_every_route(spark, monkeypatch, limits):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(fe, "LIST_PIXELS", limits[0])
    monkeypatch.setattr(fe, "CHUNK_PIXELS", limits[1])
    shapes = {1: (2, 2), 2: (3, 5), 3: (6, 4), 4: (1, 1), 5: (1, 23), 6: (31, 2)}
    rows, want = [], {}
    for key, (h, w) in shapes.items():
        cube, mask = rng.normal(size=(2, h, w)), rng.random((2, h, w)) < 0.2
        rows += cube_rows(key, cube, mask)
        edge = max(h, w)
        for b in range(2):
            image = np.where(mask[b], 0.0, cube[b])
            padded = np.pad(image, ((0, edge - h), (0, edge - w)), "wrap")
            s = np.zeros(5)
            sv = np.linalg.svd(padded, compute_uv=False)[:5]
            s[: len(sv)] = sv
            want[key, b] = s
    df = spark.createDataFrame(rows, PIXELS)
    got = {(r["sample_index"], r["band"]): r["sigma"] for r in fe.singular_profile(df).collect()}
    assert got.keys() == want.keys()
    for key, s in want.items():
        np.testing.assert_allclose(got[key], s, atol=1e-9)


def test_singular_profile_of_a_long_strip(spark):
    """One row of 100,000 pixels: the wrapped square has a single singular value, the row's length times the root of its repeats."""
    df = spark.range(100_000).selectExpr("1L as sample_index", "0 as band", "id as px", "0L as x", "id as y", "double(id % 7) as value", "false as masked")
    sigma = fe.singular_profile(df).first()["sigma"]
    want = np.sqrt(sum((i % 7) ** 2 for i in range(100_000)) * 100_000.0)
    np.testing.assert_allclose(sigma, [want, 0, 0, 0, 0], rtol=1e-12)


def test_features_have_the_layout(spark):
    rng = np.random.default_rng(4)
    cube, mask = rng.random((150, 3, 4)) * 2210, np.zeros((150, 3, 4), bool)
    mask[:, 0, 0] = True
    df = spark.createDataFrame(cube_rows(9, cube, mask), PIXELS)
    row = fe.features(df, "forest").first()
    assert [len(row[b]) for b in fe.BLOCKS["forest"]] == [150] * 16
    mean = np.ma.MaskedArray(cube / 2210, mask).mean(axis=(1, 2)).data
    np.testing.assert_allclose(row["arr"], mean, atol=1e-12)
    np.testing.assert_allclose(row["d3"], np.gradient(np.gradient(np.gradient(mean))), atol=1e-12)
    np.testing.assert_allclose(row["re_s0"], np.fft.fft(row["s0"]).real, atol=1e-9)


def test_fully_masked_field_has_null_curve(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 5.0, True), (2, 0, 0, 0, 5.0, False)], PIXELS)
    got = {r["sample_index"]: r["v"] for r in pixels.curve(df).collect()}
    assert got == {1: None, 2: 5.0}


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_rotation_flip_and_padding(spark, k):
    cube = np.arange(12.0).reshape(1, 3, 4)
    df = spark.createDataFrame(cube_rows(1, cube, np.zeros(cube.shape, bool)), PIXELS)

    def image(out):
        rows = out.collect()
        a = np.full((max(r["x"] for r in rows) + 1, max(r["y"] for r in rows) + 1), np.nan)
        for r in rows:
            a[r["x"], r["y"]] = r["value"]
        return a

    np.testing.assert_array_equal(image(reshape.rotate90(df, k)), np.rot90(cube[0], k))
    np.testing.assert_array_equal(image(reshape.flip(df, "y")), cube[0][:, ::-1])
    np.testing.assert_array_equal(image(reshape.pad_square(df, "wrap", 9)), np.pad(cube[0], ((0, 6), (0, 5)), "wrap"))
    np.testing.assert_array_equal(image(reshape.pad_square(df, "zero", 6)), np.pad(cube[0], ((0, 3), (0, 2))))
    at = lambda side, n: np.arange(side) * n // side
    np.testing.assert_array_equal(image(reshape.resize_nearest(df, 5)), cube[0][at(5, 3)][:, at(5, 4)])


def test_flatten_wrap_is_the_padded_column_major_field(spark):
    cube, mask = np.arange(12.0).reshape(2, 2, 3), np.zeros((2, 2, 3), bool)
    mask[:, 1, 1] = True
    df = spark.createDataFrame(cube_rows(1, cube, mask), PIXELS)
    got = [r["value"] for r in reshape.flatten_wrap(df, 40).orderBy("pos").collect()]
    flat = cube.flatten("F")[~mask.flatten("F")]
    np.testing.assert_array_equal(got, np.pad(flat, (5, 40 - len(flat) - 5), "wrap"))


def test_density_matches_the_direct_sum(spark):
    rng = np.random.default_rng(6)
    v = np.r_[rng.normal(size=300), rng.normal(40, 9, size=100), np.full(100, 3.0)]
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "sample_index bigint, v double")
    for h in (0.3, 1.0, 30.0):
        got = density.kde(df, "v", h, 40).orderBy("point").collect()
        at = np.linspace(v.min(), v.max(), 40)
        want = np.exp(-0.5 * ((at[:, None] - v[None, :]) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
        np.testing.assert_allclose([r["density"] for r in got], want, rtol=1e-9, atol=1e-13)


def test_scalers(spark):
    rng = np.random.default_rng(8)
    x = np.c_[rng.normal(size=200), np.full(200, 4.0), rng.exponential(size=200) + 0.1]
    long = spark.createDataFrame([(i, j, float(x[i, j])) for i, j in np.ndindex(x.shape)], "sample_index bigint, feature int, v double")

    def table(df, c):
        a = np.full(x.shape, np.nan)
        for r in df.collect():
            a[r["sample_index"], r["feature"]] = r[c]
        return a

    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    iqr = np.where(q3 == q1, 1.0, q3 - q1)
    robust = Scaler("robust").fit(long)
    np.testing.assert_allclose(table(robust.transform(long), "t"), (x - q2) / iqr, atol=1e-10)
    for kind in ("robust", "minmax", "yeo_johnson", "quantile"):
        s = Scaler(kind, quantiles=100).fit(long)
        t = s.transform(long)
        back = table(s.inverse(t, "t", "back"), "back")
        inner = (x > x.min(0)) & (x < x.max(0))
        np.testing.assert_allclose(back[inner], x[inner], atol=1e-6)
        if kind == "yeo_johnson":
            assert abs(table(t, "t")[:, 2].mean()) < 1e-9
            assert table(t, "t")[:, 2].std() == pytest.approx(1.0)


@pytest.mark.parametrize("limits", [(1024, 1_000_000), (4, 1_000_000), (4, 6)])
def test_features_of_bands_side_by_side(spark, monkeypatch, limits):
    """The same values as from a row for each band, by every route; null values, masks and fields without a mean included."""
    monkeypatch.setattr(fe, "LIST_PIXELS", limits[0])
    monkeypatch.setattr(fe, "CHUNK_PIXELS", limits[1])
    rng = np.random.default_rng(3)
    wide = []
    for key, (h, w) in {1: (2, 2), 2: (3, 5), 3: (1, 9), 4: (1, 1), None: (2, 2)}.items():
        for x, y in np.ndindex(h, w):
            mask = True if key == 4 else [False, False, True, None][int(rng.integers(4))]
            values = [float(v) for v in rng.normal(size=3)]
            if key == 1 and x == 0:
                values[1] = None
            wide.append((key, x * w + y, x, y, mask, values))
    rows = spark.createDataFrame(wide, "sample_index bigint, px bigint, x bigint, y bigint, masked boolean, bands array<double>")
    long = pixels.by_band(rows)
    one, two = ({(r["sample_index"], r["band"]): r["sigma"] for r in fe.singular_profile(x).collect()} for x in (rows, long))
    assert one.keys() == two.keys() and len(one) == 12
    for key, sigma in one.items():
        np.testing.assert_allclose(sigma, two[key], atol=1e-9)
    one, two = ({r["sample_index"]: r for r in fe.features(x, "knn").collect()} for x in (rows, long))
    assert one.keys() == two.keys() == {1, 2, 3, 4}
    for key, row in one.items():
        for block in fe.BLOCKS["knn"]:
            np.testing.assert_allclose(row[block], two[key][block], atol=1e-9)


def test_a_profile_of_rows_that_lie_by_field_needs_no_shuffle(spark):
    rows = spark.createDataFrame([(k, x, 0, False, [1.0 + k, 2.0 * x]) for k in range(20) for x in range(3)], "sample_index bigint, x bigint, y bigint, masked boolean, bands array<double>")
    lie = rows.repartition(4, "sample_index")
    plan = fe.singular_profile(lie)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_bands_of_a_field_stay_on_the_shuffle_that_gathers_it(spark):
    rows = [(s, i, i // 2, i % 2, i == 3, [float(s + i), float(i), 0.0, None if i == 1 else 0.5]) for s in range(3) for i in range(4)]
    pixels = spark.createDataFrame(rows, "sample_index long, px long, x long, y long, masked boolean, bands array<double>")
    wide = fe.features(pixels, "tuned")
    assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    long = fe.features(pixels.select("sample_index", "px", "x", "y", "masked", F.posexplode("bands").alias("band", "value")), "tuned")
    both = [{r["sample_index"]: r for r in x.collect()} for x in (wide, long)]
    assert both[0].keys() == both[1].keys() == {0, 1, 2}
    for s, row in both[0].items():
        for c in fe.BLOCKS["tuned"]:
            a, b = (np.array([np.nan if x is None else x for x in r[c]]) for r in (row, both[1][s]))
            assert np.allclose(a, b, equal_nan=True), (s, c)
