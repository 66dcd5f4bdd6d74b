import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from bandweave import TARGET_MAXIMA, TARGETS
from bandweave.operators import hybrid
from bandweave.operators.folds import kfold
from bandweave.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(60):
        crop, small = i >= 40, i % 3 > 0
        x = rng.standard_normal(4).tolist()
        data.append((i if not crop else -i - 1, 2.0 if small else 9.0, crop, x, x, *rng.random(4).tolist()))
    return spark.createDataFrame(data, "sample_index bigint, edge double, crop boolean, near_features array<double>, forest_features array<double>, P double, K double, Mg double, pH double").cache()


def brute_near(rows, train, k, folds, seed, limit):
    """Robust scaling on small originals, inverse-distance means of k neighbours, averaged over folds."""
    small = [r for r in rows if r["edge"] <= limit and not r["crop"]]
    q = np.percentile([r["near_features"] for r in small], [25, 50, 75], axis=0)
    scaled = {r["sample_index"]: (np.array(r["near_features"]) - q[1]) / (q[2] - q[0]) for r in rows}
    fold = {r["sample_index"]: r["fold"] for r in kfold(train, folds, seed).collect()}
    known = [[r for r in rows if (r["edge"] <= limit) != r["crop"] and (r["crop"] or fold[r["sample_index"]] != f)] for f in range(folds)]
    out = {}
    for r in rows:
        if r["edge"] > limit:
            continue
        means = []
        for some in known:
            d = np.array([np.linalg.norm(scaled[r["sample_index"]] - scaled[o["sample_index"]]) for o in some])
            at = np.lexsort(([o["sample_index"] for o in some], np.round(d, 9)))[:k]
            y = np.array([[some[j][c] for c in TARGETS] for j in at])
            means.append(y[d[at] == 0].mean(0) if (d[at] == 0).any() else (y / d[at][:, None]).sum(0) / (1 / d[at]).sum())
        out[r["sample_index"]] = np.mean(means, 0) * [TARGET_MAXIMA[c] for c in TARGETS]
    return out


def test_pipeline_is_the_same_after_loading(spark, rows, tmp_path):
    fitted = hybrid.pipeline(limit=2.0, k=5, folds=3, trees=3, depth=3, seed=7).fit(rows)
    before = {r["sample_index"]: r for r in fitted.transform(rows).collect()}
    fitted.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    predicted = loaded.transform(rows)
    got = {r["sample_index"]: r for r in predicted.collect()}
    assert got.keys() == before.keys() and len(got) == 60
    local = rows.collect()
    want = brute_near(local, rows.where("not crop and edge <= 2"), 5, 3, 7, 2.0)
    for r in local:
        i = r["sample_index"]
        values = [got[i][f"{c}_hat"] for c in TARGETS]
        np.testing.assert_allclose(values, [before[i][f"{c}_hat"] for c in TARGETS], rtol=1e-12)  # sums run in any order
        assert got[i]["model"] == ("neighbors" if r["edge"] <= 2 else "forest")
        if r["edge"] <= 2:
            np.testing.assert_allclose(values, want[i], rtol=1e-9)
        else:
            y = np.array([[o[c] for c in TARGETS] for o in local])
            scaled = np.array(values) / [TARGET_MAXIMA[c] for c in TARGETS]
            assert (scaled >= y.min(0)).all() and (scaled <= y.max(0)).all()
    tables.write_submission(predicted.select("sample_index", *[F.col(f"{c}_hat").alias(c) for c in TARGETS]), str(tmp_path / "out"))
    back = {r["sample_index"]: r for r in tables.read_submission(spark, str(tmp_path / "out")).collect()}
    assert back.keys() == got.keys()
    assert back[1]["Mg"] == pytest.approx(got[1]["Mg_hat"])


def test_null_features_empty_input_and_no_small_field(spark, rows):
    fitted = hybrid.pipeline(limit=2.0, k=3, folds=1, trees=1, depth=2).fit(rows)
    odd = rows.limit(2).withColumns({"near_features": F.lit(None).cast("array<double>"), "forest_features": F.lit(None).cast("array<double>"), "model": F.lit("old"), "P_hat": F.lit(1.0)})
    out = fitted.transform(odd).collect()
    assert len(out) == 2 and all(r["P_hat"] is None and r["model"] in ("neighbors", "forest") for r in out)
    assert fitted.transform(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        hybrid.pipeline(limit=1.0).fit(rows)


def test_training_rows_hold_fields_and_crops(spark):
    rng = np.random.default_rng(5)
    pixels = [(s, b, x * 4 + y, x, y, float(rng.random() * 2000), False) for s in (1, 2) for b in range(150) for x in range(4) for y in range(4)]
    df = spark.createDataFrame(pixels, "sample_index bigint, band int, px bigint, x bigint, y bigint, value double, masked boolean")
    targets = spark.createDataFrame([(1, 0.1, 0.2, 0.3, 0.4), (2, 0.5, 0.6, 0.7, 0.8)], "sample_index bigint, P double, K double, Mg double, pH double")
    got = {r["sample_index"]: r for r in hybrid.training_rows(df, targets, draws=2, edge=2).collect()}
    assert set(got) == {1, 2, -3, -4, -5, -6}
    for i, r in got.items():
        of = i if i > 0 else (-i - 1) // 2
        assert r["crop"] == (i < 0) and r["edge"] == 4.0
        assert r["K"] == pytest.approx(0.2 if of == 1 else 0.6, rel=0.0011)
        assert len(r["near_features"]) == 11 * 150 and len(r["forest_features"]) == len(got[1]["forest_features"])


def test_pixels_of_named_fields_read_their_lines_once(spark, tmp_path):
    """Places in the field are those among all fields, and the lines of other fields are not ranked; null and repeated names do no harm."""
    from bandweave.plans import views
    from bandweave.plans.registry import Tables

    lines = [(k, line, 100 - line, 1, float(line), 2.0, 0.1, 0.0, "R" if line % 3 else "N") for k in range(30) for line in range(1 + k % 7)]
    lines.append((None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "R"))
    schema = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    of = spark.createDataFrame([(6,), (6,), (13,), (None,), (999,)], "sample_index bigint")
    some = views.pixel_rows(t, of=of)
    assert not any("lineitem" in name for name in some.inputFiles())
    want = views.pixel_rows(t).where("sample_index in (6, 13)")
    assert sorted(map(str, some.collect())) == sorted(map(str, want.collect())) and some.count() == 14
