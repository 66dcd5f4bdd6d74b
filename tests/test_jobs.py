"""Folds, scores, augmentation, models, files and registration."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandweave import TARGETS
from bandweave.functions import text as tx
from bandweave.operators import augment, folds, models, reports, scores
from bandweave.sources import cubes, tables


def targets(spark, n=60):
    rng = np.random.default_rng(1)
    rows = [(i, *[float(v) for v in rng.random(4) * 100 + 1], [float(v) for v in rng.random(3)], float(rng.integers(1, 30))) for i in range(n)]
    return spark.createDataFrame(rows, "sample_index bigint, P double, K double, Mg double, pH double, curve array<double>, edge double")


def test_kfold_sizes(spark):
    got = folds.kfold(spark.range(53).withColumnRenamed("id", "sample_index"), 5, 42).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in got) == [10, 10, 11, 11, 11]
    assert {r["fold"] for r in got} == set(range(5))


def test_stratified_and_grouped_folds(spark):
    df = spark.range(90).select(F.col("id").alias("sample_index"), F.when(F.col("id") < 60, 0).otherwise(1).alias("label"))
    by = folds.stratified_kfold(df, "label", 3, 1).groupBy("label", "fold").count().collect()
    assert {(r["label"], r["count"]) for r in by} == {(0, 20), (1, 10)}
    rows = df.withColumn("g", F.col("sample_index") % 20)
    kept = folds.grouped_kfold(rows, "g", 3, 0.1, 7).collect()
    assert len(kept) == 90
    for g in range(20):
        assert len({(r["held_out"], r["fold"]) for r in kept if r["g"] == g}) == 1
    assert len({r["g"] for r in kept if r["held_out"]}) == 2


def test_fill_batches_repeats_the_head(spark):
    got = folds.fill_batches(spark.range(50).withColumnRenamed("id", "sample_index"), 16, 3).collect()
    assert len(got) == 64
    at = {r["pos"]: r["sample_index"] for r in got}
    assert [at[50 + i] for i in range(14)] == [at[i] for i in range(14)]


def test_baseline_scores_one(spark):
    df = targets(spark)
    base = scores.baseline_fit(df)
    ev = df.withColumns({f"{c}_base": base.select(c).scalar() for c in TARGETS})
    ev = ev.withColumns({f"{c}_hat": F.col(f"{c}_base") for c in TARGETS})
    got = {r["target"]: r["score"] for r in scores.relative_score(ev).collect()}
    assert got == {t: pytest.approx(1.0) for t in (*TARGETS, "all")}
    assert scores.r2(ev).first()["mean"] == pytest.approx(0.0)


def test_early_stop(spark):
    log = [(1, e, s, 1) for e, s in enumerate([5.0, 4.0, 4.5, 4.6, 4.7, 1.0])] + [(2, 0, 3.0, 1), (2, 1, 2.0, 1)]
    df = spark.createDataFrame(log, "run int, epoch int, score double, n int")
    got = {r["run"]: (r["stop_epoch"], r["best_epoch"], r["best_score"]) for r in scores.early_stop(df, 3, block=2).collect()}
    assert got == {1: (4, 1, 4.0), 2: (None, 1, 2.0)}


def test_losses_are_derivatives(spark):
    df = spark.createDataFrame([(1.0, 3.0), (4.0, 2.5)], "P double, P_hat double")
    got = {r["loss"]: r for r in scores.loss_report(df, ["weighted", "cubic", "asymmetric"]).collect()}
    d = np.array([1.0, 4.0]) - np.array([3.0, 2.5])
    assert got["weighted"]["grad"] == pytest.approx((-2 * d).sum())
    assert got["cubic"]["grad"] == pytest.approx((-4 * d**3).sum())
    assert got["asymmetric"]["grad"] == pytest.approx(np.where(d < 0, -100 * d, -2 * d).sum())
    old = scores.loss_report(df, ["cubic"], legacy_sign=True).first()["grad"]
    assert old == pytest.approx((4 * d**3).sum())


def test_roc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.7), (0, 0.2), (0, 0.2)], "truth int, score double")
    got = [(r["threshold"], r["tp"], r["fp"]) for r in reports.roc(df).orderBy(F.desc("threshold")).collect()]
    assert got == [(0.9, 1, 1), (0.7, 2, 1), (0.2, 2, 3)]
    assert reports.equal_error(df).first()["threshold"] == 0.9


def test_histogram_keeps_empty_bins_and_closes_the_right_edge(spark):
    v = [0.0, 0.1, 0.1, 1.0]
    got = [r["n"] for r in reports.histogram(spark.createDataFrame([(x,) for x in v], "v double"), "v", 4).orderBy("bin").collect()]
    assert got == np.histogram(v, 4)[0].tolist()


def test_crops_stay_inside_and_pass_the_mask_test(spark):
    rows = []
    for key, (h, w) in {1: (5, 6), 2: (2, 7)}.items():
        for b in range(2):
            rows += [(key, b, x, y, float(x * 10 + y), x == 0) for x in range(h) for y in range(w)]
    df = spark.createDataFrame(rows, "sample_index bigint, band int, x bigint, y bigint, value double, masked boolean")
    got = augment.crop_augment(df, 3, 10, 4, 5).collect()
    for draw in range(4):
        one = [r for r in got if r["sample_index"] == 1 and r["draw"] == draw]
        if one[0]["attempt"] < 10:
            assert len(one) == 18 and not any(r["masked"] for r in one)
        two = [r for r in got if r["sample_index"] == 2 and r["draw"] == draw]
        assert len(two) == 2 * 2 * 2  # shorter edge


def test_select_pixels_repeats_short_fields(spark):
    df = spark.createDataFrame([(1, p) for p in range(3)] + [(2, p) for p in range(40)], "sample_index bigint, px bigint")
    got = augment.select_pixels(df, 4, 2, 9).collect()
    short = [r for r in got if r["sample_index"] == 1]
    full = [r for r in got if r["sample_index"] == 2]
    assert len(short) == len(full) == 8
    assert all(r["repeated"] for r in short) and not any(r["repeated"] for r in full)
    assert len({r["px"] for r in full}) == 8


def test_mixing_adds_rows(spark):
    df = targets(spark)
    mixed = augment.mix_rows(df, 0.25, 0.3, 1)
    assert mixed.count() == 75
    assert mixed.where("draw IS NOT NULL").where(F.size("curve") == 3).count() == 15


def test_oversampling_adds_only_marked_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.random(3)], float(v)) for i, v in enumerate(np.r_[rng.normal(size=80), rng.normal(30, 1, 12)])]
    df = spark.createDataFrame(rows, "sample_index bigint, curve array<double>, y double")
    got = augment.oversample_rare(df, "y", 3, 4).collect()
    assert sum(not r["synthetic"] for r in got) == 92
    new = [r for r in got if r["synthetic"]]
    assert len(new) >= 12 and all(r["y"] > 20 or r["y"] < -1.5 for r in new)  # both ends may be rare


def test_hybrid_predicts_every_row_once(spark):
    df = models.as_vector(targets(spark), "curve")
    train, test = df.where("sample_index >= 20"), df.where("sample_index < 20")
    got = models.hybrid_predict(train, test, limit=11, k=5, trees=3, depth=3, seed=1).collect()
    assert sorted(r["sample_index"] for r in got) == list(range(20))
    assert {r["model"] for r in got} == {"neighbors", "forest"}


def test_saved_forest_predicts_the_same(spark, tmp_path):
    from pyspark.ml.regression import RandomForestRegressionModel

    df = models.as_vector(targets(spark), "curve")
    model = models.fit_forest(df, ["K"], trees=3, depth=3, seed=1)["K"]
    models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(RandomForestRegressionModel, str(tmp_path / "m"))
    key = lambda m: [r["K_hat"] for r in m.transform(df).orderBy("sample_index").collect()]
    assert key(model) == key(again)


def test_cube_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    cubes_in = {}
    for key in (3, 12):
        data, mask = rng.random((4, 2, key % 4 + 1)), rng.random((4, 2, key % 4 + 1)) < 0.5
        np.savez(tmp_path / f"{key}.npz", data=data, mask=mask)
        cubes_in[key] = (data, mask)
    got = cubes.ingest_cubes(spark, str(tmp_path)).collect()
    assert len(got) == sum(d.size for d, _ in cubes_in.values())
    for r in got:
        data, mask = cubes_in[r["sample_index"]]
        assert data[r["band"], r["x"], r["y"]] == r["value"] and mask[r["band"], r["x"], r["y"]] == r["masked"]


def test_class_folder(spark, tmp_path):
    for name in ("cat/1.jpg", "ant/2.jpg", "cat/3.jpg"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x")
    got = {(os.path.basename(r["path"]), r["class"], r["label"]) for r in cubes.scan_class_folder(spark, str(tmp_path)).collect()}
    assert got == {("1.jpg", "cat", 1), ("2.jpg", "ant", 0), ("3.jpg", "cat", 1)}


def test_submission_single_file_and_log(spark, tmp_path):
    df = targets(spark, 9)
    path = str(tmp_path / "sub")
    tables.write_submission(df, path, single_file=True)
    parts = [f for f in os.listdir(path) if f.endswith(".csv")]
    assert len(parts) == 1
    lines = open(os.path.join(path, parts[0])).read().split()
    assert lines[0] == "sample_index,P,K,Mg,pH" and [x.split(",")[0] for x in lines[1:]] == [str(i) for i in range(9)]
    assert tables.read_targets(spark, path).count() == 9
    for _ in range(2):
        tables.append_log(df.select("sample_index"), str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 18


def test_cached_reads_the_first_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.cached(spark.range(3), path).count() == 3
    assert tables.cached(spark.range(9), path).count() == 3


def test_text_functions(spark):
    df = spark.createDataFrame([("  A&amp;amp;B \n\tc&nbsp;D ",)], "s string")
    assert df.select(tx.clean_text(F.col("s"))).first()[0] == "a&b c d"
    toks = spark.createDataFrame([("It's 42 <|endoftext|>!?",)], "s string").select(tx.pretokens(F.col("s"))).first()[0]
    assert toks == ["It", "'s", "4", "2", "<|endoftext|>", "!?"]
    name = "XGB_SIMPLE_ix=[2]_202204250734_nest=729_maxd=12_minsl=5.bin"
    row = spark.createDataFrame([(name,)], "s string").select(*[c.alias(k) for k, c in tx.parse_artefact(F.col("s")).items()]).first()
    assert (row["target"], row["trees"], row["depth"], row["leaf"], row["label"]) == (2, 729, 12, 5, "nest=729_maxd=12_minsl=5")


def test_every_oracle_has_its_query():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 140
