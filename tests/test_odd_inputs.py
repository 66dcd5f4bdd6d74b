"""Null keys, empty spans, zero norms, one class, undefined vectors, repeated saves."""

import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandweave.functions import arrays as ar
from bandweave.functions import text as tx
from bandweave.operators import augment, density, folds, neighbors, pixels, ranks, reports, scores
from bandweave.sources import tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_null_groups_and_orders_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "a")], "sample_index long, label string")
    assert folds.stratified_kfold(df, "label", 2, 1).count() == 4
    log = spark.createDataFrame([(1, 0, 1.0, 2), (1, None, 3.0, 2), (None, 0, 5.0, 1)], "run long, epoch long, score double, n long")
    assert scores.running_weighted_mean(log, "score", "n", ["run"], "epoch").count() == 3
    got = {r["g"]: r["q"] for r in ranks.exact_quantiles(spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, v double"), ["g"], "v", [0.5]).collect()}
    assert got == {None: [2.0], "a": [2.0]}


def test_spans_and_norms_of_nothing(spark):
    one = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, v double")
    bins = reports.histogram(one, "v", 4).orderBy("bin").collect()
    assert (bins[0]["left"], bins[-1]["right"], sum(r["n"] for r in bins)) == (4.5, 5.5, 2)
    assert reports.hexbin(one.withColumn("w", F.lit(1.0)), "v", "w", 3, 3).agg(F.sum("n")).first()[0] == 2
    assert {r["weight"] for r in density.density_weight(one, "v", key="id").collect()} == {1.0}
    assert {r["relevance"] for r in augment.relevance(one, "v").collect()} == {0.0}
    unit = one.select(F.array(F.lit(0.0), F.lit(0.0)).alias("a")).select(ar.l2_normalize("a").alias("u"))
    assert unit.first()["u"] == [0.0, 0.0]
    zero = spark.createDataFrame([(1, 0, 0, 0, 0, 0.0, False)], "sample_index long, px long, x long, y long, band int, value double, masked boolean")
    row = pixels.band_stats(zero).first()
    assert row["max"] == 0.0 and row["mean"] is None
    truth = spark.createDataFrame([(1, 0.2), (1, 0.7)], "truth int, score double")
    assert {r["fpr"] for r in reports.roc(truth).collect()} == {None}


def test_curves_with_missing_values_have_no_transform(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, [1.0, None, 2.0]), (4, [1.0, math.nan, 2.0]), (5, [4.0, 4.0, 4.0])], "id long, curve array<double>")
    for fn in (ar.dft, ar.dct, ar.dwt("sym3"), ar.dwt_cascade("sym3")):
        got = {r["id"]: r["z"] for r in df.select("id", fn("curve").alias("z")).collect()}
        assert [k for k in sorted(got) if got[k] is None] == [2, 3, 4]
    np.testing.assert_allclose(df.where("id = 5").select(ar.dct("curve").alias("z")).first()["z"], [24.0, 0.0, 0.0], atol=1e-12)


def test_an_undefined_vector_is_refused(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [math.nan, 1.0])], "sample_index long, curve array<double>")
    with pytest.raises(Exception, match="undefined value"):
        neighbors.knn_join(df, df, 1).collect()


def test_last_batch_is_filled(spark):
    df = spark.range(5).withColumnRenamed("id", "sample_index")
    got = folds.fill_batches(df, 4, 1).collect()
    assert sorted(r["pos"] for r in got) == list(range(8)) and {r["sample_index"] for r in got} == set(range(5))
    assert sorted(r["pos"] for r in folds.fill_batches(df, 16, 1).collect()) == list(range(16))
    assert folds.contrastive_pairs(df, 4, 1).count() == 8


def test_long_labels_are_whole(spark):
    name = "A_b_c_d_" + "_".join(str(i) for i in range(1500))
    got = spark.createDataFrame([(name,)], "n string").select(tx.parse_artefact(F.col("n"))["label"].alias("l")).first()["l"]
    assert got == name[8:]


def test_saving_again_replaces_and_schemas_are_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "sample_index long, P double")
    for run in ("a", "b", "a"):
        tables.save_eval(df, str(tmp_path / "eval"), "forest", run)
    assert spark.read.parquet(str(tmp_path / "eval")).count() == 2
    tables.cached(df, str(tmp_path / "cache"))
    with pytest.raises(ValueError, match="holds"):
        tables.cached(df.withColumnRenamed("P", "K"), str(tmp_path / "cache"))
    log = str(tmp_path / "log")
    tables.append_log(df, log)
    tables.append_log(df.select("P", "sample_index"), log)
    rows = spark.read.option("header", True).csv(log).collect()
    assert {(r["sample_index"], r["P"]) for r in rows} == {("1", "2.0")} and len(rows) == 2
    with pytest.raises(ValueError, match="columns"):
        tables.append_log(df.withColumn("more", F.lit(1)), log)


def test_queries_run_from_another_folder(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "from bandweave.session import local_session\n"
        "import __spark_entry__ as e\n"
        "s = local_session(2)\n"
        "print('rows', e.queries()['f11_dft'](s, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "rows " in done.stdout, done.stderr[-2000:]
