"""Registered queries: sources, sinks and streams, each fed from the given tables."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from bandweave import TARGETS
from bandweave.functions.arrow import as_matrix
from bandweave.operators import models as mo
from bandweave.operators import pixels as px
from bandweave.operators import projections as pr
from bandweave.plans import views as v
from bandweave.plans.learning import KNOWN, LOF, NOVEL, scored_curves
from bandweave.plans.pixels import rounded
from bandweave.plans.registry import query
from bandweave.plans.views import oracle
from bandweave.session import scratch_path
from bandweave.sources import cubes, tables
from bandweave.streaming import jobs


@F.arrow_udf(BinaryType())
def npz_bytes(column: pa.Array) -> pa.Array:
    """A 64-element vector as a cube of 16 bands and 2 x 2 pixels, negative values masked."""
    files = []
    for row in as_matrix(column):
        cube = row.reshape(16, 2, 2)
        buffer = io.BytesIO()
        np.savez(buffer, data=cube, mask=cube < 0)
        files.append(buffer.getvalue())
    return pa.array(files, pa.binary())


@query(
    "s01_ingest_cubes",
    oracle(
        "curves",
        """SELECT sample_index, CAST(i // 4 AS INTEGER) AS band, i % 4 // 2 AS x, i % 2 AS y, curve[i + 1] AS value, curve[i + 1] < 0 AS masked
           FROM curves, range(64) AS r(i)""",
    ),
)
def s01(t):
    path = F.concat(F.lit("/cubes/"), F.col("sample_index").cast("string"), F.lit(".npz"))
    files = v.curves(t).select(path.alias("path"), npz_bytes("curve").alias("content"))
    return cubes.decode_cubes(files)


ROUNDED = "SELECT sample_index, " + ", ".join(f"round({c}, 6) AS {c}" for c in TARGETS) + " FROM targets"


@query("s02_read_targets", oracle("targets", ROUNDED))
def s02(t):
    path = scratch_path(t.spark, "targets-csv")
    v.targets(t).write.option("header", True).csv(path)
    return rounded(tables.read_targets(t.spark, path), 6, *TARGETS)


@query(
    "s03_read_wavelengths",
    oracle("wavelengths curve_long", "SELECT band_no, round(wavelength, 6) AS wavelength, round(avg(v), 9) AS mean FROM wavelengths JOIN curve_long ON band = band_no - 1 GROUP BY ALL"),
)
def s03(t):
    path = scratch_path(t.spark, "wavelengths-csv")
    v.wavelengths(t).write.option("header", True).csv(path)
    joined = pr.join_wavelengths(v.curve_long(t), tables.read_wavelengths(t.spark, path))
    out = joined.groupBy((F.col("band") + 1).alias("band_no"), "wavelength").agg(F.avg("v").alias("mean"))
    return rounded(rounded(out, 6, "wavelength"), 9, "mean")


@query(
    "s04_scan_class_folder",
    """SELECT 'file:/data/' || lang || '/' || doc_id || '.txt' AS path, lang AS class, (dense_rank() OVER (ORDER BY lang) - 1)::INTEGER AS label
       FROM documents""",
)
def s04(t):
    path = F.concat(F.lit("file:/data/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return cubes.class_labels(t.documents.select(path.alias("path")))


@query(
    "s05_cached",
    oracle(
        "pixels",
        "SELECT p.band, round(avg(value / mx), 9) AS mean, max(mx) AS max FROM pixels p JOIN s USING (band) WHERE NOT masked GROUP BY p.band",
        s="SELECT band, max(value) AS mx FROM pixels WHERE NOT masked GROUP BY band",
    ),
)
def s05(t):
    path = scratch_path(t.spark, "band-stats")
    tables.cached(px.band_stats(v.pixel_values(t)), path)
    again = tables.cached(px.band_stats(v.pixel_values(t)), path)
    return rounded(again.select("band", "mean", "max"), 9, "mean")


@query("s06_write_submission", oracle("targets", ROUNDED))
def s06(t):
    path = scratch_path(t.spark, "submission")
    tables.write_submission(v.targets(t), path)
    return rounded(tables.read_submission(t.spark, path), 6, *TARGETS)


@query(
    "s07_append_log",
    oracle("metric_log", "SELECT run, count(*) * 2 AS n, round(sum(score) * 2, 4) AS total FROM metric_log GROUP BY run"),
)
def s07(t):
    path = scratch_path(t.spark, "log")
    log = v.metric_log(t)
    tables.append_log(log, path)
    tables.append_log(log, path)
    kept = t.spark.read.schema(log.schema).option("header", True).csv(path)
    return rounded(kept.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total")), 4, "total")


@query("s08_save_load_model")
def s08(t):
    rows = scored_curves(t)
    path = scratch_path(t.spark, "model")
    model = mo.fit_forest(rows, ["K"], trees=5, depth=4, seed=3)["K"]
    mo.save_model(model, path)
    loaded = mo.load_model(RandomForestRegressionModel, path)
    before = model.transform(rows).select("sample_index", "K_hat")
    after = loaded.transform(rows).select("sample_index", F.col("K_hat").alias("K_loaded"))
    return before.join(after, "sample_index")


@query(
    "s09_save_eval",
    oracle(
        "evaluation",
        "SELECT 'priority' AS model, run_id::BIGINT AS run_id, sample_index, round(K, 6) AS \"K\", round(K_hat, 6) AS \"K_hat\", round(K_base, 6) AS \"K_base\""
        " FROM evaluation, (SELECT unnest([202201010000, 202201010001]) AS run_id)",
    ),
)
def s09(t):
    path = scratch_path(t.spark, "eval")
    ev = v.evaluation(t).select("sample_index", "K", "K_hat", "K_base")
    for run in ("202201010000", "202201010001"):
        tables.save_eval(ev, path, "priority", run)
    return rounded(t.spark.read.parquet(path), 6, "K", "K_hat", "K_base")


LIMIT = 1.0


def arriving(t, name: str):
    """A given table as a stream, be it one file or a folder of files; the pattern keeps Spark from taking a file for a base folder."""
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.folder}/{name}.parque[t]")


@query("st1_novelty_stream", oracle("curves", f"SELECT sample_index, round(lof, 7) AS lof FROM factor WHERE lof > {LIMIT}", **LOF))
def st1(t):
    rows = v.curves(t)
    new = arriving(t, "embeddings").where(NOVEL).select(F.col("vec_id").alias("sample_index"), F.col("embedding").cast("array<double>").alias("curve"))
    sink, mark = scratch_path(t.spark, "novel"), scratch_path(t.spark, "novel-checkpoint")
    jobs.novelty_stream(new, rows.where(KNOWN), sink, mark, limit=LIMIT).awaitTermination()
    kept = t.spark.read.schema("sample_index bigint, lof double, novel boolean").parquet(sink)
    return rounded(kept.select("sample_index", "lof"), 7, "lof")


@query(
    "st2_metric_stream",
    """SELECT start, event_type, round(sum(value * n) / sum(n), 7) AS average, sum(n)::BIGINT AS count
       FROM (SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, value, length(props) AS n, max(ts) OVER () AS latest FROM events)
       WHERE start + INTERVAL '6 hours' <= latest - INTERVAL '1 day' GROUP BY start, event_type""",
)
def st2(t):
    events = arriving(t, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", F.length("props").cast("bigint").alias("n"))
    sink, mark = scratch_path(t.spark, "metrics"), scratch_path(t.spark, "metrics-checkpoint")
    jobs.metric_stream(events, "6 hours", "1 day", sink, mark, ["event_type"]).awaitTermination()
    schema = "start timestamp, event_type string, average double, count bigint"
    closed = t.spark.read.schema(schema).parquet(sink)
    return rounded(closed.withColumn("start", F.col("start").cast("timestamp_ntz")), 7, "average")
