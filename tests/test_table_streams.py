"""Given tables as streams: one file or a folder of files."""

import numpy as np
import pytest

from bandweave.plans import load_all
from bandweave.plans.registry import QUERIES

load_all()


@pytest.mark.parametrize("query, name", [("st1_novelty_stream", "embeddings"), ("st2_metric_stream", "events")])
def test_stream_reads_folders_as_it_reads_files(spark, tmp_path, query, name):
    rng = np.random.default_rng(5)
    if name == "embeddings":
        rows = [(i, rng.standard_normal(4).tolist(), i % 10) for i in range(200)]
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    else:
        rows = [(i, f"2024-01-{1 + i // 10:02d} {i % 24:02d}:00:00", "ab"[i % 2], float(i), "x" * (1 + i % 3)) for i in range(200)]
        df = spark.createDataFrame(rows, "event_id bigint, ts string, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "event_type", "value", "props")
    df.repartition(3).write.parquet(str(tmp_path / "folder" / f"{name}.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "file" / f"{name}.parquet")
    got = [sorted(map(tuple, QUERIES[query](spark, str(tmp_path / kind)).collect())) for kind in ("file", "folder")]
    assert got[0] and got[0] == got[1]
