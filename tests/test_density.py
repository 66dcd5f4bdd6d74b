"""Kernel densities: what may be broadcast, and tables of more cells than may."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandweave.operators import density


def values(spark):
    return spark.range(300).select(F.col("id").alias("sample_index"), ((F.col("id") * 37) % 101 + F.col("id") / 300).alias("v"))


@pytest.mark.parametrize("most", [2, 16_384])
@pytest.mark.parametrize("by", ["position", "value"])
def test_points_are_not_broadcast_and_weights_hold(spark, monkeypatch, by, most):
    monkeypatch.setattr(density, "MOST_CELLS", most)
    seen = []
    write = density.materialize

    def written(df, name="stage"):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(density, "materialize", written)
    df = write(values(spark))
    got = density.density_weight(df, "v", by=by, bandwidth=2.0).orderBy("sample_index").toPandas()
    v = got["v"].to_numpy()
    at = np.linspace(v.min(), v.max(), len(v)) if by == "position" else v
    d = np.exp(-0.5 * ((at[:, None] - v[None]) / 2.0) ** 2).sum(1)
    w = np.maximum(1 - (d - d.min()) / (d.max() - d.min()), 1e-4)
    np.testing.assert_allclose(got["weight"], w / w.mean(), rtol=1e-9)
    near = dict(seen)["densities"]
    assert "Inner, BuildLeft" not in near  # the points times their cells, which were built on the left
