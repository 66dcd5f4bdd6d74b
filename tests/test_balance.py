import numpy as np
import pytest
from pyspark.sql import functions as F

from bandweave.operators import balance

FIELDS = "sample_index bigint, curve array<double>, P double"


@pytest.mark.parametrize("kind", ["even", "extreme"])
def test_budgets_are_exact_and_bumps_contiguous(spark, kind):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(50, 5, 80), rng.normal(120, 3, 7), [-40.0]])
    df = spark.createDataFrame([(i, [float(x), float(i % 5)], float(x)) for i, x in enumerate(values)], FIELDS)
    bump = {r["sample_index"]: r["bump"] for r in balance.bumps(df, "P").collect()}
    order = [bump[i] for i in np.argsort(values)]
    assert order == sorted(order) and set(order) == {-1, 0, 1}
    n = {b: order.count(b) for b in (-1, 0, 1)}
    weight = {b: 1.0 if kind == "even" else 1 / n[b] for b in n}
    quota = {b: len(values) * weight[b] / sum(weight.values()) for b in n}
    want = {b: int(np.floor(round(q, 9))) for b, q in quota.items()}
    for b in sorted(n, key=lambda b: (want[b] - round(quota[b], 9), b))[: len(values) - sum(want.values())]:
        want[b] += 1
    out = balance.resample(df, "P", k=3, seed=4, kind=kind).collect()
    assert {b: sum(r["bump"] == b for r in out) for b in n} == want and len(out) == len(values)
    own = [r for r in out if not r["synthetic"]]
    assert len({r["sample_index"] for r in own}) == len(own)
    assert all(r["P"] == values[r["sample_index"]] and r["bump"] == bump[r["sample_index"]] for r in own)
    for b in (-1, 1):  # all originals of a rare range stay, and what is added lies about them
        mine = [values[i] for i in bump if bump[i] == b]
        assert sum(r["bump"] == b for r in own) == len(mine)
        reach = 0.15 * np.abs(mine).max()
        assert all(r["synthetic"] and r["sample_index"] is None and min(mine) - reach <= r["P"] <= max(mine) + reach for r in out if r["bump"] == b and r["synthetic"])
    again = balance.resample(df, "P", k=3, seed=4, kind=kind).collect()
    assert sorted(r["P"] for r in again) == sorted(r["P"] for r in out)


def test_flat_empty_and_null_targets(spark):
    flat = spark.createDataFrame([(i, [1.0], 2.0) for i in range(6)], FIELDS)
    assert balance.resample(flat, "P").where("bump = 0 and not synthetic").count() == 6
    assert balance.resample(flat.withColumn("P", F.when(F.col("sample_index") > 0, F.col("P"))), "P").count() == 6
    with pytest.raises(ValueError):
        balance.resample(flat, "P", kind="other")
