"""Boosted trees with each loss against plain recursive trees on the same gradients."""

import numpy as np
import pytest

from bandweave.operators import boosting as bo

NAMES = ["K", "Mg"]
PULLS = {
    "squared": lambda y, p: (p - y, np.ones_like(y)),
    "weighted": lambda y, p: (2 * (p - y), np.full_like(y, 2.0)),
    "cubic": lambda y, p: (4 * (p - y) ** 3, 12 * (p - y) ** 2),
    "asymmetric": lambda y, p: (2 * np.where(p > y, 50.0, 1.0) * (p - y), 2 * np.where(p > y, 50.0, 1.0)),
}


def frame(spark, x, y, w):
    rows = [(i, [float(v) for v in x[i]], *(None if np.isnan(v) else float(v) for v in y[i]), float(w[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "sample_index bigint, features array<double>, K double, Mg double, weight double").repartition(3)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(31)
    x = rng.normal(size=(50, 3))
    x[:, 2] = rng.integers(0, 3, 50)
    y = np.stack([np.where(x[:, 0] > 0.2, 3.0, 1.0) + x[:, 2], 4 * (x[:, 1] > 0) * x[:, 2]], 1) + 0.1 * rng.normal(size=(50, 2))
    y[4, 0] = y[9, 1] = np.nan
    return x, y, rng.integers(1, 4, 50).astype(float)


def plain_step(x, g, h, depth, l2, least_gain, least_weight):
    """What a tree adds to each row, without the step."""
    worth = lambda s: g[s].sum() ** 2 / (h[s].sum() + l2)
    whole, best = np.ones(len(x), bool), None
    for f in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, f])[:-1]:
            right = x[:, f] > cut
            if min(h[right].sum(), h[~right].sum()) >= least_weight:
                gain = worth(right) + worth(~right) - worth(whole)
                if gain > least_gain and (best is None or gain > best[0] + 1e-9):
                    best = (gain, right)
    if best is None:
        return np.full(len(x), -g.sum() / (h.sum() + l2))
    out = np.zeros(len(x))
    for some in (best[1], ~best[1]):
        out[some] = plain_step(x[some], g[some], h[some], depth - 1, l2, least_gain, least_weight)
    return out


@pytest.mark.parametrize(("loss", "rounds", "l2", "least_gain", "least_weight", "refresh"), [("squared", 1, 0.0, 0.0, 1.0, 10), ("weighted", 2, 1.0, 3.0, 5.0, 10), ("cubic", 2, 1.0, 0.0, 0.5, 1), ("asymmetric", 3, 2.0, 0.0, 1.0, 2)])
def test_rounds_equal_plain_trees(spark, monkeypatch, data, loss, rounds, l2, least_gain, least_weight, refresh):
    x, y, w = data
    monkeypatch.setattr(bo, "REFRESH", refresh)
    if loss == "cubic":
        monkeypatch.setattr(bo, "HISTOGRAM", 1)  # one node a job
    model = bo.fit(frame(spark, x, y, w), NAMES, loss, rounds, 2, 0.4, l2, least_gain, least_weight, base=0.5, weight="weight")
    got = model.values(x)
    for t in range(2):
        real = ~np.isnan(y[:, t])
        p = np.full(real.sum(), 0.5)
        for _ in range(rounds):
            g, h = (v * w[real] for v in PULLS[loss](y[real, t], p))
            p += 0.4 * plain_step(x[real], g, h, 2, l2, least_gain, least_weight)
        np.testing.assert_allclose(got[real, t], p, rtol=1e-9)


def test_base_saved_models_and_odd_rows(spark, tmp_path, data):
    x, y, w = data
    odd = frame(spark, x, y, w).selectExpr("*", "'clash' as x", "'y' as y", "1 as p", "2 as w")
    extra = spark.createDataFrame([(99, None, 7.0, 7.0, 1.0), (98, [9.0, 9.0, 9.0], 900.0, 900.0, None)], "sample_index bigint, features array<double>, K double, Mg double, weight double")
    rows = odd.unionByName(extra, allowMissingColumns=True)
    model = bo.fit(rows, NAMES, rounds=2, depth=2, weight="weight")
    real = ~np.isnan(y)
    assert model.base == pytest.approx([np.average(y[real[:, t], t], weights=w[real[:, t]]) for t in range(2)])
    got = {r["sample_index"]: r for r in bo.predict(model, rows).collect()}
    assert got[99]["K_hat"] is None and got[0]["x"] == "clash" and len(got) == 52
    assert np.allclose([[got[i]["K_hat"], got[i]["Mg_hat"]] for i in range(50)], model.values(x))
    model.save(spark, str(tmp_path / "model"))
    again = bo.load(spark, str(tmp_path / "model"))
    assert again.targets == NAMES and np.allclose(again.values(x), model.values(x))
    with pytest.raises(ValueError, match="no rows"):
        bo.fit(rows.limit(0), NAMES, rounds=1)
    with pytest.raises(ValueError, match="unknown loss"):
        bo.fit(rows, NAMES, "none", rounds=1)
