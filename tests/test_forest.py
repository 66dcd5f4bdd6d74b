"""Trees with vector leaves against a plain recursive tree."""

import numpy as np
import pytest

from bandweave.operators import forest as ft

NAMES = ["K", "Mg"]


def frame(spark, x, y):
    rows = [(i, [float(v) for v in x[i]], *(None if np.isnan(v) else float(v) for v in y[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "sample_index bigint, features array<double>, K double, Mg double").repartition(3)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(21)
    x = rng.normal(size=(52, 4))
    x[:, 2] = rng.integers(0, 3, 52)
    y = np.stack([np.where(x[:, 0] > 0.2, 3.0, 1.0) + x[:, 2], 10 * (x[:, 1] > 0) * x[:, 2]], 1) + 0.1 * rng.normal(size=(52, 2))
    return x, y


def squares(y, w):
    mean = (w[:, None] * y).sum(0) / w.sum()
    return (w[:, None] * (y - mean) ** 2).sum()


def plain_tree(x, y, w, depth, leaf, number=0):
    value = ((w[:, None] * y).sum(0) / w.sum()).tolist()
    best = None
    if depth:
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                right = x[:, f] > cut
                if min(w[right].sum(), w[~right].sum()) >= leaf:
                    gain = squares(y, w) - squares(y[right], w[right]) - squares(y[~right], w[~right])
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, f, cut)
    if best is None or best[0] < 1e-9:
        return {number: (-1, value)}
    right = x[:, best[1]] > best[2]
    out = {number: (best[1], value)}
    for child, some in ((2 * number + 1, ~right), (2 * number + 2, right)):
        out |= plain_tree(x[some], y[some], w[some], depth - 1, leaf, child)
    return out


@pytest.mark.parametrize(("depth", "leaf", "small"), [(3, 1, False), (4, 5, True)])
def test_tree_equals_recursive_splits(spark, monkeypatch, data, depth, leaf, small):
    x, y = data
    if small:
        monkeypatch.setattr(ft, "HISTOGRAM", 1)  # one node a job
    model = ft.fit(frame(spark, x, y), NAMES, trees=1, depth=depth, leaf=leaf, bootstrap=False)
    want = plain_tree(x, y, np.ones(len(x)), depth, leaf)
    assert {n: f for (_, n), (f, *_) in model.nodes.items()} == {n: f for n, (f, _) in want.items()}
    for n, (_, value) in want.items():
        assert model.nodes[0, n][2] == pytest.approx(value)


def test_bootstrapped_trees_weigh_rows(spark, data):
    x, y = data
    model = ft.fit(frame(spark, x, y), NAMES, trees=3, depth=2, seed=4)
    for tree in range(3):
        w = ft._weights(np.arange(len(x)), tree, 4, True)
        assert 0.6 < w.mean() < 1.5
        some = w > 0
        want = plain_tree(x[some], y[some], w[some], 2, 1)
        got = {n: (f, v) for (t, n), (f, _, v, _) in model.nodes.items() if t == tree}
        assert {n: f for n, (f, _) in got.items()} == {n: f for n, (f, _) in want.items()}
        assert all(got[n][1] == pytest.approx(v) for n, (_, v) in want.items())


def test_predictions_saved_models_and_odd_rows(spark, tmp_path, data):
    x, y = data
    odd = frame(spark, x, np.where(np.arange(len(x))[:, None] % 13 == 0, np.nan, y)).selectExpr("*", "'clash' as x", "1 as y", "2 as key")
    model = ft.fit(odd, NAMES, trees=2, depth=3, seed=1)
    rows = odd.unionByName(spark.createDataFrame([(99,)], "sample_index bigint"), allowMissingColumns=True)
    got = {r["sample_index"]: r for r in ft.predict(model, rows).collect()}
    assert got[99]["K_hat"] is None and got[0]["x"] == "clash"
    want = model.values(x)
    assert np.allclose([[got[i]["K_hat"], got[i]["Mg_hat"]] for i in range(len(x))], want)
    model.save(spark, str(tmp_path / "model"))
    again = ft.load(spark, str(tmp_path / "model"))
    assert again.targets == NAMES and np.allclose(again.values(x), want)
    shares = {r["feature"]: r["importance"] for r in model.importances(spark, 4).collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares[3] < 0.2
    with pytest.raises(ValueError, match="no rows"):
        ft.fit(odd.limit(0), NAMES, trees=1)
