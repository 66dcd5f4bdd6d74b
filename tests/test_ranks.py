"""Positions, running values and quantiles against plain Python, with hot keys."""

import random

import numpy as np
from pyspark.sql import functions as F

from bandweave.operators import ranks


def rows_with_hot_key(n=3000):
    rng = random.Random(1)
    return [(0 if i % 3 == 0 else rng.randrange(50), i, rng.randrange(200), rng.random()) for i in range(n)]


def test_group_rank_matches_sorted_order(spark):
    data = rows_with_hot_key()
    df = spark.createDataFrame(data, "g int, id int, k int, v double")
    got = ranks.group_rank(df, ["g"], ["k", "id"], F.col("k"), total="n").collect()
    for g in {r[0] for r in data}:
        want = [r[1] for r in sorted((r for r in data if r[0] == g), key=lambda r: (r[2], r[1]))]
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        assert [r["id"] for r in mine] == want
        assert [r["rank"] for r in mine] == list(range(len(want)))
        assert {r["n"] for r in mine} == {len(want)}


def test_small_group_rank_cuts_only_large_groups(spark):
    data = [*rows_with_hot_key(), *[(None, 10_000 + i, i % 5, 0.0) for i in range(40)]]
    df = spark.createDataFrame(data, "g int, id int, k int, v double")
    want = sorted(map(tuple, ranks.group_rank(df, ["g"], ["k", "id"], F.col("k"), total="n").select("id", "rank", "n").collect()))
    for most in (30, 500, 100_000):  # some null, some hot, none are cut
        got = ranks.small_group_rank(df, ["g"], ["k", "id"], F.col("k"), total="n", most=most)
        assert got.columns == [*df.columns, "rank", "n"]
        assert sorted(map(tuple, got.select("id", "rank", "n").collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_ranked_rows_are_never_broadcast(spark, tmp_path):
    """Files make a table look small that is large in memory; only the sizes of the buckets may be sent."""
    spark.range(1000).select("id", (F.col("id") % 7).alias("k")).write.parquet(str(tmp_path / "rows"))
    ranked = ranks.value_rank(spark.read.parquet(str(tmp_path / "rows")), "k", ties=["id"], rows_per_bucket=100)
    assert "BroadcastHashJoin" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_shuffled_rank_is_a_permutation_and_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "key")
    once = {r["key"]: r["rank"] for r in ranks.shuffled_rank(df, "key", 3).collect()}
    twice = {r["key"]: r["rank"] for r in ranks.shuffled_rank(df.repartition(7), "key", 3).collect()}
    assert sorted(once.values()) == list(range(1000))
    assert once == twice
    assert once != {r["key"]: r["rank"] for r in ranks.shuffled_rank(df, "key", 4).collect()}


def test_value_rank_descending(spark):
    df = spark.createDataFrame([(i, float((i * 37) % 101)) for i in range(101)], "id int, v double")
    got = {r["v"]: r["rank"] for r in ranks.value_rank(df, "v", descending=True, rows_per_bucket=9).collect()}
    assert got == {float(v): 100 - v for v in range(101)}


def test_running_sums(spark):
    df = spark.createDataFrame([(float(i), i % 5) for i in range(500)], "v double, n int")
    got = {r["v"]: (r["s"], r["s_total"]) for r in ranks.running_sums(df, "v", {"s": "n"}, rows_per_bucket=25).collect()}
    total = 0
    for i in range(500):
        total += i % 5
        assert got[float(i)] == (total, 1000)


def test_exact_quantiles_hot_values_and_small_groups(spark):
    rng = np.random.default_rng(0)
    groups = {"many": rng.normal(size=5000), "hot": np.r_[np.zeros(3000), rng.random(100)], "two": np.array([1.0, 2.0]), "one": np.array([7.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r["g"]: r["q"] for r in ranks.exact_quantiles(df, ["g"], "v", probs, buckets=16).collect()}
    for g, xs in groups.items():
        np.testing.assert_allclose(got[g], np.quantile(xs, probs), rtol=0, atol=1e-12)


def test_exact_quantiles_read_one_set_of_cut_points(spark):
    """Two runs of the sketch can differ on a cluster; counts of one and sizes of the other then lose positions."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    plan = ranks.exact_quantiles(df, ["g"], "v", [0.25, 0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan


def test_group_running_min_and_sum(spark):
    data = rows_with_hot_key()
    df = spark.createDataFrame(data, "g int, id int, k int, v double")
    got = ranks.group_running(df, ["g"], ["id"], F.floor(F.col("id") / 100), {"s": ("sum", F.col("k")), "m": ("min", F.col("v"))}).collect()
    for g in (0, 7):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["id"])
        np.testing.assert_array_equal([r["s"] for r in mine], np.cumsum([r["k"] for r in mine]))
        np.testing.assert_array_equal([r["m"] for r in mine], np.minimum.accumulate([r["v"] for r in mine]))
