"""Vector searches and URL rules against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandweave.llm import ann, topk, url_rules


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist(), 1.0) for i in range(600)]
    hot = rng.standard_normal(8).tolist()
    rows += [(600 + i, hot, 2.0) for i in range(300)]  # one vector holds a third
    rows += [(1000, None, 0.0), (1001, [], 0.0), (1020, [1.0, None, *[0.0] * 6], 0.0), (1040, [float("nan"), *[0.0] * 7], 0.0), (1060, [float("inf"), *[0.0] * 7], 0.0), (1100, [0.0] * 8, 0.0), (None, hot, 0.0), rows[20]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double").repartition(5)


def valid(vectors):
    rows = {}
    for r in vectors.collect():
        if r.vec_id is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding):
            rows[r.vec_id] = r.embedding
    return rows


@pytest.mark.parametrize("k", [1, 20, 2000])
def test_top_k_is_exact(vectors, k):
    whole = vectors.withColumn("embedding", F.transform("embedding", lambda x: F.floor(64 * F.nullif(x, F.lit(float("inf")))).cast("double")))
    rows = valid(whole)
    got = [tuple(r) for r in topk.top_k(whole, whole.where("vec_id % 20 = 0"), k).orderBy("query_id", "rank").collect()]
    want = []
    for q in sorted(x for x in rows if x % 20 == 0):
        best = sorted(((-int(np.dot(rows[q], v)), i) for i, v in rows.items() if i != q))[:k]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want


def test_top_k_query_equals_its_sql(spark, tmp_path):
    import duckdb

    from bandweave.llm.queries import ORACLES, QUERIES

    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(100)]
    rows += [(k, [x, *[3.0] * 3]) for k, x in ((100, float("nan")), (101, float("nan")), (120, float("inf")), (121, float("inf")), (123, float("-inf")), (140, None), (141, None))]
    rows += [(160, None), (180, [])]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/*.parquet'")
    want = sorted(con.execute(ORACLES["op3_topk"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op3_topk"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())
    assert got == want and len(want) == 100


def test_nearest_with_all_lists_is_exact(vectors):
    rows = {i: v for i, v in valid(vectors).items() if any(v)}
    got = ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5, probes=1.0).collect()
    ids = np.array(sorted(rows))
    unit = np.array([rows[i] for i in ids])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    hits = total = 0
    for q in [i for i in ids if i % 50 == 0]:
        s = unit @ unit[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != q][:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - s[list(ids).index(r.vec_id)]) < 1e-12 for r in mine)
        hits += len({ids[i] for i in order} & {r.vec_id for r in mine})
        total += 5
    assert hits >= 0.97 * total  # the test on partial distances may err


def test_recall_of_random_vectors(spark):
    """The hardest case: no clusters. The default share of lists reaches 0.9."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((3000, 32))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = ann.nearest(table, table.where("vec_id % 50 = 0")).collect()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for q in range(0, 3000, 50):
        s = unit @ unit[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hits / (60 * 5) >= 0.9


def test_searches_of_few_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (100, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(none, none).count() == 0 and ann.nearest(none, none).count() == 0 and ann.nearest(few, none).count() == 0
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 100), (0, 2, 50)]
    assert topk.top_k(few, few, 5).count() == 6


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    if not best:
        return host, path, None, "allow"
    return host, path, *max(best)[2:]


@pytest.mark.parametrize("ranges", [1, 7])
def test_url_rules_against_brute_force(spark, ranges):
    rng = random.Random(ranges)
    hosts = ["org", "a.org", "b.a.org", "x.b.a.org", "ab.org", "com", "c.com", "d.c.com", "a-b.com", "é.com", "com.org"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/bc", "/é", "/ab", "/\U0010ffff"]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h in hosts for p in paths if rng.random() < 0.35}.values())
    urls = [None, "", "no scheme", "http://", "HTTP://B.A.ORG/a/b?x#y", "http://u@a.org:80/a", "x://a.org?q/a", "x://.org/a", "x://a.org./a", "x://org\n/a\nb"]
    urls += [f"http://{rng.choice(['', 'www.', 'W.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '/z', '?q=1', '#t'])}" for _ in range(400)]
    rows = [(i, x, "clash") for i, x in enumerate(urls)] + [(4, urls[4], "again"), (None, urls[5], "null")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    made = spark.createDataFrame([*rules, rules[0], (None, "/", "block"), ("org", None, None), ("", "/", "block")], "host string, path string, verdict string")
    got = sorted((tuple(r) for r in url_rules.judge(pages, made, ranges=ranges).collect()), key=str)
    assert got == sorted(((i, *brute(x, rules)) for i, x, _ in rows), key=str)
    assert url_rules.judge(pages.limit(0), made).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, made.limit(0), default="block").collect()} == {"block"}


def test_top_k_blocks_meet_without_broadcast_or_shuffle(spark, monkeypatch):
    # Blocks are small as files and large in memory: a broadcast of them, chosen by file size, goes through the driver.
    monkeypatch.setattr(topk, "CANDIDATES", 8)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(3)
    v = rng.integers(-9, 10, (40, 5))
    rows = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(40)], "vec_id long, embedding array<double>")
    found = topk.top_k(rows, rows.where("vec_id % 3 = 0"), 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and not any("Broadcast" in line or "Exchange" in line and "block" in line for line in plan.splitlines())
    scores = v @ v.T
    want = []
    for q in range(0, 40, 3):
        others = sorted((i for i in range(40) if i != q), key=lambda i: (-scores[q, i], i))[:4]
        want += [(q, place, i, int(scores[q, i])) for place, i in enumerate(others, 1)]
    assert [tuple(r) for r in found.orderBy("query_id", "rank").collect()] == want
