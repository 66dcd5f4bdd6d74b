"""Collocations and importance resampling against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandweave.llm import collocations, resample
from bandweave.llm.ordered import ranked

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
COLUMNS = "doc_id long, text string, lang string, rank long, score double, n long, block string, row int, phrase string"


def frame(spark, rows):
    """Documents with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, lang, 7, 0.5, 3, "b", 1, "p") for i, t, lang in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = "the of and stone river light a b c I was to be that it".split() + ["É", " x", "z\x00y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(260):
        some = rng.choices(words, weights, k=rng.randint(0, 60))
        at = rng.randint(0, len(some))
        some[at:at] = rng.choice([[], [], "once upon a time there".split(), "New York City".split(), "new york".split()])
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"]) for w in some), rng.choice(["en", "en", "en", None, "fr"])))
    rows += [(900, None, "en"), (901, "", "de"), (902, " \t\n", "de"), (None, "once upon a time there was", "en"), (5, rows[5][1], rows[5][2]), rows[5]]
    rows.append((903, "long tale " * 4000, "en"))
    return rows


def plain_collocations(rows, least, longest, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = []
    for (lang, words), a in candidates.items():
        score, k = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
        around = [b for (other, longer), b in candidates.items() if other == lang and len(longer) > len(words) and any(longer[i : i + len(words)] == words for i in range(len(longer)))]
        if not any(100 * b >= 100 * a for b in around):
            out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    place = collections.Counter()
    ranked_rows = []
    for lang, *rest in out:
        place[lang] += 1
        if place[lang] <= top:
            ranked_rows.append((lang, place[lang], *rest))
    return ranked_rows


@pytest.mark.parametrize(("least", "top", "words", "tables"), [(8, 40, 1 << 19, (1 << 18, 1 << 21)), (3, 2000, 300, (0, 0)), (3, 2000, 300, (1 << 18, 0))])
def test_collocations_equal_brute_force(spark, corpus, least, top, words, tables):
    want = plain_collocations(corpus, least, 5, top)
    got = collocations.mine(frame(spark, corpus), least=least, top=top, block_words=words, tables=tables)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert len(want) > 30


def test_collocations_of_nothing(spark, corpus):
    docs = frame(spark, corpus)
    assert collocations.mine(docs.limit(0)).count() == 0
    assert collocations.mine(docs.where("doc_id in (900, 901, 902)"), least=1).count() == 0


def test_tiles_count_like_a_dictionary():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 60_000) - 1, 5_000).astype(np.int32)
    ids[rng.random(len(ids)) < 0.1] = -1
    pairs = collocations.pairs_of(ids)
    want = collections.Counter((a, b) for a, b in zip(ids.tolist(), ids[1:].tolist()) if a >= 0 and b >= 0)
    for side, dense in ((16, 0.5), (256, 1 / 16), (256, 1e9), (7, 0)):
        keys, counts = collocations.tiled_counts(pairs, side, dense)
        assert {(k >> 32, k & 0xFFFFFFFF): c for k, c in zip(keys.tolist(), counts.tolist(), strict=True)} == want
    assert collocations.tiled_counts(pairs[:0])[0].tolist() == []


def test_ranks_run_over_all_parts(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 7).alias("v")).repartition(9)
    got = {r["id"]: r["rank"] for r in ranked(rows, [F.col("v").desc(), F.col("id")], "rank").collect()}
    want = {i: n for n, i in enumerate(sorted(range(3000), key=lambda i: (-(i % 7), i)), 1)}
    assert got == want


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(rows, target, percent, least):
    def bags(texts):
        out = collections.Counter()
        for x in texts:
            out.update(zlib.crc32(f.encode()) % 10000 for f in plain_features(x)[1])
        return out, sum(out.values())

    (s, s_all), (t, t_all) = bags([r[1] for r in rows]), bags(target)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out = []
    for i, text, _ in rows:
        n, found = plain_features(text)
        weight = sum(gain(zlib.crc32(f.encode()) % 10000) for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    return out, able[: percent * len(able) // 100]


def test_features_equal_plain_checksums():
    rng = random.Random(8)
    texts = ["", "A", "x" * 49, "Ab cD eF", "z" * 5000 + " y " + "w" * 48 + " é日本 12a", *(" ".join(rng.choice(["ab", "É", "q" * rng.randint(1, 90), "7"]) for _ in range(rng.randint(0, 40))) for _ in range(50))]
    words, owner, bucket = resample.features([x.encode() for x in texts])
    for i, text in enumerate(texts):
        n, found = plain_features(text)
        assert words[i] == n
        assert sorted(bucket[owner == i].tolist()) == sorted(zlib.crc32(f.encode()) % 10000 for f in found)
    assert [len(x) for x in resample.features([b"", b""])] == [2, 0, 0]


@pytest.mark.parametrize(("percent", "least"), [(5, 20), (60, 1), (100, 0), (37, 5)])
def test_resample_equals_brute_force(spark, corpus, percent, least):
    target = ["once upon a time there was a river of light", None, "", "New York City, the stone"]
    rows = corpus + [(None, "once upon a time there was", "en"), (None, "", None), (None, None, None)]
    want, drawn = plain_resample(rows, target, percent, least)
    got = resample.resample(frame(spark, rows), spark.createDataFrame([(x, 1) for x in target], "text string, row int"), percent, least).collect()
    assert sorted((str(r["doc_id"]), r["n_features"], r["weight"], r["score"]) for r in got) == sorted((str(a), b, c, d) for a, b, c, d, _ in want)
    picked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in picked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in picked] == [(x[0], x[3]) for x in drawn]


def test_resample_of_nothing_and_of_copies(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 50 + [(None, "a b c")] * 50, "doc_id long, text string").repartition(4)
    empty = docs.limit(0).select("text")
    assert resample.resample(docs.limit(0), empty).count() == 0
    got = resample.resample(docs, empty, 50, 3).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 51)) and len(got) == 100
    assert [r["rank"] for r in resample.resample(docs, empty, 50, 4).collect()] == [None] * 100


def test_bisection_finds_the_order_statistic(spark):
    rng = random.Random(2)
    for span in (0, 5, 1 << 62):
        values = [rng.randint(-span, span) for _ in range(200)]
        rows = spark.createDataFrame([(v,) for v in values], "v long")
        for need in (1, 77, 200):
            assert resample.bisect(rows, F.col("v"), need) == sorted(values)[need - 1]
