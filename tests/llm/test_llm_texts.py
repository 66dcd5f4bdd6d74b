"""Text operators against brute force: packing, BPE, quality, language, sentences, suffixes, Jaccard join, pipeline."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bandweave.llm import bpe, jaccard, langid, ngrams, packing, quality, sentences, suffixes
from bandweave.llm.components import components
from bandweave.llm.tokens import library_encoder, piece_finder, rank_file

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "the of and thing water stone river light under over many small great house green old new long way day".split()


def prose(rng, n):
    out = []
    while len(out) < n:
        some = [rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(rng.randint(4, 11))]
        out += [some[0].title(), *some[1:-1], some[-1] + "."]
    return " ".join(out[:n])


@pytest.fixture(scope="module")
def texts():
    """Nulls, empty, blank and very long texts, exact and near copies, repeats within and across documents, odd characters."""
    rng = random.Random(4)
    base = prose(rng, 300)
    passage = prose(rng, 60)
    near = base.split(" ")
    near[100] = "changed"
    return [
        None, "", " ", "\n\t ", "a", "Re.", base, base, " ".join(near), base.upper(), prose(rng, 40) + " " + passage + " " + prose(rng, 30),
        prose(rng, 20) + ", " + passage + " " + prose(rng, 50), passage, "a" * 3000, "ab" * 900, "é日本 😀\u2003x  y \x1c z <|endoftext|>\r\n 12,5%", prose(rng, 6000), "one two", "One\ttwo", "x y z",
        *[prose(rng, rng.randint(3, 200)) for _ in range(30)],
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """The texts with a repeated row, a row without id, and columns whose names clash with those of the operators."""
    rows = [(i, x, "en", "s", 0, 1.0) for i, x in enumerate(texts)]
    rows += [rows[6], (None, "no id here", None, "s", 0, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, score double").repartition(3)


def test_pack_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for capacity in (7, 64):
        sizes = [rng.randint(1, capacity) for _ in range(400)]
        rows = packing.plan(dict(collections.Counter(sizes)), capacity)
        fill = collections.Counter()
        for length, rank, first, each, offset in rows:
            following = min([r[1] for r in rows if r[0] == length and r[1] > rank], default=sizes.count(length))
            for k in range(following - rank):
                assert offset + k % each * length == fill[first + k // each]
                fill[first + k // each] += length
        rooms = []  # the plain algorithm
        for size in sorted(sizes, reverse=True):
            best = min((r for r in rooms if r >= size), default=None)
            if best is not None:
                rooms.remove(best)
            rooms.append((capacity if best is None else best) - size)
        assert sorted(rooms) == sorted(capacity - x for x in fill.values())
        assert sorted(fill) == list(range(len(fill)))


def test_packing_keeps_each_id_once(docs, texts):
    rows = packing.pack(packing.cut(docs, JSON)).withColumn("crc", F.crc32("ids")).collect()
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    want = collections.Counter()
    for i, x in [*enumerate(texts), (6, texts[6]), (None, "no id here")]:
        ids = np.array([*tok.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048))
    assert collections.Counter((r.doc_id, r.start, r.length, r.crc, r.doc_tokens) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [a for a, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1]) and sum(n for _, n in parts) <= 2048
    assert sorted(by) == list(range(len(by)))


def test_packing_refuses_odd_lengths_and_takes_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, length long")
    assert packing.pack(empty).count() == 0
    with pytest.raises(Exception, match="lengths must lie"):
        packing.pack(spark.createDataFrame([(1, 4096)], "doc_id long, length long")).collect()


def test_library_encoder_equals_the_tokenizers_library(texts):
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    for x in texts:
        assert library_encoder(JSON)(x or "").tolist() == tok.encode(x or "", add_special_tokens=False).ids


def test_packing_query_gives_added_tokens_their_ids(spark, texts, tmp_path):
    from bandweave.llm.queries import QUERIES

    tok = Tokenizer.from_file(JSON)
    some = [*texts, "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n\n <|endoftext|", "x  <|endoftext|>  y <|EndOfText|>"]
    spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = collections.Counter()
    for i, x in enumerate(some):
        ids = np.array([*tok.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        assert library_encoder(JSON, added=True)(x or "").tolist() == ids[:-1].tolist()
        want.update((i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048))
    assert 50256 in tok.encode("a <|endoftext|> b", add_special_tokens=False).ids
    rows = QUERIES["op1_packing"](spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want


@pytest.mark.parametrize("leaf", [1, 3, 8])
def test_tree_reduction_equals_plain_bpe(leaf):
    rng = random.Random(leaf)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_file(MULTI), special_tokens={})
    alphabets = ["ab", "abcdefghij", "theinoraen", "éèàüß", "aA1,.!", "日本語한국어", "a"]
    pieces = ["".join(rng.choice(a) for _ in range(rng.randint(1, 60))).encode() for _ in range(1500) for a in [rng.choice(alphabets)]]
    pieces += [b"a" * 2000, b"\xf0\x9f\x98\x80" * 50]
    assert [list(x) for x in bpe.TreeEncoder(rank_file(MULTI), leaf).pieces(pieces)] == [plain._core_bpe.encode_single_piece(x) for x in pieces]


def test_bpe_round_trip(docs, texts):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_file(MULTI), special_tokens={})
    rows = bpe.decode(bpe.encode(docs, MULTI), MULTI).collect()
    both = {(r.doc_id, r.ids, r.decoded) for r in bpe.encode(docs, MULTI, decoded=True).collect()}
    assert len(rows) == len(texts) + 2 and {(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in rows} == {(a, bytes(b), bytes(c)) for a, b, c in both}
    for r in rows:
        text = "no id here" if r.doc_id is None else texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert piece_finder()("a  b") == ["a", " ", " b"]


def test_sentences_against_brute_force(docs, texts):
    for x in texts:
        assert "".join(sentences.split(x or "")) == (x or "")
    out = sentences.dedup(docs, counts=("total", "gone"))
    assert out.columns == [*docs.columns, "total", "gone"]
    first = {}
    for i, x in enumerate(texts):
        for at, _, plain in sentences.runs(sentences.split(x or "")):
            first.setdefault(plain, (i, at))
    rows = out.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            continue
        parts = sentences.split(texts[r.doc_id] or "")
        gone = [False] * len(parts)
        for at, n, plain in sentences.runs(parts):
            if first[plain] != (r.doc_id, at):
                gone[at : at + n] = [True] * n
        want = None if texts[r.doc_id] is None else "".join(x for x, g in zip(parts, gone, strict=True) if not g)
        assert (r.text, r.total, r.gone) == (want, len(parts), sum(gone))
    assert any(r.gone for r in rows)
    assert sentences.dedup(docs.limit(0)).count() == 0


def test_sentences_against_all_runs(spark):
    """Also runs longer than the shortest, whose last sentences no run from a sentence on ends at."""
    rng = random.Random(12)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n)) + "."
    passage = " ".join(fresh(n) for n in (40, 6, 6))
    texts = [passage, f"{fresh(30)} {passage}", f"{passage} {fresh(30)}"]
    pool = [fresh(rng.choice([1, 3, 6, 9, 15, 30])) for _ in range(12)]
    for _ in range(60):
        parts = [rng.choice(pool) if rng.random() < 0.3 else fresh(rng.randint(1, 12)) for _ in range(rng.randint(1, 6))]
        at = rng.randrange(len(pool))
        texts.append(" ".join([*parts, *pool[at : at + rng.randint(0, 6)], *([fresh(4)] if rng.random() < 0.5 else [])]))
    split = [sentences.split(x) for x in texts]
    plain = [[tuple(s.lower().split()) for s in x] for x in split]
    every = [(k, i, e) for k, x in enumerate(plain) for i in range(len(x)) for e in range(i + 2, len(x) + 1) if sum(map(len, x[i:e])) >= 20]
    first, gone = {}, [[False] * len(x) for x in plain]
    for k, i, e in every:
        first.setdefault(tuple(plain[k][i:e]), (k, i))
    for k, i, e in every:
        if first[tuple(plain[k][i:e])] != (k, i):
            gone[k][i:e] = [True] * (e - i)
    assert gone[1] == [False, True, True, True] and gone[2] == [True, True, True, False]
    out = sentences.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    want = {k: "".join(s for s, g in zip(split[k], gone[k], strict=True) if not g) for k in range(len(texts))}
    assert {r.doc_id: r.text for r in out.collect()} == want


def test_merged_transforms_against_brute_force():
    rng = random.Random(3)
    for alphabet in ("a", "ab", "abc ", "abcdefghijklmnop \0"):
        base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(260, 700))) for _ in range(4)]
        strings = []
        for _ in range(12):
            b = rng.choice(base)
            at = rng.randint(0, len(b) - 250)
            s = list(b[at : at + rng.randint(210, 600)])
            if rng.random() < 0.5:
                s[rng.randrange(len(s))] = "Z"
            strings.append("".join(s).encode())
        times = np.array([1] * 11 + [2])
        counts = collections.Counter()
        for s, n in zip(strings, times.tolist(), strict=True):
            counts.update({s[i : i + 200]: 0 for i in range(len(s) - 199)})
            for i in range(len(s) - 199):
                counts[s[i : i + 200]] += n
        want = [[i for i in range(len(s) - 199) if counts[s[i : i + 200]] > 1] for s in strings]
        for shard in (300, 1 << 18):
            assert [x.tolist() for x in suffixes.repeated_windows(strings, times, shard=shard)] == want


def test_suffix_dedup_against_brute_force(docs, texts):
    raw = [(i, (x or "").encode()) for i, x in [*enumerate(texts), (6, texts[6]), (None, "no id here")]]
    counts = collections.Counter(t[i : i + 200] for _, t in raw for i in range(len(t) - 199))
    want = collections.Counter()
    for k, t in raw:
        edges = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1:
                edges[i] += 1
                edges[i + 200] -= 1
        gone = np.cumsum(edges[:-1]) > 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        want[k, len(t), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if t else 0, hashlib.sha256(kept).hexdigest()] += 1
    rows = suffixes.dedup(docs).withColumn("sha", F.sha2("kept", 256)).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in rows) == want
    assert suffixes.dedup(docs.limit(0)).count() == 0


def brute_classes(texts, n, percent):
    sets = []
    for x in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets.append(frozenset(zip(*[words[i:] for i in range(n)], strict=False)) if len(words) >= n else frozenset([tuple(words)] if words else []))
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                p, q = top(i), top(j)
                root[max(p, q)] = min(p, q)
    return [(len(s), top(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("n", "percent", "parts"), [(3, 90, 3), (5, 80, 2)])
def test_jaccard_join_against_brute_force(spark, docs, texts, n, percent, parts):
    rng = random.Random(n)
    texts = list(texts)
    for _ in range(4):  # groups whose members lie on both sides of the threshold
        base = prose(rng, 120).split(" ")
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r.doc: (r.n, r.component) for r in jaccard.classes(table, n, percent, parts).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_classes(texts, n, percent)


def test_jaccard_join_of_odd_rows(spark, docs):
    rows = jaccard.classes(docs).collect()
    assert len(rows) == docs.count() and sum(r.doc == 6 for r in rows) == 2 and [r.component for r in rows if r.doc is None] == [None]
    assert jaccard.classes(docs.limit(0)).count() == 0


def test_jaccard_join_of_many_rows_without_id(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        words = prose(rng, 80).split(" ")
        rows += [(i if i % 2 else None, " ".join(words)), (None, " ".join([*words, "tail"]))]
    rows += rows[:2] * 20  # copies without an id
    rows += [(7, prose(rng, 50))]  # a second text of one id
    found = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 90).collect()
    want = collections.Counter([(i if i % 2 else None) for i in range(60) for _ in range(42 if i == 0 else 2)] + [7])
    assert len(found) == len(rows) and collections.Counter(r.component for r in found) == want


def test_sentences_of_rows_without_id_are_told_apart(spark, monkeypatch):
    """Even if the short keys of all texts were equal."""
    rng = random.Random(14)
    monkeypatch.setattr(sentences, "_key", lambda text: F.lit(7).cast("long"))
    shared = " ".join(" ".join(rng.choice(WORDS) for _ in range(12)) + "." for _ in range(4))
    texts = [" ".join(" ".join(rng.choice(WORDS) for _ in range(12)) + "." for _ in range(5)) for _ in range(40)]
    rows = [(None, x if i % 4 else f"{x}\n{shared}") for i, x in enumerate(texts)]
    out = sentences.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), counts=("total", "gone")).collect()
    gone = [r for r in out if r.gone]
    assert len(out) == 40 and len(gone) == 9 and all(r.gone == 4 and r.total == 9 for r in gone)
    assert {r.text.strip() for r in out} >= {x for i, x in enumerate(texts) if i % 4}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x in got} and all(x in got for a, b in edges if a != b for x in (a, b))


def languages(spark):
    rng = random.Random(8)
    parts = {"aa": ["lor", "em", "ip", "sum"], "bb": ["zwi", "schen", "ung", "ä"], "cc": ["que", "ción", "ado", "ez"]}
    rows = [(i, " ".join("".join(rng.choices(parts[k], k=rng.randint(1, 3))) for _ in range(rng.randint(4, 80))), k) for i in range(400) for k in [rng.choice(list(parts))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_id(spark, docs):
    rows = languages(spark)
    model = langid.train(rows.where("doc_id % 5 <> 0"))
    assert model.languages == ["aa", "bb", "cc"]
    found = langid.predict(rows.where("doc_id % 5 = 0"), model, ["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) >= 0.97 and all(0 <= r.score <= 1 for r in found)
    odd = langid.predict(docs, model, ["doc_id"]).collect()
    assert len(odd) == docs.count() and {r.lang_pred for r in odd if r.doc_id in (0, 1, 2, 3)} == {"und"}
    assert langid.train(rows.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(rows, None, ["doc_id"]).collect()} == {"und"}


def test_language_stage_rejects_what_no_language_explains(spark):
    import base64
    import corpus_pipeline

    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    learned = languages(spark).where("lang <> 'cc'")
    short = [(1000 + i, " ".join(r.text.split(" ")[:2]), None) for i, r in enumerate(learned.limit(20).collect())]
    noise = [(2000 + i, "".join(rng.choices(letters, k=rng.choice([40, 300]))), None) for i in range(20)]
    noise += [(2100 + i, base64.b64encode(rng.randbytes(200)).decode(), None) for i in range(20)]
    other = [(3000 + r.doc_id, r.text, None) for r in languages(spark).where("lang = 'cc' and length(text) > 40").collect()]
    rows = learned.unionByName(spark.createDataFrame([*short, *noise, *other], learned.schema))
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, rows, "").collect()}
    assert {r.doc_id for r in learned.collect()} | {i for i, _, _ in short} == set(kept)
    assert set(kept.values()) == {"aa", "bb"} and len(other) > 50


def test_folded_weights_are_the_kernel_regression():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 60, 25)) for _ in range(30)]
    model = langid.fit(rows, ["a" if i % 2 else "b" for i in range(30)], landmarks=30, ridge=1e-9)
    kernel = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in rows] for a in rows])
    if np.linalg.matrix_rank(kernel) == 30:  # no ridge: the training rows are met
        flags = np.zeros((30, langid.FEATURES))
        for f, r in zip(flags, rows, strict=True):
            f[r] = 1 / np.sqrt(len(r))
        assert np.allclose(flags[:, model.used] @ model.weights + model.bias, np.where(np.arange(30)[:, None] % 2 == [1, 0], 1.0, -1.0), atol=0.05)


def test_quality_table_against_plain_kneser_ney(spark):
    rng = random.Random(5)
    texts = [prose(rng, 60) for _ in range(30)]
    table = quality.log_table(quality.gram_counts(spark.createDataFrame([(x,) for x in texts], "text string").repartition(3)))
    k, n = quality.CLASSES, quality.ORDER
    assert np.allclose(np.exp(table.reshape(-1, k).astype(float)).sum(1), 1, atol=1e-4)  # a distribution for each context
    counts = {n: collections.Counter(quality.grams(texts)[0].tolist())}
    for m in range(n - 1, 0, -1):
        counts[m] = collections.Counter(g % k**m for g in counts[m + 1])

    def discounts(c):
        n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            return [0.75] * 3
        y = n1 / (n1 + 2 * n2)
        return [min(max(d, 0.05), i + 0.95) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]

    def p(g, m):
        if m == 0:
            return 1 / k
        d = discounts(counts[m])
        seen = {x: v for x, v in counts[m].items() if x // k == g // k}
        if not seen:
            return p(g % k ** (m - 1), m - 1)
        off = lambda v: min(d[min(v, 3) - 1], v)
        own = max(seen[g] - d[min(seen[g], 3) - 1], 0) if g in seen else 0
        return (own + sum(map(off, seen.values())) * p(g % k ** (m - 1), m - 1)) / sum(seen.values())

    for g in [*list(counts[n])[:15], 0, 5_000_000, k**n - 1]:
        assert np.isclose(table[g], np.log(p(g, n)), atol=1e-3)


def test_quality_judges_and_keeps(spark, docs):
    rng = random.Random(6)
    clean = [(i, prose(rng, rng.randint(1, 200)), "en") for i in range(300)]
    junk = [(1000 + i, " ".join(x.upper() + "!!" for x in prose(rng, 60).split()) + "###%%%" * 20, "en") for i in range(30)]
    odd = [(2000, None, "en"), (2001, "", None), (None, prose(rng, 80), None), clean[3]]
    rows = spark.createDataFrame([*clean, *junk, *odd], "doc_id long, text string, lang string").withColumn("mean", F.lit(1))
    trusted = spark.createDataFrame([(i,) for i in [*range(250), 5, None, 99999]], "doc_id long")
    got = {r.doc_id: r for r in quality.judge(rows, trusted).collect()}
    assert all(got[i].keep for i in range(300)) and not any(got[1000 + i].keep for i in range(30))
    assert not got[2000].keep and got[2000].perplexity is None and not got[2001].keep and got[None].keep
    kept = quality.kept(rows, trusted)
    assert kept.columns == rows.columns and kept.count() == 302
    assert {r.keep for r in quality.judge(rows.limit(20), trusted.limit(0)).collect()} == {True}
    assert quality.judge(rows.limit(0), trusted).count() == 0


def test_quality_model_knows_each_character(spark, monkeypatch):
    """Perplexities against plain Kneser-Ney over real characters, over several blocks, and with pairs in place of characters."""
    rng = random.Random(7)
    texts = [prose(rng, 30) for _ in range(12)] + ["Aa 12 12 Ωω", "x", "", None, "\x00 y\n", "BCD BCD 99"]
    docs = spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts)], "id long, text string, lang string").repartition(2)
    trained = [*range(8), 12]
    ids = spark.createDataFrame([(i,) for i in trained], "_id long")
    counts = {4: collections.Counter()}
    for i in trained:
        x = "   " + texts[i]
        counts[4].update(x[j : j + 4] for j in range(len(texts[i])))
    for m in (3, 2, 1):
        counts[m] = collections.Counter(g[1:] for g in counts[m + 1])
    off = {}
    for m, c in counts.items():
        n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in (1, 2, 3, 4))
        off[m] = [0.75] * 3
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            off[m] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]

    def p(g):
        m = len(g)
        if m == 0:
            return 1 / (len(counts[1]) + 1)
        seen = {x: v for x, v in counts[m].items() if x[:-1] == g[:-1]}
        if not seen:
            return p(g[1:])
        cut = {x: min(off[m][min(v, 3) - 1], v) for x, v in seen.items()}
        return (seen.get(g, 0) - cut.get(g, 0) + sum(cut.values()) * p(g[1:])) / sum(seen.values())

    for block, direct in ((ngrams.BLOCK, ngrams.DIRECT), (400, ngrams.DIRECT), (400, 2)):
        monkeypatch.setattr(ngrams, "BLOCK", block)
        monkeypatch.setattr(ngrams, "DIRECT", direct)
        monkeypatch.setattr(ngrams, "CHUNK", 300)
        got = {r.id: r for r in ngrams.perplexities(docs, ids, ["id"], "id", "text").collect()}
        assert set(got) == set(range(len(texts)))
        for i, x in enumerate(texts):
            assert got[i].n_scored == len(x or "")
            if x:
                padded = "   " + x
                mean = -sum(math.log(p(padded[j : j + 4])) for j in range(len(x))) / len(x)
                assert math.isclose(got[i].mean, mean, rel_tol=1e-4)
            else:
                assert got[i].mean is None and got[i].error is None


def test_quality_tells_letters_of_one_class_apart(spark):
    """Capitals, digits and letters beyond a-z that trusted texts never hold."""
    rng = random.Random(8)
    swap = str.maketrans("ABCDEFGHIJKLM0123", "ZYXWVUTSRQPON9876")
    words = ["ABLE", "BAKE", "CAGE", "DICE", "EDGE", "FADE", "GLAD", "HIDE", "LIME", "MILK", "10", "203", "31"]
    clean = [(i, " ".join(rng.choice(words) for _ in range(60)), "en") for i in range(300)]
    odd = [(1000 + i, clean[i][1].translate(swap), "en") for i in range(10)]
    rows = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(280)], "doc_id long")
    kept = {r.doc_id for r in quality.kept(rows, trusted).collect()}
    assert kept == set(range(300))


def test_pipeline_stages_hold_together(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    passage = prose(rng, 70)
    rows = [(i, prose(rng, rng.randint(30, 200)) + (" " + passage if i % 40 == 0 else ""), "en", f"s{i % 3}", i) for i in range(240)]
    rows += [(500 + i, rows[i][1], "en", "s", 0) for i in range(5)] + [(600, None, "en", None, 0), (601, "12 34", None, None, 0), rows[7], (None, prose(rng, 50), None, None, 0)]
    rows += [(700 + i, "###!! %%% " * 40 + "X!!", "en", "s", 0) for i in range(3)]
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        kept = spark.read.parquet(f"{folder}/{name}")
        seen[name] = [r.doc_id for r in kept.collect()]
    assert 600 not in seen["language_id"] and 601 not in seen["language_id"]
    assert set(range(240)) <= set(seen["quality_classifier"]) and not {700, 701, 702} & set(seen["quality_classifier"])
    assert not {*range(500, 505)} & set(seen["jaccard_join"]) and seen["jaccard_join"].count(7) == 1 and None in seen["jaccard_join"]
    assert set(range(240)) <= set(seen["substring_dedup"])
    assert set(seen["packing"]) == set(seen["substring_dedup"])
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_pipeline_join_judges_rows(spark):
    """Copies without id go, also those linked with an id; rows that share an id but not the text are judged apart."""
    import corpus_pipeline

    rng = random.Random(13)
    one, two, three, four = (prose(rng, 120) for _ in range(4))
    near = two.split(" ")
    near[60] = "changed"
    rows = [(None, one), (None, one), (None, two), (3, " ".join(near)), (None, two), (5, three), (7, three), (7, four), (None, prose(rng, 90)), (9, four), (9, four), (11, ""), (11, None), (None, "")]
    out = corpus_pipeline.jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[k] for k in (0, 3, 5, 7, 8, 11, 12, 13)], key=str)
