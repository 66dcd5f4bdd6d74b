"""Target-distribution importance resampling with hashed word n-grams.

Each document's weight is the log ratio of two bags of hashed n-grams, the target's and the corpus's, summed over its own n-grams
with one array of gains. A draw is the highest weights after a fixed random shift of each. The cutoff is found by bisection of a
number: each job counts the persisted scores beyond some thresholds exactly, until one score is left, and in the same way the
last tied document and row. Selected rows are then dealt out by range for their ranks.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandweave.llm.ordered import ranked
from bandweave.session import materialize

BUCKETS, LONGEST = 10_000, 3
CHUNK = 1 << 20  # bytes of text worked on at a time; a longer text is taken whole
SHORT = 48  # longer words are summed one by one
WAYS = 16  # parts into which one counting job cuts the interval

POLYNOMIAL = np.uint32(0xEDB88320)  # fixed value: the CRC-32 of zlib


@functools.cache
def _crc_table() -> np.ndarray:
    """The register after one more zero byte, by its low byte."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, value >> 1 ^ POLYNOMIAL, value >> 1)
    return value


@functools.cache
def _shifts() -> np.ndarray:
    """By number of zero bytes (0 to SHORT), byte of the register and its value: the register after them. It is linear in its bytes."""
    table = _crc_table()
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = [now]
    for _ in range(SHORT):
        now = table[now & 255] ^ now >> np.uint32(8)
        out.append(now)
    return np.stack(out)


def _shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums moved past `size` further bytes, so that those bytes' own checksum can be added."""
    shifts = _shifts()
    out = crc
    while True:
        step = np.minimum(size, SHORT)
        out = shifts[step, 0, out & 255] ^ shifts[step, 1, out >> np.uint32(8) & 255] ^ shifts[step, 2, out >> np.uint32(16) & 255] ^ shifts[step, 3, out >> np.uint32(24)]
        size = size - step
        if not size.any():
            return out


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Each byte with A-Z as a-z, and whether it belongs to a word."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    return lower, word[lower]


def features(texts: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and the text and bucket of each run of 1 to `longest` words, joined by one space."""
    lower, belongs = _letters()
    raw = lower[np.frombuffer(b"\n".join(texts), np.uint8)]
    gap = np.concatenate([[True], ~belongs[raw], [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    size = ends - starts
    text = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), starts, side="right")
    crc = np.zeros(len(starts), np.uint32)
    table = _crc_table()
    order = np.argsort(-size, kind="stable")
    left = np.searchsorted(-size[order], -np.arange(1, SHORT + 1), side="right")  # words of at least 1, 2, ... bytes
    order = order[np.searchsorted(-size[order], -SHORT) :]  # those of at most SHORT bytes
    skipped = len(starts) - len(order)
    state, at = np.full(len(order), 0xFFFFFFFF, np.uint32), starts[order]
    for i, n in enumerate((left - skipped).tolist()):
        if n <= 0:
            break
        state[:n] = table[(state[:n] ^ raw[at[:n] + i]) & 255] ^ state[:n] >> np.uint32(8)
    crc[order] = ~state
    for i in np.flatnonzero(size > SHORT).tolist():
        crc[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes())
    spaced = _shifted(np.full(len(crc), zlib.crc32(b" "), np.uint32), size) ^ crc
    run, found, owner = crc, [crc], [text]
    for n in range(1, longest):
        run = _shifted(run[:-1], size[n:] + 1) ^ spaced[n:]
        one = text[n:] == text[: len(text) - n]
        found.append(run[one])
        owner.append(text[n:][one])
    return np.bincount(text, minlength=len(texts)), np.concatenate(owner), np.concatenate(found).astype(np.int64) % buckets


def _chunks(column: pa.Array):
    """Slices of a text column as UTF-8, about CHUNK bytes each."""
    coded = column.cast(pa.binary())
    start = held = 0
    for i in range(len(coded)):
        held += len(coded[i].as_buffer()) if coded[i].is_valid else 0
        if held >= CHUNK or i + 1 == len(coded):
            yield start, [x or b"" for x in coded[start : i + 1].to_pylist()]
            start, held = i + 1, 0


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all texts fall in each bucket. A task sends each bucket once; `buckets` numbers reach the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                total += np.bincount(features(texts, longest, buckets)[2], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    sums = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the smoothed target share over the smoothed corpus share) of each bucket."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(scale * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def shift(id_col: str, seed: int, scale: int = 1000) -> Column:
    """The fixed Gumbel shift of a document: floor(-scale * ln(-ln u)), u from the hash of seed and id (null: empty)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """Id, n_words, n_features and weight of each document."""

    def run(batches):
        for batch in batches:
            for start, texts in _chunks(batch.column(1)):
                words, owner, bucket = features(texts, longest, len(gain))
                weight = np.zeros(len(texts), np.int64)
                np.add.at(weight, owner, gain[bucket])
                total = np.bincount(owner, minlength=len(texts))
                ids = batch.column(0).slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int64)) for x in (words, total, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def bisect(rows: DataFrame, value: Column, need: int, ways: int = WAYS) -> int:
    """The least number v such that at least `need` rows have `value` <= v (a long, not null); each job counts at `ways` - 1 places."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        places = sorted({low + (high - low) * i // ways for i in range(1, ways)})
        counts = rows.agg(*[F.sum((value <= F.lit(p)).cast("long")) for p in places]).first()
        enough = [p for p, n in zip(places, counts, strict=True) if n >= need]
        short = [p for p, n in zip(places, counts, strict=True) if n < need]
        low, high = (short[-1] + 1 if short else low), (enough[0] if enough else high)
    return low


def draw(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """The scored rows (doc_id, n_words, n_features, weight, score, row) with `rank`: floor(percent * N / 100) highest scores of N long enough rows."""
    able = scored.where(F.col("n_words") >= least_words)
    want = percent * able.count() // 100
    if not want:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    falling = -F.col("score")
    last = -bisect(able, falling, want)
    tied = able.where(F.col("score") == last)
    need = want - able.where(F.col("score") > last).count()
    # Documents without id come last; rows that share score and id go by the number they were written with.
    named = tied.where("doc_id is not null")
    n_named = named.count()
    chosen = F.col("score") > last
    if need <= n_named:
        doc = bisect(named, F.col("doc_id"), need)
        equal, need = named.where(F.col("doc_id") == doc), need - named.where(F.col("doc_id") < doc).count()
        chosen = chosen | ((F.col("score") == last) & (F.col("doc_id") < doc))
        same = (F.col("score") == last) & (F.col("doc_id") == doc)
    else:
        equal, need = tied.where("doc_id is null"), need - n_named
        chosen = chosen | ((F.col("score") == last) & F.col("doc_id").isNotNull())
        same = (F.col("score") == last) & F.col("doc_id").isNull()
    chosen = chosen | (same & (F.col("row") <= bisect(equal, F.col("row"), need)))
    chosen = F.coalesce(chosen & (F.col("n_words") >= least_words), F.lit(False))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    drawn = ranked(scored.where(chosen), order, "rank", "resample-drawn")
    return drawn.unionByName(scored.where(~chosen).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null: not drawn), one row for each document, longs.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased, features are all runs of 1 to 3 words. A null or empty text
    has no words and weight 0. Documents without id take part, with an empty id in the hash and last among equal scores; rows
    that share id and score go by the order in which they were written. Repeated rows are documents of their own. With no
    document long enough nothing is drawn; an empty target gives equal shares. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    scored = weighted(docs, gain, id_col, text_col)
    scored = scored.select("*", (F.col("weight") + shift("doc_id", seed)).alias("score"), F.monotonically_increasing_id().alias("row"))
    return draw(materialize(scored, "resample-scored"), percent, least_words).drop("row")
