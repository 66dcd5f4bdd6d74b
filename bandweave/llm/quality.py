"""Quality of texts by an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

The model is that of `ngrams`: characters as they are, counts and probabilities joined by n-gram with the texts they score.
`class_table`, `grams`, `gram_counts` and `log_table` are a coarser model over CLASSES classes of characters, whose table has at
most CLASSES**ORDER entries; nothing here judges by it.

A text's perplexity is held against its language's threshold, a quantile over trusted texts that were kept from training.
Short texts give uncertain perplexities, so one is rejected only where it lies beyond the threshold by MARGIN standard errors.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandweave.llm.ngrams import ORDER, chunks, discounts, perplexities
from bandweave.session import materialize

CLASSES = 48
QUANTILE, MARGIN = 0.99, 4.0
# Trusted texts a language needs for a threshold of its own, and the part of trusted texts kept for thresholds.
LEAST, HELD = 50, 5
STEP = 0.001  # thresholds are exact to this step of log perplexity


@functools.cache
def class_table() -> np.ndarray:
    """White space 0, a-z 1-26, capitals 27, digits 28, line ends 29, `.` 30, `,` 31, other letters 32-43, ' and - 44, other marks 45-47."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if 97 <= c <= 122:
            table[c] = c - 96
        elif s.isupper():
            table[c] = 27
        elif s.isalpha():
            table[c] = 32 + c * 7919 % 12
        elif s.isdigit():
            table[c] = 28
        elif s == "\n":
            table[c] = 29
        elif not s.isspace():
            table[c] = {".": 30, ",": 31, "'": 44, "-": 44}.get(s, 45 + c % 3)
    return table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the n-grams that end at each character of the texts in a row, and the characters of each text."""
    pad = " " * (ORDER - 1)
    joined = pad + pad.join(texts)
    c = class_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int32)
    number = np.zeros(max(0, len(c) - ORDER + 1), np.int32)
    for i in range(ORDER):
        number = number * CLASSES + c[i : len(c) - ORDER + 1 + i]
    sizes = np.array([len(x) for x in texts])
    starts = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    inside = np.ones(len(number) + 1, np.int8)
    for i in range(ORDER - 1):  # those that end in the padding ahead of the next text
        gone = starts[1:] - (ORDER - 1) + i
        inside[gone[gone < len(number)]] = 0
    return number[inside[:-1] > 0], sizes


def gram_counts(texts: DataFrame) -> DataFrame:
    """g, c: counts of the n-grams in a table of one text column."""

    def run(batches):
        total = np.zeros(CLASSES**ORDER, np.int64)
        for batch in batches:
            for _, some in chunks(batch.column(0).to_pylist()):
                total += np.bincount(grams(some)[0], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["g", "c"])

    return texts.mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def log_table(counts: DataFrame) -> np.ndarray:
    """Log probability of the last character of each n-gram given the others, from the n-gram counts of trusted text."""
    tables = {ORDER: materialize(counts, "ngrams")}
    for n in range(ORDER - 1, 0, -1):  # in how many ways an n-gram continues another
        below = tables[n + 1].groupBy((F.col("g") % CLASSES**n).alias("g")).agg(F.count(F.lit(1)).alias("c"))
        tables[n] = materialize(below, "ngrams")
    dense = np.full(1, 1.0 / CLASSES)
    probability = None
    for n in range(1, ORDER + 1):
        d1, d2, d3 = discounts(tables[n])
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = tables[n].withColumn("h", F.expr(f"g div {CLASSES}"))
        contexts = rows.groupBy("h").agg(F.sum("c").alias("total"), F.sum(F.least(off, F.col("c"))).alias("left"))
        contexts = materialize(contexts.select("h", "total", (F.col("left") / F.col("total")).alias("weight")), "contexts")
        rows = rows.join(contexts, "h").withColumn("own", F.greatest(F.col("c") - off, F.lit(0.0)) / F.col("total"))
        if probability is None:
            rows = rows.withColumn("p", F.col("own") + F.col("weight") / CLASSES)
        else:
            lower = probability.select(F.col("g").alias("lower"), F.col("p").alias("q"))
            rows = rows.withColumn("lower", F.col("g") % CLASSES ** (n - 1)).join(lower, "lower").withColumn("p", F.col("own") + F.col("weight") * F.col("q"))
        probability = materialize(rows.select("g", "p"), "probabilities")
        # Tables of bounded size, filled up where an n-gram or its context wasn't seen.
        weights = np.ones(CLASSES ** (n - 1))
        found = contexts.select("h", "weight").toPandas()
        weights[found["h"].to_numpy(np.int64)] = found["weight"]
        dense = (weights[:, None] * (np.tile(dense.reshape(-1, CLASSES), (CLASSES if n > 1 else 1, 1)) if n > 1 else np.full((1, CLASSES), 1.0 / CLASSES))).ravel()
        found = probability.toPandas()
        dense[found["g"].to_numpy(np.int64)] = found["p"]
    return np.log(dense).astype(np.float32)


def thresholds(scored: DataFrame, quantile: float = QUANTILE, least: int = LEAST) -> DataFrame:
    """lang, limit: the quantile of `mean` by language, for languages with enough rows, and over all rows as a row with `pooled` true."""
    steps = scored.where("mean is not null").select("lang", F.round(F.col("mean") / STEP).cast("long").alias("step"))
    both = steps.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n")).withColumn("pooled", F.lit(False))
    both = both.unionByName(both.groupBy("step").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "step", "n", F.lit(True).alias("pooled")))
    group = Window.partitionBy("pooled", "lang")
    both = both.withColumn("upto", F.sum("n").over(group.orderBy("step"))).withColumn("all", F.sum("n").over(group))
    found = both.where(F.col("upto") >= F.ceil(F.col("all") * quantile)).groupBy("pooled", "lang").agg((F.min("step") * STEP).alias("limit"), F.max("all").alias("all"))
    return found.where(F.col("pooled") | (F.col("all") >= least)).select("pooled", "lang", "limit")


def _fitted(docs: DataFrame, trusted: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, float | None]:
    """Scores by row of `docs` (id, lang, text and others): `columns`, n_scored, mean, error; thresholds by language; threshold over all."""
    ids = trusted.select(F.col(trusted.columns[0]).alias("_id")).where("_id is not null").distinct()
    ids = ids.withColumn("_held", F.pmod(F.xxhash64(F.lit(11), "_id"), F.lit(HELD)) == 0)
    scored = perplexities(docs, ids.where("not _held").select("_id"), columns, "id", "text")
    known = scored.select("id", "lang", "mean").join(ids.where("_held").select(F.col("_id").alias("id")), "id", "left_semi")
    limits = materialize(thresholds(known), "thresholds")
    own = limits.where("not pooled and lang is not null").select("lang", F.col("limit").alias("_own"))  # one row a language
    return scored, own, limits.where("pooled").agg(F.max("limit")).first()[0]


def _judged(scored: DataFrame, own: DataFrame, pooled: float | None) -> DataFrame:
    out = scored.join(own, "lang", "left").withColumn("_limit", F.coalesce("_own", F.lit(pooled).cast("double")))
    keep = F.when(F.col("mean").isNull(), False).otherwise(F.coalesce(F.col("mean") - MARGIN * F.col("error") <= F.col("_limit"), F.lit(True)))
    return out.withColumn("_keep", keep)


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang, n_scored, perplexity, threshold, keep for each row. `trusted`: one column of ids whose text is trusted.

    A fifth of the trusted ids, by a hash, sets the thresholds and is kept from training. A language with fewer than LEAST of
    those, or a null language, takes the threshold over all. A null or empty text has no perplexity and is not kept. With no
    trusted text every other document is kept and its threshold is null. Rows that share an id are judged each; a trusted id
    stands for all of its rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    scored, own, pooled = _fitted(rows, trusted, ["id", "lang"])
    out = _judged(scored, own, pooled)
    return out.select(F.col("id").alias(id_col), "lang", "n_scored", F.exp("mean").alias("perplexity"), F.exp("_limit").alias("threshold"), F.col("_keep").alias("keep"))


def kept(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs`, with all their columns, that `judge` keeps."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), others.alias("_row"), F.col(text_col).alias("text"))
    scored, own, pooled = _fitted(rows, trusted, ["id", "lang", "_row", "text"])
    judged = _judged(scored, F.broadcast(own), pooled).where("_keep")
    return judged.select(*(F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns))
