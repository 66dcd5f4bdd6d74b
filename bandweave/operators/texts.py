"""Corpus counts and fixed token windows, over cleaned text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandweave.functions.text import clean_text, pretokens
from bandweave.operators.ranks import shuffled_rank


def pretoken_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts of pre-tokens over the whole corpus; frequent ones are summed before the shuffle."""
    return df.select(F.explode(pretokens(clean_text(F.col(text)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """In how many words each pair of adjacent symbols occurs; a word's last symbol carries an end mark.

    Words are counted first, so a frequent word is taken apart once.
    """
    words = pretoken_counts(df, text)
    letters = F.split(F.col("token"), "")
    symbols = F.concat(F.slice(letters, 1, F.size(letters) - 1), F.array(F.concat(F.element_at(letters, -1), F.lit("</w>"))))
    shaped = words.select("n", symbols.alias("s")).where(F.size("s") > 1)
    pairs = F.array_distinct(
        F.zip_with(
            F.slice("s", F.lit(1), F.size("s") - 1),
            F.slice("s", F.lit(2), F.size("s") - 1),
            lambda a, b: F.struct(a.alias("first"), b.alias("second")),
        )
    )
    return shaped.select("n", F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, seed: int = 0) -> DataFrame:
    """Token ids from 1 by falling count, equal counts in a repeatable shuffle.

    The running total is over the distinct counts; the many tokens of one count are ranked in hash buckets.
    """
    levels = counts.groupBy("n").agg(F.count(F.lit(1)).alias("_c"))
    above = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = levels.select("n", F.coalesce(F.sum("_c").over(above), F.lit(0)).alias("_above"))
    ranked = shuffled_rank(counts, "token", seed, by=["n"], name="_r").join(offsets, "n")
    return ranked.select("token", (F.col("_above") + F.col("_r") + 1).cast("bigint").alias("id"))


def token_window(df: DataFrame, vocab: DataFrame, size: int, length: int = 77, truncate: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Start id, token ids, end id, padded with 0 to a fixed length.

    `size` is the number of ids; start and end follow as size + 1 and size + 2. A text that does not fit is
    cut, its last place holding the end id, or with truncate=False flagged and left without ids.
    """
    start, end, room = size + 1, size + 2, length - 2
    split = df.select(key, pretokens(clean_text(F.col(text))).alias("_t"))
    split = split.select(key, F.size("_t").alias("_n"), F.slice("_t", 1, room).alias("_t"))
    placed = split.select(key, "_n", F.posexplode_outer("_t").alias("_p", "token"))
    # The dictionary side is unique per token; a token found everywhere is split by the adaptive skew join.
    named = placed.join(vocab, "token", "left")
    entry = F.when(F.col("_p").isNotNull(), F.struct("_p", "id"))
    rows = named.groupBy(key).agg(F.max("_n").alias("_n"), F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["id"]).alias("_ids"))
    whole = F.concat(F.array(F.lit(start).cast("bigint")), F.col("_ids"), F.array(F.lit(end).cast("bigint")))
    padded = F.concat(whole, F.array_repeat(F.lit(0).cast("bigint"), F.lit(length) - F.size(whole)))
    too_long = F.col("_n") > room
    kept = padded if truncate else F.when(~too_long, padded)
    return rows.select(key, too_long.alias("too_long"), kept.alias("ids"))
