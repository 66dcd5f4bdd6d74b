"""Substring dedup over sliding sentence spans.

Runs of several consecutive sentences are hashed: from each sentence on, and up to each sentence, the shortest run of at
least `least` sentences and `words` words. Runs are joined across all documents, and sentences that lie in a run which is not
the first of its kind are removed. The first is the one of least document id, then of least position. Any longer run that
repeats is covered by the shortest runs that start in it and the one that ends with it, so the result is that of all runs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences and words that a run has at least; single sentences and short ones recur by chance.
LEAST, WORDS = 2, 20

ENDS = re.compile(r"((?<=[.!?])\s+|\n+)")


def split(text: str) -> list[str]:
    """Sentences with the white space behind them; joined, they are the text. A sentence ends at . ! ? before white space, or at a line's end."""
    parts = ENDS.split(text)
    return [a + b for a, b in zip(parts[::2], [*parts[1::2], ""], strict=True) if a or b]


def runs(sentences: list[str], least: int = LEAST, words: int = WORDS) -> list[tuple[int, int, str]]:
    """(first sentence, number, normal form) of each run; case and white space don't count."""
    plain = [x.lower().split() for x in sentences]
    before = np.concatenate([[0], np.cumsum([len(x) for x in plain], dtype=np.int64)])
    joined = [" ".join(x) for x in plain]
    at = np.arange(len(plain) + 1)
    stop = np.maximum(np.searchsorted(before, before[:-1] + words), at[:-1] + least)
    start = np.minimum(np.searchsorted(before, before[1:] - words, side="right") - 1, at[1:] - least)
    found = {(i, e) for i, e in enumerate(stop.tolist()) if e <= len(plain)} | {(i, e) for e, i in enumerate(start.tolist(), 1) if i >= 0}
    return [(i, e - i, "\n".join(joined[i:e])) for i, e in sorted(found)]


def _key(text: Column) -> Column:
    """Tells rows that share an id apart: 31 bits of the text's hash."""
    return F.shiftrightunsigned(F.xxhash64(text), 33)


def _more(name: Column, text: Column) -> Column:
    """64 further bits for rows without an id, which may be many; null for all others."""
    return F.when(name.isNull(), F.xxhash64(F.lit(1), text))


def spans(docs: DataFrame, id_col: str, text_col: str, least: int, words: int) -> DataFrame:
    """One row for each run: its 128-bit hash (a, b), the document (doc, more), the position (key of the text and first sentence), its sentences."""

    def run(batches):
        for batch in batches:
            texts, keys = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            for at in range(0, len(texts), 500):
                rows, digests, places, counts = [], [], [], []
                for i in range(at, min(at + 500, len(texts))):
                    for first, n, plain in runs(split(texts[i]), least, words) if texts[i] else ():
                        rows.append(i)
                        digests.append(xxhash.xxh3_128_digest(plain.encode()))
                        places.append(keys[i] << 32 | first)
                        counts.append(n)
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                doc, more = (batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), doc, more, pa.array(places, pa.int64()), pa.array(counts, pa.int32())], names=["a", "b", "doc", "more", "place", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    name = F.col(id_col)
    return docs.select(name.alias("doc"), _more(name, text).alias("more"), _key(text).alias("key"), text.alias("text")).mapInArrow(run, f"a long, b long, doc {kind}, more long, place long, n int")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, words: int = WORDS) -> DataFrame:
    """doc, more, key, runs: of each document the runs (first sentence, number) that are not the first of their kind."""
    found = spans(docs, id_col, text_col, least, words)
    place = F.struct("doc", "more", "place")
    firsts = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    later = found.join(firsts, ["a", "b"]).where(~place.eqNullSafe(F.col("first")))
    run = F.struct(F.expr("cast(place & 4294967295 as int)").alias("at"), "n")
    return later.groupBy("doc", "more", F.shiftright("place", 32).alias("key")).agg(F.collect_list(run).alias("runs"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, words: int = WORDS, counts: tuple[str, str] | None = None) -> DataFrame:
    """The rows with repeated sentences taken out of `text_col`; all columns stay. `counts` names two further columns: sentences, and those removed.

    A null text stays null and counts as no sentences; a text whose sentences all go becomes empty. Documents with fewer
    sentences or words than a run needs stay as they are. Rows that share id and text are one document and are treated
    alike; rows that share only the id are told apart by 31 bits of their
    text's hash, rows without an id by 95 bits. An empty table gives an empty table.
    """
    marks = repeated(docs, id_col, text_col, least, words)
    columns = docs.columns
    text = F.col(text_col).cast("string")
    left = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)), F.col(id_col).alias("_doc"), _more(F.col(id_col), text).alias("_more"), _key(text).alias("_key"), text.alias("_text"))
    same = left["_doc"].eqNullSafe(marks["doc"]) & left["_more"].eqNullSafe(marks["more"]) & (left["_key"] == marks["key"])
    joined = left.join(marks, same, "left").select(*(f"_{i}" for i in range(len(columns))), "_text", "runs")

    def cut(batches):
        for batch in batches:
            texts, marked = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            out, total, removed = [], [], []
            for text, some in zip(texts, marked, strict=True):
                parts = split(text) if text else []
                gone = np.zeros(len(parts), bool)
                for run in some or ():
                    gone[run["at"] : run["at"] + run["n"]] = True
                out.append("".join(x for x, g in zip(parts, gone.tolist(), strict=True) if not g) if text is not None else None)
                total.append(len(parts))
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*batch.schema.names[:-2], "_text", "_n", "_gone"])

    fields = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    done = joined.mapInArrow(cut, f"{fields}, _text string, _n long, _gone long")
    more = [] if counts is None else [F.col("_n").alias(counts[0]), F.col("_gone").alias(counts[1])]
    return done.select(*(F.col("_text" if c == text_col else f"_{i}").alias(c) for i, c in enumerate(columns)), *more)
