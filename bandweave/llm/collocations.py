"""Phrase collocation mining by direct-address tiling.

Texts are gathered into blocks, each with its own dictionary, so that the words of a block are looked up once a block. Words that
are frequent enough get ids by falling frequency, and a block becomes a sequence of ids. Adjacent ids are pairs: their plane is
cut into tiles of SIDE x SIDE ids, the tiles in which a block has many pairs are counted by a dense bincount at direct addresses,
all others as sorted coordinates. Counts of blocks are summed; frequent pairs are ranked anew by frequency, and their ranks are
the ids of the next round, whose adjacent ids are phrases of one word more. A phrase can only be frequent if both of its
parts are, so nothing is lost.

The names of words and pairs come back to the blocks in one of two ways with the same result: a table of at most WORD_TABLE
words or PAIR_TABLE pairs, as counted, is sent to the tasks; a larger one is joined, each block asking for its own entries only.
"""

from __future__ import annotations

from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandweave.llm.ordered import ranked
from bandweave.session import materialize, release

BLOCK = 1 << 18  # words of the blocks of a task, all groups together; a longer text makes a longer block
SLICE = 256  # texts of a batch that a task holds as strings at once
SIDE = 256  # ids along a tile
DENSE = 1 / 16  # pairs for each cell from which a tile counts as dense
WORD_TABLE, PAIR_TABLE = 1 << 18, 1 << 21  # entries of the largest tables that are sent to tasks: about 16 and 24 MB
UNKNOWN = "und"

_GAP, _NONE = -2, -1
_LETTERS = bytes.maketrans(bytes(range(65, 91)) + b"\t" + b".,;:!?\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"\n" * 9)


def cut(text: str) -> list[bytes]:
    """Words of a text in order, A-Z as a-z, with a line feed between pieces; empty strings are to be left out."""
    return text.encode().translate(_LETTERS).replace(b"\n", b" \n ").split(b" ")


class Block:
    """Texts of one group as codes of an own dictionary."""

    def __init__(self, first: int):
        self.first, self.size = first, 0
        self.codes = {b"": _GAP, b"\n": _NONE}
        self.parts: list[np.ndarray] = []

    def add(self, text: str) -> int:
        words = cut(text)
        self.codes.update((w, i) for i, w in enumerate(set(filterfalse(self.codes.__contains__, words)), len(self.codes) - 2))
        ids = np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words))
        self.parts += [ids[ids != _GAP], np.array([_NONE], np.int32)]
        return len(words)

    def row(self) -> tuple[bytes, list[bytes], list[int]]:
        codes = np.concatenate(self.parts)
        return squeeze(codes).tobytes(), list(self.codes)[2:], np.bincount(codes[codes >= 0], minlength=len(self.codes) - 2).tolist()


def squeeze(ids: np.ndarray) -> np.ndarray:
    """The sequence with one gap in place of several in a row."""
    gap = ids < 0
    return ids[~(gap & np.concatenate([[False], gap[:-1]]))]


def blocks(docs: DataFrame, text_col: str, group_col: str, size: int) -> DataFrame:
    """block (long), lang, codes (32-bit, gaps negative), words and counts of each block."""

    def run(batches):
        open_blocks: dict[str, Block] = {}
        held = 0

        def flush():
            rows = [(b.first, lang, *b.row()) for lang, b in open_blocks.items()]
            open_blocks.clear()
            first, langs, codes, words, counts = zip(*rows, strict=True)
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            made = [pa.array(x, kind) for x, kind in zip((first, langs, codes, words, counts), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(made, names=["block", "lang", "codes", "words", "counts"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for row, lang, text in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True):
                    held += open_blocks.setdefault(lang, Block(row)).add(text)
                    if held >= size:
                        held = 0
                        yield flush()
        if open_blocks:
            yield flush()

    text = F.col(text_col).cast("string")
    lang = F.coalesce(F.col(group_col).cast("string"), F.lit(UNKNOWN))
    # A block bears the number of its first text, which lies in no other block.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), lang.alias("lang"), text.alias("text")).where("text <> ''")
    return rows.mapInArrow(run, "block long, lang string, codes binary, words array<binary>, counts array<long>")


def pairs_of(ids: np.ndarray) -> np.ndarray:
    """Each adjacent pair of ids as one number, -1 across a gap."""
    x, y = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
    return np.where((x >= 0) & (y >= 0), x << 32 | y, -1)


def tiled_counts(pairs: np.ndarray, side: int = SIDE, dense: float = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs: dense tiles by bincount over their cells, the rest as sorted coordinates."""
    pairs = pairs[pairs >= 0]
    x, y = pairs >> 32, pairs & 0xFFFFFFFF
    tile, place, size = np.unique((x // side) << 32 | y // side, return_inverse=True, return_counts=True)
    full = size >= dense * side * side
    keys, counts = [], []
    inside = full[place] if len(place) else np.zeros(0, bool)
    for t in np.flatnonzero(full):
        at = place == t
        found = np.bincount(x[at] % side * side + y[at] % side, minlength=side * side)
        cell = np.flatnonzero(found)
        keys.append(((tile[t] >> 32) * side + cell // side) << 32 | (tile[t] & 0xFFFFFFFF) * side + cell % side)
        counts.append(found[cell])
    some, times = np.unique(pairs[~inside], return_counts=True)
    return np.concatenate([*keys, some]), np.concatenate([*counts, times])


def _counted(sequences: DataFrame) -> DataFrame:
    """block, pair, n: the pairs of each block."""

    def run(batches):
        for batch in batches:
            for block, raw in zip(*batch.columns, strict=True):
                keys, counts = tiled_counts(pairs_of(np.frombuffer(raw.as_buffer(), "<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block.as_py())), pa.array(keys), pa.array(counts.astype(np.int64))], names=["block", "pair", "n"])

    return sequences.select("block", "ids").mapInArrow(run, "block long, pair long, n long")


def _named(was: np.ndarray, key: np.ndarray, name: np.ndarray) -> bytes:
    """A sequence in which each number is the name of the equal key, keys being sorted, or a gap."""
    if not len(key):
        return b""
    at = np.minimum(np.searchsorted(key, was), len(key) - 1)
    return squeeze(np.where((key[at] == was) & (was >= 0), name[at], _NONE).astype("<i4")).tobytes()


def _joined(sequences: DataFrame, answers: DataFrame, pairs: bool) -> DataFrame:
    """block, ids: each code (or pair of adjacent ids) as the id that `answers` (block, key, id) gives it, or a gap."""
    wanted = answers.groupBy("block").agg(F.collect_list("key").alias("keys"), F.collect_list("id").alias("ids"))

    def run(batches):
        for batch in batches:
            blocks_, old, keys, ids = batch.columns
            out = []
            for i in range(len(blocks_)):
                key, name = (c[i].values.to_numpy(zero_copy_only=False) for c in (keys, ids))
                order = np.argsort(key)
                was = np.frombuffer(old[i].as_buffer(), "<i4")
                out.append(_named(pairs_of(was) if pairs else was, key[order], name[order]))
            yield pa.RecordBatch.from_arrays([blocks_, pa.array(out, pa.binary())], names=["block", "ids"])

    return sequences.select("block", F.col("ids").alias("old")).join(wanted, "block").select("block", "old", "keys", "ids").mapInArrow(run, "block long, ids binary")


def _word_ids(cut_up: DataFrame, entries: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """block, ids of the frequent words."""
    if words.count() > most:
        asked = entries.join(words.select("lang", "word", "id"), ["lang", "word"]).select("block", "key", "id")
        return _joined(cut_up.select("block", F.col("codes").alias("ids")), asked, pairs=False)
    table: dict[str, dict[bytes, int]] = {}
    for lang, word, name in zip(*(c.to_pylist() for c in words.select("lang", "word", "id").toArrow().columns), strict=True):
        table.setdefault(lang, {})[word] = name
    sent = words.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a block at a time, as its words become Python strings
                block, lang, codes, own = (c[i].as_py() for c in batch.columns)
                known = sent.value.get(lang, {})
                name = np.fromiter((known.get(w, _NONE) for w in own), np.int64, len(own))
                ids = _named(np.frombuffer(codes, "<i4"), np.arange(len(own)), name)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids], pa.binary())], names=["block", "ids"])

    return cut_up.select("block", "lang", "codes", "words").mapInArrow(run, "block long, ids binary")


def _pair_ids(sequences: DataFrame, made: DataFrame, most: int) -> DataFrame:
    """block, ids of the frequent pairs."""
    if made.count() > most:
        asked = _counted(sequences).join(made.select("pair", "id"), "pair").select("block", F.col("pair").alias("key"), "id")
        return _joined(sequences, asked, pairs=True)
    key, name = (c.to_numpy() for c in made.select("pair", "id").toArrow().columns)
    order = np.argsort(key)
    sent = made.sparkSession.sparkContext.broadcast((key[order], name[order].astype(np.int32)))

    def run(batches):
        for batch in batches:
            for block, old in zip(*batch.columns, strict=True):
                ids = _named(pairs_of(np.frombuffer(old.as_buffer(), "<i4")), *sent.value)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()]), pa.array([ids], pa.binary())], names=["block", "ids"])

    return sequences.select("block", "ids").mapInArrow(run, "block long, ids binary")


def _numbered(found: DataFrame, ties: list[str], label: str) -> DataFrame:
    """`id` by falling frequency from 0; ids must fit 31 bits, as two of them make one key."""
    named = ranked(found, [F.col("f").desc(), *(F.col(c) for c in ties)], "id", label)
    return named.withColumn("id", F.when(F.col("id") <= 1 << 31, F.col("id") - 1).otherwise(F.raise_error(F.lit("more than 2^31 frequent phrases of one length"))))


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, text_col: str = "text", group_col: str = "lang", block_words: int = BLOCK, tables: tuple[int, int] = (WORD_TABLE, PAIR_TABLE)) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to `longest` words that occur `least` times, and (lang, n): all words.

    The words of a phrase stand side by side in one piece; overlapping occurrences count.
    """
    cut_up = materialize(blocks(docs, text_col, group_col, block_words), "phrase-blocks")
    entries = cut_up.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("key", "e")).select("block", "lang", "key", F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    counts = entries.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    totals = materialize(cut_up.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")), "phrase-totals")
    words = _numbered(counts.where(F.col("f") >= least), ["lang", "word"], "phrase-words")
    words = materialize(words.select("id", "lang", "word", F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("last"), "f"), "phrase-words")
    sequences = materialize(_word_ids(cut_up, entries, words, tables[0]), "phrase-ids")
    release(cut_up)  # each table goes when the next is written, which later jobs read
    levels = [words.select("id", "lang", "phrase", "last", "f")]
    for size in range(2, longest + 1):
        sums = _counted(sequences).groupBy("pair").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        named = _numbered(sums, ["pair"], "phrase-ranks")
        left = levels[-1].select(F.col("id").alias("x"), "lang", F.col("phrase").alias("head"))
        right = levels[-1].select(F.col("id").alias("y"), "last")
        split = named.select("*", F.shiftright("pair", 32).alias("x"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("y"))
        made = split.join(left, "x").join(right, "y").select("id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", "pair")
        made = materialize(made, "phrase-level")
        levels.append(made.drop("pair"))
        if size < longest:
            shorter, sequences = sequences, materialize(_pair_ids(sequences, made, tables[1]), "phrase-ids")
            release(shorter)
    release(sequences)
    found = None
    for size, level in enumerate(levels, 1):
        rows = level.select("lang", "phrase", F.lit(size).alias("words"), "f")
        found = rows if found is None else found.unionByName(rows)
    return found, totals


def mine(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, text_col: str = "text", group_col: str = "lang", block_words: int = BLOCK, tables: tuple[int, int] = (WORD_TABLE, PAIR_TABLE)) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the `top` collocations of each language.

    A-Z are lower-cased, pieces end at `[.,;:!?\\x0A-\\x0D]`, words are `[^\\x20\\x09]+`. A candidate is a phrase of 2 to `longest`
    words that occurs a >= `least` times; its score is the least floor(1000 * a * n / (l * r)) over all cuts into a first part that
    occurs l and a rest that occurs r times, n being all words of the language; equal scores go by the shorter first part. Candidates
    inside a longer candidate that occurs as often are dropped. Order: score, then a, falling, then the bytes of the phrase.
    A null text is empty, a null language is `und`. Repeated rows count each; ids and other columns are not read. An empty table,
    or one without frequent phrases, gives no rows. Products are decimals of 38 digits, which hold counts up to 10^17.
    """
    found, totals = phrases(docs, least, longest, text_col, group_col, block_words, tables)
    known = found.select("lang", "phrase", "f")
    candidates = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    parts = F.split("phrase", " ", -1)
    split = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).withColumn("w", parts)
    split = split.select("lang", "phrase", "words", "a", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("first"), F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.col("words") - F.col("k"))).alias("rest"))
    split = split.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    split = split.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    split = split.withColumn("score", F.expr("(cast(1000 * a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    least_cut = F.min(F.struct("score", "k", "l", "r", "n")).alias("best")
    scored = split.groupBy("lang", "phrase", "words", "a").agg(least_cut).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.n", "best.score")
    # Shorter phrases inside each candidate, with how often the candidate occurs.
    starts = F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)
    inner = candidates.where("words > 2").select("lang", "a", "words", parts.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", F.explode(F.transform(starts, lambda i: F.concat_ws(" ", F.slice("w", i, F.col("size"))))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_around"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where("_around is null or 100 * _around < 100 * a")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    best = kept.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
