"""Interpolated modified Kneser-Ney model of character n-grams, joined by n-gram with the texts it scores.

Characters are taken as they are, so the count tables grow with the corpus. Texts are packed once into blocks. Each block names
its distinct n-grams once, with their counts in its training texts; these are summed by n-gram, continuation counts and
probabilities of each order follow from one another by joins, and the probabilities are joined back once for each block that
holds the n-gram. A task holds one block and the probabilities it asks for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from bandweave.session import materialize, release

ORDER = 4
BLOCK = 1 << 25  # bytes of text in a block; a longer text makes a longer block
LEVEL = 9  # of compression, as blocks are written and sent once each
CHUNK = 1 << 19  # characters worked on at a time; a longer text is a chunk of its own
PARTS = 4096  # tasks that score blocks, at most
DIRECT = 55_108  # with fewer different characters the number of an n-gram fits 63 bits
PAD = ord(" ")


def chunks(texts: list[str | None] | pa.ChunkedArray):
    """Places and texts of the texts that have characters, CHUNK characters at a time."""
    column = texts
    if isinstance(column, pa.ChunkedArray):
        texts = (x for i in range(0, len(column), 256) for x in column.slice(i, 256).to_pylist())
    some: list[str] = []
    rows: list[int] = []
    size = 0
    for i, x in enumerate(texts):
        if x:
            if some and size + len(x) > CHUNK:
                yield rows, some
                some, rows, size = [], [], 0
            some.append(x)
            rows.append(i)
            size += len(x)
    if some:
        yield rows, some


class Numbers:
    """Numbers, exact and in a fixed order, of the n-grams of a block's texts, which end at each character and begin in padding."""

    def __init__(self, texts: pa.ChunkedArray):
        seen = np.zeros(0x110000, bool)
        seen[PAD] = True
        for _, some in chunks(texts):
            seen[np.frombuffer("".join(some).encode("utf-32-le"), "<u4")] = True
        self.letters = np.flatnonzero(seen)
        self.codes = np.cumsum(seen, dtype=np.int64) - 1
        self.size, self.pairs = len(self.letters), None
        if self.size >= DIRECT:  # pairs of characters take the place of characters
            found = [np.unique(self._run(self._codes(some), 2)) for _, some in chunks(texts)]
            self.pairs = np.unique(np.concatenate(found))

    def _codes(self, some: list[str]) -> np.ndarray:
        pad = " " * (ORDER - 1)
        return self.codes[np.frombuffer((pad + pad.join(some)).encode("utf-32-le"), "<u4")]

    def _run(self, codes: np.ndarray, n: int) -> np.ndarray:
        out = codes[: len(codes) - n + 1].copy()
        for i in range(1, n):
            out *= self.size
            out += codes[i : len(codes) - n + 1 + i]
        return out

    def of(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the n-grams of a chunk's texts in a row, and the characters of each text."""
        codes = self._codes(some)
        if self.pairs is None:
            number = self._run(codes, ORDER)
        else:
            at = np.searchsorted(self.pairs, self._run(codes, 2))
            number = at[: len(codes) - ORDER + 1] * len(self.pairs) + at[2:]
        sizes = np.array([len(x) for x in some])
        starts = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
        inside = np.ones(len(number), bool)
        for i in range(ORDER - 1):  # those that end in the padding ahead of the next text
            inside[starts[1:] - (ORDER - 1) + i] = False
        return number[inside], sizes

    def spelled(self, number: np.ndarray) -> list[str]:
        if self.pairs is not None:
            pair = self.pairs[np.stack([number // len(self.pairs), number % len(self.pairs)], 1)]
            codes = np.stack([pair // self.size, pair % self.size], 2).reshape(-1, ORDER)
        else:
            codes = np.stack([number // self.size**i % self.size for i in range(ORDER - 1, -1, -1)], 1)
        long = self.letters[codes].astype("<u4").tobytes().decode("utf-32-le")
        return [long[i : i + ORDER] for i in range(0, len(long), ORDER)]

    def distinct(self, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct numbers of the texts, sorted, and how often each occurs."""
        number, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, some in chunks(texts):
            more, times = np.unique(self.of(some)[0], return_counts=True)
            both = np.union1d(number, more)
            sums = np.zeros(len(both), np.int64)
            sums[np.searchsorted(both, number)] += count
            sums[np.searchsorted(both, more)] += times
            number, count = both, sums
        return number, count


def _opened(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def pack(docs: DataFrame, columns: list[str], id_col: str, text_col: str) -> DataFrame:
    """block, ids, rows: `columns` and `_text` of the rows of `docs`, as one compressed Arrow stream for each block of texts."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.monotonically_increasing_id().alias("_at"), F.col(id_col).alias("_id"), *(F.col(f"`{c}`") for c in columns if c != text_col), F.col(text_col).cast("string").alias("_text"))

    def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        sink = pa.BufferOutputStream()
        held = table.drop_columns(["_at", "_id"])
        with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
            out.write_table(held)
        ids = pa.array([table.column("_id").to_pylist()], pa.list_(table.schema.field("_id").type))
        return pa.RecordBatch.from_arrays([table.column("_at")[:1].combine_chunks(), ids, pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "ids", "rows"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < batch.num_rows:
                before = upto[first - 1] if first else 0
                last = min(int(np.searchsorted(upto, before + BLOCK - size)) + 1, batch.num_rows)
                parts.append(batch.slice(first, last - first))
                size += int(upto[last - 1] - before)
                first = last
                if size >= BLOCK:
                    yield made(parts)
                    parts, size = [], 0
        if parts:
            yield made(parts)

    return materialize(rows.mapInArrow(run, f"block long, ids array<{kind.simpleString()}>, rows binary"), "ngram-blocks")


def block_grams(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """block, at, g, n: the distinct n-grams of each block, with their place there and their count in texts whose id is in `ids`."""
    listed = blocks.select("block", F.posexplode("ids").alias("place", "_id"))
    found = listed.join(ids.select("_id").hint("merge"), "_id", "left_semi")  # ids grow with the corpus, so they are never broadcast
    places = materialize(found.groupBy("block").agg(F.collect_list("place").alias("places")), "ngram-places")

    def run(batches):
        for batch in batches:
            for block, rows, chosen in zip(*(batch.column(c) for c in ("block", "rows", "places")), strict=True):
                texts = _opened(rows.as_buffer()).column("_text")
                numbers = Numbers(texts)
                number, _ = numbers.distinct(texts)
                count = np.zeros(len(number), np.int64)
                if chosen.is_valid:
                    some, times = numbers.distinct(texts.take(chosen.values))
                    count[np.searchsorted(number, some)] = times
                columns = [np.full(len(number), block.as_py()), np.arange(len(number), dtype=np.int32), numbers.spelled(number), count]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.string()), pa.array(columns[3])], names=["block", "at", "g", "n"])

    made = blocks.select("block", "rows").join(places, "block", "left").select("block", "rows", "places")
    return materialize(made.mapInArrow(run, "block long, at int, g string, n long"), "ngram-lists")


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Published estimates from the numbers of n-grams seen once to four times; 0.75 where these don't suffice."""
    n1, n2, n3, n4 = counts.agg(*(F.count_if(F.col("c") == i) for i in (1, 2, 3, 4))).first()
    if not (n1 and n2 and n3):
        return 0.75, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(found))


def probabilities(counts: DataFrame) -> DataFrame:
    """g, p: probability of the last character of each n-gram given the others, for `counts` of g, c with c 0 for those not in training.

    The lowest order falls back on like shares of the characters of training and one unknown character.
    """
    tables = {ORDER: materialize(counts.select("g", "c"), "ngrams")}
    for n in range(ORDER - 1, 0, -1):  # in how many ways an n-gram continues another
        below = tables[n + 1].groupBy(F.substring("g", 2, n).alias("g")).agg(F.count_if(F.col("c") > 0).alias("c"))
        tables[n] = materialize(below, "ngrams")
    known = tables[1].agg(F.count_if(F.col("c") > 0)).first()[0] + 1
    below = None
    for n in range(1, ORDER + 1):
        d1, d2, d3 = discounts(tables[n])
        off = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = tables[n].withColumns({"off": F.least(off, F.col("c").cast("double")), "h": F.substring("g", 1, n - 1)})
        context = Window.partitionBy("h")  # at most one row for each character
        rows = rows.withColumns({"total": F.sum("c").over(context), "left": F.sum("off").over(context)})
        seen = F.col("total") > 0
        rows = rows.withColumns({"own": F.when(seen, (F.col("c") - F.col("off")) / F.col("total")).otherwise(0.0), "weight": F.when(seen, F.col("left") / F.col("total")).otherwise(1.0)})
        if below is None:
            rows = rows.withColumn("q", F.lit(1.0 / known))
        else:
            rows = rows.withColumn("lower", F.substring("g", 2, n - 1)).join(below.select(F.col("g").alias("lower"), F.col("p").alias("q")), "lower")
        made = materialize(rows.select("g", (F.col("own") + F.col("weight") * F.col("q")).alias("p")), "probabilities")
        release(tables[n])
        if below is not None:
            release(below)
        below = made
    return below


def perplexities(docs: DataFrame, trusted: DataFrame, columns: list[str], id_col: str, text_col: str) -> DataFrame:
    """`columns` of each row of `docs` with n_scored (characters), mean (log perplexity) and error (its standard error), written once.

    The model learns from the texts whose id is in `trusted`, of one column `_id`. Mean and error are null where the text is null or empty.
    """
    blocks = pack(docs, columns, id_col, text_col)
    lists = block_grams(blocks, trusted)
    p = probabilities(lists.groupBy("g").agg(F.sum("n").alias("c")))
    answers = lists.select("block", "at", "g").join(p, "g").select("block", "at", F.log("p").cast("float").alias("log"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = _opened(left.column("rows")[0].as_buffer())
        texts = held.column("_text")
        logs = np.zeros(right.num_rows, np.float32)
        if right.num_rows:
            logs[right.column("at").to_numpy()] = right.column("log").to_numpy()
        numbers = Numbers(texts)
        number, _ = numbers.distinct(texts)
        size = np.zeros(len(texts), np.int64)
        mean, error = np.full(len(texts), np.nan), np.full(len(texts), np.nan)
        for rows, some in chunks(texts):
            found, sizes = numbers.of(some)
            loss = -logs[np.searchsorted(number, found)].astype(np.float64)
            starts = np.cumsum(sizes) - sizes
            first = np.add.reduceat(loss, starts) / sizes
            second = np.add.reduceat(loss * loss, starts) / sizes
            size[rows], mean[rows], error[rows] = sizes, first, np.sqrt(np.maximum(second - first * first, 0.01) / sizes)
        none = size == 0
        made = {c: held.column("_text" if c == text_col else c) for c in columns}
        return pa.table({**made, "n_scored": pa.array(size), "mean": pa.array(mean, mask=none), "error": pa.array(error, mask=none)})

    fields = [StructField(c, StringType() if c == text_col else docs.schema[c].dataType) for c in columns]
    schema = StructType([*fields, StructField("n_scored", LongType()), StructField("mean", DoubleType()), StructField("error", DoubleType())])
    parts = min(max(blocks.count(), 1), PARTS)  # named, as the blocks are small as files and much work
    left, right = (x.repartition(parts, "block").groupBy("block") for x in (blocks.select("block", "rows"), answers))
    scored = materialize(left.cogroup(right).applyInArrow(run, schema), "scored", codec="zstd")
    for one in (blocks, lists, p):
        release(one)
    return scored
