"""Packing of token pieces into sequences of one length by best-fit decreasing.

Overlong documents are first cut into full windows. What is left is placed longest first, each piece into the tightest open
window it fits, found by a segment tree over remaining capacity. Pieces of one length are alike, so the placement is worked
out on the histogram of lengths (at most `capacity` numbers, whatever the size of the corpus): windows that hold the same
lengths move together as one range. The plan says for each length which ranks go to which windows. Ranks come from counts per
partition and length, so no task sees more than its share, and the result is exactly that of one global best-fit decreasing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandweave.llm.bpe import _chunks
from bandweave.llm.tokens import library_encoder
from bandweave.session import materialize

END_ID = 1


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf holds ranges of windows that have so much left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [0] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def push(self, capacity: int, first: int, count: int) -> None:
        if capacity and count:
            self.ranges[capacity].append((first, count))
            self._add(capacity, 1)

    def pop(self, capacity: int) -> tuple[int, int]:
        self._add(capacity, -1)
        return self.ranges[capacity].pop()

    def _add(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        while at:
            self.any[at] += n
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """Smallest capacity of `length` or more that an open window has."""
        at = length + self.size
        while not self.any[at]:
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at *= 2
            if not self.any[at]:
                at += 1
        return at - self.size


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, first window, pieces a window takes, offset in the window), by length and first rank."""
    tree, rows, windows = CapacityTree(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, count = windows, -(-left // each)
                windows += count
            else:
                each = room // length
                first, count = tree.pop(room)
            full = min(count, left // each)
            if full:
                rows.append((length, rank, first, each, capacity - room))
                tree.push(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:  # one window takes the rest
                rows.append((length, rank, first + full, left, capacity - room))
                tree.push(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            tree.push(room, first + full, count - full)
    return rows


def cut(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens.

    A document's ids end with id 1; a null or empty text has that id only. Full windows come first, the rest is the last
    piece. Repeated rows are documents of their own. With `added`, added tokens of the vocabulary that a text holds literally
    get their own ids. No shuffle.
    """

    def run(batches):
        encode = library_encoder(path, added)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts, [len(x or "") for x in texts]):
                rows, starts, lengths, pieces, totals = [], [], [], [], []
                for row in range(a, b):
                    ids = encode(texts[row] or "").tobytes() + END_ID.to_bytes(4, "little")
                    for at in range(0, len(ids), 4 * capacity):
                        piece = ids[at : at + 4 * capacity]
                        rows.append(row)
                        starts.append(at // 4)
                        lengths.append(len(piece) // 4)
                        pieces.append(piece)
                        totals.append(len(ids) // 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(pieces, pa.binary()), pa.array(totals, pa.int64())],
                    names=[id_col, "start", "length", "ids", "doc_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long")


def pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length") -> DataFrame:
    """The pieces with `sequence_id` (from 0, gapless) and `offset`; other columns go along, so leave out what isn't needed.

    Pieces of length 0 or less, of null length or beyond `capacity` raise an error. An empty table gives an empty table.
    The pieces are written once to the shared folder, so that ranks stay the same whatever tasks are run again.
    """
    good = F.coalesce(F.col(length_col).between(1, capacity), F.lit(False))
    marked = pieces.withColumn(length_col, F.when(good, F.col(length_col)).otherwise(F.raise_error(F.lit(f"lengths must lie in 1..{capacity}")).cast("long")))
    held = materialize(marked.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "pieces")
    shares = held.groupBy("_part", length_col).agg(F.count(F.lit(1)).alias("_n"))
    counts = {r[0]: r[1] for r in shares.groupBy(length_col).agg(F.sum("_n")).collect()}  # at most `capacity` rows
    rows = plan(counts, capacity)
    lengths, ranks, firsts, each, offsets = (np.array(x, np.int64) for x in (zip(*sorted(rows)) if rows else [[]] * 5))

    earlier = Window.partitionBy(length_col).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = shares.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    own = Window.partitionBy("_part", length_col).orderBy("_row")
    ranked = held.withColumn("_rank", F.row_number().over(own).cast("long")).join(before, ["_part", length_col])
    ranked = ranked.select(*pieces.columns, (F.col("_rank") - 1 + F.col("_before")).alias("_rank"))

    def place(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index(length_col)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            step = 1 << 44  # above any rank
            at = np.searchsorted(lengths * step + ranks, length * step + rank, side="right") - 1
            k = rank - ranks[at]
            window = firsts[at] + k // each[at]
            offset = offsets[at] + k % each[at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(window), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
