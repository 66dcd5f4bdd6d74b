"""Exact top-k search by distributed histogram selection.

Everything is scored: a block of queries against each block of candidates. Each pass narrows, for each query, the interval
that holds its kth score: blocks count scores by bin of the interval, counts are summed over blocks, and the bin in which the
running count from above reaches k becomes the next interval, until it is one score wide. A last pass keeps scores above the
kth, and as many at it as are wanted, those of least id. A block leaves out bins below the one in which it alone reaches k:
the kth score can't lie there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandweave.llm.blocks import pack, share, unpack, usable
from bandweave.session import materialize

CANDIDATES, QUERIES, BINS, SLICE = 16384, 512, 256, 64


def _pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each query block beside each candidate block of the same vector length.

    A task reads some files of one table against some of the other: blocks are neither shuffled nor copied, and never go through
    the driver, as a broadcast of them would, which is chosen by the size of their files and is many times that in memory.
    """
    return candidates.join(queries.hint("shuffle_replicate_nl"), "dim")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of largest integer inner product, ties to the least id.

    Both tables hold whole-numbered vectors (any numeric array; |score| below 2^53). Candidates of a query are all rows of
    `vectors` with another id and as many components. Rows with a null id, or a vector that is null, empty or holds null, NaN
    or infinite components, take no part; rows with the same id count once. A query without candidates has no rows.
    """
    base = materialize(usable(vectors, id_col, vector_col).withColumn("dim", F.size("v")), "topk-base")
    asked = usable(queries, id_col, vector_col).withColumn("dim", F.size("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows, largest = base.agg(F.count(F.lit(1)), F.max(norm)).first()
    asked_rows, asked_largest = asked.agg(F.count(F.lit(1)), F.max(norm)).first()
    blocks, parts = max(1, -(-rows // CANDIDATES)), max(1, -(-asked_rows // QUERIES))
    bound = int(np.sqrt(largest or 0.0) * np.sqrt(asked_largest or 0.0)) + 1  # no score lies further from 0
    candidates = materialize(pack(base.withColumn("block", share("id", F.lit(blocks))), ["dim", "block"], "c"), "topk-candidates")
    packed = materialize(pack(asked.withColumn("part", share("id", F.lit(parts))), ["dim", "part"], "q"), "topk-queries")

    def scores(ids, v, other_ids, other_v):
        for at in range(0, len(ids), SLICE):
            s = np.rint(v[at : at + SLICE] @ other_v.T).astype(np.int64)
            s[ids[at : at + SLICE, None] == other_ids[None, :]] = -bound - 1  # the query's own row
            yield at, s

    def states(batch, row, ids):
        """Of each query of the block: low end of its interval, and scores known to lie above the interval."""
        if "s_ids" not in batch.schema.names:
            return np.full(len(ids), -bound), np.zeros(len(ids), np.int64)
        at = np.frombuffer(batch.column("s_ids")[row].as_py(), "<i8")
        state = np.frombuffer(batch.column("s_v")[row].as_py(), "<f8").reshape(len(at), 2)[np.searchsorted(at, ids)]
        return state[:, 0].astype(np.int64), state[:, 1].astype(np.int64)

    def each(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, v = unpack(batch.column("q_ids")[row].as_py(), batch.column("q_v")[row].as_py())
                other_ids, other_v = unpack(batch.column("c_ids")[row].as_py(), batch.column("c_v")[row].as_py())
                yield ids, states(batch, row, ids), scores(ids, v, other_ids, other_v), other_ids

    def with_state(state):
        if state is None:
            return _pairs(packed, candidates)
        rows = state.withColumn("v", F.array(F.col("low").cast("double"), F.col("above").cast("double"))).withColumn("part", share("id", F.lit(parts)))
        ready = packed.hint("merge").join(pack(rows, ["dim", "part"], "s"), ["dim", "part"])
        return _pairs(materialize(ready, "topk-asked"), candidates)

    dims = materialize(asked.select("id", "dim"), "topk-ids")
    width, state = 2 * bound + 1, None
    while width > 1:
        step = -(-width // BINS)

        def count(batches, step=step, width=width):
            for ids, (low, above), parts_of, _ in each(batches):
                for at, s in parts_of:
                    n = len(s)
                    bins = (s - low[at : at + n, None]) // step
                    inside = (s - low[at : at + n, None] >= 0) & (s - low[at : at + n, None] < width)
                    counts = np.bincount((np.arange(n)[:, None] * BINS + bins)[inside], minlength=n * BINS).reshape(n, BINS)
                    down = counts[:, ::-1].cumsum(1)[:, ::-1] - counts  # in higher bins
                    q, b = np.nonzero((counts > 0) & (down < (k - above[at : at + n])[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at + q]), pa.array(b.astype(np.int32)), pa.array(counts[q, b])], names=["id", "bin", "n"])

        counts = with_state(state).mapInArrow(count, "id long, bin int, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        before = Window.partitionBy("id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        old = dims.select("id", "dim", F.lit(-bound).cast("long").alias("low"), F.lit(0).cast("long").alias("above")) if state is None else state
        found = (
            counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .join(old, "id")
            .where("above + _before < %d and above + _before + n >= %d" % (k, k))
            .select("id", F.col("low").alias("_low"), (F.col("low") + F.col("bin") * step).alias("_next"), (F.col("above") + F.col("_before")).alias("_above"))
        )
        # Where fewer than k scores are left in all, the low end stays and everything is kept.
        state = old.join(found.drop("_low"), "id", "left").select("id", "dim", F.coalesce("_next", "low").alias("low"), F.coalesce("_above", "above").alias("above"))
        state = materialize(state, "topk-state")
        width = step

    def keep(batches):
        for ids, (low, above), parts_of, other_ids in each(batches):
            for at, s in parts_of:
                low_at, want = low[at : at + len(s)], (k - above[at : at + len(s)])[:, None]
                ties = s == low_at[:, None]
                kept = (s > low_at[:, None]) | ties & (ties.cumsum(1) <= want)  # candidates are in order of id
                kept &= s >= -bound
                q, c = np.nonzero(kept)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + q]), pa.array(other_ids[c]), pa.array(s[q, c])], names=["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kept = with_state(state).mapInArrow(keep, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(order))
    return kept.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
