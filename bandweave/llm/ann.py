"""Approximate nearest neighbours by cosine: an adaptive scan of dimensions within probed lists.

The index cuts the unit vectors into lists around centroids, fitted on a bounded sample; every row is in one list. Vectors are
rotated at random, so that a distance over the first dimensions estimates the whole distance. A query scans the lists nearest
to it, block of columns by block of columns. After each block a hypothesis test compares the partial distance with the
query's current kth distance and abandons candidates that are beyond it but for a small probability. What is left is scored
exactly on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandweave.llm.blocks import pack, share, unpack, usable
from bandweave.session import materialize

# Rows that the centroids are fitted on, rows of one block, columns of one block, rows scanned at a time.
SAMPLE, ROWS, QUERIES, COLUMNS, SLICE = 10_000, 4096, 1024, 16, 512
# Most lists of an index: bounds what is sent to tasks.
LISTS = 4096
# Standard deviations of the test; 2.1 is the published setting.
CERTAINTY = 2.1
# Share of the lists a query scans. Random vectors have neighbours in half of all lists; clustered ones need far fewer.
PROBES = 0.75


def centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means on a bounded sample of unit vectors; a list that runs empty keeps its centroid."""
    out = sample[np.random.default_rng(seed).choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + 4096] @ out.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(out)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1)
        out[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return out


def rotation(dim: int, seed: int = 9) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scan(asked: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, turn: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, candidate row, cosine) of what may be among the k nearest of each query in one block."""
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    q, c = unit(asked) @ turn, unit(rows) @ turn
    dim = q.shape[1]
    best = np.full((len(q), k), np.inf)  # squared distances so far, ascending
    out = []
    for at in range(0, len(c), SLICE):
        some = c[at : at + SLICE]
        limit = best[:, -1]
        first = min(COLUMNS, dim)
        part = (q[:, :first] ** 2).sum(1)[:, None] + (some[:, :first] ** 2).sum(1)[None] - 2 * q[:, :first] @ some[:, :first].T
        alive = part <= (limit * first / dim * (1 + CERTAINTY / np.sqrt(first)) ** 2)[:, None]
        alive &= own[:, None] != ids[None, at : at + SLICE]
        i, j = np.nonzero(alive)
        far = part[i, j]
        for col in range(first, dim, COLUMNS):
            end = min(col + COLUMNS, dim)
            far = far + ((q[i, col:end] - some[j, col:end]) ** 2).sum(1)
            stay = far <= limit[i] * end / dim * ((1 + CERTAINTY / np.sqrt(end)) ** 2 if end < dim else 1.0 + 1e-9) + 1e-12
            i, j, far = i[stay], j[stay], far[stay]
        table = np.full((len(q), len(some)), np.inf)
        table[i, j] = far
        best = np.sort(np.concatenate([best, np.partition(table, min(k, len(some)) - 1, axis=1)[:, :k]], 1), axis=1)[:, :k]
        out.append((i, j + at, far))
    i, j, far = (np.concatenate(x) for x in zip(*out))
    stay = far <= best[i, -1] * (1 + 1e-9) + 1e-12
    i, j = i[stay], j[stay]
    a, b = asked[i], rows[j]
    cosine = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
    order = np.lexsort((ids[j], -cosine, i))
    i, j, cosine = i[order], j[order], cosine[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], cosine[place < k]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, probes: float = PROBES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: k candidates of largest cosine, ties to the least id.

    Candidates of a query are the rows of `vectors` with another id. Rows with a null id, or a vector that is null, empty,
    zero or holds null, NaN or infinite components, take no part; rows with the same id count once; vectors of another length
    than most of the sample take no part either. A query scans its nearest lists: `probes` of all, and more where those hold
    no k rows. Fewer rows come out only if there are fewer candidates.
    """
    some_part = lambda df: usable(df, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    base = materialize(some_part(vectors), "ann-base")
    sample = base.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(SAMPLE).collect()
    if not sample:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = [len(r.v) for r in sample]
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n))
    fitted = np.array([r.v for r in sample if len(r.v) == dim])
    fitted /= np.linalg.norm(fitted, axis=1)[:, None]
    base, asked = base.where(F.size("v") == dim), some_part(queries).where(F.size("v") == dim)
    lists = int(min(LISTS, len(fitted), max(1, np.sqrt(base.count()) / 2)))
    centres, turn = centroids(fitted, lists), rotation(dim)

    def assign(batches):
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            near = np.concatenate([(v[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(v), 4096)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(near.astype(np.int32))], names=["id", "v", "list"])

    rows = materialize(base.select("id", "v").mapInArrow(assign, "id long, v array<double>, list int"), "ann-lists")
    filled = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(lists, np.int64)
    for r in filled.collect():  # at most LISTS rows
        counts[r["list"]] = r["n"]
    most = max(1, int(np.ceil(probes * lists)))

    def probe(batches):
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for at in range(0, len(v), 1024):
                order = np.argsort(-(v[at : at + 1024] @ centres.T), axis=1, kind="stable")
                enough = np.cumsum(counts[order], 1) - counts[order] <= k  # one row more than k, its own may be among them
                q, place = np.nonzero((np.arange(lists) < most) | enough)
                take = pa.array(at + q)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("v").take(take), pa.array(order[q, place].astype(np.int32))], names=["id", "v", "list"])

    probed = asked.select("id", "v").mapInArrow(probe, "id long, v array<double>, list int")
    split = F.broadcast(filled.select("list", F.ceil(F.col("n") / ROWS).alias("_parts")))  # at most LISTS rows
    packed = pack(rows.join(split, "list").withColumn("block", share("id", F.col("_parts"))), ["list", "block"], "c")
    parts = max(1, -(-asked.count() // QUERIES))
    asked_packed = pack(probed.withColumn("part", share("id", F.lit(parts))), ["list", "part"], "q")

    def search(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                own, a = unpack(batch.column("q_ids")[row].as_py(), batch.column("q_v")[row].as_py())
                ids, b = unpack(batch.column("c_ids")[row].as_py(), batch.column("c_v")[row].as_py())
                i, j, cosine = scan(a, own, b, ids, k, turn)
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[j]), pa.array(cosine)], names=["query_id", "vec_id", "score"])

    found = packed.join(asked_packed, "list").select("q_ids", "q_v", "c_ids", "c_v").mapInArrow(search, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
