"""N-gram Jaccard join with PartEnum signatures.

A document's set is its distinct word shingles. Sets of similar size share an instance: size bands are as wide as similar
sets can differ, and a set takes part in its own band's instance and the next. In an instance, similar sets differ in at most
k shingles. The shingle domain is cut into n1 partitions, so that one of them holds at most one of the differences, and each
into n2 parts; of each partition, the subsets of n2 - 1 parts are enumerated, and each gives a signature of the shingles in
it. Two similar sets agree in one of them. Sets that agree are candidates, and candidates are compared exactly.

Equal sets count as one node. Each node is first compared with the least node of the groups it shares, the one with which it
shares most signatures. Where a group still holds several components, its nodes are compared across components, so no link is
lost and no pairs within a component are formed: block by block of sketches, shingles cut to SHORT bits, whose common ones are an upper
bound of the common shingles, and then by text. Two rounds take the most promising pair of each two components in a block, as one link
joins them; the last takes every pair that the sketches leave.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandweave.llm.components import components
from bandweave.session import materialize, release

BLOCK, SHORT = 128, 20  # sketches compared at a time, and the bits they keep of each shingle
SEEN = 1 << 20  # nodes a task remembers, so that copies are signed once
CHUNK = 1 << 20  # bytes of text hashed at a time
ROOM = 1 << 26  # bytes that may be shuffled for a comparison before it is cut into slices, or half the texts if that is more
SLICES, MOST_SLICES = 4, 64  # of texts, which are read anew for each, and of sketches
FEW = 10_000  # pairs that need no slices

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The published splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A value for each byte, A-Z as a-z and 0 for white space; and which bytes are white space."""
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    byte = np.arange(256)
    byte[65:91] += 32
    return np.where(space, np.uint64(0), mix(byte.astype(np.uint64) + _ODD)), space


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (_ODD, inverse))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word `[^\\x20\\x09-\\x0D]+`, A-Z taken as a-z."""
    values, space = _tables()
    raw = np.frombuffer(text, np.uint8)
    gap = np.concatenate([[True], space[raw], [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    up, down = _powers(max(CHUNK, 1 << len(raw).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw] * up[: len(raw)])])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words, of the whole sequence; of no words, none."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out * _ODD + words[i : len(words) - n + 1 + i])
    return np.unique(out)


def sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Shingles of each text; several short texts are hashed at once."""
    out, at = [], 0
    coded = [(x or "").encode() for x in texts]
    while at < len(coded):
        end, size = at, 0
        while end < len(coded) and (end == at or size + len(coded[end]) < CHUNK):
            size += len(coded[end]) + 1
            end += 1
        joined = b" ".join(coded[at:end])
        words = word_hashes(joined)
        # Words of a text: those that begin before its end.
        _, space = _tables()
        gap = np.concatenate([[True], space[np.frombuffer(joined, np.uint8)]])
        starts = np.flatnonzero(gap[:-1] & ~gap[1:])
        ends = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in coded[at:end]]))
        out += [shingles(words[a:b], n) for a, b in zip([0, *ends], ends, strict=False)]
        at = end
    return out


def node_of(items: np.ndarray) -> int:
    """64-bit hash of a set."""
    return int((mix(items).sum(dtype=np.uint64) + np.uint64(len(items)) * _ODD).astype(np.int64)) if len(items) else 0


@functools.cache
def band_edges(percent: int, size: int) -> list[int]:
    """Lower ends of bands up to one beyond the band of `size`: a similar pair lies in one band or in two adjacent ones."""
    edges = [1]
    while edges[-1] <= size:
        edges.append(edges[-1] * 100 // percent + 1)
    return [*edges, edges[-1] * 100 // percent + 1]


def instances(percent: int, size: int) -> list[tuple[int, int]]:
    """(instance, most differing shingles k) of the two instances a set of this size takes part in."""
    edges = band_edges(percent, 1 << size.bit_length())
    band = int(np.searchsorted(edges, size, side="right")) - 1
    while len(edges) <= band + 2:
        edges = [*edges, edges[-1] * 100 // percent + 1]
    return [(j, 2 * (edges[j + 1] - 1) * (100 - percent) // (100 + percent)) for j in (band, band + 1)]


def signatures(items: np.ndarray, percent: int, parts: int) -> np.ndarray:
    out = []
    spread = mix(items + _ODD)
    value = mix(items ^ _ODD)
    for j, k in instances(percent, len(items)):
        n1, n2 = (k + 2) // 2, parts if k else 1
        cell = (spread % np.uint64(n1)).astype(np.int64) * n2 + ((spread >> np.uint64(40)) % np.uint64(n2)).astype(np.int64)
        sums = np.zeros(n1 * n2, np.uint64)
        np.add.at(sums, cell, value)
        sums = sums.reshape(n1, n2)
        rest = sums.sum(1, dtype=np.uint64)[:, None] - sums if n2 > 1 else sums
        tag = np.arange(n1 * n2, dtype=np.uint64).reshape(n1, n2) + np.uint64(j << 32)
        out.append(mix(rest + mix(tag)).ravel())
    return np.unique(np.concatenate(out))


def sketch(items: np.ndarray) -> bytes:
    """The last SHORT bits of each shingle, in order: how many have each value of the bits above the last 16, then the last 16 of all."""
    bits = np.sort((items & np.uint64((1 << SHORT) - 1)).astype(np.uint32))
    return np.bincount(bits >> 16, minlength=1 << SHORT - 16).astype("<u4").tobytes() + bits.astype("<u2").tobytes()


def sketched(raw: bytes) -> np.ndarray:
    """The numbers of a sketch."""
    above = 1 << SHORT - 16
    return np.repeat(np.arange(above, dtype=np.uint32) << 16, np.frombuffer(raw, "<u4", above)) | np.frombuffer(raw, "<u2", offset=4 * above)


def common(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Upper bound of the number of common shingles of each pair: members of one that the other holds, the less of both ways."""
    mark = np.zeros(1 << SHORT, bool)

    def ways(some, others):
        joined = np.concatenate(others)
        starts = np.cumsum([0, *(len(x) for x in others[:-1])])
        out = np.zeros((len(some), len(others)), np.int64)
        for i, x in enumerate(some):
            mark[x] = True
            out[i] = np.add.reduceat(mark[joined].astype(np.int64), starts)
            mark[x] = False
        return out

    return np.minimum(ways(one, two), ways(two, one).T)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, key, text: the key tells rows apart that share an id or have none."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))


def _nodes(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """doc, key, n, node of each row."""

    def run(batches):
        for batch in batches:
            found = sets(batch.column(2).to_pylist(), n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(x) for x in found], pa.int64()), pa.array([node_of(x) for x in found], pa.int64())], names=["doc", "key", "n", "node"])

    return _source(docs, id_col, text_col).mapInArrow(run, "doc long, key long, n long, node long")


def _signed(docs: DataFrame, text_col: str, n: int, percent: int, parts: int) -> DataFrame:
    """sig, node: the signatures of each set."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 256):
                known = {node: x for x in sets(texts[at : at + 256], n) if len(x) and (node := node_of(x)) not in seen}
                seen = seen | known.keys() if len(seen) < SEEN else set(known)
                signed = [signatures(x, percent, parts) for x in known.values()]
                if signed:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(signed).astype(np.int64)), pa.array(np.repeat(np.array(list(known), np.int64), [len(x) for x in signed]))], names=["sig", "node"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "sig long, node long")


def _verified(sides: DataFrame, texts: DataFrame, n: int, percent: int, slices: int = 1) -> DataFrame:
    """The pairs (a, b) whose texts are alike, from rows a, b, text_b; the texts of one slice of the nodes are moved at a time."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            kept, last, own = [], None, None
            for i in range(len(a)):
                if a[i] != last:
                    last, own = a[i], sets([left[i]], n)[0]
                if alike(own, sets([right[i]], n)[0], percent):
                    kept.append(i)
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], names=["a", "b"])

    own = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    found = []
    for i in range(slices):
        some, mine = (x.where(_of_slice("a", i, slices)) for x in (sides, own))
        links = some.join(mine, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")
        found.append(materialize(links, "jaccard-links", clean=True))
    return functools.reduce(DataFrame.unionByName, found)


def _of_slice(column: str, i: int, slices: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), column), F.lit(slices)) == i if slices > 1 else F.lit(True)


def _across(members: DataFrame, texts: DataFrame, percent: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of a group (sig, node, root, members) in different components that may be alike: the best of two components in a block, or every one.

    A group of one block meets itself where it is gathered; only blocks of larger groups are written, as each meets several. They
    are the second table, of no use once the pairs are written.
    """
    sketches = texts.select("node", "n", "cells")
    rows = F.collect_list(F.struct("node", "root", "n", "cells"))
    single = members.where(F.col("members") <= BLOCK).join(sketches, "node").groupBy("sig").agg(rows.alias("rows"))
    place = F.row_number().over(Window.partitionBy("sig").orderBy("root", "node"))
    placed = members.where(F.col("members") > BLOCK).withColumn("block", F.floor((place - 1) / BLOCK).cast("int"))
    blocks = placed.join(sketches, "node").groupBy("sig", "block").agg(rows.alias("rows"), F.min("root").alias("low"), F.max("root").alias("high"))
    blocks = materialize(blocks, "jaccard-blocks", clean=True)
    ends = blocks.select("sig", F.col("block").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"))
    grid = ends.join(ends.select("sig", F.col("i").alias("j"), F.col("low_i").alias("low_j"), F.col("high_i").alias("high_j")), "sig")
    grid = grid.where("i < j and not (low_i = high_j and low_j = high_i)").select("sig", "i", "j")
    left = blocks.select("sig", F.col("block").alias("i"), F.col("rows").alias("rows_i"))
    right = blocks.select("sig", F.col("block").alias("j"), F.col("rows").alias("rows_j"))
    both = grid.join(left, ["sig", "i"]).join(right, ["sig", "j"]).select("rows_i", "rows_j")
    alone = single.unionByName(blocks.where("low <> high").select("sig", "rows")).select(F.col("rows").alias("rows_i"))

    def columns(rows):
        numbers = [np.array([r[k] for r in rows], np.int64) for k in ("node", "root", "n")]
        return *numbers, [sketched(r["cells"]) for r in rows]

    def run(batches):
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            for one, two in zip(batch.column(0).to_pylist(), batch.column(-1).to_pylist(), strict=True):  # a block alone meets itself
                (node, root, n, cells), (node2, root2, n2, cells2) = columns(one), columns(two)
                both_hold = common(cells, cells2)
                total = n[:, None] + n2[None, :]
                gap = total - 2 * both_hold
                able = (root[:, None] != root2) & (100 * both_hold >= percent * (total - both_hold))
                i, j = np.nonzero(able)
                if not every:
                    order = np.lexsort((gap[i, j], np.maximum(root[i], root2[j]), np.minimum(root[i], root2[j])))
                    i, j = i[order], j[order]
                    low, high = np.minimum(root[i], root2[j]), np.maximum(root[i], root2[j])
                    first = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) if len(i) else np.zeros(0, bool)
                    i, j = i[first], j[first]
                found.append(np.stack([np.minimum(node[i], node2[j]), np.maximum(node[i], node2[j])], 1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long").unionByName(alone.mapInArrow(run, "a long, b long")).distinct(), blocks


def classes(docs: DataFrame, n: int = 5, percent: int = 80, parts: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, n (size of the set), node (hash of the set), component: the least id reachable by links, itself included.

    Documents link when 100 * intersection >= percent * union of their sets of distinct n-word shingles, words being
    `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. With fewer words the whole sequence is one shingle; a null text or one without
    words has an empty set and links with nothing. One row for each input row. Rows that share an id are separate documents;
    a row without an id can link others, its component is null if it links with no row that has one. Shingles and sets are
    compared by 64-bit hashes. An empty table gives an empty table.
    """
    rows = materialize(_nodes(docs, id_col, text_col, n), "jaccard-nodes", clean=True)
    spread = _signed(docs, text_col, n, percent, parts).repartition("sig").groupBy("sig", "node").agg(F.count(F.lit(1)).alias("_"))
    group = Window.partitionBy("sig")
    marked = spread.select("sig", "node", F.min("node").over(group).alias("least"), F.max("node").over(group).alias("most")).where("least <> most")
    shared = materialize(marked, "jaccard-shared", clean=True)

    least = shared.where("node <> least").groupBy("node", "least").agg(F.count(F.lit(1)).alias("n"))
    first = least.groupBy("node").agg(F.max_by("least", F.struct("n", "least")).alias("a")).select("a", F.col("node").alias("b"))
    first = materialize(first, "jaccard-pairs", clean=True)
    wanted = shared.select("node").distinct()
    led = wanted.join(first.select("a", F.col("b").alias("node")), "node", "left")
    named = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.coalesce("doc", F.lit(-1)).alias("d"), "doc", "key")).alias("s")).select("node", F.col("s.doc").alias("_doc"), F.col("s.key").alias("_key")).join(led, "node")
    source = _source(docs, id_col, text_col)
    texts = source.join(named, source["doc"].eqNullSafe(F.col("_doc")) & (source["key"] == F.col("_key"))).select("node", "a", "text")

    def own(batches):  # texts of one id and key may differ by chance; a node's copies meet in one task, which gives it once
        given: set[int] = set()
        for batch in batches:
            nodes, found = batch.column(0).to_pylist(), sets(batch.column(2).to_pylist(), n)
            kept = []
            for i, x in enumerate(found):
                if nodes[i] not in given and node_of(x) == nodes[i]:
                    given.add(nodes[i])
                    kept.append(i)
            more = [pa.array([len(found[i]) for i in kept], pa.int64()), pa.array([sketch(found[i]) for i in kept], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept, pa.int64())).columns, *more], names=["node", "a", "text", "n", "cells"])

    texts = texts.mapInArrow(own, "node long, a long, text string, n long, cells binary")
    texts = materialize(texts, "jaccard-texts", clean=True, codec="zstd")
    size, width = texts.agg(F.sum(F.octet_length("text")), F.avg(F.octet_length("cells"))).first()
    slices = min(SLICES, 1 + (size or 0) // ROOM)
    sides = texts.where("a is not null").select("a", F.col("node").alias("b"), F.col("text").alias("text_b"))
    links = _verified(sides, texts, n, percent, slices)
    tested, over = first, [rows, shared, texts, first]
    for every in (False, False, True):
        roots = materialize(components(links), "jaccard-roots", clean=True)
        labelled = shared.select("sig", "node").join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
        sums = [F.sum(F.xxhash64(F.lit(i), "node") % 1_000_000_007).alias(f"sum{i}") for i in (1, 2)]
        apart = labelled.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), *sums, F.min("node").alias("a"), F.max("node").alias("b"))
        apart = apart.where("low <> high").groupBy("n", "sum1", "sum2", "a", "b").agg(F.min("sig").alias("sig"))  # groups of the same members once
        apart = materialize(apart.join(tested.select("a", "b", F.lit(2).cast("long").alias("n")), ["a", "b", "n"], "left_anti").select("sig", F.col("n").alias("members")), "jaccard-apart", clean=True)
        gathered = (apart.agg(F.sum("members")).first()[0] or 0) * (width or 0)  # bytes of sketches, a group's members side by side
        many = min(MOST_SLICES, 1 + int(gathered / max(ROOM, (size or 0) / 2)))
        pairs = []
        for i in range(many):
            found, blocks = _across(labelled.join(apart.where(_of_slice("sig", i, many)), "sig"), texts, percent, every)
            pairs.append(materialize(found.join(tested, ["a", "b"], "left_anti"), "jaccard-pairs", clean=True))
            release(blocks)
        over += pairs
        if many > 1:
            pairs.append(materialize(functools.reduce(DataFrame.unionByName, pairs).distinct(), "jaccard-pairs", clean=True))
            over.append(pairs[-1])
        for table in (apart, roots):
            release(table)
        sides = pairs[-1].join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        more = _verified(sides, texts, n, percent, slices if pairs[-1].count() > FEW else 1)
        links, tested = links.unionByName(more), tested.unionByName(pairs[-1])
    linked = components(links)

    found = rows.join(linked, "node", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "node")))
    found = materialize(found, "jaccard-found", clean=True)
    for table in over:
        release(table)
    least = found.where("root is not null").groupBy("root").agg(F.min("doc").alias("component"))
    return found.join(least, "root", "left").select("doc", "n", "node", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")).alias("component"))
