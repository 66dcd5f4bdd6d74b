"""Byte-level BPE encoding and decoding as a monoid tree reduction.

The tokens of a string form a monoid element: two neighbours are joined by encoding a window around their border anew. The
window takes one token of either side, then twice as many on each side that doesn't hold, until the tokens outside provably stay:
a sequence is the encoding of its bytes exactly if each pair of adjacent tokens is the encoding of the pair's bytes, so it is
enough that the two pairs at the window's ends hold. A piece is cut into halves down to short leaves, which are encoded by
plain merging, and joined up the tree. Borders of pieces never merge, there the join is concatenation, up to the whole text.

Distinct units of text are encoded once per task. A unit is what lies between two spaces that have no other white space
beside them; the pattern that cuts a text into pieces always cuts there.

Decoding concatenates the bytes of tokens up the tree.
"""

from __future__ import annotations

import functools
import gc
import heapq
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandweave.llm.tokens import piece_finder, rank_file

LEAF_BYTES = 8
# Entries a cache may hold; past it the cache starts anew, results don't change.
CACHE_ENTRIES = 300_000
MEMO_ENTRIES = 100_000
TWO_BLANKS = re.compile(r"\s\s")
NONE = 1 << 60
# Longer strings than this are merged one by one.
ROW_BYTES = 64
# Texts and bytes that one Arrow batch of results may hold.
BATCH_BYTES = 4 << 20

Tokens = tuple[int, ...]


class TreeEncoder:
    """Encodes pieces by the ranks of a vocabulary; see the module's text for the method. Many pieces go up the tree together."""

    def __init__(self, ranks: dict[bytes, int], leaf_bytes: int = LEAF_BYTES):
        self.ranks, self.leaf_bytes = ranks, max(1, leaf_bytes)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.known: dict[bytes, Tokens] = {}  # of leaves and windows
        self.pairs: dict[tuple[int, int], Tokens] = {}
        made = {(ranks[t[:i]] << 32 | ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pair_keys = np.array(sorted(made), np.int64)
        self.pair_ranks = np.array([*(made[k] for k in self.pair_keys.tolist()), NONE], np.int64)
        self.byte_ranks = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        found = self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] == key
        return np.where(found, self.pair_ranks[at], NONE)

    def merge(self, text: bytes) -> Tokens:
        """Plain merging of the pair of lowest rank, the leftmost first, with a heap of pairs."""
        n, rank_of = len(text), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank_of(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not (alive[i] and end[i] == j and alive[j] and end[j] == k):
                continue  # an entry counts only while both parts stand as they were
            end[i], alive[j] = k, 0
            if k < n:
                before[k] = i
                if (r := rank_of(text[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, k, end[k]))
            if (p := before[i]) >= 0 and (r := rank_of(text[p:k])) is not None:
                heapq.heappush(heap, (r, p, i, k))
        return tuple(self.ranks[text[i : end[i]]] for i in range(n) if alive[i])

    def merge_many(self, texts: list[bytes]) -> list[Tokens]:
        """The same for many strings at once: a row for each, in which one pair is merged in each step."""
        out: list[Tokens] = [()] * len(texts)
        order = sorted((i for i, x in enumerate(texts) if len(x) <= ROW_BYTES), key=lambda i: len(texts[i]))
        for i in range(len(texts)):
            if len(texts[i]) > ROW_BYTES:
                out[i] = self.merge(texts[i])
        for at in range(0, len(order), 16384):
            rows = order[at : at + 16384]
            width = len(texts[rows[-1]])
            raw = np.frombuffer(b"".join(texts[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
            size = np.array([len(texts[i]) for i in rows])
            ids = np.where(np.arange(width) < size[:, None], self.byte_ranks[raw], -1)
            ranks = np.full((len(rows), width), NONE, np.int64)  # of each token with the next
            ranks[:, :-1] = self._ranks_of(ids[:, :-1], ids[:, 1:])
            open_rows = np.arange(len(rows))
            while len(open_rows):
                r = ranks[open_rows]
                i = r.argmin(1)
                lowest = r[np.arange(len(r)), i]
                go = lowest != NONE
                open_rows, i, lowest = open_rows[go], i[go], lowest[go]
                source = np.arange(width) + (np.arange(width) > i[:, None])
                for table, pad in ((ids, -1), (ranks, NONE)):
                    some = np.concatenate([table[open_rows], np.full((len(open_rows), 1), pad, np.int64)], 1)
                    table[open_rows] = np.take_along_axis(some, source, 1)
                ids[open_rows, i] = lowest
                size[open_rows] -= 1
                inner = i + 1 < size[open_rows]
                ranks[open_rows, i] = NONE
                at_row, at_col = open_rows[inner], i[inner]
                ranks[at_row, at_col] = self._ranks_of(ids[at_row, at_col], ids[at_row, at_col + 1])
                at_row, at_col = open_rows[i > 0], i[i > 0] - 1
                ranks[at_row, at_col] = self._ranks_of(ids[at_row, at_col], ids[at_row, at_col + 1])
            for i, n, row in zip(rows, size.tolist(), ids.tolist(), strict=True):
                out[i] = tuple(row[:n])
        return out

    def learn(self, texts: set[bytes]) -> None:
        new = list(texts - self.known.keys())
        self.known.update(zip(new, self.merge_many(new), strict=True))

    def learn_pairs(self, pairs: set[tuple[int, int]]) -> None:
        new = list(pairs - self.pairs.keys())
        self.pairs.update(zip(new, self.merge_many([self.bytes_of[a] + self.bytes_of[b] for a, b in new]), strict=True))

    def join_many(self, pairs: list[tuple[Tokens, Tokens]]) -> list[Tokens]:
        self.learn_pairs({(left[-1], right[0]) for left, right in pairs if left and right})
        out: list[Tokens] = [left + right for left, right in pairs]
        todo = [(i, 1, 1, self.pairs[left[-1], right[0]]) for i, (left, right) in enumerate(pairs) if left and right]
        while todo:
            ends = [(pairs[i][0][-a - 1 : -a] + window[:1], window[-1:] + pairs[i][1][b : b + 1]) for i, a, b, window in todo]
            self.learn_pairs({x for both in ends for x in both if len(x) == 2})
            wider = []
            for (i, a, b, window), (head, tail) in zip(todo, ends, strict=True):
                holds_left = len(head) < 2 or self.pairs[head] == head
                holds_right = len(tail) < 2 or self.pairs[tail] == tail
                left, right = pairs[i]
                if holds_left and holds_right:
                    out[i] = left[: len(left) - a] + window + right[b:]
                    continue
                a, b = a if holds_left else min(2 * a, len(left)), b if holds_right else min(2 * b, len(right))
                wider.append((i, a, b, b"".join(map(self.bytes_of.__getitem__, left[len(left) - a :] + right[:b]))))
            self.learn({x[3] for x in wider})
            todo = [(i, a, b, self.known[window]) for i, a, b, window in wider]
        return out

    def pieces(self, texts: list[bytes]) -> list[Tokens]:
        """Tokens of each match of the pattern; a piece that is itself a token stays whole."""
        if len(self.known) + len(self.pairs) > MEMO_ENTRIES:
            self.known, self.pairs = {}, {}
        out: list[Tokens] = [(r,) if (r := self.ranks.get(x)) is not None else () for x in texts]
        rows = [i for i, x in enumerate(texts) if x and not out[i]]
        depth = [max(0, (-(-len(texts[i]) // self.leaf_bytes) - 1).bit_length()) for i in rows]
        leaves = [[texts[i][k * len(texts[i]) >> d : (k + 1) * len(texts[i]) >> d] for k in range(1 << d)] for i, d in zip(rows, depth, strict=True)]
        self.learn({x for some in leaves for x in some})
        nodes = [[self.known[x] for x in some] for some in leaves]
        for _ in range(max(depth, default=0)):
            at = [n for n, some in enumerate(nodes) if len(some) > 1]
            joined = iter(self.join_many([(nodes[n][k], nodes[n][k + 1]) for n in at for k in range(0, len(nodes[n]), 2)]))
            for n in at:
                nodes[n] = [next(joined) for _ in range(len(nodes[n]) // 2)]
        for i, some in zip(rows, nodes, strict=True):
            out[i] = some[0]
        return out


@functools.cache
def text_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""
    encoder, pieces = TreeEncoder(rank_file(path)), piece_finder()
    known: dict[str, bytes] = {}  # of pieces
    later: dict[str, bytes] = {}  # of units, by what follows their space

    def learn(texts: set[str]) -> None:
        new = [x for x in texts if x not in known]
        tokens = encoder.pieces([x.encode() for x in new])
        known.update((x, np.array(ids, dtype="<u4").tobytes()) for x, ids in zip(new, tokens, strict=True))

    def encode(texts: list[str]) -> list[bytes]:
        if len(known) + len(later) > CACHE_ENTRIES:
            known.clear()
            later.clear()
        cut = [(pieces(x), ()) if TWO_BLANKS.search(x) else (pieces(units[0]), units[1:]) for x in texts for units in [x.split(" ")]]
        new = list(set().union(*(itertools.filterfalse(later.__contains__, units) for _, units in cut)))
        parts = [[" " + x] if x.isalpha() else pieces(" " + x) for x in new]
        learn(set(itertools.chain.from_iterable([*parts, *(head for head, _ in cut)])))
        ids = known.__getitem__
        later.update((x, b"".join(map(ids, some))) for x, some in zip(new, parts, strict=True))
        return [b"".join([*map(ids, head), *map(later.__getitem__, units)]) for head, units in cut]

    return encode


def _chunks(values: list[str | None], sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > BATCH_BYTES:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(values):
        yield start, len(values)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Id, and `ids`: the tokens of the whole text as little-endian unsigned 32-bit integers.

    `decoded` adds the bytes that the ids decode to, in the same pass, for round trips without a second Python worker.
    A null or empty text has no tokens (empty bytes). One row comes out for each row that goes in, repeated rows and null ids
    included; other columns are left behind. No shuffle.
    """

    def run(batches):
        encode_texts = text_encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts, [len(x or "") for x in texts]):
                gc.disable()  # millions of small tuples, none in a cycle
                ids = encode_texts([x or "" for x in texts[a:b]])
                gc.enable()
                columns = [batch.column(0)[a:b], pa.array(ids, pa.binary())]
                columns += [pa.array([decode_ids(x, path) for x in ids], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "decoded"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"`{id_col}` {kind}, ids binary" + ", decoded binary" * decoded
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, fields)


@functools.cache
def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens in a row, with each token's start and length."""
    ranks = rank_file(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    lengths = np.array([len(x) for x in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


def decode_ids(raw: bytes, path: str) -> bytes:
    """Bytes of a token sequence: level by level, each token's bytes land where those before it end."""
    joined, starts, lengths = token_table(path)
    ids = np.frombuffer(raw, "<u4").astype(np.int64)
    if not len(ids):
        return b""
    size = lengths[ids]
    ends = np.cumsum(size)
    at = np.arange(ends[-1]) - np.repeat(ends - size - starts[ids], size)
    return joined[at].tobytes()


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The encoded rows with `decoded`, the bytes of their tokens; null or empty ids give empty bytes. No shuffle."""

    def run(batches):
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for a, b in _chunks(ids, [len(x or b"") for x in ids]):
                out = [decode_ids(x or b"", path) for x in ids[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(out, pa.binary())], names=[id_col, ids_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` binary, decoded binary")
