"""Exact near-duplicate join of word shingles, searched by R-trees over group-count vectors.

A document is the set of its distinct shingles.  Two link when their Jaccard
similarity reaches the threshold ``num / 100``.

1. *Route.*  Under any one order of all shingles, linked sets share a shingle
   among the first ``n - ceil(n * num / 100) + 1`` of both.  The order is by
   hash, with frequent shingles last, so common passages seldom route.  A task
   meets the documents of one shingle: a *bucket*.
2. *Connect.*  Documents of a bucket are checked against its smallest, which
   joins large groups of copies by a number of checks linear in their size.
3. *Search.*  What is left are buckets with documents of several components.
   In each, an R-tree over count vectors (shingles hashed to groups, a count for
   each group) finds for every document those of other components whose overlap
   can suffice: the sum of the coordinates' minima bounds it from above, for a
   pair as for a node, by the node's largest counts.  The tree is loaded in bulk,
   by size bands and within them by like contents, and all documents descend at
   once.  Vectors have four times as many groups as shingles, so that a node of a
   few unrelated documents still excludes most others.
4. *Verify.*  Surviving pairs are compared on their whole texts.

No step drops a pair that may link: order, components and bounds only save work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm import words
from canopy.llm.common import lean, materialise, scratch, ship_code
from canopy.llm.components import connected_components


@dataclass(frozen=True)
class JaccardConfig:
    """Parameters.  Only width and num change results; the others trade work."""

    width: int = 5
    num: int = 75
    #: A shingle counted in about so many documents is ordered last.
    frequent: int = 48
    #: Most frequent shingles known to every task: 8 bytes each, which bounds the broadcast.
    frequent_known: int = 1_000_000
    #: One in so many shingles that a partition holds once is counted, with that weight.
    single_weight: int = 32
    #: Rows of a frequent shingle that one task meets before its bucket is salted.
    salt_rows: int = 200_000
    #: Bytes of count vectors that one search task holds, about; a bucket of more is split by size bands.
    block_bytes: int = 16 << 20
    #: Documents in one block of the verification: a task holds the sets of two at a time.
    verify_block: int = 128
    #: Entries of a node of the R-tree.
    leaf: int = 8
    #: Candidate ids that may be broadcast (8 bytes each); beyond, they are joined by shuffling.
    broadcast_ids: int = 1_000_000
    #: Pairs that a search task tests and gives out at once, and those that it remembers so as to give each out once (8 bytes each; repeats beyond are merged after the search).
    bulk_pairs: int = 200_000
    seen_pairs: int = 4_000_000
    pivot_rounds: int = 2


def needed_overlap(sizes: np.ndarray, num: int) -> np.ndarray:
    """The least intersection of two sets of ``sizes`` members together that links them."""
    return -(-num * sizes // (100 + num))


def prefix_length(n: int, num: int) -> int:
    return n - -(-num * n // 100) + 1


#: A group's count is stored in two bits: this stands for itself and any larger count.
FULL = 3


def groups_for(n: int) -> int:
    """Groups of a document's count vector: a power of two near four times its number of shingles, 64 to 65536."""
    return 1 << int(np.clip(round(float(np.log2(4 * max(n, 1)))), 6, 16))


def count_vector(shingles: np.ndarray, n: int) -> bytes:
    """Shingles in each group, four groups a byte."""
    g = groups_for(n)
    counts = np.minimum(np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (g - 1), minlength=g), FULL).astype(np.uint8)
    return (counts[0::4] | (counts[1::4] << 2) | (counts[2::4] << 4) | (counts[3::4] << 6)).tobytes()


def unpack(vectors: list[bytes]) -> np.ndarray:
    """The counts of vectors of one length, a row each."""
    raw = np.frombuffer(b"".join(vectors), np.uint8).reshape(len(vectors), -1)
    return ((raw[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(len(vectors), -1)


def shingle_sets(column: pa.Array, c: JaccardConfig) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for _, _, data, bounds in words.utf8_chunks(column):
        s, e, first = words.word_spans(data, bounds)
        hashes, at = words.shingle_hashes(words.word_hashes(data, s, e), first, c.width)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield np.unique(hashes[i:j])


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit key of a whole set: equal sets have equal keys."""
    return int(words.mix64(words.mix64(shingles).sum(keepdims=True) + np.uint64(len(shingles)))[0].view(np.int64)) if len(shingles) else 0


def _describe(docs: DataFrame, c: JaccardConfig) -> DataFrame:
    """One row a document (kind 0: doc_id, node, n, vector) and partial counts of shingles (kind 1: shingle, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "node", "n", "vector"]
        held: list[np.ndarray] = []
        size = 0

        def counts() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            # A fair choice of the singles: by shingle and partition together.
            salt = found[0]
            drawn = words.mix64(found ^ salt) % np.uint64(c.single_weight) == 0
            n = np.where(n > 1, n, np.where(drawn, c.single_weight, 0))
            found, n = found[n > 0], n[n > 0]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int8)), pa.array(found.view(np.int64)), pa.nulls(len(n), pa.int64()), pa.array(n.astype(np.int64)), pa.nulls(len(n), pa.binary())], names=names)

        for batch in batches:
            ids, keys, ns, vectors = batch.column(0), [], [], []
            for x in shingle_sets(batch.column(1), c):
                keys.append(set_key(x))
                ns.append(len(x))
                vectors.append(count_vector(x, len(x)) if len(x) else None)
                held.append(x)
                size += len(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ns), np.int8)), ids, pa.array(keys, pa.int64()), pa.array(ns, pa.int64()), pa.array(vectors, pa.binary())], names=names)
            if size >= 1 << 20:
                yield counts()
                held, size = [], 0
        if size:
            yield counts()

    return docs.select("doc_id", "text").mapInArrow(lean(run), "kind byte, id long, node long, n long, vector binary")


def _frequent(counted: DataFrame, c: JaccardConfig) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts: at most ``frequent_known``."""
    top = counted.groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= c.frequent).orderBy(F.col("n").desc(), "id").limit(c.frequent_known).toArrow()
    found = top["id"].to_numpy().view(np.uint64)
    order = np.argsort(found)
    return found[order], top["n"].to_numpy()[order]


def _route(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], c: JaccardConfig) -> DataFrame:
    """(shingle, salt, node, n): each set under the first shingles of its order; equal sets of a partition once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        salts = 1 + counts // c.salt_rows
        seen: set[int] = set()
        for batch in batches:
            shingles, nodes, ns = [], [], []
            for x in shingle_sets(batch.column(0), c):
                if not len(x) or (node := set_key(x)) in seen:
                    continue
                seen.add(node)
                take = prefix_length(len(x), c.num)
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    common = known[at] == x
                    first = x[~common][:take]
                    if len(first) < take:
                        first = np.concatenate([first, x[common][: take - len(first)]])
                else:
                    first = x[:take]
                shingles.append(first)
                nodes.append(node)
                ns.append(len(x))
            times = [len(s) for s in shingles]
            flat = np.concatenate(shingles) if shingles else np.zeros(0, np.uint64)
            node = np.repeat(np.array(nodes, np.int64), times)
            salt = np.full(len(flat), -1, np.int32)
            if len(known) and salts.max() > 1:
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                of = np.where(known[at] == flat, salts[at], 1).astype(np.int64)
                salt = np.where(of > 1, (words.mix64(node.view(np.uint64)) % of.astype(np.uint64)).astype(np.int64), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(salt), pa.array(node), pa.array(np.repeat(np.array(ns, np.int64), times))], names=["shingle", "salt", "node", "n"])

    return docs.select("text").mapInArrow(lean(run), "shingle long, salt int, node long, n long")


def _shared_buckets(routed: DataFrame) -> DataFrame:
    """The routed rows of shingles that several sets have, each set once, with the bucket's smallest set as pivot.

    Rows stream by in the order of (shingle, node), so a bucket of any size passes
    through without being held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shingle", "node", "n", "pivot", "pivot_n"]
        held: np.ndarray | None = None  # the open bucket's pivot, not yet given out
        open_shingle, pivot, pivot_n, last_node = None, 0, 0, 0
        for batch in batches:
            s, salt, node, n = (batch.column(k).to_numpy() for k in range(4))
            if not len(s):
                continue
            new_shingle = np.r_[s[0] != open_shingle, s[1:] != s[:-1]]
            keep = new_shingle | np.r_[node[0] != last_node, node[1:] != node[:-1]]
            new_last = int(node[-1])
            s, salt, node, n, new_shingle = s[keep], salt[keep], node[keep], n[keep], new_shingle[keep]
            if held is not None and len(s) and not new_shingle[0]:
                s, salt, node, n, new_shingle = np.r_[held[0], s], np.r_[-1, salt], np.r_[held[1], node], np.r_[held[2], n], np.r_[True, new_shingle]
            last_node = new_last
            if not len(s):
                continue
            held = None
            carried = not new_shingle[0]
            start = np.flatnonzero(new_shingle)
            if carried:
                start = np.r_[0, start]
            size = np.diff(np.r_[start, len(s)])
            p, pn = np.repeat(node[start], size), np.repeat(n[start], size)
            if carried:
                p[: size[0]], pn[: size[0]] = pivot, pivot_n
            single = np.repeat(size == 1, size)
            if carried:
                single[: size[0]] = False
            # A salted bucket goes on in other tasks: its rows stay even where they are alone.
            single &= salt < 0
            open_shingle, pivot, pivot_n = s[-1], int(p[-1]), int(pn[-1])
            if single[-1]:
                held = np.array([s[-1], node[-1], n[-1]])
            k = ~single
            yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (s, node, n, p, pn)], names=names)

    rows = routed.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "node")
    return rows.mapInArrow(lean(run), "shingle long, node long, n long, pivot long, pivot_n long")


def _size_fits(a: str, b: str, num: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * num


def overlap_bounds(a: np.ndarray, b: np.ndarray, over_a: np.ndarray, over_b: np.ndarray) -> np.ndarray:
    """Upper bounds of |A & B| for rows of count vectors: the sums of coordinate minima.

    over: how many shingles a vector's full groups hold beyond what is stored; the
    lesser one of a pair may be common too.
    """
    return np.minimum(a, b).sum(1, dtype=np.int64) + np.minimum(over_a, over_b)


def fold(vectors: np.ndarray, g: int) -> np.ndarray:
    """Count vectors over fewer groups."""
    return vectors if vectors.shape[1] == g else vectors.reshape(len(vectors), -1, g).sum(1, dtype=np.uint8)


def size_band(n: np.ndarray, num: int) -> np.ndarray:
    """Sets that may link lie in one band or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / band_width(num)).astype(np.int64)


def band_width(num: int) -> float:
    """A little more than the largest ratio of sizes that links, as a logarithm: rounding mustn't part such sets by two bands."""
    return max(1e-3, math.log(100 / num) * (1 + 1e-6))


class CountTree:
    """An R-tree over count vectors of one bucket; a node has its documents' largest counts, sizes and components.

    Bulk loading sorts by size band and then by the least few of the occupied
    groups under fixed permutations, which copies of a text share.
    """

    def __init__(self, points: np.ndarray, n: np.ndarray, root: np.ndarray, block: np.ndarray, num: int, leaf: int):
        rng = np.random.RandomState(7)
        keys = []
        for _ in range(3):
            rank, least = rng.permutation(points.shape[1]).astype(np.int32), np.empty(len(points), np.int32)
            step = max(1, (1 << 20) // points.shape[1])
            for at in range(0, len(points), step):
                least[at : at + step] = np.where(points[at : at + step] > 0, rank, len(rank)).min(1)
            keys.append(least)
        self.order = np.lexsort((*keys[::-1], size_band(n, num)))
        self.points, self.n, self.root, self.block = points[self.order], n[self.order], root[self.order], block[self.order]
        self.over = self.n - self.points.sum(1, dtype=np.int64)
        self.num, self.leaf = num, leaf
        # From the points upwards: (largest counts, excess, sizes and components from and to, blocks from and to).
        level = (self.points, self.over, self.n, self.n, self.root, self.root, self.block, self.block)
        self.levels = [level]
        while len(level[0]) > leaf:
            at = np.arange(0, len(level[0]), leaf)
            level = tuple((np.minimum if k in (2, 4, 6) else np.maximum).reduceat(x, at, axis=0) for k, x in enumerate(level))
            self.levels.append(level)
        #: Bounds computed at each level from the top, and how many let the search go on.
        self.tested, self.passed = [0] * len(self.levels), [0] * len(self.levels)

    def join(self, two: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points (indices as given) of different components whose overlap may suffice; of different blocks if ``two``."""
        step = max(1, (1 << 22) // self.points.shape[1])
        for at in range(0, len(self.n), step):
            p = np.arange(at, min(len(self.n), at + step))
            top = len(self.levels[-1][0])
            yield from self._descend(np.repeat(p, top), np.tile(np.arange(top), len(p)), len(self.levels) - 1, two, step)

    def _descend(self, p: np.ndarray, node: np.ndarray, k: int, two: bool, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(p), step):
            q, m = p[at : at + step], node[at : at + step]
            most, over, low, high, first, last, block, to_block = (x[m] for x in self.levels[k])
            n = self.n[q]
            # What comes before a point in the tree's order has met it already.
            go = (np.minimum((m + 1) * self.leaf**k, len(self.n)) - 1 > q) & (low * self.num <= n * 100) & (high * 100 >= n * self.num)
            go &= (first != self.root[q]) | (last != self.root[q])
            if two:
                go &= (block != self.block[q]) | (to_block != self.block[q])
            q, m, n = q[go], m[go], n[go]
            self.tested[-1 - k] += len(q)
            fits = overlap_bounds(most[go], self.points[q], over[go], self.over[q]) >= needed_overlap(n + np.maximum(low[go], -(-n * self.num // 100)), self.num)
            q, m = q[fits], m[fits]
            self.passed[-1 - k] += len(q)
            if not len(q):
                continue
            if not k:
                yield self.order[q], self.order[m]
                continue
            below = len(self.levels[k - 1][0])
            child = m[:, None] * self.leaf + np.arange(self.leaf)
            inside = child < below
            yield from self._descend(np.repeat(q, inside.sum(1)), child[inside], k - 1, two, step)


class Vectors:
    """The count vectors of a search task, unpacked once, as one matrix for each number of groups."""

    def __init__(self, packed: dict[int, bytes]):
        self.nodes = np.array(sorted(packed), np.int64)
        vectors = [packed[x] for x in self.nodes.tolist()]
        self.groups = 4 * np.array([len(v) for v in vectors], np.int64)
        self.row, self.matrix = np.zeros(len(vectors), np.int64), {}
        for g in np.unique(self.groups).tolist():
            own = np.flatnonzero(self.groups == g)
            self.row[own] = np.arange(len(own))
            self.matrix[g] = unpack([vectors[i] for i in own])
        #: The same over an eighth of the groups, which excludes most pairs at an eighth of the cost.
        self.coarse = {g: fold(m, g // 8) for g, m in self.matrix.items()}

    def find(self, node: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.nodes, node)

    def take(self, at: np.ndarray, g: int, coarse: bool = False) -> np.ndarray:
        """The vectors of documents that have one number of groups, over g groups."""
        return fold((self.coarse if coarse else self.matrix)[int(self.groups[at[0]])][self.row[at]], g)


def _may_link(v: Vectors, i: np.ndarray, j: np.ndarray, ni: np.ndarray, nj: np.ndarray, c: JaccardConfig) -> np.ndarray:
    """Which pairs of documents have count vectors whose overlap may suffice."""
    keep = np.zeros(len(i), bool)
    shape = v.groups[i] * (1 << 20) + v.groups[j]
    for x in np.unique(shape).tolist():
        rows = np.flatnonzero(shape == x)
        full = int(min(v.groups[i[rows[0]]], v.groups[j[rows[0]]]))
        for coarse, g in ((True, full // 8), (False, full)):
            step, fits = max(1, (1 << 22) // g), []
            for k in range(0, len(rows), step):
                at = rows[k : k + step]
                p, q = v.take(i[at], g, coarse), v.take(j[at], g, coarse)
                over = (n[at] - m.sum(1, dtype=np.int64) for n, m in ((ni, p), (nj, q)))
                fits.append(overlap_bounds(p, q, *over) >= needed_overlap(ni[at] + nj[at], c.num))
            rows = rows[np.concatenate(fits)] if fits else rows
        keep[rows] = True
    return keep


def _tree_pairs(v: Vectors, at: np.ndarray, n: np.ndarray, root: np.ndarray, block: np.ndarray, c: JaccardConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket's documents (places in it) in different components whose overlap may suffice; across blocks where it has two."""
    two, groups = bool(block.min() != block.max()), v.groups[at]
    # Sets that may link differ in groups by a factor of two at most: one tree for each number of groups, with the next.
    for g in np.unique(groups).tolist():
        own, twice = np.flatnonzero(groups == g), np.flatnonzero(groups == 2 * g)
        inside = np.concatenate([own, twice])
        if len(inside) < 2:
            continue
        points = np.concatenate([v.take(at[x], g) for x in (own, twice) if len(x)])
        tree = CountTree(points, n[inside], root[inside], block[inside], c.num, c.leaf)
        for i, j in tree.join(two):
            here = (i < len(own)) | (j < len(own))  # others meet in their own tree
            yield inside[i[here]], inside[j[here]]


def _search_buckets(rows: DataFrame, sets: DataFrame, c: JaccardConfig) -> DataFrame:
    """(home, shingle, lo, hi, block, node, n, root) -> candidate pairs (a, b, home).

    Buckets with one home meet in a task, which gets each document's count vector
    once.  A bucket of more documents than a node holds is searched by a tree; the
    pairs of smaller ones, which repeat from bucket to bucket, are tested once, in
    bulk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "home"]
        packed: dict[int, bytes] = {}
        table: Vectors | None = None
        at: tuple[int, ...] | None = None
        bucket: tuple | None = None
        held: list[list[np.ndarray]] = []
        pending: list[tuple[np.ndarray, ...]] = []  # places in the table, sizes, whether tested
        waiting = 0
        seen = np.zeros(0, np.int64)
        found: list[tuple[np.ndarray, np.ndarray, int]] = []

        def offer(i: np.ndarray, j: np.ndarray, ni: np.ndarray, nj: np.ndarray, tested: bool) -> None:
            nonlocal waiting
            low = i < j
            pending.append((np.where(low, i, j), np.where(low, j, i), np.where(low, ni, nj), np.where(low, nj, ni), np.full(len(i), tested)))
            waiting += len(i)
            if waiting > c.bulk_pairs:
                give()

        def search() -> None:
            """The open bucket, now that it is whole."""
            nonlocal table
            if not held:
                return
            table = table or Vectors(packed)
            node, n, root, block = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            place = table.find(node)
            if len(node) > c.leaf:
                for i, j in _tree_pairs(table, place, n, root, block, c):
                    offer(place[i], place[j], n[i], n[j], True)
                return
            i, j = np.triu_indices(len(node), 1)
            k = (root[i] != root[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * c.num)
            if block.min() != block.max():
                k &= block[i] != block[j]
            if k.any():
                offer(place[i[k]], place[j[k]], n[i[k]], n[j[k]], False)

        def give() -> None:
            """The pending pairs that are new and, where a tree hasn't tested them, may link."""
            nonlocal waiting, seen
            if not pending:
                return
            i, j, ni, nj, ok = (np.concatenate(x) for x in zip(*pending, strict=True))
            pending.clear()
            waiting = 0
            if not len(i):
                return
            key = i * len(table.nodes) + j
            order = np.lexsort((~ok, key))
            first = order[np.r_[True, key[order][1:] != key[order][:-1]]]
            first = first[~np.isin(key[first], seen, assume_unique=True)]
            if len(seen) < c.seen_pairs:
                seen = np.concatenate([seen, key[first]])
            i, j, ni, nj, ok = i[first], j[first], ni[first], nj[first], ok[first]
            rest = np.flatnonzero(~ok)
            ok[rest] = _may_link(table, i[rest], j[rest], ni[rest], nj[rest], c)
            found.append((table.nodes[i[ok]], table.nodes[j[ok]], at[0]))

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            home = np.repeat(np.array([x[2] for x in found], np.int64), [len(x[0]) for x in found])
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(home)], names=names)

        for batch in batches:
            key = [batch.column(k).to_numpy() for k in range(3)]
            vector_row = np.array(batch.column(3).is_null())
            shingle = batch.column(3).fill_null(0).to_numpy()
            rest = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4, 8)]
            edge = np.flatnonzero(np.any([x[1:] != x[:-1] for x in (*key, vector_row, shingle)], axis=0)) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
                if i == j:
                    continue
                here = tuple(int(x[i]) for x in key)
                own = (here, bool(vector_row[i]), int(shingle[i]))
                if own != bucket:
                    search()
                    bucket = own
                if here != at:
                    give()
                    at, packed, table, seen = here, {}, None, seen[:0]
                if vector_row[i]:
                    packed.update(zip(rest[0][i:j].tolist(), batch.column(8).slice(i, j - i).to_pylist(), strict=True))
                else:
                    held.append([x[i:j] for x in rest])
            yield out()
        search()
        give()
        yield out()

    keys, none = ["home", "lo", "hi"], F.lit(None).cast("long")
    members = rows.select(*keys, "node").distinct().join(sets.select("node", "vector"), "node")
    zero = F.lit(0).cast("long")
    members = members.select(*keys, none.alias("shingle"), "node", zero.alias("n"), zero.alias("root"), zero.alias("block"), "vector")
    both = members.unionAll(rows.select(*keys, "shingle", "node", "n", "root", "block", F.lit(None).cast("binary").alias("vector")))
    pairs = both.repartition(*keys).sortWithinPartitions(*keys, F.col("shingle").asc_nulls_first(), "n", "node").mapInArrow(lean(run), "a long, b long, home long")
    return pairs.groupBy("a", "b").agg(F.min("home").alias("home"))


def _verify(pairs: DataFrame, texts: DataFrame, c: JaccardConfig) -> DataFrame:
    """Of the pairs of (a, b, home) whose whole texts link those that join documents not joined yet.

    Sets of one home lie in blocks of about ``verify_block``; a text is sent once to
    each pair of blocks that needs it, not once a pair.  A pair whose ends earlier
    pairs of its task have joined is passed over: it changes no component.
    """
    ends = pairs.select(F.col("a").alias("node"), "home").unionAll(pairs.select(F.col("b").alias("node"), "home")).groupBy("node").agg(F.min("home").alias("home"))
    sizes = ends.groupBy("home").agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / c.verify_block).cast("long"))
    blocks = materialise(ends.join(sizes, "home").select("node", F.xxhash64("home", part).alias("block")), "blocks")
    placed = pairs.select("a", "b").join(blocks.toDF("a", "_x"), "a").join(blocks.toDF("b", "_y"), "b").select("a", "b", F.least("_x", "_y").alias("lo"), F.greatest("_x", "_y").alias("hi"))
    placed = materialise(placed, "placed")
    wanted = placed.select("lo", "hi", F.col("a").alias("node")).unionAll(placed.select("lo", "hi", F.col("b").alias("node"))).distinct()
    rows = wanted.join(texts, "node").select("lo", "hi", "node", F.lit(None).cast("long").alias("other"), "text")
    rows = rows.unionAll(placed.select("lo", "hi", F.col("a").alias("node"), F.col("b").alias("other"), F.lit(None).cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        held: dict[int, np.ndarray] = {}
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for batch in batches:
            linked: list[tuple[int, int]] = []
            columns = (batch.column(k).to_pylist() for k in range(4))
            for lo, hi, node, other, own in zip(*columns, shingle_sets(batch.column(4), c), strict=True):
                if at != (lo, hi):
                    at, held, parent = (lo, hi), {}, {}
                if other is None:
                    held[node] = own
                    continue
                if (p := top(node)) == (q := top(other)):
                    continue
                x, y = held[node], held[other]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= c.num * (len(x) + len(y) - both):
                    parent[p] = q
                    linked.append((node, other))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in linked], pa.int64()), pa.array([p[1] for p in linked], pa.int64())], names=["a", "b"])

    return rows.repartition("lo", "hi").sortWithinPartitions("lo", "hi", F.col("other").asc_nulls_first()).mapInArrow(lean(run), "a long, b long")


def _vector_bytes(n: str) -> Column:
    return F.least(F.greatest(F.col(n), F.lit(16)), F.lit(16384))


def _placed(rows: DataFrame, c: JaccardConfig) -> DataFrame:
    """(shingle, node, n, root, home) -> (home, shingle, lo, hi, block, node, n, root): the tasks that search the buckets.

    Buckets of one home meet in as many tasks as their vectors need, each bucket in
    one.  A bucket too large for a task is dealt out by size bands, each document
    to its own and the one below, where those it may link with are; a band that is
    still too large in blocks, each pair of which is a task.
    """
    zero = F.lit(0).cast("long")
    sizes = materialise(rows.groupBy("home", "shingle").agg(F.sum(_vector_bytes("n")).alias("_bytes")), "sizes")
    of_home = sizes.filter(F.col("_bytes") <= c.block_bytes).groupBy("home").agg(F.sum("_bytes").alias("_all"))
    hot = sizes.filter(F.col("_bytes") > c.block_bytes).select("home", "shingle")
    small = sizes.filter(F.col("_bytes") <= c.block_bytes).join(of_home, "home").select("home", "shingle", F.pmod(F.xxhash64("shingle"), F.ceil(F.col("_all") / c.block_bytes).cast("long")).alias("lo"))
    out = rows.join(small, ["home", "shingle"]).select("home", "shingle", "lo", F.col("lo").alias("hi"), zero.alias("block"), "node", "n", "root")
    if hot.isEmpty():
        return out
    band = F.floor(F.ln(F.greatest("n", F.lit(1))) / band_width(c.num)).cast("long")
    dealt = rows.join(hot, ["home", "shingle"]).withColumn("_band", F.explode(F.array(band, band - 1))).withColumn("home", F.xxhash64("home", "shingle", "_band"))
    dealt = materialise(dealt.select("home", "shingle", "node", "n", "root"), "dealt")
    blocks = dealt.groupBy("home", "shingle").agg(F.ceil(F.sum(_vector_bytes("n")) / c.block_bytes).cast("long").alias("_blocks"))
    dealt = dealt.join(blocks, ["home", "shingle"]).withColumn("block", F.pmod(F.xxhash64("node"), "_blocks"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    return out.unionByName(dealt.select("home", "shingle", F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi"), "block", "node", "n", "root"))


def near_duplicates(docs: DataFrame, config: JaccardConfig | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id: the smallest doc_id reachable by links.

    Whole texts.  A text without words (or null) has no shingles, links with
    nothing and is its own component.  Equal sets always link.  Repeated rows each
    get a row; a null doc_id links like any other but never names a component
    (a component of null ids only has a null component_id).
    """
    c = config or JaccardConfig()
    ship_code(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = materialise(_describe(docs, c), "shingles")
    rows = described.filter("kind = 0").select(F.col("id").alias("doc_id"), "node", "n", "vector")
    sets = materialise(rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("vector").alias("vector")), "sets")
    frequent = _frequent(described.filter("kind = 1"), c)
    buckets = materialise(_shared_buckets(_route(docs, frequent, c)), "buckets")

    def texts_of(pairs: DataFrame) -> DataFrame:
        """(node, text) of the sets in pairs."""
        nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
        ids = materialise(nodes.join(sets.select("node", "rep"), "node"), "wanted")
        small = ids.limit(c.broadcast_ids + 1).count() <= c.broadcast_ids
        wanted = ids.select("node", F.col("rep").alias("_rep"))
        found = docs.join(F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("_rep"))).select("node", "text")

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # An id may be repeated, or null: only a text with the set's key is its own.
            for batch in batches:
                keys = [set_key(x) for x in shingle_sets(batch.column(1), c)]
                yield batch.filter(pa.array(batch.column(0).to_numpy() == np.array(keys, np.int64)))

        return found.mapInArrow(lean(own), "node long, text string").dropDuplicates(["node"])

    def bounded(pairs: DataFrame) -> DataFrame:
        """The pairs whose count vectors allow a link."""
        x = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("vector").alias("va"))
        y = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("vector").alias("vb"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                na, nb = (batch.column(k).to_numpy() for k in ("na", "nb"))
                va, vb = (batch.column(k).to_pylist() for k in ("va", "vb"))
                keep = np.zeros(len(na), bool)
                shapes: dict[tuple[int, int], list[int]] = {}
                for i, (x, y) in enumerate(zip(va, vb, strict=True)):
                    shapes.setdefault((len(x), len(y)), []).append(i)
                for (x, y), rows in shapes.items():
                    g, step = 4 * min(x, y), max(1, (1 << 22) // (4 * max(x, y)))
                    for k in range(0, len(rows), step):
                        at = np.array(rows[k : k + step])
                        p, q = (unpack([v[i] for i in at]) for v in (va, vb))
                        over = (m[at] - v.sum(1, dtype=np.int64) for m, v in ((na, p), (nb, q)))
                        keep[at] = overlap_bounds(fold(p, g), fold(q, g), *over) >= needed_overlap(na[at] + nb[at], c.num)
                yield batch.select([0, 1, 2]).filter(pa.array(keep))

        return pairs.join(x, "a").join(y, "b").select("a", "b", "home", "na", "va", "nb", "vb").mapInArrow(lean(run), "a long, b long, home long")

    def verified(pairs: DataFrame) -> DataFrame:
        with scratch(docs.sparkSession) as own:
            pairs = materialise(pairs, "pairs")
            return own.keep(materialise(_verify(pairs, texts_of(pairs), c), "links"))

    first = buckets.filter((F.col("node") != F.col("pivot")) & _size_fits("n", "pivot_n", c.num)).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct().withColumn("home", F.col("a"))
    links = verified(bounded(first))
    roots = connected_components(links)

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows (shingle, node, n) of buckets whose documents lie in several components, with what places their search."""
        sized = roots.join(roots.groupBy("root").agg(F.count("*").alias("weight")), "root")
        own = rows.select("shingle", "node", "n").join(sized, "node", "left").select("shingle", "node", "n", F.coalesce("root", "node").alias("root"), F.coalesce("weight", F.lit(1)).alias("weight"))
        own = materialise(own, "rooted")
        several = own.groupBy("shingle").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("_rows"), F.bit_xor(F.xxhash64("node")).alias("_sum"), F.max(F.struct("weight", "root")).alias("_home"))
        # A passage routes the same documents under each of its shingles: one bucket of such is enough.
        one = several.filter("_lo <> _hi").groupBy("_rows", "_sum", "_lo", "_hi", F.col("_home.root").alias("home")).agg(F.min("shingle").alias("shingle"))
        return materialise(own.join(one.select("shingle", "home"), "shingle"), "mixed")

    rest = mixed(buckets)
    for _ in range(c.pivot_rounds - 1):
        # Another pivot for what the smallest didn't join: of the bucket's largest component, the one of the largest key.
        last = materialise(rest.groupBy("shingle").agg(F.max(F.struct("weight", "root", "node", "n")).alias("_last")), "pivots")
        again = rest.join(last, "shingle").filter(F.col("root") != F.col("_last.root")).withColumn("_last_n", F.col("_last.n"))
        again = again.filter(_size_fits("n", "_last_n", c.num)).select(F.least("node", "_last.node").alias("a"), F.greatest("node", "_last.node").alias("b"), F.col("_last.node").alias("home"))
        links = links.unionAll(verified(bounded(again.groupBy("a", "b").agg(F.min("home").alias("home")))))
        roots = connected_components(links)
        rest = mixed(rest)

    links = links.unionAll(verified(_search_buckets(_placed(rest, c), sets, c)))
    roots = connected_components(links)

    named = sets.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = materialise(named.join(least, "root").select("node", "component_id"), "components")
    return rows.join(of.withColumnRenamed("node", "_node"), (F.col("n") > 0) & (F.col("node") == F.col("_node")), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
