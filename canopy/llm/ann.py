"""Nearest neighbours by adaptive dimension scan over inverted lists.

Vectors lie in the list of their nearest centroid, and lists in units of bounded
size.  The k-th best distance of a query within a sample bounds that within all
vectors, so lists that lie wholly beyond it are left out, by the triangle
inequality.  Of the others a query probes the nearest ones, as many as it takes
in the sample to find the share ``recall`` of the exact neighbours of held-out
sample vectors: the neighbours in all vectors lie nearer, so they need no more.
The number is measured anew for each table, whatever its size.  All vectors are rotated by one random orthogonal
matrix and scanned in blocks of columns: after t of d dimensions a candidate's
partial distance, scaled by d/t, estimates its distance; where it exceeds the
bound by more than the test's margin, the candidate is abandoned.  What survives
is measured exactly and tightens the query's bound for the next list.

Equal vectors are one class with its smallest ids: a result never needs more of
them than it has rows, so many copies of a vector cost no more than one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import materialise, ship_code


@dataclass(frozen=True)
class SearchConfig:
    """Parameters; ``sample`` bounds the classes that centroids are fitted on (every vector is indexed)."""

    k: int = 10
    #: Lists: the square root of the number of classes, at most this many.
    most_lists: int = 4096
    sample: int = 20_000
    rounds: int = 8
    #: Classes of the sample that bound a query's distances.
    bound_rows: int = 8192
    #: Classes and queries that one task call meets, about.
    block_rows: int = 4096
    query_rows: int = 16_384
    #: Share of exact neighbours that the probed lists must hold, and sample vectors that measure it.
    recall: float = 0.995
    probe_sample: int = 512
    #: Columns scanned between two tests, and the test's margin in standard errors.
    columns: int = 16
    margin: float = 2.1
    seed: int = 3


@dataclass(frozen=True)
class Index:
    config: SearchConfig
    centroids: np.ndarray
    rotation: np.ndarray
    #: Classes in each list, and the farthest one's distance from the centroid.
    sizes: np.ndarray
    radius: np.ndarray
    #: Classes that bound distances.
    sample: np.ndarray
    sample_list: np.ndarray
    #: Lists that a query probes, or more where these hold fewer than k + 1 classes.
    probes: int

    def blocks(self) -> np.ndarray:
        """A large list has several blocks."""
        return np.maximum(1, -(-self.sizes // self.config.block_rows))

    def units(self) -> np.ndarray:
        """Each list's first unit: small lists share one, each block of a large list is one of its own."""
        first, at, held = np.zeros(len(self.sizes), np.int64), 0, 0
        for i, (size, n) in enumerate(zip(self.sizes.tolist(), self.blocks().tolist(), strict=True)):
            if held and (n > 1 or held + size > self.config.block_rows):
                at, held = at + 1, 0
            first[i] = at
            if n > 1:
                at, held = at + n, 0
            else:
                held += size
        return first


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.RandomState(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.RandomState(seed)
    centres = x[rng.permutation(len(x))[: min(k, len(x))]].astype(np.float64)
    for _ in range(rounds):
        own = nearest(x, centres)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centres of each row, nearest first, ties by number."""
    out = np.empty((len(x), min(n, len(centres))), np.int64)
    for at in range(0, len(x), 4096):
        d = (centres**2).sum(1) - 2 * (x[at : at + 4096] @ centres.T)
        out[at : at + 4096] = d.argmin(1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]
    return out


def _rounding(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of x, what rounding can add to squared distances from rows of y that are computed by products."""
    return 8 * (x.shape[1] + 8) * np.finfo(float).eps * ((x**2).sum(1) + (y**2).sum(1).max(initial=0))


def distance_bounds(x: np.ndarray, sample: np.ndarray, k: int, counts: np.ndarray | None = None) -> np.ndarray:
    """A distance within which each row of x has k rows of the sample, of those that count for it; infinite where it has fewer."""
    out = np.full(len(x), np.inf)
    if len(sample) >= k:
        norms, slack = (sample**2).sum(1), _rounding(x, sample)
        for at in range(0, len(x), 256):
            q = x[at : at + 256]
            d = (q**2).sum(1)[:, None] + norms - 2 * (q @ sample.T)
            if counts is not None:
                d[~counts[at : at + 256]] = np.inf
            out[at : at + 256] = np.sqrt(np.maximum(0, np.partition(d, k - 1, axis=1)[:, k - 1]) + slack[at : at + 256])
    return out


def needed_probes(x: np.ndarray, centroids: np.ndarray, c: SearchConfig) -> int:
    """How many nearest lists hold the share ``recall`` of the k nearest of some rows of x among all other rows of x."""
    step = max(1, len(x) // c.probe_sample)
    own, ranks = nearest(x, centroids)[:, 0], []
    for at in range(0, len(x), 256 * step):
        rows = np.arange(at, min(len(x), at + 256 * step), step)
        d = (x**2).sum(1) - 2 * (x[rows] @ x.T)
        d[np.arange(len(rows)), rows] = np.inf
        k = min(c.k, len(x) - 1)
        if not k:
            return len(centroids)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        order = np.argsort((centroids**2).sum(1) - 2 * (x[rows] @ centroids.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(centroids))[None], 1)
        ranks.append(np.take_along_axis(place, own[near], 1).ravel())
    return int(np.quantile(np.concatenate(ranks), c.recall, method="higher")) + 1


def adaptive_scan(queries: np.ndarray, rows: np.ndarray, bounds: np.ndarray, c: SearchConfig) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of rotated vectors that may lie within the queries' bounds: the tests' survivors."""
    d, slack = rows.shape[1], _rounding(queries, rows)
    q = r = np.zeros(0, np.int64)
    partial, alive, dense = np.zeros((len(queries), len(rows))), True, True
    for at in range(0, d, c.columns):
        to = min(d, at + c.columns)
        a, b = queries[:, at:to], rows[:, at:to]
        limit = (bounds * (1 + (c.margin / np.sqrt(to) if to < d else 0))) ** 2 * (to / d) + slack
        if dense:
            partial += (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * (a @ b.T)
            alive = (partial <= limit[:, None]) & alive
            if dense := 16 * np.count_nonzero(alive) > alive.size and to < d:
                continue
            q, r = np.nonzero(alive)
            partial = partial[q, r]
        else:
            partial = partial + ((a[q] - b[r]) ** 2).sum(1)
            keep = partial <= limit[q]
            q, r, partial = q[keep], r[keep], partial[keep]
    return q, r


def _classes(vectors: DataFrame, c: SearchConfig) -> DataFrame:
    """(key, rep, vector, members): equal vectors with the k + 1 smallest of their ids; rep is the smallest, key a number of their own once stored."""
    order = Window.partitionBy("vector").orderBy("id")
    # The rank filter is applied before the shuffle too, so a hot vector is k + 1 rows a task.
    few = vectors.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= c.k + 1)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members")).select(F.monotonically_increasing_id().alias("key"), F.element_at("members", 1).alias("rep"), "vector", "members")


def build(classes: DataFrame, c: SearchConfig) -> tuple[DataFrame, Index] | None:
    """(key, rep, vector, members) -> the same with its list and unit, and the index; None without classes."""
    n = classes.count()
    if not n:
        return None
    lists = int(np.clip(round(n**0.5), 1, c.most_lists))
    sample = classes.select("rep", "vector").orderBy(F.xxhash64("rep", F.lit(c.seed)), "rep", "vector").limit(c.sample).toPandas()
    x = np.stack(sample["vector"].to_list()).astype(np.float64)
    centroids = kmeans(x, lists, c.rounds, c.seed)
    shared = classes.sparkSession.sparkContext.broadcast(centroids)  # most_lists rows at most

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.stack(frame["vector"].to_list()).astype(np.float64)
                own = nearest(x, shared.value)[:, 0]
                frame = frame.assign(list=own, far=np.sqrt(((x - shared.value[own]) ** 2).sum(1)))
                yield frame[["list", "far", "key", "rep", "vector", "members"]]

    listed = materialise(classes.select("key", "rep", "vector", "members").mapInPandas(assign, "list long, far double, key long, rep long, vector array<float>, members array<long>"), "lists")
    sizes, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for row in listed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        sizes[row["list"]], radius[row["list"]] = row["n"], row["far"]
    index = Index(c, centroids, rotation(x.shape[1], c.seed), sizes, radius, x[: c.bound_rows].astype(np.float32), nearest(x[: c.bound_rows], centroids)[:, 0], needed_probes(x, centroids, c))
    blocks, first = (F.element_at(F.lit(v.tolist()), (F.col("list") + 1).cast("int")).cast("long") for v in (index.blocks(), index.units()))
    return listed.withColumn("unit", first + F.pmod(F.xxhash64("key"), blocks)).drop("far"), index


def _probed(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lists each row of x probes, the nearest ones, and its squared distance from every centroid."""
    c = index.centroids
    d = (x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * (x @ c.T)
    order = np.argsort(np.where(index.sizes > 0, d, np.inf), axis=1, kind="stable")
    held_before = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]
    out = np.empty(d.shape, bool)
    np.put_along_axis(out, order, (np.arange(len(c)) < index.probes) | (held_before <= index.config.k), 1)
    return out & (index.sizes > 0), d


def _bounds(index: Index, x: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """A distance within which each row of x has k + 1 classes of the lists that it probes."""
    return distance_bounds(x, sample, index.config.k + 1, _probed(index, x)[0][:, index.sample_list])


def _visits(index: Index, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which lists each row of x must visit: of those that it probes the ones that may hold a class within its bound."""
    probed, d = _probed(index, x)
    nearest_point = np.sqrt(np.maximum(0, d - _rounding(x, index.centroids)[:, None])) - index.radius * (1 + 1e-12)
    return probed & (nearest_point <= bounds[:, None])


def _best(q: np.ndarray, score: np.ndarray, rep: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, by score and rep."""
    order = np.lexsort((rep, score, q))
    start = np.concatenate([[True], q[order][1:] != q[order][:-1]])
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(start, at, 0)) < k]


def _nearest_classes(queries: DataFrame, listed: DataFrame, index: Index) -> DataFrame:
    """(q, qv) and the listed classes -> (q, rep, score, members): the k + 1 nearest of each query and more."""
    shared = queries.sparkSession.sparkContext.broadcast(index)
    k = index.config.k + 1
    parts = max(1, -(-queries.count() // index.config.query_rows))

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        first, blocks, sample = own.units(), own.blocks(), own.sample.astype(np.float64)
        for frame in frames:
            for at in range(0, len(frame), 512):
                some = frame[at : at + 512]
                x = np.stack(some["qv"].to_list()).astype(np.float64)
                bounds = _bounds(own, x, sample)
                must = _visits(own, x, bounds)
                for q, v, bound, lists in zip(some["q"], some["qv"], bounds, must, strict=True):
                    units = np.unique(np.concatenate([np.arange(first[i], first[i] + blocks[i]) for i in np.flatnonzero(lists)]))
                    yield pd.DataFrame({"unit": units, "q": q, "qv": [v] * len(units), "bound": bound})

    def pair(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "members": pd.Series(dtype="object")})
        own = shared.value
        rows = rows.sort_values(["list", "rep", "key"], ignore_index=True)
        x, v = (np.stack(t.to_list()).astype(np.float64) for t in (rows["vector"], asked["qv"]))
        turned, reps, bounds = x @ own.rotation, rows["rep"].to_numpy(), asked["bound"].to_numpy().copy()
        must, turned_v = _visits(own, v, bounds), v @ own.rotation
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, row, score
        nearest_so_far = np.full((len(asked), k), np.inf)
        lists, starts = np.unique(rows["list"].to_numpy(), return_index=True)
        for i, start, end in zip(lists, starts, [*starts[1:], len(rows)], strict=True):
            who = np.flatnonzero(must[:, i])
            for at in range(0, len(who), 256):
                some = who[at : at + 256]
                q, r = adaptive_scan(turned_v[some], turned[start:end], bounds[some], own.config)
                own_q, q, r = q, some[q], r + start
                score = np.concatenate([np.sqrt(((x[r[j : j + 65536]] - v[q[j : j + 65536]]) ** 2).sum(1)) for j in range(0, max(1, len(q)), 65536)])
                best = _best(q, score, reps[r], k)
                own_q, q, r, score = own_q[best], q[best], r[best], score[best]
                # _best sorts by query: the place of each within its query.
                new = np.full((len(some), k), np.inf)
                first = np.flatnonzero(np.r_[True, own_q[1:] != own_q[:-1]]) if len(own_q) else np.zeros(0, np.int64)
                new[own_q, np.arange(len(own_q)) - np.repeat(first, np.diff(np.r_[first, len(own_q)]))] = score
                nearest_so_far[some] = np.sort(np.concatenate([nearest_so_far[some], new], 1), 1)[:, :k]
                bounds[some] = np.minimum(bounds[some], nearest_so_far[some, k - 1])
                found = tuple(np.concatenate(two) for two in zip(found, (q, r, score), strict=True))
                if len(found[0]) > 2 * k * len(asked) + 65536:
                    best = _best(found[0], found[2], reps[found[1]], k)
                    found = tuple(f[best] for f in found)
        best = _best(found[0], found[2], reps[found[1]], k)
        q, r, score = (f[best] for f in found)
        return pd.DataFrame({"q": asked["q"].to_numpy()[q], "rep": reps[r], "score": score, "members": rows["members"].to_numpy()[r]})

    part = F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int")
    asked = queries.mapInPandas(visit, "unit long, q long, qv array<float>, bound double").withColumn("part", part)
    # Each part of the queries meets every class.
    met = listed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return met.groupBy("unit", "part").cogroup(asked.groupBy("unit", "part")).applyInPandas(pair, "q long, rep long, score double, members array<long>")


def search(df: DataFrame, is_query: Column, config: SearchConfig | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of each query row, by Euclidean distance.

    Candidates are all rows but the query's own; ties go to the smaller id.  Rows
    with a null id or vector, a zero vector, or null or non-finite components take
    no part.  Rows that repeat an id are rows like any others: each is a candidate,
    and each that is a query has ranks of its own.  Vectors are compared with those
    of their own length.
    """
    c = config or SearchConfig()
    ship_code(df.sparkSession)
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    ok = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    rows = materialise(rows.filter(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False))), "vectors")
    out = None
    for (d,) in rows.select(F.size("vector").alias("d")).distinct().orderBy("d").collect():  # one search a length
        part = _search_length(rows.filter(F.size("vector") == d), c)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search_length(rows: DataFrame, c: SearchConfig) -> DataFrame:
    built = build(materialise(_classes(rows, c), "classes"), c)
    if built is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    listed, index = built
    asked = rows.filter("query").select("id", "vector", F.monotonically_increasing_id().alias("row"))
    of = materialise(asked.join(listed.select("key", F.col("vector").alias("_v")), F.col("vector") == F.col("_v")).select("id", "row", "key", "vector"), "queries")
    found = _nearest_classes(of.groupBy("key").agg(F.first("vector").alias("qv")).select(F.col("key").alias("q"), "qv"), listed, index)
    best = Window.partitionBy("q").orderBy("score", "rep")
    top = found.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= c.k + 1)
    # Of each query's classes only k + 1 rows can be needed: k, and maybe its own.
    spread = top.select("q", "score", F.explode("members").alias("vec_id"))
    near = Window.partitionBy("q").orderBy("score", "vec_id")
    few = materialise(spread.withColumn("_k", F.row_number().over(near)).filter(F.col("_k") <= c.k + 1).select("q", "score", "vec_id", "_k"), "nearest")
    rows_of = few.join(of.select(F.col("id").alias("query_id"), "row", F.col("key").alias("q")), "q")
    # A query's own row is one of its class, at distance 0: one such place is passed over.
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0), F.col("_k"))).over(Window.partitionBy("row"))
    placed = rows_of.withColumn("_own", F.coalesce(own, F.lit(c.k + 2))).filter(F.col("_k") != F.col("_own"))
    rank = F.col("_k") - (F.col("_k") > F.col("_own")).cast("int")
    return placed.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= c.k)
