"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy on every labelled row.

Rows are dealt into shards by a hash of their id.  In each round every shard
continues the shared model on its own rows, in the workers, and what the shards
changed is averaged; so any number of labelled rows is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm import words
from canopy.llm.common import free_name, lean, materialise, scratch, ship_code
from canopy.storage import release

#: Words whose filters are computed at once.
CHUNK_WORDS = 1 << 16
#: Thresholds are multiples of 1 / BINS.
BINS = 10_000
#: What shards changed is summed as multiples of this, exactly: the order of tasks doesn't matter.
UNIT = 2.0**-32


@dataclass(frozen=True)
class ToxicityConfig:
    """Parameters; none bounds the labelled rows that are fitted on."""

    buckets: int = 1 << 16
    dim: int = 8
    #: Bytes of a word's beginning that are embedded beside the whole word.
    prefix: int = 5
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 16
    #: Bytes of a shard's buckets, about: its rows are trained on one after another.
    shard_bytes: int = 10 << 20
    rounds: int = 5
    #: Steps of a shard in all rounds, at least; a round goes through all its rows.
    steps: int = 1000
    batch: int = 32
    rate: float = 0.1
    spread: float = 0.1
    first_square: float = 1e-4
    #: Words and prefixes of fewer fitted rows aren't learned: their embeddings are 0.
    least_rows: int = 2
    seed: int = 5
    #: Bits of the sieve that spares unlabelled documents the hashing, at most; with more labelled rows it lets more others through, which are dropped later.
    sieve_bits: int = 1 << 27


@dataclass(frozen=True)
class ToxicityModel:
    """embedding: (2, buckets, dim); kernels: one (width, 2*dim, filters) a width; thresholds: by language."""

    config: ToxicityConfig
    embedding: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)


_in_word = np.zeros(256, bool)
_in_word[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_features(column: pa.Array, c: ToxicityConfig) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of rows: bucket of each word, bucket of its prefix, first word of each row (one more at the end).

    A word is a run of ASCII letters, read as lower case, and of bytes above 127.
    """
    for _, _, data, bounds in words.utf8_chunks(column):
        s, e, first = words.word_spans(data, bounds, _in_word)
        whole = words.word_hashes(data, s, e)
        start = words.word_hashes(data, s, np.minimum(e, s + c.prefix))
        n = np.uint64(c.buckets)
        yield (whole % n).astype(np.int32), ((start >> np.uint64(20)) % n).astype(np.int32), first


def _tables(m: ToxicityModel) -> list[list[np.ndarray]]:
    """For each width, offset and hash: what a bucket there adds to the filters."""
    d = m.config.dim
    return [[m.embedding[h] @ k[j, h * d : (h + 1) * d] for j in range(len(k)) for h in (0, 1)] for k in m.kernels]


def score_column(column: pa.Array, m: ToxicityModel, tables: list[list[np.ndarray]]) -> np.ndarray:
    """The score of each row: filters over all words, their maxima, a logistic unit."""
    c, scores = m.config, []
    for whole, prefix, first in word_features(column, c):
        rows = len(first) - 1
        pooled = np.zeros((rows, len(c.widths) * c.filters), np.float32)
        count = np.diff(first)
        for k, width in enumerate(c.widths):
            n = len(whole) - width + 1
            some = np.flatnonzero(count >= width)
            if n <= 0 or not len(some):
                continue
            y = np.zeros((n, c.filters), np.float32)
            for j in range(width):
                y += tables[k][2 * j][whole[j : n + j]]
                y += tables[k][2 * j + 1][prefix[j : n + j]]
            # Windows that reach into the next row give way: reduceat runs over [first, end of own windows).
            cut = np.stack([first[some], np.minimum(first[some + 1] - width + 1, n)], 1).ravel()
            last = cut[-1] == n
            best = np.maximum.reduceat(y, cut[:-1] if last else cut, axis=0)[::2]
            pooled[some, k * c.filters : (k + 1) * c.filters] = np.maximum(0, best + m.bias[k])
        with np.errstate(over="ignore"):
            scores.append(1 / (1 + np.exp(-(pooled @ m.out + m.out_bias).astype(np.float64))))
    return np.concatenate(scores) if scores else np.zeros(0)


def _rows_of(c: ToxicityConfig) -> tuple[int, int]:
    """Rows of ``dim`` parameters: those of the embedding, and all."""
    dense = 2 * c.dim * c.filters * sum(c.widths) + 2 * len(c.widths) * c.filters + 1
    return 2 * c.buckets, 2 * c.buckets - (-dense // c.dim)


def _parts(flat: np.ndarray, c: ToxicityConfig) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Embedding, kernels, bias, out and out_bias as views of all parameters."""
    wide = len(c.widths)
    shapes = [(2, c.buckets, c.dim), *[(w, 2 * c.dim, c.filters) for w in c.widths], (wide, c.filters), (wide * c.filters,), (1,)]
    at = np.cumsum([0, *[int(np.prod(x)) for x in shapes]])
    views = [flat[i : i + int(np.prod(x))].reshape(x) for i, x in zip(at, shapes, strict=False)]
    return views[0], views[1:-3], views[-3], views[-2], views[-1]


def _start(rows: int, positives: int, learned: np.ndarray, c: ToxicityConfig, rng: np.random.RandomState) -> tuple[np.ndarray, np.ndarray]:
    """All parameters before training, and their summed squared gradients."""
    d, f = c.dim, c.filters
    flat = np.zeros(_rows_of(c)[1] * d, np.float32)
    embedding, kernels, _, out, out_bias = _parts(flat, c)
    embedding[:] = rng.normal(0, c.spread, (2, c.buckets, d))
    for k, w in zip(kernels, c.widths, strict=True):
        k[:] = rng.normal(0, (2 * d) ** -0.5, (w, 2 * d, f))
    out[:] = np.tile(np.where(np.arange(f) % 4 == 3, -0.3, 0.3), len(c.widths))
    share = float(np.clip(positives / rows, 0.01, 0.99)) if rows else 0.01
    out_bias[:] = np.log(share / (1 - share))
    # What few rows hold would only tell those rows apart.
    embedding[~learned] = 0
    return flat, np.full_like(flat, c.first_square)


def _maxima(a: np.ndarray, b: np.ndarray, begin: np.ndarray, embedding: np.ndarray, kernels: list[np.ndarray], c: ToxicityConfig) -> tuple[np.ndarray, np.ndarray]:
    """For each row, width and filter: the largest response (-inf without one) and the word where its window starts."""
    rows, f, reach = len(begin) - 1, c.filters, max(c.widths) - 1
    most = np.full((rows, len(c.widths), f), -np.inf, np.float32)
    where = np.zeros((rows, len(c.widths), f), np.int64)
    for u in range(0, len(a), CHUNK_WORDS):
        v = min(u + CHUNK_WORDS, len(a))
        x = np.concatenate([embedding[0][a[u : v + reach]], embedding[1][b[u : v + reach]]], 1)
        for k, w in enumerate(c.widths):
            n = max(0, min(len(x) - w + 1, v - u))
            y = sum(x[j : n + j] @ kernels[k][j] for j in range(w))
            for r in range(int(np.searchsorted(begin, u, "right")) - 1, int(np.searchsorted(begin, v, "left"))):
                s, e = max(int(begin[r]), u), min(int(begin[r + 1]) - w + 1, v)
                if s < e:
                    own = y[s - u : e - u]
                    at = own.argmax(0)
                    found = own[at, np.arange(f)]
                    more = found > most[r, k]
                    most[r, k][more], where[r, k][more] = found[more], (s + at)[more]
    return most, where


def _descend(flat: np.ndarray, past: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, learned: np.ndarray, steps: int, c: ToxicityConfig, rng: np.random.RandomState) -> None:
    """Logistic loss by Adagrad, in place; the pooled maxima pass the gradient to the windows that gave them."""
    d, f = c.dim, c.filters
    embedding, kernels, bias, out, out_bias = _parts(flat, c)
    seen, seen_kernels, *seen_rest = _parts(past, c)

    def descend(x: np.ndarray, past: np.ndarray, grad: np.ndarray) -> None:
        past += grad**2
        x -= c.rate * grad / np.sqrt(past)

    order: list[int] = []
    for _ in range(steps if len(docs) else 0):
        while len(order) < min(c.batch, len(docs)):
            order += rng.permutation(len(docs)).tolist()
        rows, order = order[: c.batch], order[c.batch :]
        a, b = (np.concatenate([docs[i][h] for i in rows]) for h in (0, 1))
        begin = np.concatenate([[0], np.cumsum([len(docs[i][0]) for i in rows])])
        most, where = _maxima(a, b, begin, embedding, kernels, c)
        best = np.maximum(0, most + bias)
        pooled = best.reshape(len(rows), -1)
        p = 1 / (1 + np.exp(-np.clip(pooled @ out + out_bias, -30, 30)))
        err = ((p - toxic[rows]) / len(rows)).astype(np.float32)
        back = err[:, None, None] * out.reshape(1, len(c.widths), f) * (best > 0)
        d_kernels = [np.zeros_like(k) for k in kernels]
        spots, grads = [], []
        for k, w in enumerate(c.widths):
            r, q = np.nonzero(back[:, k])
            g = back[r, k, q][:, None]
            for j in range(w):
                at = where[r, k, q] + j
                np.add.at(d_kernels[k][j].T, q, g * np.concatenate([embedding[0][a[at]], embedding[1][b[at]]], 1))
                toward = g * kernels[k][j].T[q]
                for h, ids in ((0, a), (1, b)):
                    spots.append(ids[at].astype(np.int64) * 2 + h)
                    grads.append(toward[:, h * d : (h + 1) * d])
        spot, of = np.unique(np.concatenate(spots), return_inverse=True)
        g = np.zeros((len(spot), d), np.float32)
        np.add.at(g, of, np.concatenate(grads))
        own = learned[spot % 2, spot // 2]
        spot, g = spot[own], g[own]
        hs, buckets = spot % 2, spot // 2
        seen[hs, buckets] += g**2
        embedding[hs, buckets] -= c.rate * g / np.sqrt(seen[hs, buckets])
        for x, past_x, grad in zip([*kernels, bias, out, out_bias], [*seen_kernels, *seen_rest], [*d_kernels, back.sum(0), pooled.T @ err, err.sum(keepdims=True)], strict=True):
            descend(x, past_x, grad)


def _model(flat: np.ndarray, c: ToxicityConfig) -> ToxicityModel:
    embedding, kernels, bias, out, out_bias = _parts(flat, c)
    return ToxicityModel(c, embedding, kernels, bias, out, float(out_bias[0]))


def _rows_with(docs: list[tuple[np.ndarray, np.ndarray]], c: ToxicityConfig) -> np.ndarray:
    """In how many rows each bucket occurs, of words and of prefixes."""
    out = np.zeros((2, c.buckets), np.int64)
    for doc in docs:
        for h in (0, 1):
            out[h, np.unique(doc[h])] += 1
    return out


def train(docs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, c: ToxicityConfig) -> ToxicityModel:
    """Trains on rows in memory, as one shard, ``steps`` steps."""
    rng = np.random.RandomState(c.seed)
    learned = _rows_with(docs, c) >= c.least_rows
    flat, past = _start(len(docs), int((toxic > 0).sum()), learned, c, rng)
    _descend(flat, past, docs, toxic, learned, c.steps, c, rng)
    return _model(flat, c)


def calibrate(bins: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold of highest F1, given how many rows and toxic rows score in each bin; ties go to the middle of their range."""
    rows, own = np.zeros(BINS + 1, np.int64), np.zeros(BINS + 1, np.int64)
    np.add.at(rows, bins, n)
    np.add.at(own, bins, toxic)
    flagged, hits = rows[::-1].cumsum()[::-1], own[::-1].cumsum()[::-1]
    grid = np.unique(np.concatenate([bins, [3 * BINS // 10, BINS // 2]]))
    f1 = 2 * hits[grid] / np.maximum(1, own.sum() + flagged[grid])
    best = grid[f1 == f1.max()]
    return float((best[0] + best[-1]) / 2 / BINS)


#: Models trained at once: one on all rows, and one without the rows of either fold, which it scores for the thresholds.
_MODELS = 3


def _taught(model: int, fold: np.ndarray) -> np.ndarray:
    """Which rows a model learns from."""
    return (fold != model - 1) if model else np.ones(len(fold), bool)


def _ids(c: ToxicityConfig) -> type:
    return np.uint16 if c.buckets <= 1 << 16 else np.int32


def _shards(batches: Iterator[pa.RecordBatch], c: ToxicityConfig) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(shard, fold, toxic, words and prefixes) of neighbouring rows of a shard."""
    now, fold, toxic, docs = None, [], [], []
    for batch in batches:
        for s, k, t, a, b in zip(*[batch.column(x).to_pylist() for x in ("shard", "fold", "toxic", "a", "b")], strict=True):
            if s != now and docs:
                yield now, np.array(fold), np.array(toxic, np.float32), docs
                fold, toxic, docs = [], [], []
            now = s
            fold.append(k)
            toxic.append(t)
            docs.append((np.frombuffer(a, _ids(c)), np.frombuffer(b, _ids(c))))
    if docs:
        yield now, np.array(fold), np.array(toxic, np.float32), docs


def _sieve(marks: DataFrame, c: ToxicityConfig) -> np.ndarray:
    """A bit for each remainder of an id's hash that a labelled row has: it lets all labelled rows through, and few others.

    It saves work only.  Up to ``sieve_bits``, there are 16 bits a row or more.
    """
    bits = 64
    rows = marks.count()
    while bits < min(16 * rows, c.sieve_bits):
        bits *= 2
    at = F.pmod(_sieve_key("_id", c), F.lit(bits))
    # At most one row for every 64 bits reaches the driver.
    found = marks.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("set")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["set"].to_numpy()
    return out.view(np.uint8)  # the lowest bit of the first byte comes first


def _sieve_key(name: str, c: ToxicityConfig) -> Column:
    return F.xxhash64(F.col(name).cast("long"), F.lit(c.seed + 2))


def _hashed_rows(docs: DataFrame, marks: DataFrame, c: ToxicityConfig) -> DataFrame:
    """(doc_id, lang, a, b) of each document that the sieve lets through: all its words and prefixes as buckets.  No shuffle of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(_sieve(marks, c))  # sieve_bits at most
    read = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", _sieve_key("doc_id", c).alias("_key"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = shared.value
        for batch in batches:
            at = batch.column(3).to_numpy() % (8 * len(sieve))
            batch = batch.filter(pa.array(((sieve[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)))
            a, b = [], []
            for whole, prefix, first in word_features(batch.column(2), c):
                whole, prefix = whole.astype(_ids(c)), prefix.astype(_ids(c))
                for i, j in zip(first[:-1], first[1:], strict=True):
                    a.append(whole[i:j].tobytes())
                    b.append(prefix[i:j].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["doc_id", "lang", "a", "b"])

    return read.mapInArrow(lean(hashed), "doc_id long, lang string, a binary, b binary")


def _dealt(hashed: DataFrame, marks: DataFrame, c: ToxicityConfig) -> DataFrame:
    """(shard, fold, toxic, lang, a, b): the labelled rows shard by shard; of repeated ids one."""
    size = hashed.agg(F.sum(F.octet_length("a") + F.octet_length("b"))).first()[0] or 0
    shards = max(1, -(-int(size) // c.shard_bytes))
    shard, fold = (F.pmod(F.xxhash64("doc_id", F.lit(c.seed + i)), F.lit(n)).cast("int") for i, n in ((0, shards), (1, 2)))
    # Rows and labels are dealt by shard and meet there, so the buckets are shuffled once.
    both = hashed.select("doc_id", F.lit(None).cast("boolean").alias("toxic"), F.struct("a", "b", "lang").alias("_row"))
    both = both.unionByName(marks.select(F.col("_id").cast("long").alias("doc_id"), "toxic", F.lit(None).cast(both.schema["_row"].dataType).alias("_row")))
    met = both.withColumn("shard", shard).repartition(2 * shards, "shard").groupBy("shard", "doc_id").agg(F.max("toxic").alias("toxic"), F.min("_row").alias("_row"))
    met = met.filter(F.col("toxic").isNotNull() & F.col("_row").isNotNull())
    return met.sortWithinPartitions("shard", "doc_id").select("shard", fold.alias("fold"), "toxic", "_row.lang", "_row.a", "_row.b")


def _count(rows: DataFrame, c: ToxicityConfig) -> tuple[np.ndarray, np.ndarray]:
    """For each fold: in how many rows each bucket occurs; rows and toxic rows."""
    spots = 2 * c.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, spots + 2), np.int64)
        for batch in batches:
            for _, fold, toxic, docs in _shards(iter([batch]), c):
                for k in (0, 1):
                    mine = np.flatnonzero(fold == k)
                    total[k, :-2] += _rows_with([docs[i] for i in mine], c).ravel()
                    total[k, -2:] += len(mine), int((toxic[mine] > 0).sum())
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0, at]), pa.array(total[1, at])], names=["spot", "n0", "n1"])

    out = np.zeros((2, spots + 2), np.int64)
    # At most one row a bucket reaches the driver.
    found = rows.mapInArrow(lean(run), "spot int, n0 long, n1 long").groupBy("spot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    for k in (0, 1):
        out[k, found["spot"].to_numpy()] = found[f"n{k}"].to_numpy()
    return out[:, :-2].reshape(2, 2, c.buckets), out[:, -2:]


def _round(rows: DataFrame, nets: list[tuple[np.ndarray, np.ndarray]], learned: list[np.ndarray], turn: int, c: ToxicityConfig) -> None:
    """Every shard continues every model on its own rows; parameters move by the mean change of the shards that changed them."""
    own, every = _rows_of(c)
    values = [f"v{i}" for i in range(2 * c.dim)]
    shared = rows.sparkSession.sparkContext.broadcast((nets, learned))  # buckets x dimensions: bounded by the configuration

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets, learned = shared.value
        moved, count = np.zeros((_MODELS, every, 2 * c.dim), np.int64), np.zeros((_MODELS, every), np.int64)
        for shard, fold, toxic, docs in _shards(batches, c):
            for m in range(_MODELS):
                mine = np.flatnonzero(_taught(m, fold))
                if not len(mine):
                    continue
                flat, past = nets[m][0].copy(), nets[m][1].copy()
                # A model of half of the rows goes through them as often.
                steps = max(-(-c.steps * len(mine) // (c.rounds * len(docs))), -(-len(mine) // c.batch))
                _descend(flat, past, [docs[i] for i in mine], toxic[mine], learned[m], steps, c, np.random.RandomState([c.seed, turn, shard, m]))
                change = np.concatenate([(x - x0).reshape(every, c.dim) for x, x0 in ((flat, nets[m][0]), (past, nets[m][1]))], 1)
                some = np.flatnonzero(change[:, c.dim :].any(1) | (np.arange(every) >= own))
                moved[m, some] += np.rint(change[some].astype(np.float64) / UNIT).astype(np.int64)
                count[m, some] += 1
        for m in range(_MODELS):
            at = np.flatnonzero(count[m])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), m), pa.int32()), pa.array(at, pa.int32()), pa.array(count[m, at]), *[pa.array(moved[m, at, i]) for i in range(2 * c.dim)]], names=["model", "at", "n", *values])

    kinds = "model int, at int, n long, " + ", ".join(f"{v} long" for v in values)
    # At most one row for every ``dim`` parameters reaches the driver.
    found = rows.mapInArrow(lean(run), kinds).groupBy("model", "at").agg(*[F.sum(v).alias(v) for v in ("n", *values)]).toArrow()
    model, at, n = (found[x].to_numpy() for x in ("model", "at", "n"))
    change = np.stack([found[v].to_numpy() for v in values], 1) * UNIT / n[:, None]
    for m, pair in enumerate(nets):
        for i, x in enumerate(pair):
            x.reshape(every, c.dim)[at[model == m]] += change[model == m, i * c.dim : (i + 1) * c.dim].astype(np.float32)
    shared.destroy()


def _thresholds(rows: DataFrame, models: list[ToxicityModel]) -> dict[str, float]:
    """By language, from all rows, each scored by the model that hasn't learned from its fold."""
    c = models[0].config
    shared = rows.sparkSession.sparkContext.broadcast(models)  # buckets x dimensions: bounded by the configuration

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, total = [_tables(m) for m in shared.value], {}
        for batch in batches:
            for fold, toxic, lang, a, b in zip(*[batch.column(x).to_pylist() for x in ("fold", "toxic", "lang", "a", "b")], strict=True):
                s = _score_one(np.frombuffer(a, _ids(c)), np.frombuffer(b, _ids(c)), shared.value[fold], tables[fold])
                n = total.setdefault((lang, int(s * BINS)), [0, 0])
                n[0] += 1
                n[1] += toxic
        kinds = {"lang": pa.string(), "bin": pa.int32(), "n": pa.int64(), "toxic": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*[(*k, *v) for k, v in total.items()], strict=True) if total else [[]] * 4, kinds.values(), strict=True)], names=list(kinds))

    def best(one: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": one["lang"][:1], "at": calibrate(one["bin"].to_numpy(), one["n"].to_numpy(), one["toxic"].to_numpy())})

    counts = rows.filter("lang is not null").mapInArrow(lean(run), "lang string, bin int, n long, toxic long").groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    # One row a language reaches the driver.
    out = {r["lang"]: r["at"] for r in counts.groupBy("lang").applyInPandas(best, "lang string, at double").collect()}
    shared.destroy()
    return out


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig | None = None) -> ToxicityModel:
    """Learns from (doc_id, text, lang) and (doc_id, toxic); the caller leaves out held-out rows.

    Every labelled document is fitted on, whole.  Rows with a null label or id
    teach nothing; of repeated labels the largest holds, of repeated documents one
    text.  Without any row the scores are near 0.  Thresholds come from all rows
    with a language, by two more models that leave out half of the rows each.
    """
    c = config or ToxicityConfig()
    ship_code(docs.sparkSession)
    with scratch(docs.sparkSession):
        marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).alias("toxic"))
        # Labels grow with the documents: they are dealt by id, not broadcast.
        marks = materialise(marks, "toxic_marks")
        # Stored tables and shuffles of ended jobs go as soon as possible: each is a part of the words or of the model a shard.
        with scratch(docs.sparkSession) as own:
            hashed = materialise(_hashed_rows(docs, marks, c), "toxic_rows")
            rows = own.keep(materialise(_dealt(hashed, marks, c), "toxic_shards"))
        release(docs.sparkSession, now=True)
        rows_with, sizes = _count(rows, c)
        # A model but the first learns from the other fold than it leaves out.
        own = [[0, 1], [1], [0]]
        learned = [rows_with[k].sum(0) >= c.least_rows for k in own]
        nets = [_start(*sizes[k].sum(0).tolist(), x, c, np.random.RandomState(c.seed)) for k, x in zip(own, learned, strict=True)]
        for turn in range(c.rounds if sizes[:, 0].any() else 0):
            _round(rows, nets, learned, turn, c)
            release(docs.sparkSession, now=True)
        models = [_model(flat, c) for flat, _ in nets]
        models[0].thresholds.update(_thresholds(rows, models[1:]))
    return models[0]


def _score_one(a: np.ndarray, b: np.ndarray, m: ToxicityModel, tables: list[list[np.ndarray]]) -> float:
    pooled = np.zeros(len(m.config.widths) * m.config.filters, np.float32)
    for k, w in enumerate(m.config.widths):
        own = slice(k * m.config.filters, (k + 1) * m.config.filters)
        for u in range(0, len(a) - w + 1, CHUNK_WORDS):
            n = min(len(a) - w + 1 - u, CHUNK_WORDS)
            y = sum(tables[k][2 * j][a[u + j : u + n + j]] + tables[k][2 * j + 1][b[u + j : u + n + j]] for j in range(w))
            pooled[own] = np.maximum(pooled[own], y.max(0) + m.bias[k])
    return float(1 / (1 + np.exp(-np.clip(pooled @ m.out + m.out_bias, -500, 500))))


def score(df: DataFrame, model: ToxicityModel, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The kept columns with toxic_score (0 to 1); a kept column so called is replaced.

    Whole texts; a null text scores as an empty one.  Repeated rows stay.  No shuffle.
    """
    ship_code(df.sparkSession)
    keep = [k for k in (["doc_id"] if keep is None else keep) if k != "toxic_score"]
    read = free_name(df, "_text")
    source = df.select(*keep, F.col(text).alias(read))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1]) + "toxic_score double"
    shared = df.sparkSession.sparkContext.broadcast(model)  # buckets x dimensions: bounded by the configuration

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(shared.value)
        for batch in batches:
            found = score_column(batch.column(read), shared.value, tables)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(found, pa.float64())], names=[*keep, "toxic_score"])

    return source.mapInArrow(lean(run), schema)
