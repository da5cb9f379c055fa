"""Byte-level BPE: encoding with cached pair merging, decoding by the tokens' retained offsets.

Offsets say where each token's bytes start in its text's UTF-8 form.  Decoding
puts every token's bytes at its offset, all tokens of a batch at once, and any
span of a text can be decoded without the rest.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import free_name, lean, ship_code
from canopy.llm.pretoken import pieces

#: Texts pre-tokenised at once hold about so many characters; a longer text goes by itself.
CHUNK_CHARS = 1 << 18
#: Pieces whose ids a worker keeps; others are merged anew each time.
CACHE_PIECES = 100_000
#: Tokens placed at once when texts are decoded.
DECODE_TOKENS = 1 << 18
#: Rows of a batch whose texts are Python strings at once.
ROWS = 256
#: From this many bytes a piece is merged with a heap instead of by rescanning.
LONG_PIECE = 48
NO_PAIR = (1 << 31) - 1


class ByteBPE:
    """A rank file (base64 token, rank) as an encoder and decoder of batches."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.lengths = np.zeros(max(self.tokens) + 1, np.int64)
        self.lengths[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        #: All tokens' bytes in the order of ids, and where each begins.
        self.flat = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(len(self.lengths))), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.decimals = {b: str(b) for b in self.tokens}
        #: piece -> its ids as bytes of little-endian int32
        self.cache: dict[str, bytes] = {}
        self._index_pairs()

    def _index_pairs(self) -> None:
        """An open-addressing table of all pairs of ids whose tokens make a token, for lookups of whole arrays."""
        ranks = self.ranks
        found = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_PAIR, np.int32)
        slot = self._slot(keys)
        while len(keys):
            empty = self.keys[slot] < 0
            self.keys[slot[empty]] = keys[empty]
            landed = self.keys[slot] == keys
            self.values[slot[landed]] = values[landed]
            keys, values, slot = keys[~landed], values[~landed], (slot[~landed] + 1) & ((1 << self.bits) - 1)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.byte_pairs = self._pair_ranks(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NO_PAIR where they make no token."""
        keys = (left << 32) | right
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], NO_PAIR).astype(np.int32)
        open_at = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_at):
            slot[open_at] = (slot[open_at] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_at]]
            hit = there == keys[open_at]
            out[open_at[hit]] = self.values[slot[open_at[hit]]]
            open_at = open_at[~hit & (there >= 0)]
        return out

    def merge_all(self, pieces_: list[str]) -> list[bytes]:
        """The ids of each piece: always the pair of lowest rank merges first, the leftmost of equals; a round does it for all pieces."""
        raw = [p.encode() for p in pieces_]
        out: list[bytes] = [b""] * len(raw)
        short: dict[int, list[int]] = {}
        for i, piece in enumerate(raw):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) < LONG_PIECE:
                short.setdefault(-(-len(piece) // 4) * 4, []).append(i)
            else:
                out[i] = np.array(self._merge_long(piece), "<i4").tobytes()
        for width, rows in short.items():
            for at in range(0, len(rows), 1 << 15):
                part = rows[at : at + (1 << 15)]
                for i, ids in zip(part, self._merge_block([raw[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge_block(self, block: list[bytes], width: int) -> list[bytes]:
        n = len(block)
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in block), np.uint8).reshape(n, width)
        length = np.array([len(p) for p in block])
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width] = self.byte_ids[data]
        ranks = np.full((n, width + 1), NO_PAIR, np.int32)
        ranks[:, : width - 1] = self.byte_pairs[data[:, :-1], data[:, 1:]]
        columns = np.arange(width + 1)
        ranks[columns >= (length - 1)[:, None]] = NO_PAIR
        final, final_length = np.empty((n, width), "<i4"), length.copy()
        row_of = np.arange(n)
        while len(row_of):
            j = ranks.argmin(1)
            row = np.arange(len(j))
            low = ranks[row, j]
            done = low == NO_PAIR
            if done.any():
                final[row_of[done]] = ids[done, :width]
                final_length[row_of[done]] = length[done]
                go = ~done
                ids, ranks, length, row_of, j, low = ids[go], ranks[go], length[go], row_of[go], j[go], low[go]
                row = np.arange(len(j))
                if not len(j):
                    break
            ids[row, j] = low
            source = np.minimum(columns + (columns > j[:, None]), width)
            ids = np.take_along_axis(ids, source, 1)
            ranks = np.take_along_axis(ranks, np.minimum(columns + (columns >= j[:, None]), width), 1)
            length = length - 1
            left = np.flatnonzero(j > 0)
            ranks[left, j[left] - 1] = self._pair_ranks(ids[left, j[left] - 1], ids[left, j[left]])
            ranks[row, j] = NO_PAIR
            right = np.flatnonzero(j + 1 < length)
            ranks[right, j[right]] = self._pair_ranks(ids[right, j[right]], ids[right, j[right] + 1])
        flat, step = final.tobytes(), 4 * width
        return [flat[i * step : i * step + 4 * k] for i, k in enumerate(final_length.tolist())]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for one piece in n log n steps: linked parts, and a heap of (rank, place) whose stale entries are skipped."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        prev = list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                rank = ranks.get(piece[i : end[j]])
                if rank is not None:
                    heap.append((rank, i, end[j])) if not ready else heapq.heappush(heap, (rank, i, end[j]))

        ready = False
        for i in range(n):
            offer(i)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode_chunks(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of all texts, chunk by chunk: (ids of some texts in a row, where each text's begin and the last one's end)."""
        at = 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (stop == at or chars + len(texts[stop] or "") <= CHUNK_CHARS):
                chars += len(texts[stop] or "")
                stop += 1
            found, first = pieces([t or "" for t in texts[at:stop]])
            ids = self._look_up(found)
            ends = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4, out=ends[1:])
            yield np.frombuffer(b"".join(ids), "<i4"), ends[first]
            at = stop

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null and empty texts have none."""
        for ids, first in self.encode_chunks(texts):
            for a, b in pairwise(first.tolist()):
                yield ids[a:b]

    def _look_up(self, found: list[str]) -> list[bytes]:
        """The ids of each piece, from the cache or merged in bulk."""
        ids = list(map(self.cache.get, found))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            names = list(dict.fromkeys([found[i] for i in missing]))
            fresh = dict(zip(names, self.merge_all(names), strict=True))
            for i in missing:
                ids[i] = fresh[found[i]]
            room = CACHE_PIECES - len(self.cache)
            if room > 0:
                self.cache.update(fresh if len(fresh) <= room else dict(list(fresh.items())[:room]))
        return ids

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token's bytes start."""
        out = np.zeros(len(ids), np.int64)
        np.cumsum(self.lengths[ids[:-1]], out=out[1:]) if len(ids) else None
        return out

    def place(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Each token's bytes put at its offset, relative to the first one's; what no token covers is 0."""
        if not len(ids):
            return b""
        start = offsets - offsets[0]
        out = np.zeros(int(start[-1] + self.lengths[ids[-1]]), np.uint8)
        for at in range(0, len(ids), DECODE_TOKENS):
            own = ids[at : at + DECODE_TOKENS]
            n = self.lengths[own]
            ends = np.cumsum(n)
            step = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
            out[np.repeat(start[at : at + DECODE_TOKENS], n) + step] = self.flat[np.repeat(self.starts[own], n) + step]
        return out.tobytes()

    def span(self, ids: np.ndarray, offsets: np.ndarray, start: int, stop: int) -> bytes:
        """Bytes start to stop of a text: only the tokens that reach into them are decoded."""
        a = max(0, int(np.searchsorted(offsets, start, "right")) - 1)
        b = int(np.searchsorted(offsets, stop, "left"))
        first = int(offsets[a]) if a < b else 0
        return self.place(ids[a:b], offsets[a:b])[max(0, start - first) : max(0, stop - first)]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> ByteBPE:
    """One for each worker process and file: its cache lives as long as the worker."""
    return ByteBPE(path)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, text: str) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Each batch with the ids of its rows' texts as chunks (see encode_chunks), made as they are read."""
    bpe = codec(path)
    for batch in batches:
        column = batch.column(text)
        slices = (column.slice(k, ROWS).to_pylist() for k in range(0, len(column), ROWS))
        yield batch, itertools.chain.from_iterable(map(bpe.encode_chunks, slices))


def encode_documents(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with ids (array<int>) and offsets (array<long>, byte starts of the tokens); kept columns so called are replaced.

    Whole texts, without special tokens.  Null and empty texts have empty arrays;
    a very long text is a chunk of its own.  The rank file must lie at ``path`` on
    every executor.  Repeated rows stay.  No shuffle.
    """
    ship_code(df.sparkSession)
    keep = [k for k in (["doc_id"] if keep is None else keep) if k not in ("ids", "offsets")]
    read = free_name(df, "_text")
    source = df.select(*keep, F.col(text).alias(read))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema.fields) + "ids array<int>, offsets array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch, chunks in encode_batches(batches, path, read):
            ids = [own for flat, first in chunks for own in np.split(flat, first[1:-1])]
            offsets = [bpe.offsets(x) for x in ids]
            columns = [batch.column(c) for c in keep] + [_lists(ids, pa.int32()), _lists(offsets, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids", "offsets"])

    return source.mapInArrow(lean(run), schema)


def decode_documents(df: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """(ids, offsets) -> the kept columns with the text: each token's bytes are put at its offset.

    Null ids or offsets give a null text; bytes that aren't UTF-8 read as U+FFFD.
    A kept column called text is replaced.
    """
    ship_code(df.sparkSession)
    keep = [k for k in (["doc_id"] if keep is None else keep) if k not in ("text", "ids", "offsets")]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema.fields) + "text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            rows = zip(batch.column("ids"), batch.column("offsets"), strict=True)
            texts = [bpe.place(np.asarray(i.values, np.int64), np.asarray(o.values, np.int64)).decode("utf-8", "replace") if i.is_valid and o.is_valid else None for i, o in rows]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, "text"])

    return df.select(*keep, "ids", "offsets").mapInArrow(lean(run), schema)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    bounds = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), kind))
