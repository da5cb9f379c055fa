"""Vectorised word and shingle hashing over Arrow string buffers.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8
text; A-Z compare as a-z.  Everything works on the raw Arrow buffers: no Python
string is made, whatever the number of documents or their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _U(0xD6E8FEB86659FD93)
#: Bytes hashed at once; a longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 19

_byte_codes = np.random.RandomState(20240229).randint(0, 2**63 - 1, 256, dtype=np.int64).view(_U) | _U(1)
_byte_codes[65:91] = _byte_codes[97:123]
_is_space = np.zeros(256, bool)
_is_space[[0x20, *range(0x09, 0x0E)]] = True
_powers = {1: np.ones(1, _U), -1: np.ones(1, _U)}


def _power(n: int, sign: int) -> np.ndarray:
    """The first n powers of the multiplier, or of its inverse, modulo 2**64."""
    if len(_powers[sign]) < n:
        base = np.full(max(n, CHUNK_BYTES + 1), _MULT if sign > 0 else _INV, _U)
        base[0] = 1
        _powers[sign] = np.cumprod(base, dtype=_U)
    return _powers[sign][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the output."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, row bounds in the bytes) of consecutive rows; null reads as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + chunk_bytes, "right")) - 1)
        last = min(last, n)
        yield first, last, flat[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def word_spans(data: np.ndarray, bounds: np.ndarray, member: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in a chunk, and for each row the index of its first word (one more at the end).

    member: which bytes make words, if not all but white space.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = ~_is_space[data] if member is None else member[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a difference of prefix sums, moved to position 0, then mixed."""
    if not len(starts):
        return np.zeros(0, _U)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_byte_codes[data] * _power(len(data), 1), dtype=_U, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _power(len(data), -1)[starts])


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a row (a shorter row is one run), and each row's first index into them."""
    count = np.diff(first)
    made = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(made, out=out_first[1:])
    out = np.zeros(int(out_first[-1]), _U)
    if len(words) >= width:
        runs = np.zeros(len(words) - width + 1, _U)
        for j in range(width):
            runs = runs * _STEP + words[j : len(words) - width + 1 + j]
        long_rows = np.flatnonzero(count >= width)
        take = np.arange(int(made[long_rows].sum()))
        begin = np.zeros(len(long_rows), np.int64)
        np.cumsum(made[long_rows][:-1], out=begin[1:])
        out[take + np.repeat(out_first[long_rows] - begin, made[long_rows])] = runs[take + np.repeat(first[long_rows] - begin, made[long_rows])]
    for row in np.flatnonzero((count > 0) & (count < width)):
        h = _U(0)
        with np.errstate(over="ignore"):
            for w in words[first[row] : first[row + 1]]:
                h = h * _STEP + w
            out[out_first[row]] = h + _U(count[row]) * _INV
    return mix64(out), out_first
