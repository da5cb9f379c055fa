"""Audio columns: lossless 8-bit storage, polyphase resampling, log-mel filterbanks, energy segments.

The stored form is a mono 8-bit PCM WAV file.  Features come from the stored
bytes alone: the samples are resampled by a polyphase filter, cut to overlapping
Hann frames, turned to log-mel bands, and segmented by frame energy with two
thresholds.  Each segment becomes a tensor of fixed shape with its time span;
a row's segments are stored as an Arrow table whose tensor column has the type
fixed_shape_tensor, so the shape travels with the values.
"""

from __future__ import annotations

import functools
import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import free_name, lean, ship_code

PAD = 64


@dataclass(frozen=True)
class AudioConfig:
    """Parameters of the features; the stored form only depends on ``rate``."""

    rate: int = 8000
    up: int = 4
    down: int = 5
    taps: int = 8
    frame: int = 256
    hop: int = 128
    bands: int = 24
    #: Frames in each stored tensor: longer segments are averaged, shorter ones repeated.
    shape: int = 16
    #: A segment opens above ``high`` and closes below ``low``, in decibels against the median frame.
    high: float = 1.0
    low: float = 0.25
    #: Frames computed at once, which bounds memory whatever the length.
    block: int = 4096

    @property
    def new_rate(self) -> float:
        return self.rate * self.up / self.down


def to_payload(text: bytes) -> bytes:
    """The bytes with zeros appended up to a positive multiple of 64."""
    return text + bytes(PAD if not text else -len(text) % PAD)


def to_wav(payload: bytes, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        return r.readframes(r.getnframes())


@functools.cache
def _filter(c: AudioConfig) -> np.ndarray:
    """One low-pass filter of ``taps`` coefficients for each of the ``up`` phases."""
    n = c.up * c.taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(c.up, c.down)
    h = np.sinc(t * cut) * cut * np.hamming(n) * c.up
    return np.ascontiguousarray(h.reshape(c.taps, c.up).T[:, ::-1]).astype(np.float32)


@functools.cache
def _mel(c: AudioConfig) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, on the bins of a frame's spectrum."""
    top = 2595 * np.log10(1 + c.new_rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, c.bands + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(c.frame, 1 / c.new_rate)[:, None]
    lo, mid, hi = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((bins - lo) / (mid - lo), (hi - bins) / (hi - mid))).astype(np.float32) + np.float32(1e-6)


def resample(x: np.ndarray, c: AudioConfig) -> np.ndarray:
    """x at up/down times its rate: output i takes phase i*down % up of the filter at sample i*down // up."""
    n = len(x) * c.up // c.down
    out = np.empty(n, np.float32)
    padded = np.concatenate([np.zeros(c.taps - 1, np.float32), x, np.zeros(1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, c.taps)
    bank = _filter(c)
    for first in range(min(c.up, n)):
        i = np.arange(first, n, c.up)
        start = first * c.down // c.up
        out[i] = windows[start : start + c.down * len(i) : c.down] @ bank[first * c.down % c.up]
    return out


def log_mel(x: np.ndarray, c: AudioConfig) -> np.ndarray:
    """(frames, bands) in decibels; at least one frame, the last padded with silence."""
    frames = max(1, -(-max(0, len(x) - c.frame) // c.hop) + 1)
    padded = np.concatenate([x, np.zeros(max(0, (frames - 1) * c.hop + c.frame - len(x)), np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, c.frame)[:: c.hop][:frames]
    hann = np.hanning(c.frame).astype(np.float32)
    out = np.empty((frames, c.bands), np.float32)
    for at in range(0, frames, c.block):
        s = np.fft.rfft(windows[at : at + c.block] * hann, axis=1)
        out[at : at + c.block] = 10 * np.log10((s.real**2 + s.imag**2).astype(np.float32) @ _mel(c) + np.float32(1e-3))
    return out


def segments(energy: np.ndarray, c: AudioConfig) -> list[tuple[int, int]]:
    """Frame spans by hysteresis: a span is a run of frames at or above ``low`` that reaches ``high`` somewhere."""
    level = energy - np.median(energy)
    above = np.concatenate([[False], level >= c.low, [False]])
    edges = np.flatnonzero(above[1:] != above[:-1]).reshape(-1, 2)
    reach = np.zeros(len(level) + 1, np.int64)
    np.cumsum(level >= c.high, out=reach[1:])
    return [(int(a), int(b)) for a, b in edges if reach[b] > reach[a]]


def tensors(mel: np.ndarray, spans: list[tuple[int, int]], c: AudioConfig) -> np.ndarray:
    """(spans, shape, bands): each span in ``shape`` steps, a step being the mean of its frames."""
    out = np.empty((len(spans), c.shape, c.bands), np.float32)
    sums = np.zeros((len(mel) + 1, c.bands))
    np.cumsum(mel, axis=0, dtype=np.float64, out=sums[1:])
    for k, (a, b) in enumerate(spans):
        lo = a + np.arange(c.shape) * (b - a) // c.shape
        hi = np.maximum(a + (np.arange(c.shape) + 1) * (b - a) // c.shape, lo + 1)
        out[k] = (sums[hi] - sums[lo]) / (hi - lo)[:, None]
    return out


@dataclass(frozen=True)
class Features:
    """mel: all frames' bands; values: a tensor a segment; times: its start and end in seconds."""

    mel: np.ndarray
    spans: list[tuple[int, int]]
    values: np.ndarray
    times: np.ndarray

    def as_tensor_array(self) -> pa.ExtensionArray:
        """The values as an Arrow array of fixed-shape tensors."""
        shape = self.values.shape[1:]
        return pa.ExtensionArray.from_storage(
            pa.fixed_shape_tensor(pa.float32(), shape), pa.FixedSizeListArray.from_arrays(pa.array(self.values.ravel()), int(np.prod(shape)))
        )

    def stored(self) -> bytes:
        """The segments as an Arrow stream: start_s, end_s, tensor; frames and the bands' mean and spread as its metadata."""
        about = {"frames": str(len(self.mel)), "mean": f"{self.mel.mean(dtype=np.float64):.2f}", "sd": f"{self.mel.std(dtype=np.float64):.2f}"}
        batch = pa.RecordBatch.from_arrays([pa.array(self.times[:, 0]), pa.array(self.times[:, 1]), self.as_tensor_array()], names=["start_s", "end_s", "tensor"])
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema.with_metadata(about)) as w:
            w.write_batch(batch)
        return out.getvalue().to_pybytes()


@dataclass(frozen=True)
class StoredFeatures:
    """What Features.stored() wrote, read back."""

    about: dict[str, str]
    times: np.ndarray
    values: np.ndarray

    @classmethod
    def read(cls, stored: bytes) -> StoredFeatures:
        with pa.ipc.open_stream(stored) as r:
            about = {k.decode(): v.decode() for k, v in r.schema.metadata.items()}
            batch = r.read_next_batch()
        tensor = batch.column("tensor")
        values = tensor.storage.values.to_numpy().reshape(-1, *tensor.type.shape)
        return cls(about, np.stack([batch.column("start_s").to_numpy(), batch.column("end_s").to_numpy()], 1), values)

    def digest(self) -> str:
        """Frames, segments, mean and spread of the bands, shape, and checksums of the time spans (in milliseconds) and of the tensors (in tenths of a decibel)."""
        tenths, ms = np.round(self.values * 10).astype("<i4"), np.round(self.times * 1000).astype("<i8")
        return (
            f"frames={self.about['frames']};segments={len(self.values)};mean={self.about['mean']};sd={self.about['sd']};"
            f"shape={'x'.join(map(str, self.values.shape[1:]))};spans={zlib.crc32(ms.tobytes()):08x};tensors={zlib.crc32(tenths.tobytes()):08x}"
        )


def features(samples: bytes, c: AudioConfig) -> Features:
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x, c), c)
    spans = segments(mel.mean(1), c)
    step = c.hop / c.new_rate
    times = np.array([(a * step, (b - 1) * step + c.frame / c.new_rate) for a, b in spans]).reshape(-1, 2)
    return Features(mel, spans, tensors(mel, spans, c), times)


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """Each row's UTF-8 bytes; null reads as empty."""
    return (x or b"" for x in column.cast(pa.binary()).to_pylist())


def _kept(df: DataFrame, keep: tuple[str, ...], new: list[str]) -> tuple[list[str], str]:
    """The kept columns that the new ones don't replace, and their schema."""
    names = [k for k in keep if k not in new]
    return names, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*names).schema.fields)


def store_media(df: DataFrame, text: str = "text", config: AudioConfig | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_bytes and media: the whole text's bytes, padded and stored as an 8-bit WAV file.

    Null and empty texts are 64 zero bytes.  Kept columns called like the new ones
    are replaced.  Repeated rows stay.  No shuffle.
    """
    c = config or AudioConfig()
    ship_code(df.sparkSession)
    keep, schema = _kept(df, keep, ["n_bytes", "media"])
    read = free_name(df, "_text")
    source = df.select(*keep, F.col(text).alias(read))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = list(text_bytes(batch.column(read)))
            media = [to_wav(to_payload(x), c.rate) for x in raw]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return source.mapInArrow(lean(run), schema + "n_bytes long, media binary")


def feature_tensors(df: DataFrame, config: AudioConfig | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with tensors: each media value's segments as an Arrow stream (see Features.stored); null media: null.

    A kept column called tensors is replaced.  Media without a segment have an empty table.
    """
    c = config or AudioConfig()
    ship_code(df.sparkSession)
    keep, schema = _kept(df, keep, ["tensors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if m is None else features(from_wav(m), c).stored() for m in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(found, pa.binary())], names=[*keep, "tensors"])

    return df.select(*keep, F.col("media").alias(free_name(df, "_media"))).mapInArrow(lean(run), schema + "tensors binary")


def audio_features(df: DataFrame, config: AudioConfig | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each energy segment of each row's stored tensors: the kept columns, segment, start_s, end_s and tensor.

    tensor is a flat array<float>; its column's metadata has the shape.  Null media
    have no rows; so have media whose energy never reaches the threshold.  Kept
    columns called like the new ones are replaced.
    """
    c = config or AudioConfig()
    new = ["segment", "start_s", "end_s", "tensor"]
    stored = feature_tensors(df, c, tuple(k for k in keep if k not in new))
    keep, schema = _kept(stored, tuple(k for k in stored.columns if k != "tensors"), new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if t is None else StoredFeatures.read(t) for t in batch.column("tensors").to_pylist()]
            n = [0 if f is None else len(f.values) for f in found]
            some = [f for f in found if f is not None and len(f.values)]
            values = np.concatenate([f.values.reshape(len(f.values), -1) for f in some]) if some else np.zeros((0, c.shape * c.bands), np.float32)
            times = np.concatenate([f.times for f in some]) if some else np.zeros((0, 2))
            number = np.concatenate([np.arange(k) for k in n]) if n else np.zeros(0)
            rows = pa.array(np.repeat(np.arange(len(found)), n), pa.int64())
            bounds = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
            columns = [pa.array(number, pa.int32()), pa.array(times[:, 0]), pa.array(times[:, 1]), pa.ListArray.from_arrays(bounds, pa.array(values.ravel(), pa.float32()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(rows) for k in keep], *columns], names=[*keep, *new])

    out = stored.mapInArrow(lean(run), schema + "segment int, start_s double, end_s double, tensor array<float>")
    return out.select(*keep, *new[:3], F.col("tensor").alias("tensor", metadata={"shape": [c.shape, c.bands]}))


def media_digests(df: DataFrame, config: AudioConfig | None = None) -> DataFrame:
    """(doc_id, n_bytes, media) -> one row each with checksums of what was stored and read back, of the media and of the features' tensors."""
    c = config or AudioConfig()
    ship_code(df.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for media in batch.column("media"):
                media = media.as_py()
                back = from_wav(media)
                tensors = StoredFeatures.read(features(back, c).stored())
                for column, value in zip(out, (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), tensors.digest()), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(v, t) for v, t in zip(out, types, strict=True)]], names=["doc_id", "n_bytes", *names])

    return df.select("doc_id", "n_bytes", "media").mapInArrow(lean(run), schema)
