"""Audio columns: bytes stored as 8-bit samples, read back, resampled, and described by log-mel tensors and segments.

Each document is computed by itself, in blocks of bounded size, so that equal payloads give equal results wherever they are.
"""

from __future__ import annotations

import io
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_text

#: Production parameters: samples a second as stored and as analysed (3 for every 4), half-width of the filter in input samples.
RATE, UP, DOWN, HALF = 16_000, 3, 4, 6
#: Samples of a frame and from one frame to the next, bands, frames of a tensor.
FRAME, HOP, FFT, BANDS, TENSOR_FRAMES = 300, 120, 512, 24, 64
#: Decibels above the clip's median frame energy at which a segment starts, and at which it ends.
START_DB, END_DB = 1.0, 0.0
#: Payloads are a positive multiple of this many bytes; frames that are computed at a time.
UNIT, BLOCK = 64, 2048
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
TEXT_BYTES = 2 << 20


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM file."""
    return HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def read_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of an 8-bit PCM file, found by its chunks."""
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples in this file")


@lru_cache(maxsize=8)
def phases(up: int, down: int) -> np.ndarray:
    """The low-pass filter at the rate of up times the input, a row of taps for each phase: a sinc in a Hann window."""
    width = HALF * up
    t = np.arange(-width, width)
    cutoff = 1 / max(up, down)
    taps = cutoff * np.sinc(cutoff * t) * (0.5 + 0.5 * np.cos(np.pi * t / width)) * up
    return np.ascontiguousarray(taps.reshape(2 * HALF, up).T[:, ::-1], np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling by up / down: sample m of the result lies at m * down / up of x; ends are padded with zeros."""
    n = -(-len(x) * up // down)
    filters = phases(up, down)
    padded = np.concatenate([np.zeros(HALF, np.float32), x, np.zeros(HALF + down, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * HALF)
    y = np.empty(n, np.float32)
    for first in range(min(up, n)):
        at, phase = divmod(first * down, up)
        count = len(range(first, n, up))
        for a in range(0, count, BLOCK * 16):
            b = min(count, a + BLOCK * 16)
            y[first + a * up : first + (b - 1) * up + 1 : up] = windows[at + 1 + a * down : at + 1 + (b - 1) * down + 1 : down] @ filters[phase]
    return y


@lru_cache(maxsize=2)
def mel_bands(rate: int) -> np.ndarray:
    """Triangles equally spaced on the mel scale, a column for each band."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), BANDS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Overlapped frames as (frames, BANDS) logarithms, rounded to 4096ths so that they don't depend on a machine's vector units, and the energy of each frame in decibels. The last frame is padded."""
    frames = 1 + max(0, -(-(len(y) - FRAME) // HOP))
    padded = np.concatenate([y, np.zeros((frames - 1) * HOP + FRAME - len(y), np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    hann, bands = np.hanning(FRAME + 2)[1:-1].astype(np.float32), mel_bands(int(rate))
    mels, energy = np.empty((frames, BANDS), np.float32), np.empty(frames)
    for a in range(0, frames, BLOCK):
        block = windows[a : a + BLOCK]
        spectrum = np.fft.rfft(block * hann, FFT)
        mels[a : a + BLOCK] = np.rint(np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bands + 1e-8) * 4096) / 4096
        energy[a : a + BLOCK] = 10 * np.log10(np.mean(block.astype(np.float64) ** 2, 1) + 1e-10)
    return mels, energy


def segments(energy: np.ndarray, rate: float, length: int) -> list[tuple[float, float]]:
    """Spans in seconds that start at a frame START_DB above the median and last until one below END_DB above it."""
    middle = float(np.median(energy))
    low = np.concatenate(([False], energy >= middle + END_DB, [False]))
    edges = np.flatnonzero(low[1:] != low[:-1])
    starts, ends = edges[::2], edges[1::2]
    high = np.concatenate(([0], np.cumsum(energy >= middle + START_DB)))
    found = []
    for a, b in zip(starts, ends):
        if high[b] > high[a]:
            first = a + int(np.argmax(energy[a:b] >= middle + START_DB))
            found.append((first * HOP / rate, min(length, (b - 1) * HOP + FRAME) / rate))
    return found


def tensors(mels: np.ndarray, rate: float, length: int) -> bytes:
    """An Arrow stream of rows start_s, end_s, log_mel: a fixed-shape tensor of TENSOR_FRAMES by BANDS, the last padded with zeros."""
    count = -(-len(mels) // TENSOR_FRAMES)
    padded = np.zeros((count * TENSOR_FRAMES, BANDS), np.float32)
    padded[: len(mels)] = mels
    kind = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, BANDS))
    storage = pa.FixedSizeListArray.from_arrays(pa.array(padded.ravel()), TENSOR_FRAMES * BANDS)
    first = np.arange(count) * TENSOR_FRAMES
    end = np.minimum(length, (np.minimum(first + TENSOR_FRAMES, len(mels)) - 1) * HOP + FRAME) / rate
    batch = pa.RecordBatch.from_arrays([pa.array(first * HOP / rate), pa.array(end), pa.ExtensionArray.from_storage(kind, storage)], names=["start_s", "end_s", "log_mel"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def read_tensors(stored: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start_s, end_s and the tensors (count, TENSOR_FRAMES, BANDS) of one document."""
    table = pa.ipc.open_stream(stored).read_all().combine_chunks()
    return table["start_s"].to_numpy(), table["end_s"].to_numpy(), table["log_mel"].chunk(0).to_numpy_ndarray()


def describe(media: bytes) -> tuple[bytes, list[tuple[float, float]]]:
    """Tensors and segments of a stored file."""
    samples, rate = read_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y, rate = resample(x), rate * UP / DOWN
    mels, energy = log_mel(y, rate)
    return tensors(mels, rate, len(y)), segments(energy, rate, len(y))


def audio_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, media (binary WAV), log_mel (binary Arrow stream of fixed-shape tensors with time spans), segments (array of start_s, end_s).

    The UTF-8 bytes of each whole text, with bytes 0 up to a positive multiple of UNIT, are the samples; a null text counts
    as empty (UNIT zero bytes). Rows map one to one; other columns of df are ignored.
    """
    span = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch[text_col].to_pylist()
        media = [to_wav(payload_of(t)) for t in texts]
        made = [describe(m) for m in media]
        spans = pa.array([[{"start_s": a, "end_s": b} for a, b in s] for _, s in made], pa.list_(span))
        return pa.RecordBatch.from_arrays([batch[id_col], pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(media, pa.binary()), pa.array([t for t, _ in made], pa.binary()), spans], names=[id_col, "n_bytes", "media", "log_mel", "segments"])

    return map_text(df, [id_col], text_col, f, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, media binary, log_mel binary, segments array<struct<start_s double, end_s double>>", TEXT_BYTES)
