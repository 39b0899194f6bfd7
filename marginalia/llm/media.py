"""Media columns: 8-bit audio and its features.

A payload is stored as a mono 8-bit PCM file, one byte a sample, and read back. Its
features are a log-mel spectrogram of the polyphase-resampled signal in overlapping
frames, and segments of activity found by hysteresis on frame energy. They are
stored as an Arrow stream of fixed-shape tensors, one per block of FRAMES frames,
each with its time span.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

RATE, UP, DOWN = 16000, 1, 2  # samples a second of the stored file; the features' rate is RATE * UP / DOWN
WINDOW, HOP, BANDS = 256, 128, 24  # samples of a frame and between frames at the features' rate; mel bands
FRAMES = 64  # frames of a tensor
TAPS = 8  # taps of the resampling filter for each phase and unit of DOWN
ON, OFF = 1.0, 0.25  # a segment starts above mean + ON, and ends below mean + OFF, deviations of the frames' log energy
_BLOCK = 2048  # frames computed at once, which bounds the memory of a long signal
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def wav(payload: bytes) -> bytes:
    """A RIFF/WAVE file of mono unsigned 8-bit samples, each a byte of the payload; RIFF pads an odd size."""
    n, pad = len(payload), len(payload) & 1
    if 36 + n + pad >= 1 << 32:
        raise ValueError("a RIFF file holds less than 4 GiB")
    return _HEADER.pack(b"RIFF", 36 + n + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload + b"\0" * pad


def wav_samples(media: bytes) -> bytes:
    """The samples of a file that wav() wrote."""
    riff, _, wave, fmt, size, kind, channels, _, _, _, bits, data, n = _HEADER.unpack_from(media)
    if (riff, wave, fmt, size, kind, channels, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, 8, b"data"):
        raise ValueError("not a mono 8-bit PCM file")
    return media[_HEADER.size : _HEADER.size + n]


@lru_cache
def _lowpass(up: int, down: int) -> np.ndarray:
    """A Hamming-windowed sinc low-pass filter for both rates, its length a multiple of up."""
    widest = max(up, down)
    n = TAPS * widest * up
    at = np.arange(n) - (n - 1) / 2
    taps = np.sinc(at / widest) / widest * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    return (taps / taps.sum() * up).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling by up/down: output k uses only the filter phase that meets existing samples."""
    taps = _lowpass(up, down)
    per = len(taps) // up
    n_out = (len(x) * up + down - 1) // down
    padded = np.concatenate([np.zeros(per - 1, np.float32), x, np.zeros(per, np.float32)])
    out = np.empty(n_out, np.float32)
    shift = (len(taps) - 1) // 2  # the filter's delay
    for phase_at in range(min(up, n_out)):
        k = np.arange(phase_at, n_out, up)
        position = k[0] * down + shift
        phase, first, step = position % up, position // up, down
        acc = np.zeros(len(k), np.float32)
        for j, tap in enumerate(taps[phase::up]):
            start = first - j + per - 1
            need = start + step * (len(k) - 1) + 1
            if need > len(padded):
                padded = np.concatenate([padded, np.zeros(need - len(padded), np.float32)])
            acc += tap * padded[start:need:step]
        out[phase_at::up] = acc
    return out


@lru_cache
def _mel(rate: int) -> np.ndarray:
    """(bins, BANDS) triangular filters, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), BANDS + 2) / 2595) - 1)
    bins = np.arange(WINDOW // 2 + 1) * rate / WINDOW
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    up, down = (bins[:, None] - low) / (mid - low), (high - bins[:, None]) / (high - mid)
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@lru_cache
def _hann() -> np.ndarray:
    return (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames, BANDS) log-mel energies and (frames,) log energies, of overlapping frames; the last is zero-padded."""
    count = max(1, -(-(len(x) - WINDOW) // HOP) + 1)
    x = np.concatenate([x, np.zeros(WINDOW + (count - 1) * HOP - len(x), np.float32)]) if len(x) < WINDOW + (count - 1) * HOP else x
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP][:count]
    mel, energy = np.empty((count, BANDS), np.float32), np.empty(count, np.float32)
    for a in range(0, count, _BLOCK):
        part = frames[a : a + _BLOCK] * _hann()
        spectrum = np.fft.rfft(part, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mel[a : a + _BLOCK] = np.log(power.astype(np.float32) @ _mel(rate) + 1e-6)
        energy[a : a + _BLOCK] = np.log(np.einsum("ij,ij->i", part, part) + 1e-6)
    return mel, energy


def segments(energy: np.ndarray, on: float = ON, off: float = OFF) -> np.ndarray:
    """(n, 2) frame ranges: a segment opens where energy exceeds the upper threshold and closes where it falls below the lower."""
    mean, deviation = float(energy.mean()), float(energy.std())
    state = np.where(energy > mean + on * deviation, 1, np.where(energy < mean + off * deviation, -1, 0))
    known = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    active = np.where(known >= 0, state[known] > 0, False)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], active.astype(np.int8), [0]])))
    return edges.reshape(-1, 2)


TENSOR = pa.fixed_shape_tensor(pa.float32(), [FRAMES, BANDS])
STREAM = pa.schema([("tensor", TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64()), ("active", pa.list_(pa.float64()))])


def features(samples: bytes) -> bytes:
    """An Arrow stream: a row per block of FRAMES frames with its log-mel tensor (zero-padded), its time span and the segments that start in it, as start and end seconds in turn."""
    rate = RATE * UP // DOWN
    x = resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128)
    mel, energy = log_mel(x, rate)
    blocks = -(-len(mel) // FRAMES)
    tensor = np.zeros((blocks, FRAMES, BANDS), np.float32)
    tensor.reshape(-1, BANDS)[: len(mel)] = mel
    spans = segments(energy)
    owner = np.searchsorted(spans[:, 0], np.arange(blocks + 1) * FRAMES)
    step = HOP / rate
    starts = np.arange(blocks) * FRAMES * step
    ends = np.minimum((np.arange(blocks) + 1) * FRAMES, len(mel)) * step
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensor.reshape(-1)), FRAMES * BANDS)
    active = pa.ListArray.from_arrays(pa.array((owner * 2).astype(np.int32)), pa.array((spans * step).reshape(-1)))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, STREAM) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(TENSOR, flat), pa.array(starts), pa.array(ends), active], schema=STREAM))
    return sink.getvalue().to_pybytes()


def summary(stream: bytes) -> str:
    """What a feature column shows of a stored stream: its shape, time, segments, the mean log-mel and a checksum."""
    batch = pa.ipc.open_stream(stream).read_next_batch()
    flat = batch.column(0).storage.flatten().to_numpy(zero_copy_only=False)
    tensor = flat.reshape(-1, BANDS)
    end = batch.column(2)[-1].as_py()
    frames = round(end * RATE * UP / DOWN / HOP)
    mean = np.rint(tensor[:frames].mean(axis=0) * 10).astype(int)
    marks = batch.column(3).values.to_numpy(zero_copy_only=False).reshape(-1, 2)
    active = float((marks[:, 1] - marks[:, 0]).sum())
    return f"tensors={batch.num_rows}x{FRAMES}x{BANDS};seconds={end:.3f};segments={len(marks)};active={active:.3f};mel={','.join(map(str, mean))};crc={zlib.crc32(np.rint(flat * 8).astype(np.int16).tobytes()):08x}"


def audio_features(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = True) -> DataFrame:
    """Each text as a stored audio file with its features; no shuffle.

    The payload is the text in UTF-8 (null: empty) with zero bytes up to a positive
    multiple of 64. Returns key, n_bytes, payload_bytes, payload_sha256 and tail_crc32
    (of the samples read back, the CRC of their last 64), media_bytes, media_sha256,
    feature, and with keep_media the columns media and tensors (the Arrow stream).
    Rows are independent, so equal texts give equal values; a row is computed in
    blocks, and a text needs some 12 bytes of memory for each of its own.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("raw"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media", "tensors"] * keep_media
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                media = wav(raw + bytes(-len(raw) % 64 if raw else 64))
                back = wav_samples(media)
                stream = features(back)
                rows.append((key, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), summary(stream), media, stream)[: len(names)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary, tensors binary" * keep_media)
