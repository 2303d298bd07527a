"""Media columns: WAV bytes by the wave module, and spectral-peak pair fingerprints.

A payload is stored as 8-bit mono PCM, read back through ``wave``, cut into frames and
transformed (short-time Fourier transform). Local maxima of the spectrogram become peaks;
each peak is paired with the peaks that follow it. The fingerprint is an array of longs,
each coded time << 32 | frequency << 16 | frequency of the partner << 8 | frames between.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vellum.llm.common import map_rows, table

FRAME, HOP, RATE = 256, 128, 8000
#: A peak stands out of its frame's mean by this factor; it pairs with the next FAN peaks up to REACH frames on.
STANDS_OUT, FAN, REACH = 2.0, 3, 16
#: Frames transformed at once; bounds memory, without effect on results.
BLOCK = 4096
HANN = np.hanning(FRAME + 1)[:-1]


def to_wav(payload: bytes) -> bytes:
    """The payload as an 8-bit mono WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """All samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(data: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def spectrum(samples: np.ndarray, first: int, last: int) -> np.ndarray:
    """Magnitudes of frames first..last-1."""
    part = samples[first * HOP : (last - 1) * HOP + FRAME]
    frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
    return np.abs(np.fft.rfft((frames - 128.0) * HANN, axis=1))


def peaks(payload: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of frames, and times and frequencies of the spectrogram's local maxima, in order."""
    samples = np.frombuffer(payload, np.uint8)
    total = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    samples = np.pad(samples, (0, (total - 1) * HOP + FRAME - len(samples)), constant_values=128)
    times, bins = [], []
    for first in range(0, total, BLOCK):
        last = min(total, first + BLOCK)
        low, high = max(0, first - 1), min(total, last + 1)
        m = spectrum(samples, low, high)
        e = np.pad(m, ((first == low, last == high), (1, 1)), constant_values=-1.0)
        c = e[1:-1, 1:-1]
        m = m[first - low : first - low + last - first]
        top = (c > e[1:-1, :-2]) & (c >= e[1:-1, 2:]) & (c > e[:-2, 1:-1]) & (c >= e[2:, 1:-1]) & (m > STANDS_OUT * m.mean(axis=1, keepdims=True) + 1e-6)
        t, f = np.nonzero(top)
        times.append(t + first)
        bins.append(f)
    return total, np.concatenate(times), np.concatenate(bins)


def fingerprint(payload: bytes) -> tuple[int, int, np.ndarray]:
    """Frames, peaks, and the time-coded pair array of a payload."""
    total, t, f = peaks(payload)
    codes = []
    for k in range(1, FAN + 1):
        apart = t[k:] - t[:-k]
        near = apart <= REACH
        codes.append((t[:-k] << 32 | f[:-k] << 16 | f[k:] << 8 | apart)[near])
    return total, len(t), np.sort(np.concatenate(codes)).astype(np.int64)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = True) -> DataFrame:
    """Store every whole text as WAV and fingerprint what is read back.

    Returns id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature and, with ``stored``, the columns media (binary) and fingerprint (array<long>).
    A null text counts as empty: a payload of 64 zero bytes. Equal texts give equal values;
    repeated rows give repeated rows; an empty table gives an empty one; other columns are
    never read.
    """

    def work(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "fingerprint")}
            for text in part.column(1).to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                media = to_wav(padded(data))
                payload = from_wav(media)
                frames, n, pairs = fingerprint(payload)
                digest = hashlib.sha256(pairs.astype("<i8").tobytes()).hexdigest()
                row = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{frames}:{n}:{len(pairs)}:{digest}", media if stored else None, pairs if stored else None)
                for column, value in zip(out.values(), row):
                    column.append(value)
            yield {id_col: part.column(0)} | out

    kind = dict(docs.select(id_col).dtypes)[id_col]
    schema = f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(docs, [id_col, text_col], work, schema + ", media binary, fingerprint array<long>" * stored)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the digest columns of every document."""
    return media_columns(table(spark, sf_dir, "documents"), stored=False)
