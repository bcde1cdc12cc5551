"""Media columns: WAV bytes, short-time Fourier transforms and spectral-peak pair fingerprints.

A WAV value is written and read by the wave module. Features come from the samples read back: the
signal is cut into frames of 576 samples, each Hann-windowed frame is transformed, the strongest bin
of each frequency band is a peak if it stands out, and each peak is paired with peaks of the next
frames. A pair is stored as one 64-bit number: frame << 32 | bin << 20 | other bin << 8 | frame gap. The
four lowest bins hold what the window makes of a frame's level and slope, and are in no band.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from groundwork.llm.common import ship, slices

FRAME = 576
BANDS = ((4, 12), (12, 24), (24, 48), (48, 96), (96, 192), (192, 289))
FRAMES_AT_ONCE = 2048


def padded(raw: bytes, unit: int = FRAME, fill: int = 255) -> bytes:
    """Fill up to a positive multiple of `unit`."""
    return raw + bytes([fill]) * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def to_wav(samples: bytes, rate: int = 8000) -> bytes:
    """One channel of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: bytes, frame: int = FRAME) -> tuple[np.ndarray, np.ndarray]:
    """Bin of the strongest peak by frame and band (-1: none stands out), and the level of each."""
    signal = np.frombuffer(samples, np.uint8)
    n = len(signal) // frame
    window = np.hanning(frame).astype(np.float32)
    bins, levels = np.full((n, len(BANDS)), -1, np.int32), np.zeros((n, len(BANDS)), np.float32)
    for start in range(0, n, FRAMES_AT_ONCE):
        part = signal[start * frame : min(n, start + FRAMES_AT_ONCE) * frame].reshape(-1, frame).astype(np.float32)
        part -= part.mean(axis=1, keepdims=True)
        spectrum = np.fft.rfft(part * window, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        for b, (lo, hi) in enumerate(BANDS):
            at = power[:, lo:hi].argmax(axis=1)
            top = power[np.arange(len(part)), lo + at]
            loud = top > 2.0 * power[:, lo:hi].mean(axis=1) + 1.0
            bins[start : start + len(part), b] = np.where(loud, lo + at, -1)
            levels[start : start + len(part), b] = top
    return bins, levels


def fingerprint(samples: bytes, reach: int = 2, frame: int = FRAME) -> np.ndarray:
    """Sorted pair codes of a signal: each peak with the peaks of its own and the next band in the next `reach` frames."""
    bins, _ = peaks(samples, frame)
    codes = []
    n = len(bins)
    for gap in range(1, reach + 1):
        for band in range(len(BANDS)):
            for other in (band, (band + 1) % len(BANDS)):
                a, b = bins[: n - gap, band], bins[gap:, other]
                t = np.flatnonzero((a >= 0) & (b >= 0)) if n > gap else np.empty(0, np.int64)
                codes.append((t << 32) | (a[t].astype(np.int64) << 20) | (b[t].astype(np.int64) << 8) | gap)
    return np.sort(np.concatenate(codes))


def media_columns(df: DataFrame, text: str = "text", rate: int = 8000, keep_media: bool = True, keep_fingerprint: bool = True) -> DataFrame:
    """Store each text's UTF-8 bytes as WAV samples and add what reading the stored form back gives.

    Adds n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, n_pairs,
    feature (the frame count, the pair count and the sha256 of the codes), and on wish media (the WAV
    value) and fingerprint (the codes). Null counts as empty; an empty text is one frame of fill.
    Equal texts get equal values, a table without rows an empty result. Columns of these names are
    replaced, others pass through. Work and memory are by row: a few times the text itself.
    """
    ship(df.sparkSession)
    added = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "n_pairs": "long", "feature": "string"}
    added |= {"media": "binary"} if keep_media else {}
    added |= {"fingerprint": "array<long>"} if keep_fingerprint else {}
    base = df.drop(*added)
    schema = T.StructType(list(base.schema.fields))
    for name, kind in added.items():
        schema = schema.add(name, pa_kind(kind))

    def work(batches):
        for batch in slices(batches, 128):
            got: dict[str, list] = {k: [] for k in added}
            for raw in batch.column(text).cast(pa.binary()).to_pylist():
                raw = raw or b""
                media = to_wav(padded(raw), rate)
                payload = from_wav(media)
                codes = fingerprint(payload)
                row = {
                    "n_bytes": len(raw), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
                    "n_pairs": len(codes), "feature": f"{len(payload) // FRAME}:{len(codes)}:{hashlib.sha256(codes.tobytes()).hexdigest()}", "media": media, "fingerprint": codes,
                }
                for k in added:
                    got[k].append(row[k])
            for name, kind in added.items():
                batch = batch.append_column(name, pa.array(got[name], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[kind]))
            yield batch

    return base.mapInArrow(work, schema)


def pa_kind(kind: str) -> T.DataType:
    return {"long": T.LongType(), "string": T.StringType(), "binary": T.BinaryType(), "array<long>": T.ArrayType(T.LongType())}[kind]
