"""Media columns: bytes kept as WAV sound, and spectral-peak pair fingerprints of it.

A payload is stored as 8-bit mono samples by the wave module and read back by it. Short-time Fourier transforms of the
samples, in frames that overlap by half, give each frame's strongest local maxima; pairs of peaks of nearby frames,
(bin, bin, distance), are stored with the frame they start at as an array of time-coded integers.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents

RATE, UNIT = 8000, 64
FRAME, HOP, FAN = 512, 256, 3
#: Peaks of a frame, at most: those of its strongest bins that stand above both neighbours.
PEAKS = 3
#: Frames transformed at once: what bounds memory for a long text.
CHUNK = 2048
#: Amplitude at or below which a bin is silent: rounding alone gives less.
SILENCE = 0.01


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded with zero bytes to a positive multiple of UNIT, and the length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(UNIT, -len(raw) % UNIT + len(raw)) - len(raw)), len(raw)


def to_wav(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the PEAKS strongest local maxima of each frame's spectrum, by frame and bin; the last frames are padded with silence.

    The constant bin is no peak; of equal bins the lower one counts as higher. A frame without any sound has none.
    """
    window = np.hanning(FRAME).astype(np.float32)
    n = max(1, -(-len(samples) // HOP))
    frames, bins = [], []
    for k in range(0, n, CHUNK):
        m = min(CHUNK, n - k)
        part = np.zeros((m - 1) * HOP + FRAME, np.float32)
        sound = samples[k * HOP : (k + m - 1) * HOP + FRAME].astype(np.float32) - 128
        part[: len(sound)] = sound
        spectrum = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * window, axis=1)).astype(np.float32)
        spectrum[:, 0] = 0
        inner = spectrum[:, 1:-1]
        height = np.where((inner > spectrum[:, :-2]) & (inner >= spectrum[:, 2:]) & (inner > SILENCE), inner, 0)
        for _ in range(PEAKS):
            best = height.argmax(1)
            row = np.flatnonzero(height[np.arange(m), best] > 0)
            frames.append(row + k)
            bins.append(best[row] + 1)
            height[row, best[row]] = 0
    frame, at = np.concatenate(frames), np.concatenate(bins)
    order = np.lexsort((at, frame))
    return frame[order].astype(np.int64), at[order].astype(np.int64)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Time-coded pairs, sorted: frame << 20 | bin << 11 | later bin << 2 | frames between them, for up to FAN later frames."""
    frame, at = peaks(samples)
    first = np.searchsorted(frame, np.arange(frame[-1] + 2 + FAN)) if len(frame) else np.zeros(0, np.int64)
    out = [np.zeros(0, np.int64)]
    for d in range(1, FAN + 1):
        if not len(frame):
            break
        for k in range(PEAKS):  # the k-th peak of the later frame, where it has one
            later = first[np.minimum(frame + d, len(first) - 2)] + k
            has = np.flatnonzero((frame + d < len(first) - 1) & (later < first[np.minimum(frame + d + 1, len(first) - 1)]))
            out.append(frame[has] << 20 | at[has] << 11 | at[later[has]] << 2 | d)
    return np.sort(np.concatenate(out))


def _two(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return df, f"doc_id {df.schema['doc_id'].dataType.simpleString()}"


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # A row at a time: a batch of long texts and their sounds isn't held together.
    for b in batches:
        for k in range(b.num_rows):
            data, n = payload(b.column(1)[k].as_py())
            stored = to_wav(data)
            prints = fingerprint(np.frombuffer(from_wav(stored), np.uint8))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([n], pa.int64()), pa.array([stored], pa.binary()), pa.array([prints], pa.list_(pa.int64()))], names=["doc_id", "n_bytes", "wav", "prints"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for t in b.column(1):
            data, n = payload(t.as_py())
            stored = to_wav(data)
            back = from_wav(stored)
            prints = fingerprint(np.frombuffer(back, np.uint8))
            feature = f"{len(prints)}:{hashlib.sha256(prints.astype('<i8').tobytes()).hexdigest()[:32]}:" + ".".join(map(str, prints[:8]))
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]] if rows else [b.column(0), *[pa.array([], k) for k in kinds]], names=["doc_id", *names])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, wav (binary), prints (array of time-coded pairs) for each row.

    Null and empty texts are 64 zero bytes. Equal texts give equal values. Repeated rows repeat, other columns
    aren't read, an empty table gives an empty result.
    """
    df, key = _two(docs, id_col, text_col)
    return df.mapInArrow(_media, f"{key}, n_bytes long, wav binary, prints array<long>")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """media_columns with lengths and digests of what was stored and read back, and a feature: number of prints, their digest, the first eight."""
    df, key = _two(docs, id_col, text_col)
    return df.mapInArrow(_features, f"{key}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media(spark, sf_dir: str) -> DataFrame:
    """media_digests of all documents; nulls, empty and repeated rows as there."""
    return media_digests(documents(spark, sf_dir))
