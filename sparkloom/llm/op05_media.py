"""Media columns: WAV payloads, short-time spectra and peak-pair fingerprints.

``store`` writes bytes losslessly as 8-bit mono samples (the ``wave`` module) in a binary
column; ``features`` and ``digests`` read the stored bytes back; ``fingerprints`` takes a short-time Fourier transform
(256 samples less their mean, a step of 128, Hann window), keeps in each of four frequency bands the
strongest bin where it tops its neighbours in time, and pairs each peak with up to
three that follow within 31 frames.  A pair is (frame, code), the code holding both
bins and the frames between; the pairs of a clip are a time-coded array.

Nulls: a null text is empty; an empty payload is padded to 64 zero bytes; a clip
shorter than a window is padded with silence, like the last window of any clip.  Long
clips are transformed a block of frames at a time.  Rows that repeat a doc_id each have
a row; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbytes import U, mix, pieces
from .work import Scratch, table

RATE, FRAME, HOP, BANDS, FAN, SPAN, BLOCK = 8000, 256, 128, 4, 3, 31, 8192
SKETCH = 16
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 or (64 if not data else 0))


def _peaks(samples: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(strength, bin) in each band of the frames that start at ``first``."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[first]
    spec = np.fft.rfft((frames - frames.mean(1, keepdims=True)) * _WINDOW, axis=1)[:, 1:]
    power = (spec.real**2 + spec.imag**2).astype(np.float32).reshape(len(first), BANDS, -1)
    best = power.argmax(2)
    return np.take_along_axis(power, best[:, :, None], 2)[:, :, 0], best + np.arange(BANDS) * power.shape[2]


def fingerprints(clips: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(frames, codes) of each clip of 8-bit samples."""
    if not clips:
        return []
    count = [1 + max(0, -(-(len(c) - FRAME) // HOP)) for c in clips]
    size = [(n - 1) * HOP + FRAME for n in count]
    base = np.concatenate([[0], np.cumsum(size)])
    samples = np.zeros(int(base[-1]), np.float32)
    for c, b in zip(clips, base.tolist()):
        samples[b : b + len(c)] = np.frombuffer(c, np.uint8).astype(np.float32) - 128
    frame = np.concatenate([np.arange(n) for n in count])
    clip = np.repeat(np.arange(len(clips)), count)
    start = base[clip] + frame * HOP
    got = [_peaks(samples, start[k : k + BLOCK]) for k in range(0, len(start), BLOCK)]
    strength, where = (np.concatenate(v) for v in zip(*got))
    top = strength > 0
    same = clip[1:] == clip[:-1]
    top[1:] &= (strength[1:] >= strength[:-1]) | ~same[:, None]
    top[:-1] &= (strength[:-1] > strength[1:]) | ~same[:, None]
    f, b = np.nonzero(top)
    t, c, k = frame[f], clip[f], where[f, b]
    pairs = []
    for step in range(1, FAN + 1):
        if len(f) > step:
            gap = t[step:] - t[:-step]
            on = np.flatnonzero((c[step:] == c[:-step]) & (gap <= SPAN))
            pairs.append((on, (k[on] << 12) | (k[on + step] << 5) | gap[on]))
    if not pairs:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in clips]
    at, code = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    order = np.lexsort((code, at))
    at, code = at[order], code[order]
    cut = np.searchsorted(c[at], np.arange(len(clips) + 1))
    return [(t[at[a:z]], code[a:z]) for a, z in zip(cut[:-1], cut[1:])]


def store(spark: SparkSession, docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes doc_id, n_bytes (without padding) and wav (the text's bytes as samples) as Parquet, and reads it again; ``path`` defaults to a folder under ``spark.checkpoint.dir``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in pieces(batch.column(1)):
                raw = data.tobytes()
                wav = [to_wav(padded(raw[x:y])) for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(off)), pa.array(wav, pa.binary())], ["doc_id", "n_bytes", "wav"])

    path = path or f"{Scratch(spark, 'media').path}/clips"
    shape = "doc_id long, n_bytes long, wav binary"
    docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, shape).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(shape).parquet(path)


def _clips(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, list[bytes], list[bytes]]]:
    """(first row, row past the last, stored forms, samples read from them), a bounded number of bytes at a time."""
    for a, b, data, off in pieces(batch.column(at)):
        raw = data.tobytes()
        wav = [raw[x:y] for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
        yield a, b, wav, [from_wav(w) for w in wav]


def features(stored: DataFrame) -> DataFrame:
    """``stored`` with times and codes: the time-coded array of each clip's peak pairs."""
    at = stored.columns.index("wav")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, back in _clips(batch, at):
                prints = fingerprints(back)
                lists = [pa.array([p[k].astype(np.int32) for p in prints], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), *lists], [*batch.schema.names, "times", "codes"])

    empty = F.array().cast("array<int>")
    return stored.mapInArrow(run, stored.withColumn("times", empty).withColumn("codes", empty).schema)


def media(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, wav (the stored form), times and codes (the time-coded array of its fingerprint)."""
    return features(store(spark, docs, **options))


def sketch(codes: np.ndarray) -> str:
    """The codes of least hash, at most ``SKETCH``, in hexadecimal, 8 digits each: clips that share sounds share codes, wherever in time."""
    distinct = np.unique(codes).astype(np.uint64)
    h = mix(distinct * U(0x9E3779B97F4A7C15) + U(1))
    return "".join(f"{c:08x}" for c in np.sort(distinct[np.argsort(h)[:SKETCH]]).tolist())


def digests(stored: DataFrame) -> DataFrame:
    """Of each stored clip, read back: sizes and hashes of payload and stored form, the number of peak pairs, and their sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_pairs", "feature"]
        for batch in batches:
            for a, b, wav, back in _clips(batch, 2):
                prints = fingerprints(back)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array([len(p) for p in back], pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in back], pa.string()),
                        pa.array([zlib.crc32(p[-64:]) for p in back], pa.int64()),
                        pa.array([len(w) for w in wav], pa.int64()),
                        pa.array([hashlib.sha256(w).hexdigest() for w in wav], pa.string()),
                        pa.array([len(t) for t, _ in prints], pa.int64()),
                        pa.array([sketch(c) for _, c in prints], pa.string()),
                    ],
                    names,
                )

    return stored.select("doc_id", "n_bytes", "wav").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_pairs long, feature string")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(store(spark, table(spark, sf_dir, "documents")))
