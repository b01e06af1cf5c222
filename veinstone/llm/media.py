"""Media columns: bytes as WAV sound, and its fingerprint of spectral-peak pairs.

A payload is stored as 8-bit mono samples by the wave module and read back by it. The samples, followed by silence up to a
whole number of hops, go through a short-time Fourier transform (Hann window of ``WINDOW``, hop ``HOP``, in blocks, so
that long sounds need bounded memory). The up to ``PEAKS`` strongest local maxima of each frame are its peaks, and every
peak (the anchor) is paired with the next ``FAN`` peaks (the targets): a pair's code holds both frequencies and the time
between. The fingerprint is the array of (time, code) as one integer each, in time order, and a column of the result.

Rows are treated one by one in the scan (no shuffle). Defined results: a null or empty text is a payload of 64 zero
bytes; a text whose length is a multiple of 64 is not padded further. Repeated rows give equal values. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Sealed, table

UNIT = 64
RATE = 8000
SILENCE = 128
WINDOW, HOP = 256, 128
#: Peaks of a frame, targets of an anchor, the most frames between them (8 bits), the lowest bin that is looked at, and the least energy of a peak against its frame's strongest.
PEAKS, FAN, MOST_BETWEEN, LEAST_BIN, LEAST_SHARE = 2, 3, 255, 2, 1 / 16
BLOCK_FRAMES = 4096


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono WAV of the payload."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT) if text else bytes(UNIT)


@functools.lru_cache
def _hann() -> np.ndarray:
    return np.hanning(WINDOW).astype(np.float32)


def spectra(samples: bytes):
    """Blocks of (first frame, energies by frame and bin). The samples are followed by silence up to whole hops, so that every one is in a window."""
    x = np.frombuffer(samples, np.uint8)
    frames = 1 + max(0, -(-(len(x) - WINDOW) // HOP))
    x = np.concatenate([x, np.full((frames - 1) * HOP + WINDOW - len(x), SILENCE, np.uint8)])
    for start in range(0, frames, BLOCK_FRAMES):
        n = min(BLOCK_FRAMES, frames - start)
        view = np.lib.stride_tricks.sliding_window_view(x[start * HOP : (start + n - 1) * HOP + WINDOW], WINDOW)[::HOP]
        spectrum = np.fft.rfft((view.astype(np.float32) - SILENCE) * _hann())
        yield start, (spectrum.real**2 + spectrum.imag**2).astype(np.float32)


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the up to ``PEAKS`` strongest local maxima of each frame, from bin ``LEAST_BIN`` on, in order of frame and bin."""
    at, bins = [], []
    for start, energy in spectra(samples):
        inner = energy[:, LEAST_BIN:-1]
        top = (inner > energy[:, LEAST_BIN - 1 : -2]) & (inner >= energy[:, LEAST_BIN + 1 :])
        strength = np.where(top, inner, np.float32(0))
        strength[strength < strength.max(axis=1, keepdims=True) * LEAST_SHARE] = 0
        best = np.sort(np.argpartition(-strength, PEAKS - 1, axis=1)[:, :PEAKS], axis=1)
        frame, k = np.nonzero(np.take_along_axis(strength, best, axis=1) > 0)
        at.append(frame + start)
        bins.append(best[frame, k] + LEAST_BIN)
    return np.concatenate(at).astype(np.int64), np.concatenate(bins).astype(np.int64)


def fingerprint(samples: bytes) -> np.ndarray:
    """int64 array of time << 32 | anchor bin << 20 | target bin << 8 | frames between, in order; a lone peak has no pairs."""
    at, bins = peaks(samples)
    codes = [np.empty(0, np.int64)]
    for step in range(1, FAN + 1):
        between = at[step:] - at[:-step]
        near = between <= MOST_BETWEEN
        codes.append((at[:-step] << 32 | bins[:-step] << 20 | bins[step:] << 8 | between)[near])
    return np.sort(np.concatenate(codes))


def features(text: bytes | None) -> tuple:
    payload = padded(text or b"")
    media = to_wav(payload)
    back = from_wav(media)
    codes = fingerprint(back)
    short = f"pairs={len(codes)};sha1={hashlib.sha1(codes.astype('<i8').tobytes()).hexdigest()}"
    return len(text or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), short, codes, media


def _made(with_codes: bool, with_media: bool):
    def run(batches):
        for batch in batches:
            rows = [features(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            columns = [batch.column(0)] + [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            if with_codes:
                columns.append(pa.array([r[7] for r in rows], pa.list_(pa.int64())))
                names.append("fingerprint")
            if with_media:
                columns.append(pa.array([r[8] for r in rows], pa.binary()))
                names.append("media")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def media_columns(docs: DataFrame, with_codes: bool = True, with_media: bool = True) -> DataFrame:
    """``docs`` (doc_id, text) -> sizes, digests, a short form of the fingerprint, and the fingerprint and the stored WAV if asked for."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", fingerprint array<long>" * with_codes + ", media binary" * with_media
    sealed = Sealed(docs)
    return sealed.df.select(sealed.of("doc_id").cast("long").alias("doc_id"), sealed.of("text").alias("text")).mapInArrow(_made(with_codes, with_media), schema)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), with_media=False)
