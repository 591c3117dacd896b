"""Media columns: text stored as 8-bit WAV, and fingerprints of pairs of spectral peaks.

A text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, are the samples of a mono WAV written and read
by the wave module. A short-time Fourier transform of the samples read back gives the loudest bin of two bands in each
frame; frames where a band's peak is loudest in time are its peaks, and each peak is paired with the next few of its band.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import map_batches

RATE, FRAME, HOP, BLOCK = 8000, 64, 32, 16384  # Hz, samples, samples, frames transformed at once
BANDS, FAN_OUT, LONGEST = ((1, 9), (9, 33)), 3, 63  # bins [from, to), pairs a peak, most frames between the peaks of a pair
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, media_bytes long,"
    " media_sha256 string, times array<int>, codes array<int>"
)


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def write_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, bands) arrays: the loudest bin of each band and its magnitude. The tail is padded with silence."""
    n = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    window = np.hanning(FRAME).astype(np.float32)
    bins, loud = np.empty((n, len(BANDS)), np.int32), np.empty((n, len(BANDS)), np.float32)
    for at in range(0, n, BLOCK):
        m = min(BLOCK, n - at)
        part = np.zeros((m - 1) * HOP + FRAME, np.float32)
        got = samples[at * HOP : at * HOP + len(part)]
        part[: len(got)] = (got.astype(np.float32) - 128) / 128
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        size = np.abs(np.fft.rfft(frames * window, axis=1))
        for b, (low, high) in enumerate(BANDS):
            top = size[:, low:high].argmax(axis=1)
            bins[at : at + m, b] = top + low
            loud[at : at + m, b] = size[np.arange(m), top + low]
    return bins, loud


def pairs(bins: np.ndarray, loud: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame of the first peak) and codes (both bins and the frames between) of all pairs, in order of time."""
    edge = np.full((1, loud.shape[1]), -1, np.float32)
    peak = (loud > np.concatenate((edge, loud[:-1]))) & (loud >= np.concatenate((loud[1:], edge))) & (loud > 0)
    at, band = np.nonzero(peak)
    at, f = at.astype(np.int32), bins[at, band]
    times, codes = np.full((len(at), FAN_OUT), -1, np.int32), np.zeros((len(at), FAN_OUT), np.int32)
    for step in range(1, FAN_OUT + 1):
        gap = at[step:] - at[:-step]
        times[: len(gap), step - 1] = np.where(gap <= LONGEST, at[:-step], -1)
        codes[: len(gap), step - 1] = f[:-step] << 12 | f[step:] << 6 | gap & 63
    kept = times >= 0
    return times[kept], codes[kept]


def media_columns(docs: DataFrame, rows: int = 64) -> DataFrame:
    """One row per row of docs (doc_id, text): its WAV, digests of what was read back, and the peak pairs.

    A null text is the empty text; an empty text has 64 silent-low samples and its own valid file. Equal texts give equal
    values. Other columns of docs are ignored; an empty table gives an empty table.
    """

    def start():
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media", pa.binary())]
            + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("times", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32()))]
        )

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [[] for _ in schema]
            for text in batch.column(1).to_pylist():
                media = write_wav(payload_of(text))
                back = read_wav(media)
                t, c = pairs(*band_peaks(np.frombuffer(back, np.uint8)))
                made = (len((text or "").encode("utf-8")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), media, len(media), hashlib.sha256(media).hexdigest(), t, c)
                for column, value in zip(out[1:], made, strict=True):
                    column.append(value)
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(out[1:], list(schema)[1:], strict=True))], schema=schema)

        return apply

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), start, SCHEMA, rows)


def digest(media: DataFrame) -> DataFrame:
    """The media rows without file and arrays: feature is the number of pairs and a hash of the time-coded pairs."""
    feature = F.concat_ws("-", F.size("times").cast("string"), F.lower(F.hex(F.xxhash64("times", "codes"))))
    return media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
