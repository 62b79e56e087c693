"""Media columns: a payload stored as WAV, and spectral-peak pair fingerprints of what is read back.

The payload becomes the 8-bit samples of a mono WAV. The steps from sample to sample, in which a level counts for nothing, are cut into frames. Frames of ``FRAME`` samples, half overlapping, go
through a short-time Fourier transform. Half a frame of silence comes before the samples, and half a frame or more after them, and the window is a periodic one: so each
sample, the first and the last too, counts in full over its two frames, and the shortest payload has two frames. In each frame the strongest bin of each of ``BANDS`` bands is a
peak where it stands out of the frame's mean. Each peak is paired with the peaks of the next ``FAN``
frames that have the same band or its neighbour; pairs are hashes of (bin, bin, time between) with the time of the first.
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

from .common import short_batches

UNIT, RATE = 64, 8000
FRAME, BANDS, FAN = 256, 8, 3
STEP = 4096  # frames transformed at a time
ROWS = 64  # of a batch of media
FIRST = 1 + np.arange(BANDS) * (FRAME // 2 // BANDS)  # bin of each band, all equally wide
WINDOW = np.hanning(FRAME + 1)[:FRAME].astype(np.float32)


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zero bytes up to a positive multiple of ``UNIT``, and the length before that."""
    data = (text or "").encode(errors="replace")
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0"), len(data)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """Bin of each frame's peak in each band, 0 where nothing stands out; frames x BANDS."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32)
    step = FRAME // 2
    x = np.pad(np.diff(x, prepend=x[:1]), (step, -len(x) % step + step))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::step]
    out = np.zeros((len(frames), BANDS), np.int64)
    for at in range(0, len(frames), STEP):
        power = np.abs(np.fft.rfft(frames[at : at + STEP] * WINDOW, axis=1))[:, 1:]
        bands = power.reshape(len(power), BANDS, -1)
        top = bands.argmax(2)
        strong = np.take_along_axis(bands, top[:, :, None], 2)[:, :, 0] > power.mean(1)[:, None]
        out[at : at + STEP] = np.where(strong, top + FIRST, 0)
    return out


def fingerprints(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, times) of the peak pairs, by time and hash: hash = bin << 16 | other bin << 8 | frames between."""
    p = peaks(samples)
    hashes, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for gap in range(1, min(FAN, len(p) - 1) + 1):
        for off in (-1, 0, 1):  # the band itself and its neighbours
            a, b = p[:-gap, max(0, -off) : BANDS - max(0, off)], p[gap:, max(0, off) : BANDS - max(0, -off)]
            t, k = np.nonzero((a > 0) & (b > 0))
            hashes.append(a[t, k] << 16 | b[t, k] << 8 | gap)
            times.append(t)
    h, t = np.concatenate(hashes), np.concatenate(times)
    order = np.lexsort((h, t))
    return h[order], t[order]


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text's payload as a WAV file in a binary column. Null and empty texts have ``UNIT`` zero bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                ids, texts = batch.column(0)[at : at + ROWS], batch.column(1)[at : at + ROWS]
                made = [payload(t.as_py()) for t in texts]
                yield pa.RecordBatch.from_arrays([ids, pa.array([n for _, n in made], pa.int64()), pa.array([to_wav(data) for data, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return short_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fp_hashes array<int>, fp_times array<int>"


def features(table: DataFrame, keep_media: bool = True) -> DataFrame:
    """``table`` (doc_id, n_bytes, media) with what is read back from its WAV files; every sample is in a frame. ``keep_media=False`` leaves the files out.

    ``feature`` is "pairs:sha256" over the time-coded arrays fp_hashes and fp_times.
    """
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["doc_id", "n_bytes", *(x.split()[0] for x in FEATURES.split(", ")), *(["media"] if keep_media else [])]

    def read(wav: bytes) -> tuple:
        back = from_wav(wav)
        h, times = fingerprints(back)
        code = hashlib.sha256(np.stack([h, times]).astype("<i4").tobytes()).hexdigest()
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(wav), hashlib.sha256(wav).hexdigest(), f"{len(h)}:{code}", h.astype(np.int32), times.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):  # the arrays of few texts at a time
                part = batch.slice(at, ROWS)
                columns = list(zip(*(read(m.as_py()) for m in part.column(2)), strict=True)) or [()] * len(kinds)
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays, *([part.column(2)] if keep_media else [])], names)

    return table.mapInArrow(run, "doc_id long, n_bytes long, " + FEATURES + ", media binary" * keep_media)


def media(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """doc_id, n_bytes and ``features`` of each row's ``stored`` text, equal for equal texts.

    Null ids stay, repeated rows give repeated results, an empty table gives no rows; other columns don't matter. A very long
    text is a long file, its spectra are made a stretch at a time.
    """
    return features(stored(docs), keep_media)
