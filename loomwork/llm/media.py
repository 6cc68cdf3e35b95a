"""Media columns: bytes as 8-bit WAV, read back with the wave module, and spectral-peak pair fingerprints.

A frame of FRAME samples starts at each multiple of HOP. In each band of its spectrum the strongest bin is a peak
(ties: the lowest). A peak pairs with the peak of the next band in its frame and with the peaks of its band in the
next REACH frames; each pair is one 64-bit code with its time (the frame) in the high bits, so a sorted array of codes
is in time order.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Payloads are padded to a positive multiple of FRAME bytes with PAD.
FRAME, HOP, PAD, RATE = 576, 288, b"\xff", 16_000
BANDS = ((1, 24), (24, 96), (96, FRAME // 2 + 1))
REACH = 3
#: Frames that are transformed at once.
STEP = 1024
TIME_BIT, FIRST_BIT, SECOND_BIT = 24, 13, 3
_WINDOW = np.hanning(FRAME + 1)[:FRAME]


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded for whole frames, and their number before padding; null counts as empty."""
    data = (text or "").encode()
    return data + PAD * ((-len(data)) % FRAME or (0 if data else FRAME)), len(data)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """The peak bin of each frame and band; powers are rounded, so that ties do not hang on the last bit."""
    n = (len(samples) - FRAME) // HOP + 1
    out = np.empty((n, len(BANDS)), np.int64)
    for at in range(0, n, STEP):
        part = samples[at * HOP : (min(n, at + STEP) - 1) * HOP + FRAME]
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        spectrum = np.fft.rfft((frames.astype(np.float64) - 128) * _WINDOW, axis=1)
        power = np.rint(spectrum.real**2 + spectrum.imag**2)
        for b, (low, high) in enumerate(BANDS):
            out[at : at + len(frames), b] = low + power[:, low:high].argmax(axis=1)
    return out


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Codes of all peak pairs, ascending, so by time first."""
    found = peaks(samples)
    n = len(found)
    parts = [(np.arange(n)[:, None] << TIME_BIT | found[:, :-1] << FIRST_BIT | found[:, 1:] << SECOND_BIT).ravel()]
    for ahead in range(1, min(REACH, n - 1) + 1):
        times = np.arange(n - ahead)[:, None]
        parts.append((times << TIME_BIT | found[:-ahead] << FIRST_BIT | found[ahead:] << SECOND_BIT | ahead).ravel())
    return np.sort(np.concatenate(parts))


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (WAV) and fingerprint array<long> of each row of docs(doc_id, text).

    A null or empty text becomes one frame of padding. Equal texts have equal media and fingerprints. Null doc_ids
    and repeated rows stay, other columns are left out, an empty table gives no rows.
    """

    def rows(doc_id: int | None, text: str | None) -> tuple:
        payload, n = payload_of(text)
        media = to_wav(payload)
        return doc_id, n, media, fingerprint(np.frombuffer(from_wav(media), np.uint8))

    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    return _mapped(docs.select(docs["doc_id"].cast("long"), "text"), rows, types, "doc_id long, n_bytes long, media binary, fingerprint array<long>")


def media_digests(media: DataFrame) -> DataFrame:
    """Digests of media_columns' rows: of the stored media, and of the payload that is read back from them.

    A row without media has null digests.
    """

    def rows(doc_id: int | None, n: int, media: bytes | None, codes: list[int] | None) -> tuple:
        if media is None:
            return (doc_id, n) + (None,) * 6
        back = from_wav(media)
        digest = hashlib.sha256(np.array(codes or [], "<i8").tobytes()).hexdigest()
        feature = f"{(len(back) - FRAME) // HOP + 1} frames, {len(codes or [])} pairs, {digest}"
        return doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return _mapped(media.select("doc_id", "n_bytes", "media", "fingerprint"), rows, types, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


#: Bytes and rows that are worked on at once; a larger row is a run of its own.
RUN_BYTES, RUN_ROWS = 1_000_000, 128


def _runs(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts, media and lists have RUN_BYTES together, about."""
    size = np.zeros(part.num_rows, np.int64)
    for column in part.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(column.type):
            size += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(size), 0
    while at < part.num_rows:
        before = upto[at - 1] if at else 0
        end = min(at + RUN_ROWS, max(at + 1, int(np.searchsorted(upto, before + RUN_BYTES, "right"))))
        yield part.slice(at, end - at)
        at = end


def _mapped(df: DataFrame, rows, types: list[pa.DataType], schema: str) -> DataFrame:
    """rows of each row's values; few bytes at once, as media are large."""
    names = [c.split()[0] for c in schema.split(", ")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in _runs(part):
                found = zip(*(rows(*r) for r in zip(*(c.to_pylist() for c in some.columns), strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found, types, strict=True)], names)

    return df.mapInArrow(batches, schema)
