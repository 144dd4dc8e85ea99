"""Media columns: any bytes as a greyscale PNG in a binary column, read back, hashed by low cosine frequencies.

A payload (a text's UTF-8, null read as empty, filled with byte 255 up to a positive multiple of the
row width) becomes an 8-bit greyscale PNG of that width.  The reader walks the PNG's chunks, tests every
checksum, inflates the IDAT stream and undoes the five row filters with numpy.  The feature is a 64-bit
hash of the 8 x 8 lowest cosine frequencies of the picture's 32 x 32 block means.

Defined cases: null and empty texts give one row of 255; equal texts give equal values; repeated rows stay
rows; an empty table gives no rows; a damaged chunk, a wrong checksum or an unsupported header raises
ValueError; a null media value gives nulls.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, chunks, text_of, tidily

SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed by the format


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _weight(rows: np.ndarray) -> np.ndarray:
    """Each row's sum of absolute signed samples."""
    return np.minimum(rows, -rows).sum(axis=1, dtype=np.int64)


def encode_png(payload: bytes, width: int = 576, level: int = 1, gain: int = 16) -> bytes:
    """A row gets the filter left or above only where that makes its absolute sum `gain` times smaller: text and other noise compress best unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    body = np.zeros((len(rows), width + 1), np.uint8)
    body[:, 1:] = rows
    most = _weight(rows) // gain
    left, above = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    above[1:] -= rows[:-1]
    for kind, form in ((1, left), (2, above)):
        if (hit := (weight := _weight(form)) < most).any():
            body[hit, 0], body[hit, 1:] = kind, form[hit]
            most[hit] = weight[hit]
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(body.data, level)) + _chunk(b"IEND", b"")


def _by_diagonals(kind: int, body: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Rows of Average (3) or Paeth (4): a sample needs its left and upper neighbours, so all of one diagonal are undone at once."""
    h, w = body.shape
    out = np.zeros((h + 1, w + 1), np.int16)
    out[0, 1:] = prior
    for d in range(h + w - 1):
        i = np.arange(max(0, d - w + 1), min(h, d + 1))
        j = d - i
        left, up, corner = out[i + 1, j], out[i, j + 1], out[i, j]
        if kind == 3:
            guess = (left + up) >> 1
        else:
            to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
            guess = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        out[i + 1, j + 1] = (body[i, j] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def unfilter(kinds: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Undoes the row filters; runs of rows of one kind are undone at once where the filter allows it."""
    out = np.empty_like(body)
    if (bad := kinds > 4).any():
        raise ValueError(f"unknown row filter {kinds[bad][0]}")
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(kinds)], strict=True):
        if lo == hi:
            continue
        kind, prior = kinds[lo], out[lo - 1] if lo else np.zeros(body.shape[1], np.uint8)
        if kind == 0:
            out[lo:hi] = body[lo:hi]
        elif kind == 1:
            out[lo:hi] = np.cumsum(body[lo:hi], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[lo:hi] = np.cumsum(body[lo:hi], axis=0, dtype=np.uint8) + prior
        else:
            out[lo:hi] = _by_diagonals(int(kind), body[lo:hi], prior)
    return out


def decode_png(media: bytes) -> np.ndarray:
    """The picture as rows of 8-bit samples."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, packed, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("cut chunk")
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        data, crc = media[at + 8 : at + 8 + n], media[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(kind + data) != struct.unpack(">I", crc)[0]:
            raise ValueError(f"wrong checksum in {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        ended = kind == b"IEND"
        at += 12 + n
    if header is None or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only whole 8-bit greyscale pictures without interlacing are read")
    width, height = header[:2]
    flat = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if flat.size != height * (width + 1):
        raise ValueError("the picture's size does not fit its header")
    lines = flat.reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


_N = np.arange(32)
#: The 8 lowest rows of the orthonormal cosine transform of 32 points.
COSINES = np.cos(np.pi * (2 * _N + 1) * np.arange(8)[:, None] / 64) * np.where(np.arange(8) == 0, np.sqrt(1 / 32), np.sqrt(2 / 32))[:, None]


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    """How many lines each block has; a block that starts where the next one does is that one line."""
    return np.maximum(np.diff(starts, append=n), 1)


def cosine_hash(picture: np.ndarray) -> str:
    """16 hex digits: for each of the 64 low frequencies, whether it exceeds the median of those without the mean."""
    h, w = picture.shape
    rows, cols = _N * h // 32, _N * w // 32
    across = picture.reshape(h, 32, -1).sum(axis=2, dtype=np.int64) if w % 32 == 0 else np.add.reduceat(picture, cols, axis=1, dtype=np.int64)
    sums = np.add.reduceat(across, rows, axis=0)
    size = _sizes(rows, h)[:, None] * _sizes(cols, w)
    low = np.round(COSINES @ (sums / size) @ COSINES.T, 6).ravel()
    bits = low > np.sort(low[1:])[31]
    return np.packbits(bits).tobytes().hex()


def to_png(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 576, level: int = 1) -> DataFrame:
    """A row (id_col, n_bytes long, media binary) for each row of df."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in chunks(batches, 200):
            sizes, media = [], []
            for s in b.column(1):
                raw = s.as_py().encode()
                sizes.append(len(raw))
                media.append(encode_png(raw + b"\xff" * (-len(raw) % width if raw else width), width, level))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return df.select(F.col(f"`{id_col}`"), text_of(text_col).alias("t")).mapInArrow(tidily(run), f"`{id_col}` {kind}, n_bytes long, media binary")


FEATURES = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("hash", pa.binary()), ("feature", pa.string())]


def png_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Reads the stored pictures back: payload_bytes, payload_sha256, tail_crc32 (of the payload's last 32 bytes), media_bytes, media_sha256, hash binary, feature string, beside id_col and n_bytes."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in chunks(batches, 200):
            out = []
            for s in b.column(2):
                media = s.as_py()
                if media is None:
                    out.append((None,) * 7)
                    continue
                picture = decode_png(media)
                payload, feature = picture.tobytes(), cosine_hash(picture)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), bytes.fromhex(feature), feature))
            rest = batch(FEATURES, list(zip(*out, strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *rest.columns], names=[id_col, "n_bytes", *rest.schema.names])

    return df.select(F.col(f"`{id_col}`"), "n_bytes", F.col(f"`{media_col}`")).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary, feature string"
    )
