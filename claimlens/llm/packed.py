"""Sorted hash runs as compact bytes, and the shuffles that carry them.

A task that meets many hashes sends, instead of one row per hash, one row
per (bucket, chunk): the bucket's hashes in ascending order as differences.
A chunk names the task's documents, so an answer can find its way back; a
hash is sent once per chunk however often it occurs in it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

U64 = np.uint64


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash, ascending with the hash (ranges of the hash)."""
    return ((hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def bucket_edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in ascending hashes (buckets + 1 entries)."""
    return np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))


def pack(hashes: np.ndarray) -> bytes:
    """Ascending uint64 as bytes: differences of 3 or 4 bytes where they fit."""
    if not len(hashes):
        return b""
    gaps = np.diff(hashes)
    if len(gaps) and gaps.max() >= U64(2**32):
        return b"\x08" + hashes.tobytes()
    if not len(gaps) or gaps.max() >= U64(2**24):
        return b"\x04" + hashes[:1].tobytes() + gaps.astype(np.uint32).tobytes()
    return b"\x03" + hashes[:1].tobytes() + gaps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpack(blob) -> np.ndarray:
    if not len(blob):
        return np.zeros(0, U64)
    if blob[0] == 8:
        return np.frombuffer(blob, U64, offset=1)
    width = blob[0]
    out = np.empty((len(blob) - 9) // width + 1, U64)
    out[0] = np.frombuffer(blob, U64, 1, 1)[0]
    if width == 3:
        gaps = np.zeros((len(out) - 1, 4), np.uint8)
        gaps[:, :3] = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, 3)
        out[1:] = gaps.view("<u4")[:, 0]
    else:
        out[1:] = np.frombuffer(blob, np.uint32, offset=9)
    return np.cumsum(out, dtype=U64)


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, all first bytes together, then all second ones and so on."""
    x = np.ascontiguousarray(x)
    return zlib.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def unsqueeze(blob: bytes, kind: type) -> np.ndarray:
    raw, size = np.frombuffer(zlib.decompress(blob), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 0 or more, in the fewest bytes that hold them all."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


_ZSTD = pa.Codec("zstd", compression_level=1)


def shrink(x: np.ndarray) -> bytes:
    """Whole numbers of 0 or more as compressed bytes: narrow ones, laid out as by ``squeeze``."""
    x = narrow(x)
    raw = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return bytes([x.itemsize]) + len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def grow(blob: bytes) -> np.ndarray:
    """The numbers that ``shrink`` was given, as narrow ones."""
    size, n = blob[0], int.from_bytes(blob[1:9], "little")
    raw = np.frombuffer(_ZSTD.decompress(blob[9:], n, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(f"u{size}")
