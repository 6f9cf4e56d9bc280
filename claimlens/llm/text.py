"""Array helpers over Arrow string columns: words, hashes, batches.

Texts are handled as UTF-8 bytes. Null texts count as empty everywhere.
Words are hashed eight bytes at a time, all words of a slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: the bytes that part words: space and 0x09 to 0x0D
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: masks of the low 0 to 8 bytes
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that any bits of a hash are usable."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about max_bytes of text, a row at least each."""
    if not batch.num_rows:
        return
    _, offs = byte_column(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + max_bytes, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def byte_column(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, nulls as empty.

    The bytes start at the first row's first byte, so offsets[0] is 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):  # no chunks
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """The words of a run of texts: byte ranges and the text of each.

    data: the bytes the ranges refer to (folded if asked), start/end: byte
    ranges, doc: index of the text, first: index of each text's first word
    (one more entry than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool):
        self.data = _FOLD[data] if fold else data
        n = len(data)
        solid = np.zeros(n + 2, bool)
        np.logical_not(_IS_SPACE[data], out=solid[1 : n + 1])
        begins = solid[1 : n + 1] & ~solid[:n]
        ends = solid[1 : n + 1] & ~solid[2 : n + 2]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begins[inner] = solid[1 : n + 1][inner]  # a text's first byte begins a word
        ends[inner - 1] = solid[1 : n + 1][inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.n)

    def hashes(self, second: bool = False) -> np.ndarray:
        """64-bit hash of each word, eight bytes at a time; or a second one that is independent of the first."""
        factor = U64(0xC2B2AE3D27D4EB4F if second else 0x9E3779B97F4A7C15)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded.data, strides=(1,))  # the 8 bytes from each position
        at, left = self.start, self.end - self.start
        head = eight[at] & _LOW_BYTES[np.minimum(left, 8)]
        out = mix(head + left.astype(U64) * factor) if second else mix(left.astype(U64) ^ head)
        which = np.flatnonzero(left > 8)
        while len(which):
            at, left = at[left > 8] + 8, left[left > 8] - 8
            out[which] = mix(out[which] * factor + (eight[at] & _LOW_BYTES[np.minimum(left, 8)]))
            which = which[left > 8]
        return out


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes, over text borders too: the
    caller drops what crosses one. len(words) - n + 1 entries, or none."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = words[:m].copy()
    for k in range(1, n):
        out *= U64(0x9E3779B97F4A7C15)
        out += words[k : k + m]
    return mix(out)


def inner_grams(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask over all total - n + 1 n-grams: inside one text."""
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    ok = np.ones(m, bool)
    if n > 1:  # a border at b spoils the n-grams that start in [b - n + 1, b)
        marks = np.zeros(m + 1, np.int32)
        borders = first[1:-1]
        borders = np.unique(borders[(borders > 0) & (borders < total)])
        np.add.at(marks, np.clip(borders - n + 1, 0, m), 1)
        np.add.at(marks, np.clip(borders, 0, m), -1)
        ok = np.cumsum(marks[:m]) == 0
    return ok


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of each range, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
