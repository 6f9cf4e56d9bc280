"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with every run of white space as one
space, as UTF-8 bytes. A test item of n bytes may occur with at most
k = floor(n * rate) edits. The item is cut into k + 1 pieces: whatever the
edits, one piece is untouched. Tasks look for exact piece hits at every
position (a 12-byte window value against a table of piece beginnings, then
the whole piece) and decide each hit with Myers' bit-parallel distance of
the whole item against the surrounding bytes.

The items are a query set: they go to the tasks in blocks of bounded size
(``BLOCK_BYTES``), each block against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import parts
from .text import U64, text_slices

#: edits per byte of an item; bytes of items that are sent to tasks at once
EDIT_RATE, BLOCK_BYTES = 0.06, 8 << 20
SLICE_BYTES = 4 << 20
#: bytes of a piece that the window table looks at
WINDOW = 12
_K1, _K2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def normalise(text: str | None) -> bytes:
    return " ".join(text.lower().split()).encode() if text else b""


def myers(pattern: bytes, text: bytes) -> tuple[int, int]:
    """(distance, end): the smallest edit distance of pattern to a substring
    of text, and where the first such substring ends."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        score += bool(ph & top)
        score -= bool(mh & top)
        ph = (ph << 1) & full  # a match may begin anywhere: no carry into the first row
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


class Items:
    """A block of items with the tables that find their pieces."""

    def __init__(self, texts: list[bytes], rate: float = EDIT_RATE):
        self.texts = texts
        self.budget = [int(len(t) * rate) for t in texts]
        wide: dict[bytes, list[tuple[int, int, int]]] = {}
        self.short: dict[bytes, list[tuple[int, int, int]]] = {}  # pieces below a window: plain search
        for i, (t, k) in enumerate(zip(texts, self.budget)):
            cuts = [len(t) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                if b - a >= WINDOW:
                    wide.setdefault(t[a : a + WINDOW], []).append((i, a, b))
                elif b > a:
                    self.short.setdefault(t[a:b], []).append((i, a, b))
        heads = list(wide)
        values = self.window_values(np.frombuffer(b"".join(heads), np.uint8), np.arange(len(heads)) * WINDOW) if heads else np.zeros(0, U64)
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.heads = [(heads[o], wide[heads[o]]) for o in order]
        self.shift = U64(64 - max(16, (64 * len(heads)).bit_length()))
        self.table = np.zeros(1 << int(64 - int(self.shift)), bool)
        self.table[(self.values >> self.shift).astype(np.int64)] = True

    @staticmethod
    def window_values(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        n = len(data) - WINDOW + 1
        eight = np.ndarray((n + 4,), "<u8", np.ascontiguousarray(data).data, strides=(1,))  # the 8 bytes from each position
        if at is not None:
            return (eight[at] * _K1) ^ ((eight[at + 4] + _K1) * _K2)
        v = eight[:n] * _K1
        v ^= (eight[4:] + _K1) * _K2
        return v

    def piece_hits(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(item, item offset, position in data) of every exact piece."""
        if len(data) >= WINDOW and len(self.values):
            v = self.window_values(np.frombuffer(data, np.uint8))
            at = np.flatnonzero(self.table[(v >> self.shift).astype(np.int64)])
            lo = np.searchsorted(self.values, v[at])
            hi = np.searchsorted(self.values, v[at], side="right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                for head, pieces in self.heads[a:b]:
                    for i, x, y in pieces:
                        if data[p : p + y - x] == self.texts[i][x:y]:
                            yield i, x, p
        for piece, where in self.short.items():
            p = data.find(piece)
            while p >= 0:
                for i, x, _ in where:
                    yield i, x, p
                p = data.find(piece, p + 1)

    def matches(self, texts: list[bytes]) -> dict[int, dict[int, tuple[int, int]]]:
        """By number of a normalised text: item -> (distance, end) of its best match within its budget."""
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        data = b"\n".join(texts)  # normalised texts hold no line ends, so no piece reaches over one
        best: dict[int, dict[int, tuple[int, int]]] = {}
        tried: set[tuple[int, int]] = set()
        for i, x, p in self.piece_hits(data):
            start = p - x
            if (i, start) in tried:
                continue
            tried.add((i, start))
            doc = int(np.searchsorted(first, p, side="right")) - 1
            lo, hi = int(first[doc]), int(first[doc + 1]) - 1
            t, k, had = self.texts[i], self.budget[i], best.get(doc, {}).get(i)
            if had and had[0] == 0:
                continue
            if start >= lo and data[start : start + len(t)] == t:
                found = 0, start + len(t) - lo
            elif k:
                begin = max(lo, start - k)
                d, end = myers(t, data[begin : max(begin, min(hi, start + len(t) + k))])
                found = d, begin + end - lo
            else:
                continue
            if found[0] <= k and (had is None or found[0] < had[0]):
                best.setdefault(doc, {})[i] = found
        return best


def blocks(benchmark: DataFrame, text: str) -> Iterator[dict[bytes, list[str]]]:
    """Normalised texts of the items, in blocks of about BLOCK_BYTES, each with the
    keys (digests) of the different texts that it stands for. Equal items
    are one before anything is collected; empty ones are left out."""
    texts = benchmark.select(F.col(f"`{text}`").cast("string").alias("t")).where("t is not null").distinct()
    n = parts(texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0, BLOCK_BYTES)
    for b in range(n):
        of: dict[bytes, list[str]] = {}
        for r in texts.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b).select("t", text_key("t").alias("k")).collect():
            if t := normalise(r["t"]):
                of.setdefault(t, []).append(r["k"])
        yield {t: sorted(of[t]) for t in sorted(of)}


def text_key(text: str) -> Column:
    return F.sha2(F.col(text).cast("binary"), 256)


def find_leaks(df: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, text: str = "text", doc_id: str = "doc_id",
               item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, distance, budget, start, end: one row for each row of
    df and item that occurs in it within the item's budget (the best match;
    of equal ones the first found). start and end are byte positions in the
    normalised text; start assumes the item's own length.

    Null or empty texts and items match nothing. Items with equal texts each
    get their rows; rows that repeat an id each get theirs. Ids may be of any
    type."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k string, distance int, budget int, start long, end long"
    out = None
    for block in blocks(benchmark, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            texts, keys = list(shared.value), list(shared.value.values())
            items = Items(texts, rate)
            for batch in batches:
                for part in text_slices(batch, "t", SLICE_BYTES):
                    found = items.matches([normalise(t) for t in part.column("t").to_pylist()])
                    rows = [(r, k, d, items.budget[i], max(0, end - len(texts[i])), end)
                            for r in sorted(found) for i, (d, end) in sorted(found[r].items()) for k in keys[i]]
                    cols = list(zip(*rows)) or [()] * 6
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()),
                                                      pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())],
                                                     ["doc_id", "k", "distance", "budget", "start", "end"])

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    named = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("_t")).where("_t is not null").select("item_id", text_key("_t").alias("k"))
    return out.join(named, "k").select("doc_id", "item_id", "distance", "budget", "start", "end")


def keep_clean(df: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, text: str = "text",
               item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of df, with all their columns, in which no item occurs. No shuffle."""
    for block in blocks(benchmark, item_text):
        shared = df.sparkSession.sparkContext.broadcast(list(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, rate)
            for batch in batches:
                for part in text_slices(batch, text, SLICE_BYTES):
                    found = items.matches([normalise(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()])
                    yield part.filter(pa.array([r not in found for r in range(part.num_rows)], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
