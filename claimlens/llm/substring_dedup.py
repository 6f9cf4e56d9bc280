"""Substring dedup by fixed-block anchors over words.

A window is n consecutive words of one document. A word goes if a window
that covers it also starts in a document with a smaller id.

Index: the non-overlapping blocks of b = (n + 1) / 2 words of every
document; any window holds one whole block of the document it is found in.
Probe: every rolling b-word window of every document is looked up among the
blocks. Extend: around each hit, both sides send the n-word windows that hold
the block or the hit, each as two independent 64-bit hashes of its words, and
windows that meet there with a smaller id elsewhere are repeats; neighbouring
ones join to maximal repeats.

Documents are dealt into chunks by id hash, and texts are shuffled once, by
chunk. Lookups travel as sorted hash runs (a hash once per chunk however
often it occurs, so a frequent passage costs one entry per chunk) to hash
buckets and come back to the chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import bucket_edges, pack, unpack
from .tables import id_and_text, parts, total_bytes
from .text import U64, Words, byte_column, inner_grams, mix, ngram_hashes, spread

#: text of a chunk, text whose hashes go to one bucket
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 12 << 20
#: low bits of a block's hash that are not sent (false hits end in the extension): a chunk's hashes then
#: mostly differ by less than 3 bytes hold
DROPPED_BITS = U64(25)
NO_ID = 2**63 - 1


class Chunk:
    """The words of a chunk's documents, with the hashes of their n-word and b-word windows."""

    def __init__(self, table: pa.Table, n: int):
        ids = table.column("d")
        self.ids = np.array([NO_ID if x is None else x for x in ids.to_pylist()], np.int64)
        self.words = Words(*byte_column(table.column("t")), fold=False)
        self.n, self.b = n, (n + 1) // 2
        self.total = len(self.words.start)
        self.hashes = self.words.hashes()

    def seconds(self, starts: np.ndarray) -> np.ndarray:
        """The second hashes of the n-word windows from there: with the first, 128 independent bits tell windows apart."""
        words = self.words.hashes(second=True)
        out = words[starts]
        for k in range(1, self.n):
            out = out * U64(0xD6E8FEB86659FD93) + words[starts + k]
        return mix(out)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of so many words."""
        ok = np.flatnonzero(inner_grams(self.words.first, size, self.total))
        return ok, ngram_hashes(self.hashes, size)[ok]

    def blocks(self, starts: np.ndarray) -> np.ndarray:
        """Mask of the windows that are blocks: at multiples of b words in their document."""
        return (starts - self.words.first[self.words.doc[starts]]) % self.b == 0

    def around(self, hits: np.ndarray) -> np.ndarray:
        """Mask over word positions: n-word windows from there hold a b-word window that begins at a hit."""
        marks = np.zeros(self.total + 1, np.int32)
        np.add.at(marks, np.maximum(hits - (self.n - self.b), 0), 1)
        np.add.at(marks, hits + 1, -1)
        return np.cumsum(marks[:-1]) > 0


def send_blocks(table: pa.Table, n: int, buckets: int) -> pa.Table:
    c = Chunk(table, n)
    starts, h = c.grams(c.b)
    probes = np.unique(h >> DROPPED_BITS)
    is_block = np.zeros(len(probes), bool)  # the blocks are some of the windows
    is_block[np.searchsorted(probes, h[c.blocks(starts)] >> DROPPED_BITS)] = True
    pe = bucket_edges(probes << DROPPED_BITS, buckets)
    use = np.flatnonzero(np.diff(pe))
    chunk = table.column("chunk")[0].as_py()
    return pa.table({"bucket": pa.array(use, pa.int32()), "chunk": pa.array([chunk] * len(use), pa.int64()),
                     "probes": pa.array([pack(probes[pe[b] : pe[b + 1]]) for b in use], pa.binary()),
                     "index": pa.array([np.packbits(is_block[pe[b] : pe[b + 1]]).tobytes() for b in use], pa.binary())})


def meet_blocks(table: pa.Table) -> pa.Table:
    """For each chunk: the probes that are a block of another chunk, and the blocks that another chunk probes."""
    probes = [unpack(x) for x in table.column("probes").to_pylist()]
    index = [p[np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool)] for p, x in zip(probes, table.column("index").to_pylist())]
    rows = len(probes)
    hi = np.concatenate(index)
    ci = np.repeat(np.arange(rows), [len(x) for x in index])
    order = np.argsort(hi, kind="stable")
    hi, ci = hi[order], ci[order]
    names, first, counts = np.unique(hi, return_index=True, return_counts=True)
    met = np.zeros(len(names), np.int64)  # chunks that probe each block
    found, where = [], []
    for p in probes:
        at = np.minimum(np.searchsorted(names, p), max(0, len(names) - 1))
        ok = names[at] == p if len(names) else np.zeros(len(p), bool)
        found.append(ok)
        where.append(at[ok])
        met[at[ok]] += 1
    out_p, out_i = [], []
    for r, p in enumerate(probes):
        at = where[r]
        other = (counts[at] > 1) | (ci[first[at]] != r)
        out_p.append(pack(p[found[r]][other]))
        mine = np.searchsorted(names, index[r])
        out_i.append(pack(index[r][met[mine] > 1]))
    keep = pa.array([bool(a or b) for a, b in zip(out_p, out_i)])
    return pa.table({"chunk": table.column("chunk"), "probes": pa.array(out_p, pa.binary()), "index": pa.array(out_i, pa.binary())}).filter(keep)


def gathered(table: pa.Table, column: str) -> np.ndarray:
    """Ascending hashes of all of a chunk's answers."""
    runs = [unpack(x) for x in table.column(column).to_pylist()]
    return np.sort(np.concatenate(runs)) if runs else np.zeros(0, U64)


def among(h: np.ndarray, sorted_hashes: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(h), bool)
    return sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)] == h


def among_pairs(h: np.ndarray, g: np.ndarray, hs: np.ndarray, gs: np.ndarray) -> np.ndarray:
    """Which (h, g) are among the pairs (hs, gs)."""
    out = np.zeros(len(h), bool)
    if not len(hs):
        return out
    order = np.argsort(hs, kind="stable")
    hs, gs = hs[order], gs[order]
    lo, hi = np.searchsorted(hs, h), np.searchsorted(hs, h, side="right")
    for k in range(int((hi - lo).max(initial=0))):  # one, unless first hashes collide
        at = np.minimum(lo + k, len(hs) - 1)
        out |= (lo + k < hi) & (gs[at] == g)
    return out


def least_ids(h: np.ndarray, g: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each entry the smallest id of the entries with its (h, g)."""
    order = np.lexsort((ids, g, h))
    hs, gs = h[order], g[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])
    out = np.empty_like(ids)
    out[order] = ids[order][new][np.cumsum(new) - 1]
    return out


def send_windows(table: pa.Table, answers: pa.Table, n: int, buckets: int) -> pa.Table:
    none = pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int64()), "h": pa.array([], pa.binary()), "g": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})
    if not table.num_rows or not answers.num_rows:
        return none
    c = Chunk(table, n)
    starts, h = c.grams(c.b)
    short = h >> DROPPED_BITS
    hits = among(short, gathered(answers, "probes")) | (c.blocks(starts) & among(short, gathered(answers, "index")))
    near = c.around(starts[hits])
    starts, h = c.grams(n)
    ok = near[starts]
    starts, h = starts[ok], h[ok]
    g, ids = c.seconds(starts), c.ids[c.words.doc[starts]]
    order = np.lexsort((ids, g, h))
    h, g, ids = h[order], g[order], ids[order]
    new = np.ones(len(h), bool)  # of equal windows that of the smallest id
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    h, g, ids = h[new], g[new], ids[new]
    edges = bucket_edges(h, buckets)
    use = np.flatnonzero(np.diff(edges))
    return pa.table({"bucket": pa.array(use, pa.int32()), "chunk": pa.array([table.column("chunk")[0].as_py()] * len(use), pa.int64()),
                     "h": pa.array([pack(h[edges[b] : edges[b + 1]]) for b in use], pa.binary()),
                     "g": pa.array([g[edges[b] : edges[b + 1]].tobytes() for b in use], pa.binary()),
                     "ids": pa.array([pack_ids(ids[edges[b] : edges[b + 1]]) for b in use], pa.binary())})


def pack_ids(ids: np.ndarray) -> bytes:
    low = ids.min()
    gaps = (ids - low).view(U64)
    if gaps.max() < 2**32:
        return low.tobytes() + gaps.astype(np.uint32).tobytes()
    return b"\x08" * 7 + ids.tobytes()


def unpack_ids(blob: bytes, n: int) -> np.ndarray:
    if len(blob) == 8 + 4 * n:
        return np.frombuffer(blob, np.int64, 1)[0] + np.frombuffer(blob, np.uint32, offset=8).astype(np.int64)
    return np.frombuffer(blob, np.int64, offset=7)


def meet_windows(table: pa.Table) -> pa.Table:
    """For each chunk: its windows that a smaller id of another chunk has too."""
    h = [unpack(x) for x in table.column("h").to_pylist()]
    g = [np.frombuffer(x, U64) for x in table.column("g").to_pylist()]
    ids = [unpack_ids(x, len(y)) for x, y in zip(table.column("ids").to_pylist(), h)]
    least = np.split(least_ids(np.concatenate(h), np.concatenate(g), np.concatenate(ids)), np.cumsum([len(x) for x in h])[:-1])
    gone = [x < y for x, y in zip(least, ids)]
    return pa.table({"chunk": table.column("chunk"), "h": pa.array([pack(x[k]) for x, k in zip(h, gone)], pa.binary()),
                     "g": pa.array([x[k].tobytes() for x, k in zip(g, gone)], pa.binary())}).filter(pa.array([bool(k.any()) for k in gone]))


def remove_words(table: pa.Table, answers: pa.Table, n: int) -> pa.Table:
    c = Chunk(table, n)
    w = c.words
    starts, h = c.grams(n)
    ids = c.ids[w.doc[starts]]
    # second hashes only of windows whose first hash occurs again, here or in an answer
    order = np.argsort(h)
    again = np.zeros(len(h), bool)
    same = h[order][1:] == h[order][:-1]
    again[order[1:]] |= same
    again[order[:-1]] |= same
    told = [unpack(x) for x in answers.column("h").to_pylist()]
    hs = np.concatenate(told) if told else np.zeros(0, U64)
    gs = np.concatenate([np.frombuffer(x, U64) for x in answers.column("g").to_pylist()]) if told else hs
    some = np.flatnonzero(again | among(h, np.sort(hs)))
    g = c.seconds(starts[some])
    gone = np.zeros(len(h), bool)
    gone[some] = (least_ids(h[some], g, ids[some]) < ids[some]) | among_pairs(h[some], g, hs, gs)
    marks = np.zeros(c.total + 1, np.int32)
    np.add.at(marks, starts[gone], 1)
    np.add.at(marks, starts[gone] + n, -1)
    covered = np.cumsum(marks[:-1]) > 0
    kept = ~covered
    before = np.concatenate([[0], np.cumsum(kept)])
    n_kept = before[w.first[1:]] - before[w.first[:-1]]
    # kept words, each followed by a space; the text's last space is left off
    lengths = w.end[kept] - w.start[kept]
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(int(begin[-1]), 0x20, np.uint8)
    out[spread(begin[:-1], lengths)] = w.data[spread(w.start[kept], lengths)]
    edge = begin[before[w.first]]
    raw = out.tobytes()
    texts = [raw[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
    return pa.table({"doc_id": table.column("d"), "n_words": pa.array(w.n, pa.int64()), "n_removed": pa.array(w.n - n_kept, pa.int64()), "kept": pa.array(texts, pa.binary())})


def remove_repeats(df: DataFrame, n: int = 13, text: str = "text", doc_id: str = "doc_id", finish=None, schema: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text) of every row of df.

    kept: the words that stay, joined by one space. Null and empty texts
    have no words. Null ids count as larger than all others; rows that
    repeat an id do not count as smaller than each other. finish and
    schema: an Arrow function over the result, applied in the same tasks."""
    if n < 1:
        raise ValueError("n: one word at least")
    docs = id_and_text(df, doc_id, text).withColumn("d", F.col("d").cast("long"))
    size = total_bytes(docs)
    chunks, buckets = parts(size, CHUNK_BYTES), parts(size, BUCKET_BYTES)
    # rows without an id are dealt by their text
    by_chunk = docs.withColumn("chunk", F.pmod(F.when(F.col("d").isNull(), F.xxhash64("t")).otherwise(F.xxhash64("d")), F.lit(chunks))).groupBy("chunk")
    blocks = by_chunk.applyInArrow(lambda t: send_blocks(t, n, buckets), "bucket int, chunk long, probes binary, index binary")
    met = blocks.groupBy("bucket").applyInArrow(meet_blocks, "chunk long, probes binary, index binary")
    windows = by_chunk.cogroup(met.groupBy("chunk")).applyInArrow(lambda t, a: send_windows(t, a, n, buckets), "bucket int, chunk long, h binary, g binary, ids binary")
    repeats = windows.groupBy("bucket").applyInArrow(meet_windows, "chunk long, h binary, g binary")
    last = finish or as_text
    return by_chunk.cogroup(repeats.groupBy("chunk")).applyInArrow(
        lambda t, a: last(remove_words(t, a, n)), schema or "doc_id long, n_words long, n_removed long, kept string")


def as_text(table: pa.Table) -> pa.Table:
    return table.set_column(3, "kept", table.column("kept").cast(pa.string()))


def as_digest(table: pa.Table) -> pa.Table:
    return table.set_column(3, "kept_sha256", pa.array([hashlib.sha256(x).hexdigest() for x in table.column("kept").to_pylist()], pa.string()))
