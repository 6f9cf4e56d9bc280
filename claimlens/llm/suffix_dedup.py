"""Substring dedup over bytes with a run-length index.

Every byte covered by a ``length``-byte string that also starts anywhere
else goes. Work that compares documents is confined to places that can
repeat:

1. Anchors. In each window of ``length`` bytes the k-gram of the smallest
   hash (its upper 44 bits; the leftmost of equals) is the window's anchor: equal windows have
   equal anchors at equal offsets. Documents, dealt into chunks by id hash,
   send their distinct anchors to hash buckets; anchors that occur once in
   the whole corpus end there.
2. Contexts. Around each anchor that occurs again, a chunk sends the bytes
   that any of the anchor's windows can reach, with a mark where the anchor
   begins (a window and its anchor's offset then match together, so a
   context never matches the same place seen from a neighbouring anchor).
   Equal contexts of a chunk are sent once, with their number.
3. Index. A bucket builds a suffix order of its distinct contexts, takes the
   Burrows-Wheeler transform in runs, and keeps the runs (letter, first place)
   and the match length at the ends of runs; streaming over the text, every
   other length follows from the one before it. Windows whose match with
   another context reaches their length are repeats, as are all windows of
   contexts that come twice.
4. Hot anchors, which occur more than HOT_ANCHOR times, may have any number of
   different contexts. Their windows travel one by one instead, as two
   independent 64-bit hashes dealt by the first: no group holds an anchor.
5. The chunk gets the repeated windows back and removes what they cover.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import bucket_edges, bucket_of, pack, unpack
from .substring_dedup import among, gathered
from .tables import id_and_text, parts, total_bytes
from .text import U64, byte_column, mix, spread

#: text of a chunk, text whose anchors go to one bucket, text whose contexts go to one bucket
CHUNK_BYTES, ANCHOR_BYTES, CONTEXT_BYTES = 4 << 20, 32 << 20, 6 << 20
#: contexts that one index holds (an anchor's are never parted: HOT_ANCHOR bounds them)
INDEX_BYTES = 256 << 10
#: occurrences (by powers of two) from which on an anchor is hot
HOT_ANCHOR = 4096
#: window starts handled at once, and the bits that hold a place among them (the rest is the hash's)
STRETCH, PLACE_BITS = 1 << 18, 20
#: bytes that UTF-8 text never holds: the anchor's mark, the end of a context
MARK, END = 0xFF, 0xFE


def gram_of(length: int) -> int:
    """Bytes of an anchor: a power of two, a third of a window at most. Long
    anchors keep chance meetings of short strings out of the contexts."""
    return 1 << max(3, (length // 3).bit_length() - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two, 8 at least) from each position that has so many."""
    h = np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data).data, strides=(1,)).copy()
    have = 8
    while have < gram:
        h = h[:-have] * U64(0x9E3779B97F4A7C15) + (h[have:] ^ (h[have:] >> U64(29)))
        have *= 2
    return mix(h)


def window_hashes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the ``length`` bytes from each position that has so many."""
    out, gram = [], 1 << (length.bit_length() - 1)
    for salt in (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)):
        h = np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data).data, strides=(1,)) * salt
        have = 8
        while have < gram:
            h = mix(h[:-have] + salt) * salt + h[have:]
            have *= 2
        n = max(0, len(data) - length + 1)
        out.append(mix(mix(h[:n] + salt) * salt + h[length - gram : length - gram + n]))  # two grams that overlap
    return out[0], out[1]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of texts that lie one after another."""
    gram = gram_of(length)
    width = length - gram + 1  # k-grams of a window
    whole = np.ones(len(data), bool)  # windows from there lie in one text
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        whole[max(a, b - length + 1) : b] = False
    low = U64((1 << PLACE_BITS) - 1)
    found, hashes = [], []
    for s in range(0, max(0, len(data) - length + 1), STRETCH):
        windows = whole[s : min(s + STRETCH, len(data) - length + 1)]
        if not windows.any():
            continue
        h = gram_hashes(data[s : s + len(windows) + length - 1], gram)
        # the place in the low bits: the smallest is the leftmost of equals
        keyed = np.full(-(-len(h) // width) * width, ~U64(0))
        keyed[: len(h)] = h & ~low | np.arange(len(h), dtype=U64)
        rows = keyed.reshape(-1, width)
        # smallest of each window: running minima of rows from the left and from the right
        left = np.minimum.accumulate(rows, axis=1).reshape(-1)
        right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(right[: len(windows)], left[width - 1 : width - 1 + len(windows)])
        at = (least[windows] & low).astype(np.int64)
        at = at[np.append(True, at[1:] != at[:-1])]
        found.append(at + s)
        hashes.append(h[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    pos, first = np.unique(np.concatenate(found), return_index=True)  # a stretch may end on the next one's first
    return pos, np.concatenate(hashes)[first]


class Chunk:
    """A chunk's bytes and the anchors of its texts."""

    def __init__(self, table: pa.Table, length: int):
        self.data, self.offsets = byte_column(table.column("t"))
        self.pos, self.h = anchors(self.data, self.offsets, length)
        self.doc = np.searchsorted(self.offsets, self.pos, side="right") - 1

    def hot_windows(self, hot: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, first hashes, second hashes) of the windows that hold a hot anchor, ordered by their hashes."""
        use = among(self.h, hot)
        if not use.any():
            return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
        pos, doc = self.pos[use], self.doc[use]
        low = np.maximum(self.offsets[doc], pos - (length - gram_of(length)))
        high = np.minimum(pos, self.offsets[doc + 1] - length)
        starts = np.unique(spread(low, np.maximum(0, high - low + 1)))
        if not len(starts):
            return starts, np.zeros(0, U64), np.zeros(0, U64)
        # only the bytes that these windows hold are hashed: pieces of overlapping windows, one after another
        new = np.append(True, starts[1:] >= starts[:-1] + length)
        begin, last = starts[new], starts[np.append(new[1:], True)]
        sizes = last + length - begin
        held = self.data[spread(begin, sizes)]
        at = starts + (np.cumsum(sizes) - sizes - begin)[np.cumsum(new) - 1]
        h, g = np.empty(len(at), U64), np.empty(len(at), U64)
        for s in range(0, len(held), STRETCH):
            a, b = np.searchsorted(at, [s, s + STRETCH])
            if a < b:
                h[a:b], g[a:b] = (x[at[a:b] - s] for x in window_hashes(held[s : s + STRETCH + length - 1], length))
        order = np.lexsort((g, h))
        return starts[order], h[order], g[order]

    def contexts(self, repeated: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Of anchors among ``repeated``: (positions, context start, distinct contexts, number of each, context of each)."""
        use = among(self.h, repeated)
        pos, doc = self.pos[use], self.doc[use]
        begin = np.maximum(self.offsets[doc], pos - (length - gram_of(length)))
        end = np.minimum(self.offsets[doc + 1], pos + length)
        raw, mark = self.data.tobytes(), bytes([MARK])
        seen: dict[bytes, int] = {}
        of = np.empty(len(pos), np.int64)
        for k, (a, p, b) in enumerate(zip(begin.tolist(), pos.tolist(), end.tolist())):
            of[k] = seen.setdefault(raw[a:p] + mark + raw[p:b], len(seen))
        # numbered by their bytes: a chunk's rows may come in another order each time it is read
        texts = sorted(seen)
        place = np.empty(len(texts), np.int64)
        place[[seen[t] for t in texts]] = np.arange(len(texts))
        of = place[of]
        return pos, begin, texts, np.bincount(of, minlength=len(texts)), of


def send_anchors(table: pa.Table, length: int, buckets: int) -> pa.Table:
    c = Chunk(table, length)
    h, n = np.unique(c.h, return_counts=True)
    power = np.ceil(np.log2(n)).astype(np.uint8)  # a power of two that is no less
    edges = bucket_edges(h, buckets)
    use = np.flatnonzero(np.diff(edges))
    return pa.table({"bucket": pa.array(use, pa.int32()), "chunk": pa.array([table.column("chunk")[0].as_py()] * len(use), pa.int64()),
                     "h": pa.array([pack(h[edges[b] : edges[b + 1]]) for b in use], pa.binary()),
                     "many": pa.array([zlib.compress(power[edges[b] : edges[b + 1]].tobytes(), 1) for b in use], pa.binary())})


def meet_anchors(table: pa.Table, hot_from: int) -> pa.Table:
    """For each chunk: its anchors that occur twice or more in the corpus, and which of them are hot."""
    h = [unpack(x) for x in table.column("h").to_pylist()]
    many = [1 << np.frombuffer(zlib.decompress(m), np.uint8).astype(np.int64) for m in table.column("many").to_pylist()]
    every = np.concatenate(h)
    names, at = np.unique(every, return_inverse=True)
    number = np.bincount(at, np.concatenate(many))
    out, hot, a = [], [], 0
    for x in h:
        n = number[at[a : a + len(x)]]
        out.append(pack(x[n > 1]))
        hot.append(pack(x[n > hot_from]))
        a += len(x)
    return pa.table({"chunk": table.column("chunk"), "h": pa.array(out, pa.binary()), "hot": pa.array(hot, pa.binary())}).filter(pa.array([bool(x) for x in out]))


def cool(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(repeated anchors that are not hot, hot ones) of a chunk, ascending."""
    hot = gathered(answers, "hot")
    every = gathered(answers, "h")
    return every[~among(every, hot)], hot


_SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("number", pa.binary()), ("many", pa.binary()), ("texts", pa.binary())])


def distinct_windows(h: np.ndarray, g: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows ordered by their hashes: (first place of each distinct one, where each bucket begins among these)."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    first = np.flatnonzero(new)
    return first, bucket_edges(h[first], buckets)


def send_contexts(table: pa.Table, answers: pa.Table, length: int, buckets: int) -> pa.Table:
    """Contexts of repeated anchors (kind 0), windows of hot ones (kind 1)."""
    if not table.num_rows or not answers.num_rows:
        return _SENT.empty_table()
    c = Chunk(table, length)
    repeated, hot = cool(answers)
    _, _, texts, count, of = c.contexts(repeated, length)
    # all contexts of an anchor go to one bucket, by the anchor's hash
    h = np.empty(len(texts), U64)
    h[of] = c.h[among(c.h, repeated)]
    where = bucket_of(mix(h), buckets)
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(buckets + 1))
    end, chunk = bytes([END]), table.column("chunk")[0].as_py()
    rows = []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        r = order[cuts[b] : cuts[b + 1]]
        rows.append((0, b, chunk, r.astype(np.uint32).tobytes(), np.packbits(count[r] > 1).tobytes(), b"".join([texts[i] + end for i in r.tolist()])))
    _, h, g = c.hot_windows(hot, length)
    first, edges = distinct_windows(h, g, buckets)
    many = np.diff(np.append(first, len(h))) > 1
    for b in np.flatnonzero(np.diff(edges)).tolist():
        at = first[edges[b] : edges[b + 1]]
        rows.append((1, b, chunk, pack(h[at]), np.packbits(many[edges[b] : edges[b + 1]]).tobytes(), g[at].tobytes()))
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SENT)], schema=_SENT)


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Suffix starts ordered by their first ``length`` bytes at least; ties by position."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded.data, strides=(1,)).astype(U64)
    order = np.argsort(key)
    rank = np.empty(n, np.int64)

    def ranked(k: np.ndarray) -> np.ndarray:
        """Rank of each position: how many come before its group of equals."""
        new = np.ones(n, bool)
        new[1:] = k[1:] != k[:-1]
        group = np.flatnonzero(new)
        rank[order] = np.repeat(group, np.diff(np.append(group, n)))
        return new

    new = ranked(key[order])
    have = 8
    while have < length and not new.all():
        # only groups of equals are ordered further, by the rank of what follows
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)
        who = order[at]
        after = np.where(who + have < n, rank[np.minimum(who + have, n - 1)] + 1, 0).astype(U64)
        k = rank[who].astype(U64) << U64(32) | after
        inner = np.argsort(k)
        order[at] = who[inner]
        full = rank[order].astype(U64) << U64(32)
        full[at] = k[inner]
        new = ranked(full)
        have *= 2
    # ties by position
    full = rank[order]
    alone = new & np.append(new[1:], True)
    at = np.flatnonzero(~alone)
    if len(at):
        order[at] = order[at][np.lexsort((order[at], full[at]))]
    return order


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the longest common prefix of the suffixes a and b, up to limit."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(text) + 1,), "<u8", padded.data, strides=(1,))
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for at in range(0, limit, 8):
        x, y = a[live] + at, b[live] + at
        inside = np.maximum(x, y) <= len(text)
        differ = eight[np.minimum(x, len(text))] ^ eight[np.minimum(y, len(text))]
        same = (differ == 0) & inside
        low = differ & (~differ + U64(1))
        out[live] += np.where(same, 8, np.where(inside, np.bitwise_count(low - U64(1)) >> 3, 0))
        live = live[same]
        if not len(live):
            break
    return np.minimum(out, len(text) - np.maximum(a, b))


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a text with sampled run ends."""

    def __init__(self, text: np.ndarray, length: int, longest: int):
        """longest: bytes between two ENDs at most; matches are measured within that."""
        order = suffix_order(text, length)
        n = len(text)
        before = text[order - 1]  # the transform; the first suffix takes the last byte
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.text, self.limit = text, longest + length + 8
        #: run heads: where the transform's letter changes, or neighbours do not step back to neighbours
        stepped = place[order - 1]
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | (stepped[1:] != stepped[:-1] + 1)
        #: the transform: a letter for each run, and where it begins; the order itself is not kept
        self.heads = np.flatnonzero(head)
        self.letters = before[self.heads]
        self.runs = len(self.heads)
        starts = np.zeros(n, bool)  # each context's first byte is sampled too: no length is carried over an END
        starts[np.append(0, np.flatnonzero(text == END)[:-1] + 1)] = True
        self.up = self._samples(order, head, starts, place, -1)
        tail = np.append(head[1:], True)
        self.down = self._samples(order, tail, starts, place, 1)

    def _samples(self, order, ends, starts, place, step):
        """Text positions of run ends, in ascending order, and their match length with the neighbour outside the run."""
        pick = np.zeros(len(order), bool)
        pick[order[ends]] = True
        at = np.flatnonzero(pick | starts)
        beside = place[at] + step
        ok = (beside >= 0) & (beside < len(order))
        size = np.zeros(len(at), np.int64)
        size[ok] = common(self.text, at[ok], order[beside[ok]], self.limit)
        return at, size

    def transform(self) -> np.ndarray:
        """The transform's letters, from its runs."""
        return np.repeat(self.letters, np.diff(np.append(self.heads, len(self.text))))

    def match_lengths(self) -> np.ndarray:
        """Of every position: the longest match of its suffix with any other, streamed from the samples."""
        n = len(self.text)
        out = np.zeros(n, np.int64)
        for at, size in (self.up, self.down):
            gap = np.diff(np.append(at, n))
            out = np.maximum(out, np.repeat(size + at, gap) - np.arange(n))
        return out


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For distinct marked contexts: mask of the windows (by start) that another context has too."""
    text = np.frombuffer(b"".join([c + bytes([END]) for c in contexts]), np.uint8)
    sizes = np.array([len(c) + 1 for c in contexts])
    ends = np.cumsum(sizes)
    long = RunIndex(text, length + 1, int(sizes.max())).match_lengths() >= length + 1  # a window and its mark
    return [long[e - s : max(e - s, e - 1 - length)] for s, e in zip(sizes.tolist(), ends.tolist())]


_MET = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("number", pa.binary()), ("masks", pa.binary())])


def meet_windows(table: pa.Table) -> pa.Table:
    """For each chunk: which of the windows that it sent come again, there or elsewhere (number: null)."""
    h = [unpack(x) for x in table.column("number").to_pylist()]
    g = [np.frombuffer(x, U64) for x in table.column("texts").to_pylist()]
    many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(x)) for m, x in zip(table.column("many").to_pylist(), h)]
    hs, gs = np.concatenate(h), np.concatenate(g)
    order = np.lexsort((gs, hs))
    new = np.ones(len(hs), bool)
    new[1:] = (hs[order][1:] != hs[order][:-1]) | (gs[order][1:] != gs[order][:-1])
    group = np.empty(len(hs), np.int64)
    group[order] = np.cumsum(new) - 1
    again = np.bincount(group, 1 + np.concatenate(many))[group] > 1
    masks = np.split(again, np.cumsum([len(x) for x in h])[:-1])
    return pa.table([table.column("chunk"), table.column("bucket"), pa.nulls(len(h), pa.binary()), pa.array([np.packbits(m).tobytes() for m in masks], pa.binary())], schema=_MET).filter(
        pa.array([bool(m.any()) for m in masks]))


def meet_contexts(table: pa.Table, length: int) -> pa.Table:
    """For each chunk: numbers of its contexts with repeated windows, and masks of these."""
    if table.column("kind")[0].as_py() == 1:
        return meet_windows(table)
    seen: dict[bytes, list[tuple[int, int]]] = {}
    end = bytes([END])
    double: set[bytes] = set()
    rows = list(zip(*(table.column(c).to_pylist() for c in ("number", "many", "texts"))))
    for r, (number, many, texts) in enumerate(rows):
        ids = np.frombuffer(number, np.uint32).tolist()
        flags = np.unpackbits(np.frombuffer(many, np.uint8), count=len(ids)).tolist()
        for i, m, t in zip(ids, flags, texts.split(end)):
            places = seen.setdefault(t, [])
            places.append((r, i))
            if m or len(places) > 1:
                double.add(t)
    # contexts of an anchor that has no others need no comparison: all their windows repeat, or none
    by_anchor: dict[bytes, int] = {}
    mark = bytes([MARK])
    key = {}
    for t in seen:
        p = t.index(mark)
        key[t] = k = t[p + 1 : p + 1 + gram_of(length)]
        by_anchor[k] = by_anchor.get(k, 0) + 1
    masks: dict[bytes, np.ndarray] = {}
    batch: list[bytes] = []
    held = 0
    # whole anchors at a time, in indexes that fit a processor's cache
    compare = sorted((t for t in seen if by_anchor[key[t]] > 1), key=key.__getitem__)
    for i, t in enumerate(compare):
        batch.append(t)
        held += len(t)
        if i + 1 == len(compare) or held >= INDEX_BYTES and key[compare[i + 1]] != key[t]:
            masks.update(zip(batch, repeated_windows(batch, length)))
            batch, held = [], 0
    out_n: list[list[int]] = [[] for _ in rows]
    out_m: list[list[bytes]] = [[] for _ in rows]
    width = -(-(length - gram_of(length) + 1) // 8)
    for t, places in seen.items():
        windows = max(0, len(t) - length)
        mask = np.ones(windows, bool) if t in double else masks.get(t, np.zeros(windows, bool))
        if mask.any():
            bits = np.packbits(mask).tobytes().ljust(width, b"\0")
            for r, i in places:
                out_n[r].append(i)
                out_m[r].append(bits)
    return pa.table([table.column("chunk"), table.column("bucket"), pa.array([np.array(x, np.uint32).tobytes() for x in out_n], pa.binary()),
                     pa.array([b"".join(x) for x in out_m], pa.binary())], schema=_MET).filter(pa.array([bool(x) for x in out_n]))


def remove_bytes(table: pa.Table, anchors_met: pa.Table, answers: pa.Table, length: int, buckets: int) -> pa.Table:
    data, offsets = byte_column(table.column("t"))
    starts = np.zeros(len(data), np.int64)
    if answers.num_rows:
        c = Chunk(table, length)
        repeated, hot = cool(anchors_met)
        of_windows = answers.column("number").is_null()
        at, h, g = c.hot_windows(hot, length)
        first, edges = distinct_windows(h, g, buckets)
        again = np.zeros(len(first), bool)
        for r in answers.filter(of_windows).to_pylist():
            lo, hi = edges[r["bucket"]], edges[r["bucket"] + 1]
            again[lo:hi] = np.unpackbits(np.frombuffer(r["masks"], np.uint8), count=hi - lo)
        starts[at[np.repeat(again, np.diff(np.append(first, len(h))))]] = 1
        answers = answers.filter(pa.compute.invert(of_windows))
        pos, begin, texts, _, of = c.contexts(repeated, length)
        width = -(-(length - gram_of(length) + 1) // 8)
        masks = np.zeros((len(texts), width), np.uint8)
        for number, bits in zip(answers.column("number").to_pylist(), answers.column("masks").to_pylist()):
            masks[np.frombuffer(number, np.uint32)] = np.frombuffer(bits, np.uint8).reshape(-1, width)
        for a in range(0, len(pos), 4096):
            k, w = np.nonzero(np.unpackbits(masks[of[a : a + 4096]], axis=1))
            starts[begin[a + k] + w] = 1
    so_far = np.cumsum(starts)  # a byte goes if a repeated window starts in the length bytes up to it
    gone = so_far > np.concatenate([np.zeros(min(length, len(data)), np.int64), so_far[: max(0, len(data) - length)]])
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    run = gone & (first[:-1] | ~np.append(False, gone[:-1]))
    sums = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[offsets])
    removed = sums(gone)
    kept = data[~gone]
    edge = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)])
    raw = kept.tobytes()
    return pa.table({"doc_id": table.column("d"), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                     "n_spans": pa.array(sums(run), pa.int64()), "kept": pa.array([raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.binary())})


def remove_repeats(df: DataFrame, length: int = 200, text: str = "text", doc_id: str = "doc_id", finish=None, schema: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the cut may part a
    character) of every row of df.

    Null and empty texts have no bytes; texts below ``length`` bytes lose
    none. Rows that repeat a text repeat all its windows, whatever their
    ids; chunks are dealt by id and text. finish and schema: an Arrow function over the result, applied in
    the same tasks."""
    if length < 24:
        raise ValueError("length: 24 bytes at least")
    docs = id_and_text(df, doc_id, text)
    size = total_bytes(docs)
    chunks = parts(size, CHUNK_BYTES)
    by_chunk = docs.withColumn("chunk", F.pmod(F.xxhash64("d", "t"), F.lit(chunks))).groupBy("chunk")
    hot_from, buckets = HOT_ANCHOR, parts(size, CONTEXT_BYTES)
    sent = by_chunk.applyInArrow(lambda t: send_anchors(t, length, parts(size, ANCHOR_BYTES)), "bucket int, chunk long, h binary, many binary")
    met = sent.groupBy("bucket").applyInArrow(lambda t: meet_anchors(t, hot_from), "chunk long, h binary, hot binary")
    contexts = by_chunk.cogroup(met.groupBy("chunk")).applyInArrow(
        lambda t, a: send_contexts(t, a, length, buckets), "kind int, bucket int, chunk long, number binary, many binary, texts binary")
    repeats = contexts.groupBy("kind", "bucket").applyInArrow(lambda t: meet_contexts(t, length), "chunk long, bucket int, number binary, masks binary")
    # the chunk needs both answers again: one stream, told apart by what is null
    none = F.lit(None).cast("binary")
    both = met.select("chunk", "h", "hot", F.lit(None).cast("int").alias("bucket"), none.alias("number"), none.alias("masks")).unionByName(
        repeats.select("chunk", none.alias("h"), none.alias("hot"), "bucket", "number", "masks"))

    def last(t: pa.Table, a: pa.Table) -> pa.Table:
        is_anchor = a.column("masks").is_null()
        out = remove_bytes(t, a.filter(is_anchor), a.filter(pa.compute.invert(is_anchor)), length, buckets)
        return finish(out) if finish else out

    kind = docs.schema["d"].dataType.simpleString()
    return by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(last, schema or f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def as_digest(table: pa.Table) -> pa.Table:
    return table.set_column(4, "kept_sha256", pa.array([hashlib.sha256(x).hexdigest() for x in table.column("kept").to_pylist()], pa.string()))
