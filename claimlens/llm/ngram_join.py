"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection.

A document's set holds the hashes of its distinct word shingles. Documents
with equal sets form a class; links are sought between classes.

Tiles. Sizes fall into bands so wide that linked sets lie in the same band
or in neighbouring ones; tile i holds bands i - 1 and i. Two linked sets of
tile i differ in at most d_i elements. Each set is dealt by hash into
k_i > d_i parts, so linked sets agree on k_i - d_i parts at least: a tile is
further cut by (part number, hash of the part's elements), and only sets
that meet in such a cell are compared. Empty parts make a cell only for
sets that have as many of them as two linked sets must have in common.

Bitmaps. Each set has a parity bitmap of its hashes; the number of bits in
which two bitmaps differ bounds the difference from below and so the overlap
from above. What passes is decided by intersecting the sorted arrays.

Hot cells. Linked sets agree on several parts, not on one. A set that has
fewer hot cells than it must have parts in common with any set it links with
leaves them: it meets those sets in other cells. What stays in a hot cell
are sets that mostly consist of what many share.

A cell with many mutually similar sets is not expanded into all its pairs:
every set is first compared with one leader; after that, rounds compare each
set only with its nearest (by bitmap) sets of other components in its cell,
until no set has more of them. A cell of many bytes is compared block against
block, in tasks of bounded size. All links between components are found, as no
pair is left out for any other reason than that its ends are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import bucket_edges, pack, unpack
from .tables import bucketed, connected_components, id_and_text, parts, written, written_and_told
from .text import U64, Words, byte_column, inner_grams, mix, ngram_hashes, text_slices

#: text that a task hashes at once; cell entries that it sends at once, and that a bucket should hold
SLICE_BYTES, SENT_ENTRIES, BUCKET_ENTRIES = 1 << 20, 500_000, 500_000
#: bits by which a cell's sent hash is longer than the number of cells needs (false meetings are ruled out later)
SPARE_BITS = 14
#: sets from which on a cell is hot
HOT_SETS = 1000
#: pairs that a set tries in the first round; bytes of bitmaps that a task compares at once; arrays of a bucket
NEAREST, GROUP_BYTES, ARRAY_BYTES = 8, 4 << 20, 8 << 20


def shingle_sets(col, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): ascending distinct shingle hashes of each text of a
    string column, one text after another; first: where each begins."""
    w = Words(*byte_column(col), fold=True)
    words, docs = w.hashes(), len(w.n)
    grams, ok = ngram_hashes(words, n), inner_grams(w.first, n, len(words))
    at = np.flatnonzero(ok)
    h = grams[at]
    first = np.searchsorted(at, w.first)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        h[a:b].sort()
    doc = w.doc[at]
    short = np.flatnonzero((w.n > 0) & (w.n < n))
    if len(short):  # the whole sequence as one shingle
        one = np.zeros(len(short), U64)
        for k in range(n - 1):
            has = w.n[short] > k
            one[has] = one[has] * U64(0x9E3779B97F4A7C15) + words[w.first[:-1][short[has]] + k]
        h = np.insert(h, first[short], mix(one + w.n[short].astype(U64)))
        doc = np.insert(doc, first[short], short)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(docs + 1))


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Wrapping sum of each run of values."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def set_names(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, the same for equal sets."""
    return mix(sums_by(mix(h ^ U64(0x5851F42D4C957F2D)), first) + np.diff(first).astype(U64)).view(np.int64)


def band_edges(largest: int, percent: int) -> np.ndarray:
    """First size of each band, up to beyond the largest size."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(edges[-1] * 100 // percent + 1)
    edges += [edges[-1] * 100 // percent + 1]
    return np.array(edges, np.int64)


def tile_parts(edges: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(d, k) of each tile: the largest difference of linked sets, and the parts."""
    upper = edges[1:] - 1
    d = (100 - percent) * 2 * upper // (100 + percent)
    spare = np.maximum(3, -(-(d + 1) // 4))
    return d, np.where(d > 0, d + 1 + spare, 1)


def tiled_cells(h: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell hash, set index, tile) of every cell that each set falls into, and
    need (tile, set). tile: 0 for that of the set's band, 1 for the next one.

    need: of any set that links with this one in the tile, so many non-empty
    parts at least agree, each a cell of both; 0: some of them may be empty."""
    size = np.diff(first)
    edges = band_edges(int(size.max(initial=0)), percent)
    d_of, k_of = tile_parts(np.append(edges, edges[-1] * 100 // percent + 1), percent)
    band = np.searchsorted(edges, size, side="right") - 1  # -1: empty
    owner = np.repeat(np.arange(len(size)), size)
    mixed = mix(h + U64(0xA0761D6478BD642F))
    out_h, out_i, out_t, needs = [], [], [], []
    for which, tile in enumerate((band, band + 1)):
        use = (size > 0) & (d_of[np.maximum(tile, 0)] > 0)
        k = np.where(use, k_of[np.maximum(tile, 0)], 0)
        base = np.cumsum(k) - k
        mine = use[owner]
        o = owner[mine]
        slot = base[o] + ((h[mine] >> U64(32)) * k[o].astype(U64) >> U64(32)).astype(np.int64)
        total = int(k.sum())
        acc = np.zeros(total, U64)
        np.add.at(acc, slot, mixed[mine])
        full = np.zeros(total, bool)
        full[slot] = True
        who = np.repeat(np.arange(len(size)), k)
        empties = k - np.bincount(who[full], minlength=len(size))
        needed = np.where(use, k - d_of[np.maximum(tile, 0)], 1)
        emit = full | (empties >= needed)[who]
        part = np.arange(total) - base[who]
        sig = mix(acc + mix(tile[who].astype(U64) * U64(1 << 32) + part.astype(U64) + U64(1)))
        out_h.append(sig[emit])
        out_i.append(who[emit])
        out_t.append(np.full(len(out_h[-1]), which, np.int8))
        needs.append(np.where(empties < needed, needed - empties, 0))
    return np.concatenate(out_h), np.concatenate(out_i), np.concatenate(out_t), np.stack(needs)


def cells(h: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell hash, set index) of every cell that each set falls into."""
    return tiled_cells(h, first, percent)[:2]


def bitmap(h: np.ndarray) -> np.ndarray:
    """Parity bitmap as bytes; bits: a power of two, eight times the size at least."""
    width = 1 << max(6, int(8 * len(h) - 1).bit_length())
    odd = np.bincount((h & U64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows) of fewer bytes: halves are xored."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def may_link(na, nb, differing, percent: int):
    """Whether sets of these sizes, whose bitmaps differ in so many bits, can link."""
    return differing * (100 + percent) <= (100 - percent) * (na + nb)


def may_link_by_bits(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose bitmaps (ba, bb) and sizes (na, nb) do not rule a link out."""
    for batch in batches:
        ba, bb = batch.column("ba"), batch.column("bb")
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        ok = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = np.frombuffer(ba[i].as_buffer(), np.uint8), np.frombuffer(bb[i].as_buffer(), np.uint8)
            w = min(len(x), len(y))
            ok[i] = may_link(na[i], nb[i], int(np.bitwise_count(fold(x, w).view(U64) ^ fold(y, w).view(U64)).sum()), percent)
        keep = pa.array(ok)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, ok) of the pairs; ok: their arrays' exact intersection links them."""
    for batch in batches:
        ha, hb = batch.column("ha"), batch.column("hb")
        ok = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = np.frombuffer(ha[i].as_buffer(), U64), np.frombuffer(hb[i].as_buffer(), U64)
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok)], ["a", "b", "ok"])


def differing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits in which each left bitmap differs from each right one."""
    out = np.zeros((len(left), len(right)), np.uint32)
    for w in range(left.shape[1]):
        out += np.bitwise_count(left[:, w, None] ^ right[None, :, w])
    return out


def near_pairs(f: np.ndarray, root: np.ndarray, n: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, tries: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(places in left, places in right) of the ``tries`` nearest sets of other
    components for each set of left that may link with it, and whether there
    were more. Bitmaps are compared folded to an eighth first."""
    short = bits
    while short.shape[1] > max(1, bits.shape[1] // 8):
        short = short[:, : short.shape[1] // 2] ^ short[:, short.shape[1] // 2 :]
    out, more = ([], []), False
    for lo in range(0, len(left), 256):
        a = left[lo : lo + 256]
        ok = (root[a][:, None] != root[right][None, :]) & may_link(n[a][:, None], n[right][None, :], differing(short[a], short[right]).astype(np.int64), percent)
        x, y = np.nonzero(ok)
        x, y = a[x], right[y]
        wide = np.empty(len(x), np.int64)
        for k in range(0, len(x), 8192):
            wide[k : k + 8192] = np.bitwise_count(bits[x[k : k + 8192]] ^ bits[y[k : k + 8192]]).sum(axis=1)
        ok = may_link(n[x], n[y], wide, percent)
        x, y, wide = x[ok], y[ok], wide[ok]
        order = np.lexsort((f[y], wide, x))
        x, y = x[order], y[order]
        place = np.arange(len(x)) - np.searchsorted(x, x)
        more |= bool((place >= tries).any())
        out[0].append(x[place < tries])
        out[1].append(y[place < tries])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(out[0] or none), np.concatenate(out[1] or none), more


def nearest(table: pa.Table, percent: int, tries: int) -> pa.Table:
    """(cell, a, b): for each set of a cell, its nearest sets of other components
    that may link with it; (cell, null, null): a set had more than ``tries``.

    Columns cell, i, j, block, f (set), root, n, bits. A row's cell is compared
    whole (i = j), or a block i of it against a block j. A table holds all
    rows of each (cell, i, j)."""
    cell, i, j, block, f_all, root_all, n_all = (table.column(k).to_numpy() for k in ("cell", "i", "j", "block", "f", "root", "n"))
    order = np.lexsort((j, i, cell))
    changed = (np.diff(cell[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)
    cuts = np.concatenate([[0], np.flatnonzero(changed) + 1, [len(cell)]])
    blobs = table.column("bits").combine_chunks()
    out: tuple[list, list, list] = ([], [], [])
    unfinished = set()
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        at = order[lo:hi]
        f, root, n = f_all[at], root_all[at], n_all[at]
        names, counts = np.unique(root, return_counts=True)
        if len(names) < 2:
            continue
        raw = [np.frombuffer(blobs[k].as_buffer(), np.uint8) for k in at.tolist()]
        width = min(len(b) for b in raw)
        bits = np.stack([fold(b, width) for b in raw]).view(U64)
        rest = root != names[counts.argmax()]  # those of the biggest component are met by all others
        if i[at[0]] == j[at[0]]:
            sides = [(rest, np.ones(len(f), bool))]
        else:
            one = block[at] == i[at[0]]
            sides = [(one & rest, ~one), (~one & rest, one)]
        for left, right in sides:
            x, y, more = near_pairs(f, root, n, bits, np.flatnonzero(left), np.flatnonzero(right), percent, tries)
            out[0].append(np.full(len(x), cell[at[0]]))
            out[1].append(np.maximum(f[x], f[y]))
            out[2].append(np.minimum(f[x], f[y]))
            if more:
                unfinished.add(int(cell[at[0]]))
    cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
    pairs = pa.table({k: pa.array(x, pa.int64()) for k, x in zip(("cell", "a", "b"), cols)})
    none = pa.nulls(len(unfinished), pa.int64())
    return pa.concat_tables([pairs, pa.table({"cell": pa.array(sorted(unfinished), pa.int64()), "a": none, "b": none})])


def classes_and_links(df: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text",
                      doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, links, roots).

    sets: d, x (text hash), n (shingles), f (class) of every row; links: a, b, classes that
    were compared and link; roots: node, root: components of the links."""
    percent = round(similarity * 100)
    if abs(percent - similarity * 100) > 1e-9 or not 0 < percent <= 100:
        raise ValueError("similarity: whole hundredths in (0, 1]")
    docs = id_and_text(df, doc_id, text).withColumn("x", F.xxhash64("t"))

    def name_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "t", SLICE_BYTES):
                h, first = shingle_sets(part.column("t"), shingle)
                yield pa.RecordBatch.from_arrays([part.column("d"), part.column("x"), pa.array(np.diff(first), pa.int64()), pa.array(set_names(h, first), pa.int64())], ["d", "x", "n", "f"])

    kind = docs.schema["d"].dataType.simpleString()
    sets = written(docs.mapInArrow(name_sets, f"d {kind}, x long, n long, f long"), "sets")
    entries = (sets.agg(F.sum("n")).first()[0] or 0) * 2.7 * 200 * (100 - percent) / (100 + percent) / 100
    buckets = parts(entries, BUCKET_ENTRIES)
    dropped = max(0, min(28, 64 - SPARE_BITS - max(1, int(entries)).bit_length()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            base = np.cumsum([0] + [len(x[3]) for x in held])
            sig, which = np.concatenate([x[0] for x in held]), np.concatenate([x[2] for x in held])
            who = np.concatenate([x[1] + at for x, at in zip(held, base)]) * 2 + which
            names, needs = np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held], axis=1)
            held.clear()
            order = np.argsort(sig)
            sig, who = sig[order], who[order]
            edges = bucket_edges(sig, buckets)
            out: tuple[list, ...] = ([], [], [], [], [])
            for b in np.flatnonzero(np.diff(edges)).tolist():
                lo, hi = edges[b], edges[b + 1]
                here, at = np.unique(who[lo:hi], return_inverse=True)
                some = (pack(sig[lo:hi] >> U64(dropped)), at.astype(np.uint32 if len(here) > 65535 else np.uint16).tobytes(), names[here >> 1].tobytes(),
                        (needs[here & 1, here >> 1] * 2 + (here & 1)).astype(np.int32).tobytes())
                for o, x in zip(out, (b, *some)):
                    o.append(x)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:]]], ["bucket", "sigs", "at", "names", "needs"])

        for batch in batches:
            for part in text_slices(batch, "t", SLICE_BYTES):
                h, first = shingle_sets(part.column("t"), shingle)
                names = set_names(h, first)
                _, one = np.unique(names, return_index=True)  # equal sets of the slice are sent once
                again = np.ones(len(names), bool)
                again[one] = False
                size = np.diff(first)
                h = h[~np.repeat(again, size)]
                first = np.concatenate([[0], np.cumsum(np.where(again, 0, size))])
                sig, who, which, needs = tiled_cells(h, first, percent)
                held.append((sig, who, which, names, needs))
                if sum(len(x[0]) for x in held) >= SENT_ENTRIES:
                    yield flush()
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        sig, f, need = [], [], []
        for s, a, m, w in zip(*(table.column(k).to_pylist() for k in ("sigs", "at", "names", "needs"))):
            names = np.frombuffer(m, np.int64)
            at = np.frombuffer(a, np.uint32 if len(names) > 65535 else np.uint16)
            sig.append(unpack(s))
            f.append(names[at])
            need.append(np.frombuffer(w, np.int32)[at])
        sig, f, need = np.concatenate(sig), np.concatenate(f), np.concatenate(need)
        order = np.lexsort((f, sig))
        sig, f, need = sig[order], f[order], need[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (f[1:] != f[:-1])
        sig, f, need = sig[new], f[new], need[new]
        first = np.append(np.flatnonzero(np.append(True, sig[1:] != sig[:-1])), len(sig)) if len(sig) else np.zeros(1, np.int64)
        size = np.diff(first)
        hot = size > HOT_SETS
        # named by its members: cells of the same sets are one (hot ones by their tiles too, as they are counted)
        member = f.view(U64) * U64(2) + np.where(np.repeat(hot, size), need & 1, 0).astype(U64)
        cell = mix(sums_by(mix(member), first) + size.astype(U64)).view(np.int64)
        lead = f[first[:-1]]
        _, one, times = np.unique(cell, return_index=True, return_counts=True)
        fresh, weight = np.zeros(len(cell), bool), np.zeros(len(cell), np.int64)
        fresh[one], weight[one] = True, times
        keep = np.repeat(fresh & (size > 1), size)
        per = lambda x: np.repeat(x, size)[keep]
        return pa.table({"cell": per(cell), "f": f[keep], "lead": per(lead), "hot": per(hot), "times": per(weight), "tile": need[keep] & 1, "need": need[keep] >> 1})

    met = docs.select("t").mapInArrow(send, "bucket int, sigs binary, at binary, names binary, needs binary").groupBy("bucket").applyInArrow(
        meet, "cell long, f long, lead long, hot boolean, times long, tile int, need int")
    one = met.groupBy("cell", "f").agg(F.min("lead").alias("lead"), F.max("hot").alias("hot"), F.sum("times").alias("times"), F.min("tile").alias("tile"), F.min("need").alias("need"))
    met, told = written_and_told(one, "cells", hot=F.count_if("hot"))
    if told["hot"]:
        # a set leaves its hot cells if it has fewer of them than parts in common with any set it links with: those it meets elsewhere
        hot = met.where("hot")
        stay = hot.groupBy("f", "tile").agg(F.sum("times").alias("h"), F.min("need").alias("need")).where("need = 0 OR h >= need").select("f", "tile")
        met = written(met.where("not hot").unionByName(hot.join(stay, ["f", "tile"], "left_semi")), "cells")
    met = met.select("cell", "f", "lead")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # a task gives a set once
        for batch in batches:
            for part in text_slices(batch, "t", SLICE_BYTES):
                h, first = shingle_sets(part.column("t"), shingle)
                names = set_names(h, first)
                new = [i for i, f in enumerate(names.tolist()) if not (f in sent or sent.add(f))]
                each = [h[first[i] : first[i + 1]] for i in new]
                yield pa.RecordBatch.from_arrays([pa.array(names[new], pa.int64()), pa.array(np.diff(first)[new], pa.int64()),
                                                  pa.array([x.tobytes() for x in each], pa.binary()), pa.array([bitmap(x).tobytes() for x in each], pa.binary())], ["f", "n", "h", "bits"])

    wanted = met.select("f").distinct()
    # a set's holder: a row's id, which may be null, and text
    holding = sets.join(wanted, "f", "left_semi").groupBy("f").agg(F.min(F.struct(F.col("d").isNull().alias("none"), "d", "x")).alias("r"), F.first("n").alias("n"))
    holders, told = written_and_told(holding.select("f", "n", F.col("r.d").alias("hd"), F.col("r.x").alias("hx")), "holders", n=F.coalesce(F.sum("n"), F.lit(0)))
    # merged at every size: a side that is broadcast while it is small says nothing about a large corpus
    held = docs.join(holders.select("hd", "hx").hint("merge"), (F.col("x") == F.col("hx")) & F.col("d").eqNullSafe(F.col("hd")), "left_semi")
    # in buckets by set: pairs come to the arrays, which do not move again; rows that repeat the holder's id and text give its set once
    in_buckets = min(parts(told["n"] * 9, ARRAY_BYTES), int(docs.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    data = bucketed(held.select("t").mapInArrow(arrays, "f long, n long, h binary, bits binary").repartition(in_buckets, "f").dropDuplicates(["f"]), "arrays", in_buckets, "f")

    def with_ends(pairs: DataFrame, *columns: str) -> DataFrame:
        for k in "ab":
            pairs = pairs.join(data.select(F.col("f").alias(k), *[F.col(c).alias(f"{c[0]}{k}") for c in columns]).hint("merge"), k)
        return pairs

    def compared(pairs: DataFrame) -> DataFrame:
        return written(with_ends(pairs, "h").select("a", "b", "ha", "hb").mapInArrow(lambda it: verify(it, percent), "a long, b long, ok boolean"), "compared")

    def rooted(rows: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
        """rows with column ``name``: the root of ``node``, itself where no link has it."""
        return rows.join(roots.select(F.col("node").alias(node), F.col("root").alias("_root")), node, "left").withColumn(name, F.coalesce("_root", node)).drop("_root")

    # one leader for each set first: most cells fall into one component then
    leaders = met.where("f <> lead").groupBy("f").agg(F.min("lead").alias("b")).select(F.col("f").alias("a"), "b")
    likely = written(with_ends(leaders, "n", "bits").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(lambda it: may_link_by_bits(it, percent), "a long, b long"), "likely")
    found = compared(likely)
    roots = written(connected_components(found.where("ok")), "roots")
    tries = NEAREST
    while True:
        named = rooted(met.select("cell", "f"), roots, "f", "root")
        split = named.groupBy("cell").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("cell")
        rows = named.join(split, "cell", "left_semi").join(holders.select("f", "n"), "f").withColumn("bytes", bitmap_bytes("n"))
        rows, told = written_and_told(rows, "open", bytes=F.coalesce(F.sum("bytes"), F.lit(0)))
        groups = parts(told["bytes"], GROUP_BYTES)
        # a cell of more bytes is compared block against block
        large = rows.groupBy("cell").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > GROUP_BYTES).select("cell", F.expr(f"cast(ceil(2 * bytes / {GROUP_BYTES}) as int)").alias("blocks"))
        dealt = rows.join(large, "cell", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.expr("cast(pmod(xxhash64(f), blocks) as int)")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0))))).select(
            "cell", "f", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("cell"), F.lit(groups))).otherwise(F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other"))).alias("g"))
        full = dealt.join(data.select("f", "n", "bits"), "f")
        proposed = nearest_pairs(full, percent, tries)
        more, told = written_and_told(proposed, "pairs", n=F.count("a"), open=F.count_if(F.col("a").isNull()))
        if told["n"]:
            fresh = compared(more.where("a IS NOT NULL").select("a", "b").distinct().join(found.select("a", "b"), ["a", "b"], "left_anti"))
            found = found.unionByName(fresh)
            # components grow by links between the present ones
            between = rooted(rooted(fresh.where("ok"), roots, "a", "x"), roots, "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
            grown = connected_components(between)
            known = roots.unionByName(grown.select("node", F.col("node").alias("root"))).distinct()
            roots = written(rooted(known, grown.select("node", "root"), "root", "root2").select("node", F.col("root2").alias("root")).distinct(), "roots")
        if not told["open"]:  # every pair that its bitmaps allow has been compared, or its ends are connected
            return sets, found.where("ok").select("a", "b"), roots
        met = met.join(more.where("a IS NULL").select("cell").distinct(), "cell", "left_semi")
        tries *= 8


def bitmap_bytes(n: str):
    """Bytes of the bitmap of a set of n elements, and of what goes with it."""
    return F.expr(f"32 + cast(pow(2, greatest(3, ceil(log2({n})))) as bigint)")


def nearest_pairs(rows: DataFrame, percent: int, tries: int) -> DataFrame:
    return rows.groupBy("g").applyInArrow(lambda t: nearest(t, percent, tries), "cell long, a long, b long")


def similarity_classes(df: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of df.

    Words are lower-cased (A-Z). Texts with fewer words than a shingle give
    one shingle, the whole sequence; texts without words (null, empty, white
    space) give none and are linked with nothing: their component is their
    own id. component_id: smallest id that links reach. Rows that repeat an
    id stay rows of their own; null ids are linked like others."""
    sets, _, roots = classes_and_links(df, shingle, similarity, text, doc_id)
    named = sets.where("n > 0").join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    least = named.groupBy("root").agg(F.min("d").alias("component_id"))
    smallest = named.select("f", "root").distinct().join(least, "root").select("f", "component_id")
    return (sets.join(smallest, "f", "left")
            .select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("d")).alias("component_id")))


def copies_and_kept(df: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(gone, kept): doc_id and text hash (``x``) of rows that links join with others.

    Of a component one row is kept: that of the smallest id (rows without an
    id come last) and then the smallest text hash. kept names each such row
    of df; rows without words are in neither table."""
    sets, _, roots = classes_and_links(df, shingle, similarity, text, doc_id)
    named = sets.where("n > 0").join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    row = F.struct(F.col("d").isNull().alias("none"), "d", "x")
    rows = named.select("d", "x", "root", row.alias("row")).join(named.groupBy("root").agg(F.min(row).alias("best")), "root")
    verdict = written(rows.select(F.col("d").alias("doc_id"), "x", F.col("row").eqNullSafe(F.col("best")).alias("kept")), "near")
    return verdict.where("not kept").select("doc_id", "x").distinct(), verdict.where("kept").select("doc_id", "x")
