"""Hard negatives: for every anchor its nearest rows of the same label, and for
each of these the nearest rows of other labels that score not far below it.

Components are whole numbers (floor of scale times the value), scores their
exact inner products. Kronecker packing: components are biased to be
non-negative and those of several candidates go into fields of one wide
integer, each field wide enough for any sum of products; one multiplication
by an anchor's component then serves all of them, and the fields of the sum
hold the exact scores. Where two or more fields (or one) fit into the 53
bits that a double holds exactly, the products are one matrix product; wider
ones use Python's integers, with all candidates of a tile in one of them.

Anchors are a stated share of the rows: they are taken in blocks of bounded
bytes, each broadcast to two passes over all rows. A task keeps the best of
what it read for each anchor, so what is shuffled follows from anchors and
tasks, not from rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.session import scratch_path

from .tables import parts

#: anchors that are broadcast at once (components as doubles, and what is kept of each)
BLOCK_BYTES, ANCHOR_BYTES = 8 << 20, 256
#: rows and anchors that are multiplied at once
TILE_ROWS, TILE_ANCHORS = 2048, 1024
LEAST, NO_ID = -(2**63) + 1, 2**63 - 1
EXACT_BITS = 53

OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def matrix(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, a row each; shorter vectors end in zeros."""
    offsets = np.asarray(column.offsets)
    values = np.floor(column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] * float(scale))
    n = np.diff(offsets)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.arange(out.shape[1]) < n[:, None]] = values
    return out


def packed_products(a: np.ndarray, c: np.ndarray, bits: int = EXACT_BITS) -> np.ndarray:
    """Inner products of all rows of a with all rows of c, as int64 (held to its range).

    a and c hold whole numbers. bits: what one exact packed integer may take."""
    d = max(a.shape[1], c.shape[1])
    a, c = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, c))
    top_a, top_c = (int(np.abs(x).max(initial=0)) for x in (a, c))
    width = max(1, (d * 4 * top_a * top_c).bit_length())  # a field holds any sum of d products of biased components
    fields = bits // width
    if not fields:
        return _wide_products(a, c, top_a, top_c, width)
    n = len(c)
    c = c + top_c
    per = -(-n // fields)
    packed = np.zeros((per, d))
    for k in range(fields):
        some = c[k * per : (k + 1) * per]
        packed[: len(some)] += some * float(1 << width * k)
    sums = ((a + top_a) @ packed.T).astype(np.int64)
    out = np.empty((len(a), n), np.int64)
    for k in range(fields):
        got = sums >> (width * k) if k == fields - 1 else (sums >> (width * k)) & ((1 << width) - 1)
        out[:, k * per : (k + 1) * per] = got[:, : max(0, n - k * per)]
    out -= (top_c * a.sum(1)).astype(np.int64)[:, None]
    out -= (top_a * c.sum(1)).astype(np.int64)[None, :]
    return out


def _wide_products(a: np.ndarray, c: np.ndarray, top_a: int, top_c: int, width: int) -> np.ndarray:
    """The same with one Python integer for all rows of c."""
    size = -(-width // 8)
    rows_a, rows_c = ([[int(x) for x in r] for r in m] for m in (a, c))
    packed = [int.from_bytes(b"".join((r[k] + top_c).to_bytes(size, "little") for r in rows_c), "little") for k in range(a.shape[1])]
    of_c = [top_a * (sum(r) + top_c * len(r)) for r in rows_c]
    out = np.empty((len(a), len(c)), np.int64)
    for i, r in enumerate(rows_a):
        fields = sum((x + top_a) * p for x, p in zip(r, packed)).to_bytes(size * len(c), "little")
        own = top_c * sum(r)
        for j, other in enumerate(of_c):
            out[i, j] = min(max(int.from_bytes(fields[j * size : (j + 1) * size], "little") - own - other, LEAST), -LEAST)
    return out


class Best:
    """The k best (score, id) of each of m anchors: higher scores first, then smaller ids."""

    def __init__(self, m: int, k: int):
        self.scores, self.ids = np.full((m, k), LEAST), np.full((m, k), NO_ID)

    def offer(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Entries for anchors at; those that cannot enter are dropped first."""
        last = self.scores[at, -1]
        ok = (scores > last) | ((scores == last) & (ids < self.ids[at, -1]))
        at, scores, ids = at[ok], scores[ok], ids[ok]
        if not len(at):
            return
        k = self.scores.shape[1]
        mine = np.unique(at)
        at = np.concatenate([np.repeat(mine, k), at])
        scores = np.concatenate([self.scores[mine].ravel(), scores])
        ids = np.concatenate([self.ids[mine].ravel(), ids])
        order = np.lexsort((ids, -scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        top = place < k
        self.scores[at[top], place[top]], self.ids[at[top], place[top]] = scores[top], ids[top]


class Anchors:
    """A block of anchors, in order of their labels."""

    def __init__(self, table: pa.Table, scale: float):
        table = table.sort_by([("l", "ascending"), ("i", "ascending")]).combine_chunks()
        self.ids = table.column("i").fill_null(NO_ID).to_numpy()
        labels = table.column("l").to_pylist()
        self.code = {l: k for k, l in enumerate(dict.fromkeys(labels))}
        self.labels = np.array([self.code[l] for l in labels], np.int64)
        self.first = np.searchsorted(self.labels, np.arange(len(self.code) + 1))
        column = table.column("v")
        self.vectors = matrix(column.chunk(0) if column.num_chunks else pa.array([], column.type), scale)

    def tiles(self, batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, label codes, components) of the rows, ordered by label; -1: a label of no anchor."""
        for batch in batches:
            for k in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(k, TILE_ROWS)
                labels = np.array([self.code.get(x, -1) for x in part.column("l").to_pylist()], np.int64)
                order = np.argsort(labels, kind="stable")
                ids = part.column("i").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                yield ids[order], labels[order], matrix(part.column("v"), scale)[order]


def positives(batches: Iterator[pa.RecordBatch], anchors: Anchors, scale: float, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of the same label and another id, of each anchor, among these rows."""
    best = Best(len(anchors.ids), k)
    for ids, labels, vectors in anchors.tiles(batches, scale):
        for code in np.unique(labels[labels >= 0]).tolist():
            a, b = np.searchsorted(labels, [code, code + 1])
            for lo in range(anchors.first[code], anchors.first[code + 1], TILE_ANCHORS):
                hi = min(lo + TILE_ANCHORS, anchors.first[code + 1])
                scores = packed_products(anchors.vectors[lo:hi], vectors[a:b])
                at, which = np.nonzero(scores >= best.scores[lo:hi, -1:])
                score, at, who = scores[at, which], at + lo, ids[a:b][which]
                other = anchors.ids[at] != who
                best.offer(at[other], score[other], who[other])
    at, place = np.nonzero(best.scores > LEAST)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(best.scores[at, place]), pa.array(best.ids[at, place])], ["a", "s", "i"])


def negatives(batches: Iterator[pa.RecordBatch], anchors: Anchors, bounds: tuple[np.ndarray, np.ndarray], scale: float, k: int) -> Iterator[pa.RecordBatch]:
    """For each anchor and positive the k best rows of other labels with a score from low to high."""
    low, high = bounds  # (anchors, positives)
    best = [Best(len(anchors.ids), k) for _ in range(low.shape[1])]
    highest = high.max(1)
    for ids, labels, vectors in anchors.tiles(batches, scale):
        for lo in range(0, len(anchors.ids), TILE_ANCHORS):
            hi = min(lo + TILE_ANCHORS, len(anchors.ids))
            scores = packed_products(anchors.vectors[lo:hi], vectors)
            need = np.minimum.reduce([np.maximum(low[lo:hi, p], x.scores[lo:hi, -1]) for p, x in enumerate(best)])
            at, which = np.nonzero((scores >= need[:, None]) & (scores <= highest[lo:hi, None]))
            score, at = scores[at, which], at + lo
            other = anchors.labels[at] != labels[which]
            at, score, who = at[other], score[other], ids[which[other]]
            for p, x in enumerate(best):
                ok = (score >= low[at, p]) & (score <= high[at, p])
                x.offer(at[ok], score[ok], who[ok])
    for p, x in enumerate(best):
        at, place = np.nonzero(x.scores > LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(at), p), pa.int32()), pa.array(x.scores[at, place]), pa.array(x.ids[at, place])], ["a", "p", "s", "i"])


def mine(df: DataFrame, anchors: Column, scale: float = 256, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100,
         row_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: which rows are anchors (null: not). A row's score is the inner
    product of its components, floor(scale * x), with the anchor's; an anchor's
    positives are its n_positives best rows of the same label, and the negatives of
    one the n_negatives best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score;
    ties go to smaller ids, null ids are larger than all others.

    Rows with a null label or vector, or a null or non-finite component take
    no part. Ids are whole numbers (others are refused); rows with the anchor's
    id are not its positives. Repeated rows each count; equal anchors once.
    Vectors of different lengths are compared as if the shorter ended in zeros.
    Scores beyond 64 bits count as the largest or smallest long."""
    spark = df.sparkSession
    if df.schema[row_id].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{row_id}: whole numbers only")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(scale))) < F.lit(float("inf"))))
    rows = df.select(F.col(f"`{row_id}`").cast("long").alias("i"), F.col(f"`{label}`").cast("string").alias("l"), F.col(f"`{vector}`").cast("array<double>").alias("v"),
                     F.coalesce(anchors, F.lit(False)).alias("anchor")).where(F.col("l").isNotNull() & F.col("v").isNotNull()).where(finite)
    chosen = rows.where("anchor").select("i", "l", "v").distinct()
    total = chosen.agg(F.sum(F.size("v") * 8 + ANCHOR_BYTES)).first()[0] or 0
    blocks = parts(total, BLOCK_BYTES)
    name = uuid.uuid4().hex
    by_block, result = scratch_path(spark, f"anchors-{name}"), scratch_path(spark, f"negatives-{name}")
    chosen.withColumn("block", F.pmod(F.xxhash64("i", "l", "v"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(by_block)
    spark.createDataFrame([], OUT).write.parquet(result)
    rows = rows.drop("anchor")
    written = spark.read.schema("i long, l string, v array<double>, block long").parquet(by_block)
    for block in range(blocks if total else 0):
        held = Anchors(written.where(F.col("block") == block).drop("block").toArrow(), scale)  # BLOCK_BYTES
        if not len(held.ids):
            continue
        shared = spark.sparkContext.broadcast(held)
        near = rows.mapInArrow(lambda b, s=shared: positives(b, s.value, scale, n_positives), "a int, s long, i long")
        best = Window.partitionBy("a").orderBy(F.desc("s"), "i")
        near = near.withColumn("p", F.row_number().over(best)).where(F.col("p") <= n_positives).toArrow()  # n_positives an anchor
        a, p = near.column("a").to_numpy(), near.column("p").to_numpy() - 1
        score, who = (np.zeros((len(held.ids), n_positives), np.int64) for _ in range(2))
        bounds = np.full(score.shape, -LEAST), np.full(score.shape, LEAST)
        score[a, p], who[a, p] = near.column("s").to_numpy(), near.column("i").to_numpy()
        for x, y in zip(a.tolist(), p.tolist()):
            s = int(score[x, y])
            bounds[0][x, y], bounds[1][x, y] = max(-(-low * s // 100), LEAST), min(high * s // 100, -LEAST)
        limits = spark.sparkContext.broadcast((bounds, who, score))

        def far(batches: Iterator[pa.RecordBatch], s=shared, b=limits) -> Iterator[pa.RecordBatch]:
            bounds, who, score = b.value
            for out in negatives(batches, s.value, bounds, scale, n_negatives):
                x, y = out.column("a").to_numpy(), out.column("p").to_numpy()
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(s.value.ids[x]), pa.array(who[x, y]), pa.array(score[x, y])], ["a", "p", "s", "i", "anchor_id", "positive_id", "positive_score"])

        found = rows.mapInArrow(far, "a int, p int, s long, i long, anchor_id long, positive_id long, positive_score long")
        best = Window.partitionBy("a", "p").orderBy(F.desc("s"), "i")

        def known(c: str) -> Column:
            return F.when(F.col(c) != NO_ID, F.col(c))

        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives).select(
            known("anchor_id").alias("anchor_id"), known("positive_id").alias("positive_id"), "rank", known("i").alias("negative_id"), "positive_score", F.col("s").alias("negative_score")
        ).write.mode("append").parquet(result)
        shared.unpersist()
        limits.unpersist()
    return spark.read.schema(OUT).parquet(result)
