"""LM scoring by online logistic context mixing.

A text is a run of tokens: its words, then one end. A token is told in
three steps: whether its type is known at all, the CLASS_BITS bits of its
class (a hash of the type), and the type within its class by its smoothed
count. The class bits are predicted one by one. Predictors, each a count of
the bits that came in a hashed context:

  corpus 0  bits so far, over the training corpus
  corpus 1  and the token before, over the training corpus
  text 0    bits so far, earlier in this text
  text 1    and the token before, earlier in this text

Their logits are added up with weights that a gate chooses (bit position, and
how much the corpus and the text know of the context). Weights are learnt
online: each text starts from START_WEIGHTS and takes a step after every batch of
its tokens, and so does a table over the mixed logit that refines the
probability adaptively; with ``batch=0`` both learn from every token before the
next one is told. Nothing is fitted beforehand, so no text is a sample.
The sum of all logs is the score of the words; bits per byte divide it by the
text's bytes (case and white space are not told).

Counts come from every training document and grow with the corpus: of each
type how often it occurs, and of each type which classes came after it and how
often, in hash buckets. To score, documents are dealt into chunks; a chunk asks
the buckets for what they know of its distinct types. No table is broadcast
but the 2**CLASS_BITS class counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import bucket_edges, grow, narrow, pack, shrink, unpack
from .tables import parts, total_bytes, written
from .text import U64, Words, byte_column, mix, spread, text_slices

CLASS_BITS = 6
#: a chunk's texts are scored side by side: the more, the fewer steps a text
CHUNK_BYTES, BUCKET_BYTES, SLICE_BYTES, SCORE_BYTES = 8 << 20, 12 << 20, 4 << 20, 8 << 20
#: texts that are scored side by side (each holds weights)
SCORE_ROWS = 4096
#: tokens whose inputs are worked out at once
BLOCK = 8192
#: entries that a training task holds before it sends them
HELD = 1_500_000
#: texts whose tokens, tokens whose counts in their text, and contexts whose followers are worked out at once while a chunk is scored
TOKEN_ROWS, COUNTED, FOLLOWED = 256, 1 << 17, 8192
NODES = 1 << CLASS_BITS
END, UNKNOWN, START = (U64(x) for x in (0x51A7E9C3B2D4F601, 0x7D3C0B5A9E8F1246, 0x2F1E4D3C5B6A7988))
#: gates: bit position, how often the corpus (0, below 8, 8 and more) and the text (0, below 3, 3 and more) saw the context
GATES = CLASS_BITS * 9
#: weights that each text starts from, by those two: corpus 0, corpus 1, text 0, text 1, bias
START_WEIGHTS = np.array([
    [[0.90, 0.0, 0.20, 0.0, 0.0], [0.80, 0.0, 0.20, 0.25, 0.0], [0.60, 0.0, 0.20, 0.50, 0.0]],
    [[0.65, 0.35, 0.20, 0.0, 0.0], [0.55, 0.35, 0.20, 0.20, 0.0], [0.45, 0.35, 0.15, 0.45, 0.0]],
    [[0.15, 0.85, 0.15, 0.0, 0.0], [0.15, 0.80, 0.15, 0.15, 0.0], [0.10, 0.70, 0.10, 0.35, 0.0]]])
INPUTS = START_WEIGHTS.shape[-1]
#: tokens of a text's first batch (each next one is twice as long), length of a step, what slows the first ones
BATCH, STEP, INERTIA = 64, 0.5, 12.0
#: cells of the refining table over logits from -8 to 8, and the weight of what it starts with
CELLS, REFINE_FROM = 17, 12.0


def tokens(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, first token of each text, bytes of each text); one end per text."""
    data, offsets = byte_column(col)
    w = Words(data, offsets, fold=True)
    h = np.insert(w.hashes(), w.first[1:], END)
    return h, w.first + np.arange(len(w.first)), np.diff(offsets)


def tokens_by_slices(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``tokens``, TOKEN_ROWS texts at a time, so that what is needed on the way stays small."""
    found = [tokens(col.slice(a, TOKEN_ROWS)) for a in range(0, len(col), TOKEN_ROWS)]
    if not found:
        return tokens(col)
    h, sizes, n_bytes = (np.concatenate(x) for x in zip(*[(h, np.diff(first), n) for h, first, n in found]))
    return h, np.concatenate([[0], np.cumsum(sizes)]), n_bytes


def before(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before in the same text, or START."""
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[first[:-1]] = START
    return out


def classes(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ U64(0x3C79AC492BA7B653)) >> U64(64 - CLASS_BITS)).astype(np.int64)


def logit_of(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4))).astype(np.float32)


def online_counts(context: np.ndarray, cls: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each class bit, the highest first: how many zeros and ones came earlier at
    this bit, after the same higher bits in the same context.

    Entries are in order of time; contexts are any numbers. The entries are
    kept grouped by context and higher bits, in order of time within a group:
    each bit parts every group in two. One that is alone in its group has
    seen nothing and will not: it is left out from there on."""
    n = len(cls)
    at = np.argsort(context, kind="stable").astype(np.int32)
    cls = cls.astype(np.int32)
    new = np.ones(n, bool)
    context = context[at]
    new[1:] = context[1:] != context[:-1]
    sizes = np.diff(np.append(np.flatnonzero(new), n))
    for k in range(CLASS_BITS):
        # entries at, in groups of so many
        keep = np.repeat(sizes > 1, sizes)
        at, sizes = at[keep], sizes[sizes > 1].astype(np.int32)
        begins = np.cumsum(sizes, dtype=np.int32) - sizes
        bit = cls[at] >> (CLASS_BITS - 1 - k) & 1
        sums = np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)])
        ones = sums[:-1] - np.repeat(sums[begins], sizes)
        start = np.repeat(begins, sizes)
        zeros = np.arange(len(at), dtype=np.int32) - start - ones
        n0, n1 = np.zeros(n, np.float32), np.zeros(n, np.float32)
        n0[at], n1[at] = zeros, ones
        yield n0, n1
        if k + 1 < CLASS_BITS:
            with_one = sums[begins + sizes] - sums[begins]
            to = np.where(bit == 1, np.repeat(begins + sizes - with_one, sizes) + ones, start + zeros)
            moved = np.empty_like(at)
            moved[to] = at
            at, sizes = moved, np.stack([sizes - with_one, with_one], axis=1).reshape(-1)


class Followers:
    """Of some contexts, how often each class came after them: rows of 2**CLASS_BITS counts, added up bit by bit."""

    def __init__(self, leaves: np.ndarray):
        self.by_bits = [leaves]  # [k]: counts by the highest CLASS_BITS - k bits
        while self.by_bits[-1].shape[1] > 1:
            self.by_bits.append(self.by_bits[-1].reshape(len(leaves), -1, 2).sum(axis=2, dtype=leaves.dtype))
        self.by_bits.reverse()

    def counts(self, row: np.ndarray, cls: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(zeros, ones) at bit k, after the higher bits of each class."""
        pairs = self.by_bits[k + 1].reshape(-1, 2).take((row << k) + (cls >> (CLASS_BITS - k)), axis=0).astype(np.float32)
        return pairs[:, 0], pairs[:, 1]


class Mixer:
    """Weights and refining table of each of some texts, as they stand.

    Entries are bits: CLASS_BITS of a text's token, of one text after another, as many texts as still have tokens.
    A bit position has weights and a table of its own, so the bits of a token learn apart."""

    def __init__(self, texts: int):
        bits = texts * CLASS_BITS
        self.w = np.zeros((bits * 9, 8), np.float32)  # (text, bit position, gate; input): the inputs' weights lie together, in 32 bytes
        self.w[:, :INPUTS] = np.tile(START_WEIGHTS.reshape(9, INPUTS), (bits, 1))
        self.w_run = self.w.view("V32").reshape(-1)  # the same, an item for all inputs
        grid = 1 / (1 + np.exp(-np.linspace(-8, 8, CELLS)))
        self.table = np.tile(grid * REFINE_FROM + 1j * REFINE_FROM, bits)  # ones + 1j * all
        self.noted: tuple[np.ndarray, ...] | None = None

    def probability(self, x: np.ndarray, gate: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, tuple]:
        """(probability of a one, of which half is the refined one; what ``learn`` needs).

        gate: the row of each entry's weights in ``w``; cells: where its table begins.
        All places are in range: take's "clip" only spares the check."""
        rows = self.w_run.take(gate, mode="clip")
        w = rows.view(np.float32).reshape(-1, 8).T[:INPUTS]
        up = np.add.reduce(np.multiply(w, x, order="C"), axis=0, dtype=np.float64)
        np.maximum(up, -8, out=up)
        np.minimum(up, 8, out=up)
        up += 8  # the mixed logit, from 0 to 16
        p = np.exp(8 - up)
        p += 1
        np.divide(1, p, out=p)
        cell = np.minimum(up.astype(np.int64), CELLS - 2)
        part = up - cell
        cell += cells
        low = self.table.take(cell, mode="clip")
        cell += 1
        high = self.table.take(cell, mode="clip")
        refined = low.real / low.imag * (1 - part)
        refined += high.real / high.imag * part
        refined += p
        refined /= 2
        return refined, (x, gate, cells, rows, w, p, up)

    def learn(self, told: tuple, squares: np.ndarray, bit: np.ndarray) -> None:
        """Learn from one token of each text: a damped Newton step for each weight, and a hit in the table. squares: of the inputs."""
        x, gate, cells, rows, w, p, up = told
        slope = bit - p
        slope *= STEP
        curve = 1 - p
        curve *= p
        divisor = squares * curve.astype(np.float32)
        divisor += np.float32(INERTIA)
        step = x * slope.astype(np.float32)
        step /= divisor
        w += step
        self.w_run[gate] = rows
        cell = np.rint(up).astype(np.int64)
        cell += cells
        hits = self.table.take(cell, mode="clip")
        hits += bit
        hits += 1j
        self.table[cell] = hits

    def note(self, told: tuple, bit: np.ndarray) -> None:
        """Keep for ``step`` what ``learn`` would learn at once."""
        if self.noted is None:
            self.noted = np.zeros(self.w.shape), np.zeros(self.w.shape), np.zeros_like(self.table)
        slope, curve, hits = self.noted
        x, gate, cells, _, _, p, up = told
        slope[gate, :INPUTS] += (x * (bit - p)).T
        curve[gate, :INPUTS] += (x * x * (p * (1 - p))).T
        hits[cells + np.rint(up).astype(np.int64)] += bit + 1j

    def step(self) -> None:
        """Learn from what was noted since the last step."""
        slope, curve, hits = self.noted
        self.w += STEP * slope / (curve + INERTIA)
        self.table += hits
        self.noted = None


def bit_logs(cls: np.ndarray, text: np.ndarray, prev: np.ndarray, row: np.ndarray, after: Followers, overall: Followers, batch: int = BATCH) -> np.ndarray:
    """Log probability of each token's class, tokens in order of texts and places.

    text: the number of the token's text, ascending. prev: a number of the token before, the same for
    equal ones. row: its row in ``after``; overall: one row for all tokens. batch: tokens of a text that
    its first step learns from, each next step from twice as many; 0: every token is learnt from before the next.

    All texts go on side by side, a token of each at a time, the longest texts first. What does not hang
    on the mixer (counts, logits, gates) is worked out for a block of tokens at once."""
    n, texts = len(cls), int(text[-1]) + 1 if len(text) else 0
    if not n:
        return np.zeros(0)
    first = np.searchsorted(text, np.arange(texts + 1))
    longest = np.argsort(-np.diff(first), kind="stable")
    whole = np.int32 if n < 2**31 else np.int64  # holds the number of a token
    rank = np.empty(texts, whole)
    rank[longest] = np.arange(texts)
    place = np.arange(n, dtype=whole) - first.astype(whole)[text]
    starts = np.append(0, np.cumsum(np.bincount(place)))
    at = starts.astype(whole)[place] + rank[text]  # the texts that have a token at a place are the first ones by rank
    del place
    order = np.empty(n, whole)
    order[at] = np.arange(n, dtype=whole)
    own1 = np.empty((2, n, CLASS_BITS), np.min_scalar_type(len(starts)))  # no count is larger than a text
    u = 0
    while u < texts:  # whole texts, as many as have about COUNTED tokens
        v = max(u + 1, int(np.searchsorted(first, first[u] + COUNTED, side="right")) - 1)
        some = slice(first[u], first[v])
        for k, (n0, n1) in enumerate(online_counts(text[some].astype(np.int64) << 32 | prev[some], cls[some])):
            own1[0, at[some], k], own1[1, at[some], k] = n0, n1
        u = v
    cls, row = cls[order], row[order]
    del text, prev, order
    every = np.arange(NODES)
    base = np.stack([logit_of(*overall.counts(np.zeros(NODES, np.int64), every, k)) for k in range(CLASS_BITS)], axis=1)
    shifts = CLASS_BITS - np.arange(CLASS_BITS)
    bits, nodes = every[:, None] >> shifts - 1 & 1, (every[:, None] >> shifts) + (1 << np.arange(CLASS_BITS))
    came_at = ((1 - bits) + 1j * bits).astype(np.complex64)
    mixer = Mixer(texts)
    own0 = np.zeros(texts * NODES, np.complex64)  # zeros + 1j * ones that came at each node of the classes' tree
    numbers = np.arange(texts * CLASS_BITS)  # of the bits of a place
    gates, cells = numbers * 9, numbers * CELLS
    chance = np.empty(n)
    due = length = batch
    t = 0
    while t + 1 < len(starts):  # as many places as make a block of tokens
        to = max(t + 1, int(np.searchsorted(starts, starts[t] + BLOCK, side="right")) - 1)
        a, b = starts[t], starts[to]
        c, after_row = cls[a:b].astype(np.int64), row[a:b].astype(np.int64)
        bit, came, p = bits[c], came_at[c].reshape(-1), np.empty((b - a) * CLASS_BITS)
        edges = ((starts[t : to + 1] - a) * CLASS_BITS).tolist()
        node = (nodes[c] + (np.arange(a, b) - np.repeat(starts[t:to], np.diff(starts[t : to + 1])))[:, None] * NODES).reshape(-1)
        seen0 = np.empty(len(node), np.complex64)
        for u, v in zip(edges[:-1], edges[1:]):
            own0.take(node[u:v], out=seen0[u:v], mode="clip")
            own0[node[u:v]] = seen0[u:v] + came[u:v]
        corpus1, text1 = np.empty((2, b - a, CLASS_BITS), np.float32), own1[:, a:b].astype(np.float32)
        for k in range(CLASS_BITS):
            corpus1[0, :, k], corpus1[1, :, k] = after.counts(after_row, c, k)
        x = np.empty((INPUTS, b - a, CLASS_BITS), np.float32)
        x[0], x[1], x[2], x[3], x[4] = base[c], logit_of(*corpus1), logit_of(seen0.real, seen0.imag).reshape(-1, CLASS_BITS), logit_of(*text1), 0.3
        known, seen = corpus1[0] + corpus1[1], text1[0] + text1[1]
        gate = ((known > 0).view(np.int8) + (known >= 8)) * np.int8(3) + (seen > 0) + (seen >= 3)
        x, gate, ones = x.reshape(INPUTS, -1), gate.reshape(-1).astype(np.int64), bit.reshape(-1).astype(np.float64)
        squares = x * x
        for k, (u, v) in enumerate(zip(edges[:-1], edges[1:]), t):
            if batch and k == due:
                mixer.step()
                length *= 2
                due += length
            p[u:v], told = mixer.probability(x[:, u:v], gates[: v - u] + gate[u:v], cells[: v - u])
            if batch:
                mixer.note(told, ones[u:v])
            else:
                mixer.learn(told, squares[:, u:v], ones[u:v])
        p = np.clip(p.reshape(-1, CLASS_BITS), 1e-4, 1 - 1e-4)
        chance[a:b] = np.where(bit == 1, p, 1 - p).prod(axis=1)
        t = to
    return np.log(chance)[at]


class Model:
    """What every task needs to score besides what it asks for: numbers of the whole corpus."""

    def __init__(self, total: float, types: float, once: float, class_mass: np.ndarray):
        self.total, self.types, self.class_mass = total, types, class_mass
        self.rare = (once + 0.5) / (total + 1.0)  # share of types never seen before, as in the corpus
        self.overall = Followers(class_mass[None, :])

    def score(self, at: np.ndarray, first: np.ndarray, cls_of: np.ndarray, count_of: np.ndarray, prev: np.ndarray, row: np.ndarray, after: Followers, batch: int) -> np.ndarray:
        """log10 probability of each text. at: the type of each token, by its place in cls_of and count_of (the
        types' classes and counts in training); prev, row, batch: see ``bit_logs``."""
        known = (count_of > 0)[at]
        whole = np.int32 if len(at) < 2**31 else np.int64  # holds the number of a token
        begin = np.repeat(first[:-1].astype(whole), np.diff(first))
        unknown = np.concatenate([np.zeros(1, whole), np.cumsum(~known, dtype=whole)])
        new = unknown[:-1] - unknown[begin]  # unknown tokens earlier in the text
        del unknown
        place = np.arange(len(at), dtype=whole) - begin
        p_new = (new + 20 * self.rare) / (place + 20)
        del new, place
        log = np.log(np.where(known, 1 - p_new, p_new))
        del p_new
        begin = begin[known]  # each text has one of its own: it has its end at least
        left = np.zeros(len(begin), whole)
        np.cumsum(begin[1:] != begin[:-1], out=left[1:])
        del begin
        types, prev, row = at[known], prev[known], row[known]
        told = bit_logs(cls_of[types], left, prev, row, after, self.overall, batch)
        told += np.log((count_of + 0.5) / self.class_mass[cls_of])[types]
        log[known] += told
        return np.add.reduceat(log, first[:-1]) / np.log(10)


def _entries(prev: np.ndarray, cls: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (context, class, number) ordered, equal ones added up."""
    order = np.lexsort((cls, prev))
    prev, cls, n = prev[order], cls[order], n[order]
    new = np.ones(len(prev), bool)
    new[1:] = (prev[1:] != prev[:-1]) | (cls[1:] != cls[:-1])
    at = np.flatnonzero(new)
    return prev[at], cls[at], np.add.reduceat(n, at) if len(at) else n


def _by_context(prev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct contexts, entries of each) of ordered entries."""
    at = np.flatnonzero(np.concatenate([[True], prev[1:] != prev[:-1]])) if len(prev) else np.zeros(0, np.int64)
    return prev[at], np.diff(np.append(at, len(prev)))


#: types and their counts; contexts, entries of each, their classes and numbers
_COLUMNS = ("h", "c", "ph", "pn", "pc", "pk")


def _packed(h, c, prev, cls, n) -> tuple[bytes, ...]:
    names, sizes = _by_context(prev)
    return (pack(h), shrink(c), pack(names), shrink(sizes), shrink(cls), shrink(n))


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    c, sizes, cls, n = (grow(row[k]).astype(np.int64) for k in ("c", "pn", "pc", "pk"))
    return unpack(row["h"]), c, unpack(row["ph"]), sizes, cls, n


def train(docs: DataFrame, buckets: int) -> tuple[Model, DataFrame]:
    """Model and the written counts by bucket (types, and classes after them) of the training texts (column t)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[tuple] = []
        pairs: list[tuple] = []

        def flush() -> pa.RecordBatch:
            h, c = (np.concatenate([x[i] for x in types]) for i in (0, 1))
            h, at = np.unique(h, return_inverse=True)
            c = np.bincount(at, c).astype(np.int64)
            prev, cls, n = _entries(*(np.concatenate([x[i] for x in pairs]) for i in range(3)))
            types.clear()
            pairs.clear()
            te, pe = bucket_edges(h, buckets), bucket_edges(prev, buckets)
            use = np.flatnonzero(np.diff(te) + np.diff(pe)).tolist()
            rows = [_packed(h[te[b] : te[b + 1]], c[te[b] : te[b + 1]], *(x[pe[b] : pe[b + 1]] for x in (prev, cls, n))) for b in use]
            return pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(6)]], ["bucket", *_COLUMNS])

        for batch in batches:
            for part in text_slices(batch, "t", SLICE_BYTES):
                h, first, _ = tokens(part.column("t"))
                names, at = np.unique(before(h, first), return_inverse=True)
                key, n = np.unique(at << CLASS_BITS | classes(h), return_counts=True)
                types.append(np.unique(h, return_counts=True))
                pairs.append((names[key >> CLASS_BITS], key & NODES - 1, n))
                if sum(len(x[0]) for x in pairs) > HELD:
                    yield flush()
        if types:
            yield flush()

    def add_up(table: pa.Table) -> pa.Table:
        rows = [_unpacked(r) for r in table.to_pylist()]
        h, at = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
        c = np.bincount(at, np.concatenate([r[1] for r in rows])).astype(np.int64)
        prev, cls, n = _entries(np.concatenate([np.repeat(r[2], r[3]) for r in rows]), np.concatenate([r[4] for r in rows]), np.concatenate([r[5] for r in rows]))
        mass = np.bincount(classes(h), c + 0.5, minlength=NODES)
        return pa.table({"bucket": table.column("bucket")[:1], **{k: pa.array([x], pa.binary()) for k, x in zip(_COLUMNS, _packed(h, c, prev, cls, n))}, "n": pa.array([int(c.sum())]),
                         "types": pa.array([len(h)]), "once": pa.array([int((c == 1).sum())]), "mass": pa.array([mass], pa.list_(pa.float64()))})

    packed = ", ".join(f"{k} binary" for k in _COLUMNS)
    sent = docs.select("t").mapInArrow(count, f"bucket int, {packed}")
    counts = written(sent.groupBy("bucket").applyInArrow(add_up, f"bucket int, {packed}, n long, types long, once long, mass array<double>"), "counts")
    total, types, once = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "types", "once")]).first()
    mass = np.zeros(NODES)
    for r in counts.select(F.posexplode("mass").alias("k", "m")).groupBy("k").agg(F.sum("m").alias("m")).collect():  # one row per class
        mass[r["k"]] = r["m"]
    return Model(float(total), float(types), float(once), np.maximum(mass, 0.5)), counts


def score(df: DataFrame, training: Column, text: str = "text", doc_id: str = "doc_id", batch: int = BATCH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte of every row of df.

    training: which rows to learn from (null: not). Null and empty texts are
    one end token. No training rows: every type is unknown. Rows that repeat
    an id are scored each; rows are dealt by id and text. base_score:
    log10 of the product of add-0.5 unigram probabilities. batch: see
    ``bit_logs``; 0 learns from every token before the next is told."""
    spark = df.sparkSession
    flagged = df.select(F.col(f"`{doc_id}`").alias("d"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"), F.coalesce(training, F.lit(False)).alias("train"))
    size = total_bytes(flagged)
    chunks, buckets = parts(size, CHUNK_BYTES), parts(size, BUCKET_BYTES)
    model, counts = train(flagged.where("train"), buckets)
    shared = spark.sparkContext.broadcast(model)  # 2**CLASS_BITS numbers
    by_chunk = flagged.withColumn("chunk", F.pmod(F.xxhash64("d", "t"), F.lit(chunks))).groupBy("chunk")

    def ask(table: pa.Table) -> pa.Table:
        h = distinct(table)
        edges = bucket_edges(h, buckets)
        use = np.flatnonzero(np.diff(edges))
        return pa.table({"bucket": pa.array(use, pa.int32()), "chunk": pa.array([table.column("chunk")[0].as_py()] * len(use), pa.int64()),
                         "asked": pa.array([pack(h[edges[b] : edges[b + 1]]) for b in use], pa.binary())})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        h, c, names, sizes, cls, n = _unpacked(known.to_pylist()[0]) if known.num_rows else (np.zeros(0, U64), *[np.zeros(0, np.int64)] * 5)
        begin = np.cumsum(sizes) - sizes
        out: tuple[list, ...] = ([], [], [], [])
        for x in asked.column("asked").to_pylist():
            q = unpack(x)
            if not len(h) and not len(names):
                of, many, entries = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.zeros(0, np.int64)
            else:
                at = np.minimum(np.searchsorted(h, q), max(0, len(h) - 1))
                of = np.where(h[at] == q, c[at], 0) if len(h) else np.zeros(len(q), np.int64)
                at = np.minimum(np.searchsorted(names, q), max(0, len(names) - 1))
                has = names[at] == q
                many, entries = np.where(has, sizes[at], 0), spread(begin[at[has]], sizes[at[has]])
            for o, y in zip(out, (of, many, cls[entries], n[entries])):
                o.append(shrink(y))
        return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), **{k: pa.array(x, pa.binary()) for k, x in zip(("c", "pn", "pc", "pk"), out)}})

    def distinct(table: pa.Table) -> np.ndarray:
        seen = [np.unique(tokens(table.column("t").slice(a, 256))[0]) for a in range(0, table.num_rows, 256)]
        return np.unique(np.concatenate([*seen, [START]]))

    def last(table: pa.Table, answers: pa.Table) -> pa.Table:
        model = shared.value
        h, first, n_bytes = tokens_by_slices(table.column("t"))
        h = np.append(h, START)
        names, at = np.unique(h, return_inverse=True)
        del h
        at = at.astype(np.int32 if len(names) < 2**31 else np.int64)
        prev = np.append(at[-1], at[:-2]) if len(at) > 1 else at[:0]
        prev[first[:-1]], at = at[-1], at[:-1]
        rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])  # buckets ascend with the hash
        count_of, sizes, cls, n = (np.concatenate([grow(r[k]) for r in rows]) for k in ("c", "pn", "pc", "pk"))
        count_of, sizes = count_of.astype(np.int64), sizes.astype(np.int64)
        del rows
        begin, ends, cls_of = np.cumsum(sizes) - sizes, np.cumsum(n_bytes), classes(names).astype(np.uint8)
        base_of = np.log10((count_of + 0.5) / (model.total + 0.5 * (model.types + 1)))
        out, a = [], 0
        while a < table.num_rows:  # texts from a, before b
            b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SCORE_BYTES, side="right"))
            b = min(max(a + 1, b), a + SCORE_ROWS, table.num_rows)
            part, mine, edges = table.slice(a, b - a), slice(first[a], first[b]), first[a : b + 1] - first[a]
            types, before_ = at[mine], prev[mine]
            base_score = np.add.reduceat(base_of[types], edges[:-1])  # each text on its own
            known = np.add.reduceat((count_of > 0)[types], edges[:-1], dtype=np.int64)
            some = np.zeros(len(names), bool)
            some[before_] = True
            used = np.flatnonzero(some & (sizes > 0))
            row_of = np.zeros(len(names), at.dtype)  # row 0: nothing is known
            row_of[used] = np.arange(1, len(used) + 1)
            leaves = np.zeros((len(used) + 1, NODES), np.int32 if model.total < 2**31 else np.int64)
            for u in range(0, len(used), FOLLOWED):
                some = used[u : u + FOLLOWED]
                entries = spread(begin[some], sizes[some])
                leaves[np.repeat(row_of[some], sizes[some]), cls[entries]] = n[entries]
            scores = model.score(types, edges, cls_of, count_of, before_, row_of[before_], Followers(leaves), batch)
            out.append(pa.table({"doc_id": part.column("d"), "held_out": pa.compute.invert(part.column("train")), "n_tokens": pa.array(np.diff(edges), pa.int64()),
                                 "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([int(model.total)] * len(known), pa.int64()), "base_score": pa.array(base_score),
                                 "score": pa.array(scores), "bits_per_byte": pa.array(-scores * np.log2(10) / np.maximum(n_bytes[a:b], 1))}))
            a = b
        return pa.concat_tables(out)

    asked = by_chunk.applyInArrow(ask, "bucket int, chunk long, asked binary")
    answers = asked.groupBy("bucket").cogroup(counts.select("bucket", *_COLUMNS).groupBy("bucket")).applyInArrow(answer, "chunk long, bucket int, c binary, pn binary, pc binary, pk binary")
    kind = df.schema[doc_id].dataType.simpleString()
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(
        last, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
