"""Toxicity: a counterfactual-regularised linear classifier.

Features are the distinct word forms of a text (letters only, lower case)
and the first 4 and 5 letters of longer forms, which catch inflected and
compound insults. An identity term, alone or as a plural or possessive, has one feature,
the term itself, so that nothing else of it can take weight. Spark counts in how many toxic and other
labelled texts each feature occurs; the features that tell most (by the signed root of the
likelihood ratio) and the identity terms become the vocabulary. The weights
minimise the logistic loss plus LAMBDA times the mean squared change of a
text's score when its identity terms are swapped for others of their group,
so that naming a group moves no score. Training sees a bounded sample of
labelled rows (``max_rows``); scoring sees every row and whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import smallest_hashes, written
from .text import text_slices

# Identity terms, in groups whose members may stand for each other.
IDENTITY_GROUPS = (
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("female", "male"), ("she", "he"), ("her", "his"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("american", "mexican", "chinese", "indian", "french", "german", "arab"),
    ("old", "young"), ("disabled", "blind", "deaf"), ("immigrant", "refugee", "native"),
)

#: vocabulary size, rows of which a feature must be part, labelled rows that training sees at most
VOCABULARY, LEAST_ROWS, MAX_ROWS = 4096, 8, 30_000
#: weight of the counterfactual penalty, of the L2 penalty
LAMBDA, RIDGE = 4.0, 0.3

#: forms that count as an identity term: the term, and its regular plural (a possessive parts at the apostrophe)
_NO_PLURAL = {"woman", "man", "women", "men", "she", "he", "her", "his"}
IDENTITY_FORMS = {w + end: w for group in IDENTITY_GROUPS for w in group for end in ("", "s") if not (end and w in _NO_PLURAL)}

_FORM = re.compile(r"[^\W\d_]+")
SLICE_BYTES = 2 << 20


def features(token: str) -> list[str]:
    """Features of one run of characters without white space."""
    out = []
    for f in _FORM.findall(token.lower()):
        if f in IDENTITY_FORMS:
            out.append(IDENTITY_FORMS[f])
            continue
        out.append(f)
        out += ["^" + f[:k] for k in (4, 5) if len(f) > k]
    return out


class Tokens(dict):
    """Features of each token seen so far, by token; ``known`` maps a feature to what is wanted of it."""

    LIMIT = 200_000  # entries, then it starts anew: memory (about 90 MB), not results, depends on it

    def __init__(self, known: dict | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, token: str):
        if len(self) >= self.LIMIT:
            self.clear()
        f = features(token)
        self[token] = f = f if self.known is None else [self.known[x] for x in f if x in self.known]
        return f

    def of(self, text: str | None) -> set:
        return set(chain.from_iterable(map(self.__getitem__, set(text.split())))) if text else set()


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each labelled row, counted by label within the task's slice."""
    tokens = Tokens()
    for batch in batches:
        for part in text_slices(batch, "t", SLICE_BYTES):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(part.column("t").to_pylist(), part.column("y").to_pylist()):
                seen[y].update(tokens.of(t))
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[w] for w in names], pa.int64()) for c in seen]], ["w", "n0", "n1"])


def swaps(vocabulary: dict[str, int]) -> dict[int, list[int]]:
    """Index of each identity term to the indices that may stand for it."""
    return {vocabulary[w]: [vocabulary[v] for v in group if v != w] for group in IDENTITY_GROUPS for w in group}


def fit(rows: list[np.ndarray], labels: np.ndarray, size: int, swap: dict[int, list[int]], steps: int = 800) -> np.ndarray:
    """Weights (bias last) by accelerated gradient descent on the whole sample.

    Each row is an array of feature indices. For a row with identity terms,
    its counterfactual is the row with every identity term replaced by the
    mean of its group's other members: the expected swap."""
    n = max(1, len(rows))
    lens = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows).astype(np.int64) if lens.sum() else np.zeros(0, np.int64)
    row_of = np.repeat(np.arange(len(rows)), lens)
    # score change of a swap = sum over the row's identity terms of (mean of others - own)
    hit = np.isin(flat, np.array(sorted(swap), np.int64)) if swap else np.zeros(len(flat), bool)
    cf_row, cf_feat, cf_val = [], [], []
    for r, f in zip(row_of[hit], flat[hit]):
        others = swap[int(f)]
        cf_row += [r] * (len(others) + 1)
        cf_feat += [int(f), *others]
        cf_val += [-1.0, *[1.0 / len(others)] * len(others)]
    cf_row, cf_feat, cf_val = np.array(cf_row, np.int64), np.array(cf_feat, np.int64), np.array(cf_val)
    # a penalty in the identity directions also where the sample has few such texts
    prior_rows = [(f, others) for f, others in swap.items()]
    y = labels.astype(float)
    w = np.zeros(size + 1)
    rate = y.mean() if len(y) else 0.0
    w[-1] = np.log((rate + 1e-3) / (1 - rate + 1e-3))
    look, momentum = w.copy(), 1.0
    # diagonal scaling: curvature of each weight at most
    curve = 0.25 * (np.bincount(flat, minlength=size + 1).astype(float) / n * max(1.0, lens.mean() if len(lens) else 1.0) ** 0.5)
    curve[-1] = 0.25 * max(1.0, lens.mean() if len(lens) else 1.0) ** 0.5
    if len(cf_feat):
        curve[:size] += 2 * LAMBDA * np.bincount(cf_feat, np.abs(cf_val), minlength=size)[:size] / n * 4
    curve += (2 * RIDGE + 8 * LAMBDA * 2) / n
    for _ in range(steps):
        z = np.bincount(row_of, look[flat], minlength=len(rows)) + look[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.zeros(size + 1)
        if len(rows):
            g[:size] = np.bincount(flat, (p - y)[row_of], minlength=size)[:size] / n
            g[-1] = (p - y).mean()
        if len(cf_feat):
            change = np.bincount(cf_row, cf_val * look[cf_feat], minlength=len(rows))
            g[:size] += 2 * LAMBDA * np.bincount(cf_feat, cf_val * change[cf_row], minlength=size)[:size] / n
        for f, others in prior_rows:
            d = look[f] - look[others].mean()
            g[f] += 2 * LAMBDA * d / n
        g[:size] += 2 * RIDGE * look[:size] / n
        new = look - g / curve
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        if np.dot(g, new - w) > 0:  # restart when the momentum leads uphill
            after, look = 1.0, new.copy()
        else:
            look = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    return w


class Model:
    """Vocabulary and weights; ``score`` gives the probability of label 1."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray):
        self.vocabulary, self.weights = vocabulary, weights
        self.tokens = Tokens(vocabulary)

    def score(self, text: str | None) -> float:
        z = float(self.weights[sorted(self.tokens.of(text))].sum() + self.weights[-1])
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, key: str = "doc_id") -> Model:
    """Fit on the docs that labels marks 0 or 1 (other labels are left out).

    The fit sees max_rows labels at most: those whose key has the smallest
    hash. That bounds what is broadcast to the documents (ids and labels; the
    texts stay where they are). Where documents repeat labelled ids, so that
    more than max_rows are labelled, each text counts once and those with the
    smallest hash are kept: that bounds what reaches the driver (vocabulary
    indices). No labelled rows: a model that gives every text the same low
    score. Null texts count as empty; null keys have no label."""
    marked = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("y in (0, 1) and k is not null")
    marked = marked.withColumn("r", F.xxhash64(F.col("k").cast("string")))
    total = marked.count()
    if total > max_rows:
        marked = marked.where(F.col("r") <= F.lit(smallest_hashes(marked, "r", total, max_rows))).orderBy("r", "k", "y").limit(max_rows)
    rows = (docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
            .join(F.broadcast(marked.select("k", "y")), "k").select("t", "y"))
    by_label = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if (many := sum(by_label.values())) > max_rows:  # documents repeat labelled ids
        hashed = rows.withColumn("r", F.xxhash64("t", "y")).dropDuplicates(["r"])
        cut = smallest_hashes(hashed.select("r"), "r", many, max_rows)
        rows = written(hashed.where(F.col("r") <= F.lit(cut)).orderBy("r").limit(max_rows).select("t", "y"), "labelled")
        by_label = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = rows.mapInArrow(_feature_rows, "w string, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a, b = float(by_label.get(0, 0)), float(by_label.get(1, 0))
    if not a + b:
        return Model({}, np.array([-6.0]))

    def lg(k: Column, n: float, p: Column) -> Column:  # k log p + (n - k) log (1 - p)
        return k * F.log(F.greatest(p, F.lit(1e-12))) + (n - k) * F.log(F.greatest(1 - p, F.lit(1e-12)))

    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    told = lg(n0, a, n0 / max(a, 1)) + lg(n1, b, n1 / max(b, 1)) - lg(n0, a, (n0 + n1) / (a + b)) - lg(n1, b, (n0 + n1) / (a + b))
    top = [r["w"] for r in counts.where(F.col("n0") + F.col("n1") >= LEAST_ROWS).withColumn("g", F.round(told, 6))
           .orderBy(F.desc("g"), "w").limit(VOCABULARY).select("w").collect()]
    fixed = [w for group in IDENTITY_GROUPS for w in group]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys([*fixed, *top]))}

    def indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(vocabulary)
        for batch in batches:
            for part in text_slices(batch, "t", SLICE_BYTES):
                found = [np.array(sorted(tokens.of(t)), np.uint16).tobytes() for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(found, pa.binary())], ["y", "f"])

    got = rows.mapInArrow(indices, "y int, f binary").toArrow()
    feats = [np.frombuffer(x, np.uint16) for x in got.column("f").to_pylist()]
    labels = np.array(got.column("y").to_pylist())
    order = sorted(range(len(feats)), key=lambda i: (labels[i], feats[i].tobytes()))  # the fit must not depend on task order
    return Model(vocabulary, fit([feats[i] for i in order], labels[order], len(vocabulary), swaps(vocabulary)))


def score(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score of every row of df (null text: empty; ids as they are)."""
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast((model.vocabulary, model.weights))  # VOCABULARY entries at most, and the identity terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            for part in text_slices(batch, "t", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("d"), pa.array([m.score(t) for t in part.column("t").to_pylist()], pa.float64())], ["doc_id", "score"])

    rows = df.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").cast("string").alias("t"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['d'].dataType.simpleString()}, score double")


def keep_below(df: DataFrame, model: Model, limit: float, text: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose score is below limit.

    One pass in Arrow batches; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast((model.vocabulary, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            for part in text_slices(batch, text, SLICE_BYTES):
                below = [m.score(t) < limit for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                yield part.filter(pa.array(below, pa.bool_()))

    return df.mapInArrow(run, df.schema)
