"""Collocations by sampling and one full count (Toivonen), with exact counts.

A sample of the documents proposes words and pairs of words. One full pass
counts every word, every pair of proposed words and every triple of two
proposed pairs: the proposals together with their negative border. What
reaches the minimum there without having been proposed is a border failure; the
next pass counts what it opens up (pairs with such a word, triples with
such a pair), and so on until a pass has no failures. The sample only decides
in which pass a phrase is counted, never whether.

A chunk of documents is written once as a sequence of local word numbers, in
a table bucketed by chunk, so that it never moves. In each pass it sends its distinct new phrases with their counts as sorted runs
to hash buckets, and gets back the failures among them. Words are told
apart by their bytes, longer phrases by the numbers of their parts: no hash
stands for a phrase.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.session import scratch_path

from .packed import bucket_of, squeeze, unsqueeze
from .tables import parts, total_bytes, written
from .text import _FOLD, U64, byte_column, mix

#: text of a chunk, text whose phrases go to one bucket, text of the sample (and its largest share)
CHUNK_BYTES, BUCKET_BYTES, SAMPLE_BYTES, SAMPLE_SHARE = 5 << 20, 8 << 20, 8 << 20, 8
#: words and pairs that the sample may propose, and how often they must occur in it
PROPOSED, PROPOSED_AT = 1 << 17, 2
#: bits of a word's number in a key; a pair's number has the rest of 64
WORD_BITS = 30
LOWER = U64((1 << WORD_BITS) - 1)
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"

_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(BREAKS)] = True
_PARTS = _IS_BREAK.copy()
_PARTS[[0x20, 0x09]] = True


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as the steps of their upper parts and their lower parts: a few bytes each."""
    upper = keys >> U64(WORD_BITS)
    return squeeze(np.diff(upper, prepend=U64(0)) << U64(WORD_BITS) | keys & LOWER)


def unsqueeze_sorted(blob: bytes) -> np.ndarray:
    x = unsqueeze(blob, np.uint64)
    return np.cumsum(x >> U64(WORD_BITS), dtype=np.uint64) << U64(WORD_BITS) | x & LOWER


def counted(h: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values, and how often each occurs (or the sum of its c)."""
    if c is None:
        return np.unique(h, return_counts=True)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(first) else c


@dataclass
class Words:
    """The words of some texts: number of each among the distinct (lang, word) of the
    chunk, whether it begins a piece, and for each number lang, TAB, word as bytes."""

    number: np.ndarray
    begins: np.ndarray
    names: pa.Array
    counts: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, langs: pa.Array) -> Words:
        data, offsets = byte_column(texts)
        solid = np.zeros(len(data) + 2, bool)
        np.logical_not(_PARTS[data], out=solid[1:-1])
        first, last = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        first[inner], last[inner - 1] = solid[1:-1][inner], solid[1:-1][inner - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        n = len(start)
        if not n:
            return cls(np.zeros(0, np.int32), np.zeros(0, bool), pa.array([], pa.binary()), np.zeros(0, np.int64))
        doc = np.searchsorted(offsets, start, side="right") - 1
        lang = langs.dictionary_encode()
        of_word = lang.indices.to_numpy()[doc]
        breaks = np.flatnonzero(_IS_BREAK[data])
        begins = np.ones(n, bool)
        begins[1:] = (doc[1:] != doc[:-1]) | (np.searchsorted(breaks, start[1:]) != np.searchsorted(breaks, end[:-1]))
        del doc, breaks, solid, first, last
        # words and what lies between them, in turn, over the same bytes
        edges = np.empty(2 * n, np.int32)
        edges[0::2], edges[1::2] = start, end
        view = pa.Array.from_buffers(pa.binary(), 2 * n - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(_FOLD[data]))])
        coded = view.dictionary_encode()
        kinds = len(lang.dictionary)
        key = coded.indices.to_numpy()[0::2].astype(np.int64) * kinds + of_word
        used = np.zeros(len(coded.dictionary) * kinds, bool)
        used[key] = True
        number = (np.cumsum(used) - 1)[key]
        used = np.flatnonzero(used)
        counts = np.bincount(number, minlength=len(used))
        order = np.argsort(-counts, kind="stable")  # frequent words have small numbers
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        used = used[order]
        spelled, prefix = coded.dictionary.take(pa.array(used // kinds)).to_pylist(), [lang_key(x) for x in lang.dictionary.to_pylist()]
        names = pa.array([prefix[k] + w for k, w in zip((used % kinds).tolist(), spelled)], pa.binary())
        return cls(place[number], begins, names, counts[order])


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(texts, langs) of about CHUNK_BYTES, whole texts."""
    held, size = [], 0
    for batch in batches:
        _, offsets = byte_column(batch.column("t"))
        a = 0
        while a < batch.num_rows:
            b = min(batch.num_rows, max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES - size, side="right")) - 1))
            held.append(batch.slice(a, b - a))
            size += int(offsets[b] - offsets[a])
            a = b
            if size >= CHUNK_BYTES:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    table = pa.Table.from_batches(held).combine_chunks()
    return tuple(table.column(c).chunk(0).cast(pa.string()) if table.num_rows else pa.array([], pa.string()) for c in ("t", "lang"))


def lang_key(lang: str) -> bytes:
    """A language as it stands before its words: without line ends, and with a TAB at its end."""
    return lang.replace("\\", "\\\\").replace("\n", "\\n").encode() + b"\t"


def split_key(name: bytes) -> tuple[str, str]:
    lang, _, word = name.rpartition(b"\t")
    return plain_lang(lang), word.decode()


def plain_lang(lang: bytes) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), lang.decode())


class Proposals:
    """Words and pairs that the sample proposes, with their numbers."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]]):
        self.words = {w: k for k, w in enumerate(words)}
        known = [(self.words[a], self.words[b]) for a, b in pairs if a in self.words and b in self.words]
        self.pairs = np.sort(np.array([a << WORD_BITS | b for a, b in known], U64))  # a pair's number is its place here


def propose(docs: DataFrame, size: int) -> Proposals:
    """What occurs at least PROPOSED_AT times in a sample, the PROPOSED most frequent words and pairs."""
    share = min(1 / SAMPLE_SHARE, SAMPLE_BYTES / size) if size else 1
    sample = docs.where(F.pmod(F.xxhash64("t", "lang", "d"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in chunks_of(batches):
            w = Words.of(texts, langs)
            at = np.flatnonzero(~w.begins[1:])
            pair, c = counted(w.number[at].astype(np.int64) << 32 | w.number[at + 1])
            a, b = w.names.take(pa.array(pair >> 32)), w.names.take(pa.array(pair & 0xFFFFFFFF))
            none = pa.nulls(len(w.names), pa.binary())
            yield pa.RecordBatch.from_arrays([w.names, none, pa.array(w.counts, pa.int64())], ["a", "b", "c"])
            yield pa.RecordBatch.from_arrays([a, b, pa.array(c, pa.int64())], ["a", "b", "c"])

    found = written(sample.select("t", "lang").mapInArrow(count, "a binary, b binary, c long").groupBy("a", "b").agg(F.sum("c").alias("c")).where(F.col("c") >= PROPOSED_AT), "proposed")

    def most(which: Column) -> list:
        return found.where(which).orderBy(F.desc("c"), "a", "b").limit(PROPOSED).select("a", "b").collect()  # PROPOSED rows

    return Proposals([bytes(r["a"]) for r in most(F.col("b").isNull())], [(bytes(r["a"]), bytes(r["b"])) for r in most(F.col("b").isNotNull())])


class Chunk:
    """A chunk's words by their global numbers, as far as they are known so far."""

    def __init__(self, row: dict, proposals: Proposals, answers: list[dict]):
        seq = unsqueeze(row["seq"], np.uint32)
        inside = (seq & 1) == 0  # not at the beginning of a piece
        word = unsqueeze(row["known"], np.int64).copy()
        since = np.where(word >= 0, 0, -1)  # the pass that found it; 0: proposed
        pairs, ids, when = [proposals.pairs], [np.arange(len(proposals.pairs))], [np.zeros(len(proposals.pairs), np.int64)]
        for x in answers:
            keys, numbers = unsqueeze_sorted(x["keys"]), unsqueeze(x["ids"], np.int64)
            if x["what"] == -1:
                at = keys.astype(np.int64)
                word[at], since[at] = numbers, x["pass"]
            else:
                pairs.append(keys)
                ids.append(numbers)
                when.append(np.full(len(keys), x["pass"]))
        pairs = np.concatenate(pairs)
        order = np.argsort(pairs)
        self.pairs, self.ids, self.when = pairs[order], np.concatenate(ids)[order], np.concatenate(when)[order]
        local = (seq >> 1).astype(np.int64)
        self.word, self.since = word[local], since[local]
        #: places of the first words of pairs of known words
        self.at = np.flatnonzero(inside[1:] & (self.word[1:] >= 0) & (self.word[:-1] >= 0))

    def new_pairs(self, number: int) -> np.ndarray:
        """Keys of the pairs that pass ``number`` is the first to count, an entry for each place."""
        at = self.at[np.maximum(self.since[self.at], self.since[self.at + 1]) == number - 1]
        return self._keys(at)

    def _keys(self, at: np.ndarray) -> np.ndarray:
        return (self.word[at] << WORD_BITS | self.word[at + 1]).astype(U64)

    def new_triples(self, number: int) -> np.ndarray:
        if not len(self.pairs):
            return np.zeros(0, U64)
        keys = self._keys(self.at)
        place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        ok = self.pairs[place] == keys
        at, place = self.at[ok], place[ok]
        k = np.flatnonzero(at[1:] == at[:-1] + 1)  # two known pairs, one word apart
        k = k[np.maximum(self.when[place[k]], self.when[place[k + 1]]) == number - 1]
        return self.ids[place[k]].astype(U64) << U64(WORD_BITS) | self.word[at[k] + 2].astype(U64)


SENT = "kind int, bucket int, chunk long, h binary, c binary, names binary"
FOUND = "what int, chunk long, lang string, word string, k1 long, k2 long, id long, f long, keys binary, ids binary"
_SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("h", pa.binary()), ("c", pa.binary()), ("names", pa.binary())])
_FOUND = pa.schema([("what", pa.int32()), ("chunk", pa.int64()), ("lang", pa.string()), ("word", pa.string()), *[(k, pa.int64()) for k in ("k1", "k2", "id", "f")],
                    ("keys", pa.binary()), ("ids", pa.binary())])


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, ascending places of its entries) of every bucket that has some."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, order[edges[b] : edges[b + 1]]


def send(state: pa.Table, answers: pa.Table | None, proposals: Proposals, number: int, buckets: int) -> pa.Table:
    """A chunk's new phrases of pass ``number``, a row for each kind and bucket."""
    if not state.num_rows:
        return _SENT.empty_table()
    row = {c: state.column(c)[0].as_py() for c in ("chunk", "seq", "known")}
    chunk = Chunk(row, proposals, answers.to_pylist() if answers is not None else [])
    out = []
    if number == 1:
        names, c = state.column("names")[0].values, np.frombuffer(state.column("counts")[0].as_py(), np.int64)
        names = names.to_pylist()
        for b, at in _by_bucket(np.array([zlib.crc32(x) % buckets for x in names], np.int64), buckets):
            out.append((0, b, row["chunk"], squeeze_sorted(at.astype(U64)), squeeze(c[at]), zlib.compress(b"\n".join([names[k] for k in at.tolist()]), 1)))
    for kind, keys in ((1, chunk.new_pairs(number)), (2, chunk.new_triples(number))):
        keys, c = counted(keys)
        for b, at in _by_bucket(bucket_of(mix(keys), buckets), buckets):
            out.append((kind, b, row["chunk"], squeeze_sorted(keys[at]), squeeze(c[at].astype(np.int64)), None))
    return pa.table([pa.array([x[k] for x in out], f.type) for k, f in enumerate(_SENT)], schema=_SENT)


def add_up(table: pa.Table, proposals: Proposals, number: int, buckets: int, least: int) -> pa.Table:
    """The frequent phrases of a bucket (what 1, 2, 3: words, pairs, triples), and for
    each chunk those of its words (-1) and pairs (-2) that were not proposed."""
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    c = [unsqueeze(x, np.int64) for x in table.column("c").to_pylist()]
    h = [unsqueeze_sorted(x) for x in table.column("h").to_pylist()]
    numbered = lambda rank: (rank * buckets + bucket) * 2 + number - 1  # numbers of a bucket and a pass
    parts_, chunks = [], table.column("chunk").to_pylist()

    def rows(**columns) -> pa.Table:
        n = len(next(iter(columns.values())))
        return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FOUND], schema=_FOUND)

    if kind == 0:
        names = [y for x in table.column("names").to_pylist() for y in zlib.decompress(x).split(b"\n")]
        coded = pa.array(names, pa.binary()).dictionary_encode()
        code = coded.indices.to_numpy()
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, code, np.concatenate(c))
        often = np.flatnonzero(total >= least)
        spelled = coded.dictionary.take(pa.array(often)).to_pylist()
        by_name = sorted(range(len(often)), key=spelled.__getitem__)
        new = [k for k in by_name if spelled[k] not in proposals.words]
        number_of = np.full(len(total), -1)
        number_of[often] = [proposals.words.get(x, -1) for x in spelled]
        number_of[often[new]] = len(proposals.words) + numbered(np.arange(len(new)))
        if (number_of >> WORD_BITS).max(initial=0) > 0:
            raise OverflowError("more frequent words than numbers")
        split = [split_key(x) for x in spelled]
        parts_.append(rows(what=np.ones(len(often), np.int32), lang=[x for x, _ in split], word=[x for _, x in split], id=number_of[often], f=total[often]))
        fresh = np.zeros(len(total), bool)
        fresh[often[new]] = True
        at = 0
        for chunk, x in zip(chunks, h):
            mine = code[at : at + len(x)]
            at += len(x)
            if fresh[mine].any():
                parts_.append(rows(what=[-1], chunk=[chunk], keys=[squeeze_sorted(x[fresh[mine]])], ids=[squeeze(number_of[mine[fresh[mine]]])]))
    else:
        keys, total = counted(np.concatenate(h), np.concatenate(c))
        keys, total = keys[total >= least], total[total >= least]
        found = dict(what=np.full(len(keys), kind + 1, np.int32), k1=(keys >> U64(WORD_BITS)).astype(np.int64), k2=(keys & LOWER).astype(np.int64), f=total)
        if kind == 2:
            parts_.append(rows(**found))
        else:
            place = np.searchsorted(proposals.pairs, keys)
            known = np.zeros(len(keys), bool)
            inside = place < len(proposals.pairs)
            known[inside] = proposals.pairs[place[inside]] == keys[inside]
            ids = np.where(known, place, len(proposals.pairs) + numbered(np.cumsum(~known) - 1))
            if (ids >> (64 - WORD_BITS)).max(initial=0) > 0:
                raise OverflowError("more frequent pairs than numbers")
            parts_.append(rows(**found, id=ids))
            keys, ids = keys[~known], ids[~known]
            for chunk, x in zip(chunks, h):
                at = np.searchsorted(x, keys)
                has = at < len(x)
                has[has] = x[at[has]] == keys[has]
                if has.any():
                    parts_.append(rows(what=[-2], chunk=[chunk], keys=[squeeze_sorted(keys[has])], ids=[squeeze(ids[has])]))
    return pa.concat_tables(parts_)


@dataclass
class Mined:
    """Exact counts of all words (frequent ones by name), pairs and triples that reach the minimum."""

    words: DataFrame  # id, lang, word, f
    pairs: DataFrame  # id, w1, w2, f
    triples: DataFrame  # pair, w3, f
    totals: DataFrame  # lang, n
    passes: int


def mine(df: DataFrame, least: int, text: str = "text", lang: str = "lang") -> Mined:
    """Words, pairs and triples that occur at least ``least`` times in a language, with their counts.

    A-Z are lower-cased; a phrase does not cross BREAKS. Null texts are empty,
    a null lang is ``und``. Repeated rows each count."""
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                     F.spark_partition_id().alias("d"))
    size = total_bytes(docs)
    buckets = parts(size, BUCKET_BYTES)
    shared = spark.sparkContext.broadcast(propose(docs, size))  # PROPOSED words and pairs

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.words
        for k, (texts, langs) in enumerate(chunks_of(batches)):
            w = Words.of(texts, langs)
            numbers, of_lang = np.empty(len(w.names), np.int64), {}
            for at, (name, c) in enumerate(zip(w.names.to_pylist(), w.counts.tolist())):
                numbers[at] = known.get(name, -1)
                x = name[: name.rindex(b"\t")]
                of_lang[x] = of_lang.get(x, 0) + c
            of_lang = {plain_lang(x): c for x, c in of_lang.items()}
            row = [TaskContext.get().partitionId() << 24 | k, squeeze(w.number.astype(np.uint32) << 1 | w.begins), squeeze(numbers), w.names, w.counts.astype(np.int64).tobytes(), list(of_lang.items())]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.map_(pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], ["chunk", "seq", "known", "names", "counts", "of_lang"])

    # in buckets by chunk, so that answers come to the chunks and no chunk moves
    name = f"chunks_{uuid.uuid4().hex}"
    encoded = docs.select("t", "lang").mapInArrow(encode, "chunk long, seq binary, known binary, names array<binary>, counts binary, of_lang map<string,long>")
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))  # Spark's limit; beyond it a bucket holds more chunks
    path = scratch_path(spark, name)
    encoded.write.bucketBy(min(parts(size, 2 * CHUNK_BYTES), most), "chunk").option("path", path).saveAsTable(name)
    states = spark.table(name)

    def first_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from send(pa.Table.from_batches([batch.slice(k, 1)]), None, shared.value, 1, buckets).to_batches()

    def counts_of(number: int, answers: DataFrame | None) -> DataFrame:
        if answers is None:
            sent = states.mapInArrow(first_of, SENT)
        else:
            slim = states.select("chunk", "seq", "known")
            sent = slim.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda s, a: send(s, a, shared.value, number, buckets), SENT)
        return sent.groupBy("kind", "bucket").applyInArrow(lambda t: add_up(t, shared.value, number, buckets, least), FOUND)

    folder = scratch_path(spark, f"phrases-{uuid.uuid4().hex}")
    answers, number = None, 0
    while True:
        number += 1
        # one file a task, all kinds in it: making a file or folder may start a process (chmod) from the executor's JVM
        counts_of(number, answers).write.parquet(f"{folder}/pass={number}")
        found = spark.read.schema(f"{FOUND}, pass int").option("basePath", folder).parquet(folder)
        answers = found.where("what < 0").select("chunk", "what", "pass", "keys", "ids")
        if answers.where(F.col("pass") == number).limit(1).count() == 0:
            break
    spark.sql(f"DROP TABLE {name}")  # its name only: the files stay with the session's scratch
    totals = spark.read.schema(states.schema).parquet(path).select(F.explode("of_lang").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("n"))
    return Mined(found.where("what = 1").select("id", "lang", "word", "f"), found.where("what = 2").select("id", F.col("k1").alias("w1"), F.col("k2").alias("w2"), "f"),
                 found.where("what = 3").select(F.col("k1").alias("pair"), F.col("k2").alias("w3"), "f"), totals, number)


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact: a million at most, as no part is rarer than the whole."""
    return F.expr(f"cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) * 1000000BD div (cast({left} as decimal(18,0)) * cast({right} as decimal(18,0)))")


def collocations(df: DataFrame, least: int = 10, top: int = 2000, absorbed: int = 50, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two or three words.

    a: the phrase's count, l and r: those of its two parts at the cut with
    the lowest score (ties: the first cut), n: all words of the language. A
    phrase goes if it lies inside a longer one with at least absorbed percent of
    its count. Order: score, a (both descending), phrase by its bytes. No
    texts, or none with so frequent a phrase: no rows."""
    m = mine(df, least, text, lang)
    words, pairs = m.words, m.pairs
    f = {k: words.select(F.col("id").alias(f"w{k}"), F.col("f").alias(f"f{k}")) for k in (1, 2, 3)}
    of = words.select(F.col("id").alias("w1"), "lang", F.col("f").alias("f1"))
    triples = m.triples.withColumnRenamed("f", "a").join(
        pairs.select(F.col("id").alias("pair"), "w1", "w2", F.col("f").alias("f12")), "pair").join(
        pairs.select(F.col("id").alias("tail"), F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23")), ["w2", "w3"])
    triples = written(triples, "triples")  # numbers only; pairs and triples both read it
    longest = triples.select(F.explode(F.array("pair", "tail")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("longer"))
    two = pairs.join(longest, "id", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("f"))).join(of, "w1").join(f[2], "w2")
    two = two.select("lang", "w1", "w2", F.lit(None).cast("long").alias("w3"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), _score("f", "f1", "f2").alias("score"))
    cuts = triples.join(of, "w1").join(f[3], "w3").withColumns({"s1": _score("a", "f1", "f23"), "s2": _score("a", "f12", "f3")})
    first = F.col("s1") <= F.col("s2")
    three = cuts.select("lang", "w1", "w2", "w3", "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"),
                        F.least("s1", "s2").alias("score"))
    scored = written(two.unionByName(three), "scored")
    # the score and count of each language's last row, from numbers alone: the first rows of many parts, then of all
    best = [F.desc("score"), F.desc("a")]
    some = scored.select("lang", "score", "a", F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(64)).alias("part"))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("place") <= top)
    last = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("place") == top).select("lang", F.struct("score", "a").alias("last"))
    # all rows down to that one, ties included, get their words and their place among them
    kept = scored.join(last, "lang", "left").where(F.col("last").isNull() | (F.struct("score", "a") >= F.col("last"))).drop("last")
    kept = written(kept, "kept")
    names = words.select("id", "word").join(kept.select(F.explode(F.array("w1", "w2", "w3")).alias("id")).distinct(), "id")
    for k in (1, 2, 3):
        kept = kept.join(names.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}")), f"w{k}", "left")
    named = kept.withColumn("phrase", F.concat_ws(" ", "word1", "word2", "word3"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase"))).where(F.col("rank") <= top)
    return ranked.join(m.totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
