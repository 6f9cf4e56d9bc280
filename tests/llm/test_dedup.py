"""Exact dedup, n-gram Jaccard join, substring dedup over words and over bytes."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimlens.llm import exact_dedup, ngram_join, packed, substring_dedup, suffix_dedup, text
from claimlens.llm.tables import connected_components

from . import brute
from .conftest import odd_rows


def bag(rows):
    return Counter(map(repr, rows))


def as_rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ------------------------------------------------------------------ helpers

@settings(deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_hash_runs_round_trip(xs):
    x = np.unique(np.array(xs, np.uint64))
    assert (packed.unpack(packed.pack(x)) == x).all()
    near = np.unique(x >> np.uint64(40))
    assert (packed.unpack(packed.pack(near)) == near).all()


@settings(deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabAé", max_size=30), max_size=6))
def test_words_and_hashes(texts):
    import pyarrow as pa

    w = text.Words(*text.byte_column(pa.array(texts, pa.string())), fold=True)
    got = [[bytes(w.data[w.start[k] : w.end[k]]) for k in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
    want = [brute.words(t, True) for t in texts]
    assert got == want
    flat = [x for t in want for x in t]
    h = w.hashes()
    assert len({*h.tolist()}) == len(set(flat)) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_components_of_a_chain_and_a_star(sp):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(sp.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in [100, *range(200, 250)]}}


# ------------------------------------------------------------------ exact dedup

def exact(rows, keep):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    best = {t: (max if keep == "largest" else min)((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return bag([(d, best[t or ""], len(groups[t or ""]), d == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows])


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_odd_rows(odd, keep):
    assert bag(tuple(r) for r in exact_dedup.exact_dedup(odd, keep=keep).collect()) == exact(odd_rows(), keep)


def test_exact_collisions_are_told_apart(sp):
    rows = [(i, "ab"[i % 2] * (1 + i % 5)) for i in range(60)]
    got = exact_dedup.exact_dedup(sp.createDataFrame(rows, "doc_id long, text string"), hash_of=lambda t: F.length(t))
    assert bag(tuple(r) for r in got.collect()) == exact(rows, "smallest")


def test_exact_large_group_is_salted(sp):
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(4000)]
    got = exact_dedup.exact_dedup(sp.createDataFrame(rows, "doc_id long, text string"))
    assert bag(tuple(r) for r in got.collect()) == exact(rows, "smallest")


def test_exact_group_without_ids_is_salted(sp, monkeypatch, tmp_path):
    """Rows without ids, or with one id, spread over the salts too, and are counted all the same."""
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 50)
    seen = []
    real = exact_dedup.written
    monkeypatch.setattr(exact_dedup, "written", lambda df, name: (seen.append(real(df, name)) or seen[-1]) if name == "copies" else real(df, name))
    rows = [(None, "same")] * 400 + [(5, "other")] * 400 + [(6, "alone")]
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(sp.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "keep_id", "group_size", "kept").collect())
    assert got == Counter({(None, None, 400, True): 400, (5, 5, 400, True): 400, (6, 6, 1, True): 1})
    assert [r["n"] for r in seen[0].groupBy("h").agg(F.countDistinct("salt").alias("n")).collect()] == [8, 8]


def test_exact_empty(empty):
    assert exact_dedup.exact_dedup(empty).collect() == []


# ------------------------------------------------------------------ n-gram Jaccard join

@pytest.mark.parametrize("shingle,similarity", [(3, 0.9), (5, 0.8), (1, 0.75)])
def test_join_odd_rows(odd, shingle, similarity):
    got = ngram_join.similarity_classes(odd, shingle, similarity).collect()
    rows = odd_rows()
    assert bag(tuple(r) for r in got) == bag((d, *x) for (d, _), x in zip(rows, brute.components(rows, shingle, round(100 * similarity))))


def test_join_on_documents(documents):
    rows = as_rows(documents)
    got = ngram_join.similarity_classes(documents, 5, 0.8).collect()
    assert bag(tuple(r) for r in got) == bag((d, *x) for (d, _), x in zip(rows, brute.components(rows, 5, 80)))


def test_join_of_a_cluster_at_the_limit(sp):
    """Copies with a few words changed: some pairs link, others only through third ones."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for p in rng.choice(120, int(rng.integers(0, 6)), replace=False):
            w[p] = f"x{rng.integers(50)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.similarity_classes(sp.createDataFrame(rows, "doc_id long, text string"), 2, 0.9).collect()
    assert bag(tuple(r) for r in got) == bag((d, *x) for (d, _), x in zip(rows, brute.components(rows, 2, 90)))


def test_join_through_a_text_without_id(sp):
    """A near copy without an id links two documents that do not link themselves; its rows may repeat."""
    left, middle, right = (" ".join(f"w{i}" for i in range(k, k + 100)) for k in (0, 10, 20))
    alone = [(1, left), (2, right)]
    join = lambda rows: Counter(tuple(r) for r in ngram_join.similarity_classes(sp.createDataFrame(rows, "doc_id long, text string").repartition(3), 1, 0.75).select("doc_id", "component_id").collect())
    assert join(alone) == Counter([(1, 1), (2, 2)])
    assert join([*alone, (None, middle)]) == Counter([(1, 1), (2, 1), (None, 1)])
    assert join([*alone, *[(None, middle)] * 6]) == Counter({(1, 1): 1, (2, 1): 1, (None, 1): 6})


def test_join_empty(empty):
    assert ngram_join.similarity_classes(empty, 3, 0.9).collect() == []


@settings(deadline=None)
@given(st.integers(1, 400), st.sampled_from([50, 75, 80, 90, 99]))
def test_linked_sizes_share_a_tile(x, percent):
    edges = ngram_join.band_edges(1000, percent)
    band = np.searchsorted(edges, np.arange(1001), side="right") - 1
    largest = x * 100 // percent
    assert band[min(1000, largest)] <= band[x] + 1


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 60), st.integers(0, 2**32), st.sampled_from([60, 80, 90]))
def test_linked_sets_share_a_cell(size, seed, percent):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, size, dtype=np.uint64)
    b = a.copy()
    b[: rng.integers(0, size // 4 + 1)] = rng.integers(0, 2**63)
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b))
    if 100 * both >= percent * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
        sig, who = ngram_join.cells(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
        assert set(sig[who == 0]) & set(sig[who == 1])


# ------------------------------------------------------------------ substring dedup over words

@pytest.mark.parametrize("n", [13, 4, 1])
def test_substrings_odd_rows(odd, n):
    rows = odd_rows()
    got = substring_dedup.remove_repeats(odd, n).collect()
    assert bag(tuple(r) for r in got) == bag((d, *x) for (d, _), x in zip(rows, brute.without_windows(rows, n)))


def test_substrings_on_documents(documents):
    rows = as_rows(documents)
    got = substring_dedup.remove_repeats(documents, 13).collect()
    assert bag(tuple(r) for r in got) == bag((d, *x) for (d, _), x in zip(rows, brute.without_windows(rows, 13)))


def test_substrings_over_many_chunks(documents, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 50_000)
    rows = as_rows(documents)
    got = substring_dedup.remove_repeats(documents, 13).collect()
    assert bag(tuple(r) for r in got) == bag((d, *x) for (d, _), x in zip(rows, brute.without_windows(rows, 13)))


def test_substrings_empty(empty):
    assert substring_dedup.remove_repeats(empty).collect() == []


# ------------------------------------------------------------------ suffix dedup over bytes

def test_suffix_odd_rows(odd):
    rows = odd_rows()
    got = suffix_dedup.remove_repeats(odd, 200).collect()
    assert bag((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == bag((d, *x) for (d, _), x in zip(rows, brute.without_strings(rows, 200)))


def test_suffix_over_many_chunks(documents, monkeypatch):
    for name in ("CHUNK_BYTES", "ANCHOR_BYTES", "CONTEXT_BYTES"):
        monkeypatch.setattr(suffix_dedup, name, 40_000)
    rows = as_rows(documents)
    got = suffix_dedup.remove_repeats(documents, 200).collect()
    assert bag((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == bag((d, *x) for (d, _), x in zip(rows, brute.without_strings(rows, 200)))


def test_suffix_empty(empty):
    assert suffix_dedup.remove_repeats(empty).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=90), min_size=1, max_size=8, unique=True), st.sampled_from([4, 9, 20]))
def test_run_index_match_lengths(texts, length):
    """Lengths of at least ``length`` are told from shorter ones at every position."""
    t = b"".join(x.encode() + bytes([suffix_dedup.END]) for x in texts)
    data = np.frombuffer(t, np.uint8)
    got = suffix_dedup.RunIndex(data, length, max(map(len, texts)) + 1).match_lengths()
    for i in range(len(t) - length + 1):
        piece = t[i : i + length]
        if suffix_dedup.END in piece:
            continue
        again = t.find(piece) != i or t.find(piece, i + 1) >= 0
        assert (got[i] >= length) == again


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=150), max_size=4), st.sampled_from([32, 40]))
def test_anchors_are_the_leftmost_smallest(texts, length):
    blobs = [x.encode() for x in texts]
    data = np.frombuffer(b"".join(blobs), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
    want = set()
    for b, o in zip(blobs, offsets):
        if len(b) >= length:
            gram = suffix_dedup.gram_of(length)
            h = suffix_dedup.gram_hashes(np.frombuffer(b, np.uint8), gram) >> np.uint64(suffix_dedup.PLACE_BITS)
            want |= {int(o) + i + int(np.argmin(h[i : i + length - gram + 1])) for i in range(len(b) - length + 1)}
    assert suffix_dedup.anchors(data, offsets, length)[0].tolist() == sorted(want)


def test_context_numbers_do_not_follow_row_order():
    import pyarrow as pa

    texts = [("x" * k + " ".join(f"word{i}" for i in range(60)) + "y" * k) for k in range(6)]
    a, b = (suffix_dedup.Chunk(pa.table({"t": t}), 100) for t in (texts, texts[::-1]))
    every = np.unique(a.h)
    assert (every == np.unique(b.h)).all() and a.contexts(every, 100)[2] == b.contexts(every, 100)[2]


# ------------------------------------------------------------------ hot cells of the n-gram join

def boilerplate_rows(seed, n, shared, own, words=400):
    """Texts of a shared passage with words of their own, and near copies of some of them."""
    rng = np.random.default_rng(seed)
    passage = [f"s{i}" for i in range(shared)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.3:  # a near copy
            w = rows[int(rng.integers(len(rows)))][1].split()
            for p in rng.choice(len(w), int(rng.integers(0, 4)), replace=False):
                w[p] = f"y{rng.integers(words)}"
        else:
            w = passage + [f"x{rng.integers(words)}" for _ in range(own)]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("shingle, similarity", [(3, 0.9), (5, 0.8)])
@pytest.mark.parametrize("hot, group, near", [(4, 2000, 1), (4, 1 << 22, 8), (1000, 3000, 2)])
def test_hot_cells_and_blocks_lose_no_link(sp, monkeypatch, shingle, similarity, hot, group, near):
    monkeypatch.setattr(ngram_join, "HOT_SETS", hot)
    monkeypatch.setattr(ngram_join, "GROUP_BYTES", group)
    monkeypatch.setattr(ngram_join, "NEAREST", near)
    monkeypatch.setattr(ngram_join, "BUCKET_ENTRIES", 3000)
    monkeypatch.setattr(ngram_join, "SENT_ENTRIES", 1000)
    rows = boilerplate_rows(3, 60, 60, 20) + [(100 + i, t) for i, t in boilerplate_rows(4, 60, 20, 60)] + [(200 + i, t) for i, t in boilerplate_rows(5, 40, 75, 6)]
    got = ngram_join.similarity_classes(sp.createDataFrame(rows, "doc_id long, text string").repartition(4), shingle, similarity).collect()
    assert bag(tuple(r) for r in got) == bag((d, *x) for (d, _), x in zip(rows, brute.components(rows, shingle, round(100 * similarity))))


@pytest.mark.parametrize("seed", range(3))
def test_a_set_that_leaves_its_hot_cells_meets_its_links_elsewhere(seed):
    """Any two linked sets agree on at least ``need`` non-empty cells of their common tile."""
    rng = np.random.default_rng(seed)
    for _ in range(60):
        percent = int(rng.choice([60, 80, 90]))
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(2, 300)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[int(rng.integers(0, len(a) // 6 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, len(a) // 8 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both):
            continue
        sig, who, tile, need = ngram_join.tiled_cells(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
        for ta in (0, 1):
            for tb in (0, 1):
                common = set(sig[(who == 0) & (tile == ta)].tolist()) & set(sig[(who == 1) & (tile == tb)].tolist())
                if common:
                    assert len(common) >= max(1, min(need[ta][0], need[tb][1]))


def test_a_cell_of_very_many_near_misses_is_compared_in_seconds():
    import time

    import pyarrow as pa

    rng = np.random.default_rng(1)
    m, size = 16_000, 300
    base = rng.integers(0, 2**63, size, dtype=np.uint64)
    bits = [ngram_join.bitmap(np.concatenate([base[:150], rng.integers(0, 2**63, 150, dtype=np.uint64)])).tobytes() for _ in range(m)]
    zero = np.zeros(m, np.int64)
    f = np.arange(1, m + 1)
    table = pa.table({"cell": zero, "i": zero, "j": zero, "block": zero, "f": f, "root": f, "n": np.full(m, size), "bits": pa.array(bits, pa.binary())})
    began = time.process_time()
    assert ngram_join.nearest(table, 80, 8).num_rows == 0
    assert time.process_time() - began < 30


# ------------------------------------------------------------------ windows are told apart by both hashes

def test_a_window_is_asked_for_in_little_more_than_three_bytes():
    rng = np.random.default_rng(11)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 1000))) for _ in range(700)]
    sent = substring_dedup.send_blocks(pa.table({"chunk": pa.array([0] * 700, pa.int64()), "d": pa.array(range(700), pa.int64()), "t": texts}), 13, 20)
    windows = sum(len(packed.unpack(x)) for x in sent.column("probes").to_pylist())
    assert windows == 700 * 994
    assert sum(len(x) for c in ("probes", "index") for x in sent.column(c).to_pylist()) < 3.2 * windows
    blocks = sum(int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in sent.column("index").to_pylist())
    assert blocks == 700 * 142
    for gaps in ([0, 5, 2**24 - 1, 7], [3, 2**24, 9], [2**32, 1]):
        run = np.cumsum(np.array([2**40, *gaps], np.uint64))
        assert (packed.unpack(packed.pack(run)) == run).all()


@pytest.mark.parametrize("stretch", [1 << 18, 512])
def test_only_bytes_of_hot_windows_are_hashed(monkeypatch, stretch):
    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(97, 123, 900))) for _ in range(300)]
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    c = suffix_dedup.Chunk(pa.table({"t": texts}), 200)
    hot = np.unique(c.h[[5, 6, 400, 900]])
    plain, hashed = suffix_dedup.window_hashes, []
    whole = [plain(c.data, 200)[k] for k in (0, 1)]
    monkeypatch.setattr(suffix_dedup, "window_hashes", lambda data, length: hashed.append(len(data)) or plain(data, length))
    starts, h, g = c.hot_windows(hot, 200)
    width = 200 - suffix_dedup.gram_of(200)
    want = {s for p, d in zip(c.pos[np.isin(c.h, hot)], c.doc[np.isin(c.h, hot)])
            for s in range(max(c.offsets[d], p - width), min(p, c.offsets[d + 1] - 200) + 1)}
    assert set(starts.tolist()) == want and len(starts) == len(want)
    assert (h == whole[0][starts]).all() and (g == whole[1][starts]).all() and (np.lexsort((g, h)) == np.arange(len(h))).all()
    assert sum(hashed) < len(c.data) / 20
    assert all(not len(x) for x in c.hot_windows(np.zeros(0, np.uint64), 200))


def test_windows_whose_first_hashes_collide(monkeypatch):
    """With first hashes of five bits, the second ones alone keep different windows apart."""
    import pyarrow as pa

    real = text.ngram_hashes
    monkeypatch.setattr(substring_dedup, "ngram_hashes", lambda words, n: (real(words, n) & text.U64(31)) << text.U64(59) if n == 5 else real(words, n))
    rng = np.random.default_rng(2)
    passage = [f"p{k}" for k in range(12)]
    rows = [(i, " ".join([f"w{x}" for x in rng.integers(0, 30, 20)] + (passage if i % 3 == 0 else []) + [f"w{x}" for x in rng.integers(0, 30, 10)])) for i in range(40)]
    n, buckets = 5, 3
    tables = [pa.table({"d": pa.array([r[0] for r in rows[k::4]], pa.int64()), "t": pa.array([r[1] for r in rows[k::4]]), "chunk": pa.array([k] * len(rows[k::4]), pa.int64())}) for k in range(4)]

    def exchanged(sent, meet):
        sent = pa.concat_tables(sent)
        return pa.concat_tables([meet(sent.filter(pa.compute.equal(sent.column("bucket"), b))) for b in sorted(set(sent.column("bucket").to_pylist()))])

    of = lambda answers, k: answers.filter(pa.compute.equal(answers.column("chunk"), k))
    met = exchanged([substring_dedup.send_blocks(t, n, buckets) for t in tables], substring_dedup.meet_blocks)
    gone = exchanged([substring_dedup.send_windows(t, of(met, k), n, buckets) for k, t in enumerate(tables)], substring_dedup.meet_windows)
    got = {}
    for k, t in enumerate(tables):
        out = substring_dedup.remove_words(t, of(gone, k), n).to_pydict()
        got |= {d: (a, b, x.decode()) for d, a, b, x in zip(out["doc_id"], out["n_words"], out["n_removed"], out["kept"])}
    want = brute.without_windows(rows, n)
    assert [got[d] for d, _ in rows] == want and any(x[1] for x in want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab\x00é", min_size=1, max_size=20), min_size=1, max_size=30))
def test_two_word_hashes_are_independent(words):
    """Words that one of the hashes takes for equal are told apart by the other."""
    import pyarrow as pa

    w = text.Words(*text.byte_column(pa.array([" ".join(words)])), fold=False)
    pairs = {(a, b) for a, b in zip(w.hashes().tolist(), w.hashes(second=True).tolist())}
    assert len(pairs) == len(set(words))


# ------------------------------------------------------------------ hot anchors of the byte index

@pytest.mark.parametrize("hot", [1, 3, 30])
def test_hot_anchors_lose_no_repeat(sp, odd, monkeypatch, hot):
    """Windows of anchors that occur often travel one by one, with the same result."""
    monkeypatch.setattr(suffix_dedup, "HOT_ANCHOR", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 6000)
    monkeypatch.setattr(suffix_dedup, "CONTEXT_BYTES", 20_000)
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdé "), 6))
    shared, passage = "".join(word() for _ in range(14)), "".join(word() for _ in range(60))
    rows = [(i, "".join(word() for _ in range(int(rng.integers(0, 30)))) + (passage if i % 7 == 0 else shared) + "".join(word() for _ in range(int(rng.integers(0, 30))))) for i in range(120)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (None, rows[5][1]), (None, None), (202, "x" * 900), (203, shared * 9)]
    got = suffix_dedup.remove_repeats(sp.createDataFrame(rows, "doc_id long, text string").repartition(4), 100).collect()
    want = brute.without_strings(rows, 100)
    assert bag((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == bag((d, *x) for (d, _), x in zip(rows, want))
    got = suffix_dedup.remove_repeats(odd, 200).collect()
    assert bag((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == bag(
        (d, *x) for (d, _), x in zip(odd_rows(), brute.without_strings(odd_rows(), 200)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=40), min_size=1, max_size=4))
def test_the_transform_is_kept_as_runs(texts):
    t = b"".join(x.encode() + bytes([suffix_dedup.END]) for x in texts)
    index = suffix_dedup.RunIndex(np.frombuffer(t, np.uint8), 64, max(map(len, texts)) + 1)
    order = sorted(range(len(t)), key=lambda k: t[k:])
    plain = bytes(t[k - 1] for k in order)
    assert index.transform().tobytes() == plain and (np.diff(index.heads) > 0).all() and len(index.letters) == index.runs <= len(t)
