"""Token files, toxicity, URL filter, decontamination, LM scoring, SentencePiece, the pipeline."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimlens.llm import decontaminate, lm_score, packed, piece_codec, tables, token_pack, toxicity, url_filter
from claimlens.llm.queries import ORACLE_SQL, QUERIES, URL_RULES, vocabulary_file

from . import brute
from .conftest import SMALL, odd_rows

PIECES, WORDS = vocabulary_file("piece_bpe_32k.model"), vocabulary_file("word_bpe_49k.json")


def bag(rows):
    return Counter(map(repr, rows))


# ------------------------------------------------------------------ token files

@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 300), st.integers(0, 2**32))
def test_bits_round_trip(bits, n, seed):
    x = np.random.default_rng(seed).integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32)
    blob = token_pack.pack_bits(x, bits)
    assert (token_pack.unpack_bits(blob, n, bits) == x).all() and len(blob) == -(-n // 64) * 8 * bits
    assert token_pack.bits_for(2**bits) == bits and token_pack.bits_for(2**bits + 1) == bits + 1


def test_ids_too_wide_are_refused():
    with pytest.raises(ValueError):
        token_pack.pack_bits(np.array([8], np.uint32), 3)


def test_random_access(tmp_path):
    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 40, 100)
    tokens = rng.integers(0, 1000, lengths.sum()).astype(np.uint32)
    path = tmp_path / "x.bin"
    with pa.OSFile(str(path), "wb") as out:
        w = token_pack.Writer(out, 10, block=64)
        cut = int(lengths[:37].sum())
        w.add(np.arange(37), lengths[:37], tokens[:cut])
        w.add(np.arange(37, 100), lengths[37:], tokens[cut:])
        assert w.close() == (100, len(tokens))
    with pa.OSFile(str(path)) as source:
        r = token_pack.Reader(source)
        assert r.ids.tolist() == list(range(100)) and np.diff(r.starts).tolist() == lengths.tolist()
        for a, b in [(0, len(tokens)), (63, 65), (5, 5), (128, 200), (len(tokens) - 1, len(tokens))]:
            assert (r.tokens(a, b) == tokens[a:b]).all()


ODD_TEXTS = ["It's we'll I'D x's 'sfoo 12a3b!?", "a\x1cb c", "<|endoftext|> foo<|startoftext|>bar <|x|>", "é é e ́ ﬁ Ⅷ ½ ß İ ΑΣ ς", "a b c​d\u0085e",
             "日本語 テキスト", "\x00\x01 \x7f", "a" * 300, "Ǆ'S 'ſ ’s", " x  y　z ", "", "  "]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="aB'sSdD1 \n\x1c.-éÉßŒžŽİıſ×ªŉ<|>", max_size=20), st.sampled_from(ODD_TEXTS)), max_size=5))
def test_word_encoding_is_the_librarys(texts):
    encoder = token_pack.word_ids(WORDS)
    n, ids = encoder.encode(texts)
    want = [e.ids for e in encoder.lib.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


def test_token_files_of_odd_rows(odd):
    passage = odd_rows()[6][1]
    order = {r[0]: r[1] for r in odd.sparkSession.createDataFrame([(passage,), ("",)], "t string").selectExpr("t", "xxhash64(t)").collect()}
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, order.get(r[1] or "", 0) if r[0] is None else 0))
    lib = token_pack.word_ids(WORDS).lib
    manifest = token_pack.write_tokens(odd, WORDS, token_pack.new_folder(odd), end_id=1)
    got = sorted((tuple(r) for r in token_pack.read_digests(manifest).collect()), key=lambda r: r[1])
    start, want = 0, []
    for d, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_token_files_of_several_parts(documents, monkeypatch):
    monkeypatch.setattr(token_pack, "FILE_BYTES", 60_000)
    manifest = token_pack.write_tokens(documents, WORDS, token_pack.new_folder(documents), end_id=1)
    files = manifest.orderBy("part").collect()
    assert len(files) > 3 and [r["start"] for r in files] == np.cumsum([0, *[r["tokens"] for r in files]])[:-1].tolist()
    got = token_pack.read_digests(manifest).orderBy("doc_id").collect()
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    lib = token_pack.word_ids(WORDS).lib
    for d, t in documents.select("doc_id", "text").limit(20).collect():
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (len(ids), zlib.crc32(ids.tobytes())) in {(r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] == d}


def test_all_documents_are_the_librarys(documents):
    lib = token_pack.word_ids(WORDS).lib
    rows = documents.select("doc_id", "text").collect()
    want = {r["doc_id"]: np.array([*e.ids, 1], "<u4") for r, e in zip(rows, lib.encode_batch([r["text"] for r in rows], add_special_tokens=False))}
    got = token_pack.read_digests(token_pack.write_tokens(documents, WORDS, token_pack.new_folder(documents), end_id=1)).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in got} == {d: (len(x), zlib.crc32(x.tobytes())) for d, x in want.items()}


def test_another_tokenizer_is_encoded_by_the_library_alone():
    path = vocabulary_file("byte_bpe_50k.json")
    encoder = token_pack.WordIds(path)
    texts = [*ODD_TEXTS, "Two  spaces\n\nand lines", "plain words"]
    n, ids = encoder.encode(texts)
    want = [e.ids for e in encoder.lib.encode_batch(texts, add_special_tokens=False)]
    assert not encoder.fast and ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


def test_rows_of_one_id_are_dealt_over_several_files(sp, monkeypatch):
    monkeypatch.setattr(token_pack, "FILE_BYTES", 4000)
    rows = [(7, f"text number {i} " * 20) for i in range(100)] + [(None, f"other {i} " * 20) for i in range(60)]
    manifest = token_pack.write_tokens(sp.createDataFrame(rows, "doc_id long, text string"), WORDS, token_pack.new_folder(sp.range(1)), end_id=1)
    assert manifest.count() > 5
    got = token_pack.read_digests(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 60 + [7] * 100


def test_token_files_of_nothing(empty):
    assert token_pack.read_digests(token_pack.write_tokens(empty, WORDS, token_pack.new_folder(empty), end_id=1)).collect() == []


# ------------------------------------------------------------------ toxicity

def test_toxicity_on_held_out_rows(sp):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op3_toxicity"](sp, d).join(sp.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert not any(r["predicted"] for r in got if not r["toxic"]) and all(0 <= r["score"] <= 1 for r in got)
    bad, fine = ([r["score"] for r in got if r["toxic"] == k] for k in (1, 0))  # 51 toxic rows in all at this size
    assert sum(x > y for x in bad for y in fine) > 0.75 * len(bad) * len(fine)


def test_fit_stays_bounded_where_documents_repeat_labelled_ids(sp):
    """A labelled id on very many rows: the fit sees max_rows of them at most, and works."""
    rows = [(i % 3, f"{'insult fool' if i % 3 == 1 else 'kind words'} w{i % 40}") for i in range(3000)]
    labels = sp.createDataFrame([(0, 0), (1, 1), (2, 0)], "doc_id long, toxic int")
    docs = sp.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = toxicity.train(docs, labels, max_rows=60)
    assert model.score("insult fool w1") > model.score("kind words w1")


def test_naming_a_group_moves_no_score():
    """Identity words that go with the label in the sample still weigh alike."""
    rng = random.Random(3)
    names = [w for g in toxicity.IDENTITY_GROUPS for w in g]
    vocabulary = {w: i for i, w in enumerate([*names, "insult", *[f"f{k}" for k in range(50)]])}
    rows, labels = [], []
    for _ in range(600):
        bad = rng.random() < 0.4
        words = {f"f{rng.randrange(50)}" for _ in range(6)} | ({"insult"} if bad and rng.random() < 0.8 else set())
        words |= {"muslim"} if bad and rng.random() < 0.5 else {"christian"} if rng.random() < 0.3 else set()
        rows.append(np.array(sorted(vocabulary[w] for w in words)))
        labels.append(int(bad))
    swap = toxicity.swaps(vocabulary)
    with_it, without = toxicity.fit(rows, np.array(labels), len(vocabulary), swap), toxicity.fit(rows, np.array(labels), len(vocabulary), {})
    gap = lambda w: w[vocabulary["muslim"]] - w[vocabulary["christian"]]
    assert gap(without) > 1 and abs(gap(with_it)) < 0.35 * gap(without)
    assert with_it[vocabulary["insult"]] > 1


def test_naming_a_group_in_texts_moves_no_score(sp):
    """Plurals, possessives and prefixes of identity terms, through training on texts."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        bad = rng.random() < 0.4
        words = [f"w{chr(97 + rng.randrange(26))}x" for _ in range(6)] + (["insult"] if bad and rng.random() < 0.8 else [])
        group = "muslim" if bad and rng.random() < 0.6 else "christian" if rng.random() < 0.3 else None
        rows.append((i, " ".join(words + ([group + rng.choice(["", "s", "'s"])] if group else [])), int(bad)))
    df = sp.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"))
    z = lambda t: math.log(model.score(t) / (1 - model.score(t)))
    rate = lambda g: sum(y for _, t, y in rows if g in t) / sum(g in t for _, t, _ in rows)
    assert rate("muslim") > 0.95 and rate("christian") < 0.45
    gaps = [z(f"the {a} live here") - z(f"the {b} live here") for a, b in (("muslim", "christian"), ("Muslims", "Christians"), ("muslim's", "christian's"))]
    assert max(map(abs, gaps)) < 1 and max(gaps) - min(gaps) < 1e-9
    assert not {"^musl", "^musli", "^chri", "^chris", "muslims", "christians"} & set(model.vocabulary)
    assert z("an insult here") - z("a word here") > 1


def test_toxicity_odd_rows(odd, empty):
    labels = odd.select("doc_id", F.when(F.col("doc_id") == 5, 2).when(F.col("doc_id") == 6, F.lit(None)).otherwise(F.col("doc_id") % 2).alias("toxic")).distinct()
    model = toxicity.train(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3, 10)}) == 1
    nothing = toxicity.train(empty, labels.limit(0))
    assert toxicity.score(empty, nothing).collect() == [] and all(r["score"] < 0.1 for r in toxicity.score(odd, nothing).collect())
    kept = toxicity.keep_below(odd, model, 2.0)
    assert kept.schema == odd.schema and kept.count() == len(odd_rows())


def test_bounded_sample_of_labels(sp):
    rows = [(i, ("bad idiot " if i % 4 == 0 else "fine ") + f"w{i % 50}", int(i % 4 == 0)) for i in range(800)]
    df = sp.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"), max_rows=200)
    assert model.score("an idiot") > 0.5 > model.score("a fine day")


def test_small_share_of_many_labels(sp):
    """A sample far below a thousandth of the labels is still full: exact threshold, not a quantile with an error."""
    total, most = 400_000, 100
    hashes = sp.range(total).select(F.xxhash64(F.col("id").cast("string")).alias("r"))
    cut = tables.smallest_hashes(hashes, "r", total, most)
    assert most <= hashes.where(F.col("r") <= cut).count() < 3 * most
    equal = sp.range(total).select(F.xxhash64((F.col("id") % 3).cast("string")).alias("r"))
    assert equal.where(F.col("r") <= tables.smallest_hashes(equal, "r", total, most)).count() >= most
    chosen = {r["id"] for r in sp.range(total).orderBy(F.xxhash64(F.col("id").cast("string"))).limit(most).collect()}
    docs = sp.createDataFrame([(i, "filthy insult" if i % 2 else "kind remark") for i in sorted(chosen)], "doc_id long, text string")
    model = toxicity.train(docs, sp.range(total).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic")), max_rows=most)
    assert model.score("filthy insult") > 0.8 and model.score("kind remark") < 0.2


def test_small_share_of_many_urls(sp):
    """The trees see a full sample of the URLs that rules decide, also where it is a small share."""
    rules = [("block", "bad.com", "/"), ("allow", "good.com", "/")]
    ruled = sp.range(300_000).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("http://bad.com/win/prize-"), F.col("id"), F.lit("-x-y-z?a=1&b=2&c=3")))
                                     .otherwise(F.concat(F.lit("http://good.com/"), F.col("id"))).alias("url"))
    open_urls = sp.createDataFrame([("http://else.com/win/prize-77-x-y-z?a=1&b=2&c=3",), ("http://else.com/78",)], "url string")
    got = {r["url"]: r["verdict"] for r in url_filter.judge(ruled.unionByName(open_urls), rules, max_rows=200).where("score is not null").collect()}
    assert got == {"http://else.com/win/prize-77-x-y-z?a=1&b=2&c=3": "block", "http://else.com/78": "allow"}


# ------------------------------------------------------------------ URL filter

def judged(url):
    """(host, path, rule, rule's verdict)"""
    rest = "" if url is None or "://" not in url else url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for what, h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, what)
    return host, path, *(best or (None, None))


URLS = [None, "", "x", "http://", "HTTP://WWW.Example.COM/en/1?q=1#f", "http://example.com/en/", "http://example.com/fr", "http://com/", "http://com", "http://a.net/es/1", "http://net/fr/",
        "http://notnet/fr/", "a://b://c/d", "http://É.NET/es/x", "http://x.net?y=/es/", "http://x.net#/es/", "http://a.org/" + "p/" * 3000 + "?" + "a=1&" * 500, "http://a.org/1", "http://a.org/1"]


def test_urls(sp):
    pages = sp.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url")
    odd = sp.createDataFrame([(1000 + i, u, "own", "own", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, _u string, score int")
    for df in (pages, odd):
        got = url_filter.judge(df, URL_RULES).collect()
        want = {r["page_id"]: judged(r["url"]) for r in df.collect()}
        assert len(got) == len(want)
        for r in got:
            host, path, rule, verdict = want[r["page_id"]]
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block")
            assert verdict is None or r["verdict"] == verdict


def test_trees_learn_lexical_signs(sp):
    rng = random.Random(1)
    words = ["river", "stone", "cloud", "maple", "ember"]
    rows = []
    for i in range(600):
        bad = i % 2 == 0
        host = rng.choice(words) + ("-" + str(rng.randrange(10**6, 10**7)) if bad else "") + ".org"
        rows.append((i, f"http://{host}/{'q/' * (6 if bad else 1)}{rng.choice(words)}", bad))
    rules = [("block", r[1].split("/")[2], "/") for r in rows[:60] if r[2]] + [("allow", f"{w}.org", f"/q/{v}") for w in words for v in words[:3]]
    got = {r["i"]: r for r in url_filter.judge(sp.createDataFrame([r[:2] for r in rows], "i long, url string"), rules).collect()}
    rest = [r for r in rows if got[r[0]]["rule"] is None]
    assert len(rest) > 200 and sum((got[r[0]]["verdict"] == "block") == r[2] for r in rest) >= 0.97 * len(rest)


def test_urls_of_nothing(sp):
    assert url_filter.judge(sp.createDataFrame([], "page_id long, url string"), URL_RULES).collect() == []
    none = url_filter.judge(sp.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), URL_RULES).collect()
    assert [r["verdict"] for r in none] == ["allow"]


# ------------------------------------------------------------------ decontamination

def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=80), st.binary(max_size=120), st.booleans())
def test_myers_distance(a, b, near):
    if near:
        b = b[:20] + a[: len(a) // 2] + b"?" + a[len(a) // 2 :] + b[20:]
    assert decontaminate.myers(a, b)[0] == plain_distance(a, b)


def test_every_match_within_the_budget_is_found():
    rng = random.Random(4)
    syllables = ["the", "on", "er", "tion", "ing", "and", "re", "sh"]
    make = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))
    items = sorted({make(rng.randint(3, 40)).encode() for _ in range(40)} | {b"tiny", b"a short one"})
    index = decontaminate.Items(items)
    texts = []
    for _ in range(60):
        t = bytearray(rng.choice(items))
        for _ in range(rng.randint(0, 6)):
            p = rng.randrange(len(t) + 1)
            kind = rng.randrange(3)
            t[p : p + (kind > 0)] = b"" if kind == 1 else rng.choice(b"abcxyz ").to_bytes(1, "big")
        texts.append(make(15).encode() + b" " + bytes(t) + b" " + make(15).encode())
    got = {(r, i): d for r, x in index.matches(texts).items() for i, (d, _) in x.items()}
    want = {}
    for r, t in enumerate(texts):
        for i, x in enumerate(items):
            d = plain_distance(x, t)
            if d <= index.budget[i]:
                want[r, i] = d
    assert got == want and any(want.values())


def test_leaks_of_odd_rows(sp, odd, empty):
    items = sp.createDataFrame([(1, " ".join(f"passage{i}" for i in range(60)), 0), (2, None, 0), (3, "", 0), (4, " \n", 0), (5, "ONE\n two", 0), (5, "one two", 0), (6, "nowhere to be found at all", 0)],
                               "item_id long, text string, doc_id int")
    got = decontaminate.find_leaks(odd, items).collect()
    assert Counter((r["doc_id"], r["item_id"], r["distance"]) for r in got) == Counter({(7, 1, 0): 1, (8, 1, 0): 1, (9, 1, 0): 2, (None, 1, 0): 1, (17, 1, 0): 1, (6, 5, 0): 2})
    clean = decontaminate.keep_clean(odd, items)
    assert clean.schema == odd.schema and bag((r["doc_id"], r["text"]) for r in clean.collect()) == bag(r for r in odd_rows() if r[0] not in (6, 7, 8, 9, 17) and r != (None, odd_rows()[6][1]))
    assert decontaminate.find_leaks(empty, items).collect() == [] and decontaminate.find_leaks(odd, items.limit(0)).collect() == []


def test_leaks_in_documents(sp, documents):
    items = sp.read.parquet(f"{SMALL}/benchmark.parquet")
    norm = {r["item_id"]: decontaminate.normalise(r["text"]) for r in items.collect()}
    exact = {(r["doc_id"], i) for r in documents.collect() for i, t in norm.items() if t in decontaminate.normalise(r["text"])}
    got = decontaminate.find_leaks(documents, items).collect()
    assert exact and {(r["doc_id"], r["item_id"]) for r in got if r["distance"] == 0} == exact


def test_items_in_several_blocks(sp, documents, monkeypatch):
    items = sp.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = bag(tuple(r) for r in decontaminate.find_leaks(documents, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert bag(tuple(r) for r in decontaminate.find_leaks(documents, items).collect()) == whole


@pytest.mark.parametrize("kind", ["smallint", "string", "double", "struct<a:int>"])
def test_item_ids_of_any_type_and_equal_items(sp, kind):
    passage = " ".join(f"word{i}" for i in range(30))
    docs = sp.createDataFrame([("x", "before " + passage + " after"), (None, passage), ("z", "nothing")], "doc_id string, text string")
    items = sp.createDataFrame([(1, passage), (2, passage), (3, passage.upper()), (4, None), (5, "")], "n int, text string").select(
        (F.struct(F.col("n").alias("a")) if kind.startswith("struct") else F.col("n").cast(kind)).alias("item_id"), "text")
    got = decontaminate.find_leaks(docs, items)
    assert got.schema["item_id"].dataType.simpleString() == items.schema["item_id"].dataType.simpleString()
    assert Counter((r["doc_id"], r["distance"]) for r in got.collect()) == Counter({("x", 0): 3, (None, 0): 3})


# ------------------------------------------------------------------ LM scoring

def test_language_model_counts_and_base(sp, documents):
    got = QUERIES["op7_lm_score"](sp, SMALL).collect()
    rows = [(r["doc_id"], brute.words(r["text"], True) + [None]) for r in documents.collect()]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    c = Counter(w for d, ws in rows if not held[d] for w in ws)
    n, v, words = sum(c.values()), len(c), dict(rows)
    for r in got:
        ws = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0 and math.isclose(r["bits_per_byte"], -r["score"] * math.log2(10) / max(1, len(dict(documents.select("doc_id", "text").collect())[r["doc_id"]].encode())), rel_tol=1e-9)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def scalar_scores(texts, train):
    """log10 probability of each text, told token by token and bit by bit in plain Python."""
    bits = lm_score.CLASS_BITS
    told = [lm_score.tokens(pa.array([t]))[0].tolist() for t in texts]
    cls = {h: int(lm_score.classes(np.array([h], np.uint64))[0]) for ws in told for h in ws}
    count = Counter(h for ws, x in zip(told, train) for h in ws if x)
    total, once = sum(count.values()), sum(c == 1 for c in count.values())
    mass, after = [0.0] * (1 << bits), {}
    for h, c in count.items():
        mass[cls[h]] += c + 0.5
    mass = [max(m, 0.5) for m in mass]
    start = int(lm_score.START)
    for ws, x in zip(told, train):
        for prev, h in zip([start, *ws], ws):
            if x:
                after.setdefault(prev, Counter())[cls[h]] += 1
    rare = (once + 0.5) / (total + 1)
    logit = lambda n0, n1: math.log((n1 + 0.4) / (n0 + 0.4))
    sigma = lambda z: 1 / (1 + math.exp(-z))
    out = []
    for ws in told:
        log, new, seen = 0.0, 0, []  # seen: (context, class) of known tokens so far
        w = {(k, a, b): list(lm_score.START_WEIGHTS[a][b]) for k in range(bits) for a in range(3) for b in range(3)}
        grid = [sigma(-8 + i) for i in range(lm_score.CELLS)]
        hits = {(k, i): grid[i] * lm_score.REFINE_FROM for k in range(bits) for i in range(lm_score.CELLS)}
        held = {x: lm_score.REFINE_FROM for x in hits}
        noted, batch, known_so_far = [], 0, 0
        for place, (prev, h) in enumerate(zip([start, *ws], ws)):
            p_new = (new + 20 * rare) / (place + 20)
            if not count[h]:
                log += math.log(p_new)
                new += 1
                continue
            log += math.log(1 - p_new)
            now = int(math.log2(known_so_far / lm_score.BATCH + 1))
            if now > batch:
                for g in w:
                    for j in range(lm_score.INPUTS):
                        slope = sum((bit - p) * x[j] for gg, x, p, bit, _ in noted if gg == g)
                        curve = sum(p * (1 - p) * x[j] ** 2 for gg, x, p, bit, _ in noted if gg == g)
                        w[g][j] += lm_score.STEP * slope / (curve + lm_score.INERTIA)
                for _, _, _, bit, cell in noted:
                    hits[cell] += bit
                    held[cell] += 1
                noted, batch = [], now
            for k in range(bits):
                high, bit = cls[h] >> (bits - k), cls[h] >> (bits - 1 - k) & 1
                same = lambda c: c >> (bits - k) == high
                one = lambda c: c >> (bits - 1 - k) & 1
                o0 = [sum(m for c, m in enumerate(mass) if same(c) and one(c) == v) for v in (0, 1)]
                o1 = [sum(m for c, m in after.get(prev, {}).items() if same(c) and one(c) == v) for v in (0, 1)]
                t0 = [sum(1 for _, c in seen if same(c) and one(c) == v) for v in (0, 1)]
                t1 = [sum(1 for q, c in seen if q == prev and same(c) and one(c) == v) for v in (0, 1)]
                x = [logit(*o0), logit(*o1), logit(*t0), logit(*t1), 0.3]
                g = (k, (sum(o1) > 0) + (sum(o1) >= 8), (sum(t1) > 0) + (sum(t1) >= 3))
                z = min(8, max(-8, sum(a * b for a, b in zip(w[g], x))))
                p, low = sigma(z), min(int(z + 8), lm_score.CELLS - 2)
                r = [hits[k, low + i] / held[k, low + i] for i in (0, 1)]
                final = min(1 - 1e-4, max(1e-4, (p + r[0] * (low + 1 - z - 8) + r[1] * (z + 8 - low)) / 2))
                log += math.log(final if bit else 1 - final)
                noted.append((g, x, p, bit, (k, int(np.rint(z + 8)))))
            seen.append((prev, cls[h]))
            known_so_far += 1
            log += math.log((count[h] + 0.5) / mass[cls[h]])
        out.append(log / math.log(10))
    return out


def test_scores_are_those_of_a_scalar_online_model(sp, monkeypatch):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choice(words[: rng.randrange(2, 30)]) for _ in range(rng.randrange(0, 200))) for _ in range(14)]
    texts += ["", "unseen words only", "w1 w2 unseen w1 w2 unseen " * 40, "W1 w1"]
    rows = [(i, t) for i, t in enumerate(texts)]
    train = [i % 3 != 1 and i < 14 for i in range(len(rows))]
    df = sp.createDataFrame(rows, "doc_id long, text string").repartition(3)
    training = (F.col("doc_id") % 3 != 1) & (F.col("doc_id") < 14)
    want = dict(enumerate(scalar_scores(texts, train)))
    got = {r["doc_id"]: r["score"] for r in lm_score.score(df, training).collect()}
    assert all(math.isclose(got[i], want[i], rel_tol=1e-4, abs_tol=1e-4) for i in want)
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 700)  # other chunks and buckets, the same scores
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 900)
    assert all(math.isclose(r["score"], got[r["doc_id"]], rel_tol=1e-6) for r in lm_score.score(df, training).collect())


def test_every_token_is_learnt_from_before_the_next(sp, monkeypatch):
    """Token by token: a scalar model that takes a step after each token, and refines with it, scores the same."""
    rng = random.Random(16)
    texts = [" ".join(f"w{min(rng.randrange(1, 12), rng.randrange(1, 30))}" for _ in range(rng.randrange(0, 120))) for _ in range(12)] + ["", "w1 new w1 new w2 " * 9]
    train = [i % 3 != 1 for i in range(len(texts))]
    df = sp.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm_score.score(df, F.col("doc_id") % 3 != 1, batch=0).collect()}
    steps = {r["doc_id"]: r["score"] for r in lm_score.score(df, F.col("doc_id") % 3 != 1).collect()}

    class EveryToken:  # the scalar model's schedule, int(log2(known / BATCH + 1)), comes to known
        def __rtruediv__(self, known):
            return 2.0 ** known - 1

    monkeypatch.setattr(lm_score, "BATCH", EveryToken())
    want = dict(enumerate(scalar_scores(texts, train)))
    assert all(math.isclose(got[i], want[i], rel_tol=1e-4, abs_tol=1e-4) for i in want)
    assert any(not math.isclose(got[i], steps[i], rel_tol=1e-4) for i in want)
    monkeypatch.setattr(lm_score, "SCORE_ROWS", 2)
    again = {r["doc_id"]: r["score"] for r in lm_score.score(df, F.col("doc_id") % 3 != 1, batch=0).collect()}
    assert all(math.isclose(again[i], got[i], rel_tol=1e-6) for i in want)


def test_the_query_learns_token_by_token(sp, tmp_path):
    df = sp.createDataFrame([(i, " ".join(f"w{(i * 7 + k * k) % 9}" for k in range(90))) for i in range(12)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    training = F.expr("crc32(cast(doc_id as string)) % 5 <> 1")
    want = {r["doc_id"]: r["score"] for r in lm_score.score(df, training, batch=0).collect()}
    assert {r["doc_id"]: r["score"] for r in QUERIES["op7_lm_score"](sp, str(tmp_path)).collect()} == pytest.approx(want, rel=1e-9)


def test_model_is_a_distribution():
    """Over all classes the predictions sum to one, whatever came before."""
    rng = np.random.default_rng(0)
    past = rng.integers(0, 12, 200)
    after = lm_score.Followers(rng.integers(0, 5, (3, lm_score.NODES)).astype(np.int32))
    overall = lm_score.Followers(rng.random((1, lm_score.NODES)) * 50)
    total = 0.0
    for c in range(lm_score.NODES):
        cls = np.append(past, c)
        prev = np.concatenate([[99], past])
        total += math.exp(lm_score.bit_logs(cls, np.zeros(201, np.int64), prev, prev % 3, after, overall)[-1])
    assert math.isclose(total, 1, rel_tol=1e-5)


def test_scoring_holds_few_bytes_a_token():
    """Counts within a text are worked out for some texts at a time; what is kept a token is narrow."""
    rng = np.random.default_rng(1)
    n = 400_000
    cls, prev, text = rng.integers(0, lm_score.NODES, n), rng.integers(0, 500, n), np.repeat(np.arange(100), n // 100)
    after = lm_score.Followers(rng.integers(0, 5, (500, lm_score.NODES)).astype(np.int32))
    overall = lm_score.Followers(rng.random((1, lm_score.NODES)) * 50)
    tracemalloc.start()
    try:
        lm_score.bit_logs(cls, text, prev, prev, after, overall, 0)
        assert tracemalloc.get_traced_memory()[1] < 90 * n
    finally:
        tracemalloc.stop()


def test_pieces_of_a_chunk_change_no_score(sp, monkeypatch):
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice(["a", "b", "of", "é", "Word"]) for _ in range(rng.choice([0, 1, 7, 60])))) for k in range(40)] + [(41, None)]
    df = sp.createDataFrame(rows, "doc_id long, text string")
    got = bag(lm_score.score(df, F.col("doc_id") % 5 != 1, batch=0).collect())
    for name in ("TOKEN_ROWS", "COUNTED", "FOLLOWED"):
        monkeypatch.setattr(lm_score, name, 3)
    assert bag(lm_score.score(df, F.col("doc_id") % 5 != 1, batch=0).collect()) == got


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, lm_score.NODES - 1)), max_size=60))
def test_online_counts(entries):
    context, cls = np.array([c for c, _ in entries], np.int64), np.array([x for _, x in entries], np.int64)
    for k, (n0, n1) in enumerate(lm_score.online_counts(context, cls)):
        for i, (c, x) in enumerate(entries):
            same = [y >> (lm_score.CLASS_BITS - 1 - k) & 1 for d, y in entries[:i] if d == c and y >> (lm_score.CLASS_BITS - k) == x >> (lm_score.CLASS_BITS - k)]
            assert (n0[i], n1[i]) == (same.count(0), same.count(1))


def test_more_text_tells_more():
    """What contexts gather grows with the corpus: the same texts cost less after more training."""
    rng = random.Random(8)
    chain = {k: [rng.randrange(60) for _ in range(2)] for k in range(60)}

    def text():
        at, out = rng.randrange(60), []
        for _ in range(40):
            at = rng.choice(chain[at])
            out.append(f"w{at}")
        return " ".join(out)

    texts, held = [text() for _ in range(200)], [text() for _ in range(4)]
    cost = [sum(scalar_scores([*texts[:n], *held], [True] * n + [False] * 4)[n:]) for n in (20, 200)]
    assert cost[1] > cost[0] * 0.8


def test_language_model_odd_rows(odd, empty):
    got = lm_score.score(odd, F.col("doc_id") % 2 == 0).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((d, len(brute.words(t)) + 1) for d, t in odd_rows())
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert lm_score.score(empty, F.lit(True)).collect() == []
    none = lm_score.score(odd, F.lit(None).cast("boolean")).collect()
    assert len(none) == len(odd_rows()) and all(r["n_known"] == 0 and r["base_score"] == 0 for r in none)


def test_repeated_text_is_told_better(sp):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(80))) for i in range(300)]
    line = " ".join(f"v{k}" for k in range(20))
    rows += [(1000, " ".join([line] * 8)), (1001, " ".join(f"v{rng.randrange(20)}" for _ in range(160))), *[(2000 + i, line) for i in range(40)]]
    got = {r["doc_id"]: r for r in lm_score.score(sp.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") != 1000).collect()}
    assert got[1000]["score"] > got[1001]["score"] and got[1000]["score"] > 0.6 * got[1000]["base_score"]


# ------------------------------------------------------------------ SentencePiece

PIECE_TEXTS = ["", " ", "  a  b ", "a▁b ▁ c", "\n\t x", "<s> </s> <unk>", "𐍈 émoji 😀😀", "a\x00b", " ▁", "▁", "ﬁ  ", "x" * 500, " " * 50 + "k"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="a b▁\né", max_size=20), st.sampled_from(PIECE_TEXTS)), max_size=4))
def test_pieces_are_the_librarys(texts):
    c = piece_codec.Chunks(PIECES) if not hasattr(test_pieces_are_the_librarys, "c") else test_pieces_are_the_librarys.c
    test_pieces_are_the_librarys.c = c
    for t, (slots, align) in zip(texts, c.slots(texts)):
        ids = c.tokens(slots).tolist()
        assert ids == c.lib.encode(t) and " ".join(c.decoded[s] for s in slots.tolist()) == c.lib.decode(ids)
        if ids:
            edges = c.spans(np.array(ids), align)
            assert edges[0] == 0 and edges[-1] == len(t.encode()) and (np.diff(edges) >= 0).all()


def test_spans_are_the_librarys():
    c = piece_codec.Chunks(PIECES)
    for t in ["Plain words here", "  two  spaces ", "a▁b c", "line\nbreak"]:
        slots, align = c.slots([t])[0]
        edges = c.spans(c.tokens(slots), align).tolist()
        want = [(p.begin, p.end) for p in c.lib.encode(t, return_type="proto").pieces if not p.piece.startswith("<0x")]
        got = [(a, b) for a, b, i in zip(edges, edges[1:], c.tokens(slots).tolist()) if not c.lib.id_to_piece(i).startswith("<0x")]
        assert got == want


def double_array(entries):
    """A compiled map for a few entries: (source, replacement)."""
    keys = sorted(k.encode() for k, _ in entries)
    texts, value = b"", {}
    for k, v in sorted((k.encode(), v.encode()) for k, v in entries):
        value[k] = len(texts)
        texts += v + b"\0"
    units = {0: 0}
    used = {0}

    def place(prefix, node):
        kids = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in value
        offset = 1
        while any((node ^ offset) ^ x in used for x in [*kids, *([0] if leaf else [])]):
            offset += 1
        base = node ^ offset
        used.update(base ^ x for x in [*kids, *([0] if leaf else [])])
        units[node] = units.get(node, 0) | offset << 10 | (1 << 8 if leaf else 0)
        if leaf:
            units[base] = 1 << 31 | value[prefix]
        for x in kids:
            units[base ^ x] = x
            place(prefix + bytes([x]), base ^ x)

    place(b"", 0)
    table = np.zeros(max(units) + 256, "<u4")
    for k, u in units.items():
        table[k] = u
    return len(table.tobytes()).to_bytes(4, "little") + table.tobytes() + texts


class Spec:
    def __init__(self, entries, dummy=True, squeeze=False):
        self.precompiled_charsmap = double_array(entries) if entries else b""
        self.add_dummy_prefix, self.remove_extra_whitespaces, self.escape_whitespaces = dummy, squeeze, True


def test_normalisation_keeps_source_offsets():
    n = piece_codec.Normaliser(Spec([("ﬁ", "fi"), ("Ａ", "A"), ("ab", "c"), ("abc", "dd"), ("\t", " "), ("x", "")]))
    text, align = n("ﬁAab\tabcx!")
    assert text == "▁fiAc▁dd!"
    assert align.tolist() == [0, 0, 0, 0, 0, 3, 4, 6, 6, 6, 7, 7, 11, 12]
    assert n("")[0] == "" and n("")[1].tolist() == [0]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab\tcﬁéＡx ▁日", max_size=30))
def test_normalisation_equals_a_walk_over_all_places(text):
    """Only places where an entry may begin are walked; a walk over every place gives the same."""
    entries = [("ﬁ", "fi"), ("Ａ", "A"), ("ab", "c"), ("abc", "dd"), ("\t", " "), ("x", ""), ("é", "e")]
    out, align, data, at = b"", [], text.encode(), 0
    if data:
        out, align = "▁".encode(), [0, 0, 0]
    while at < len(data):
        hits = [(k.encode(), v.encode()) for k, v in entries if data[at:].startswith(k.encode())]
        n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3
        n, rep = max((len(k), v) for k, v in hits) if hits else (n, data[at : at + n])
        new = rep.replace(b" ", "▁".encode())
        out, align, at = out + new, align + [at] * len(new), at + n
    got = piece_codec.Normaliser(Spec(entries))(text)
    assert got[0] == out.decode() and got[1].tolist() == [*align, at]


def test_normalisation_squeezes_spaces():
    n = piece_codec.Normaliser(Spec([("\t", " ")], squeeze=True))
    text, align = n("  a \t b  ")
    assert text == "▁a▁b" and align.tolist() == [2, 2, 2, 2, 3, 3, 3, 6, 7]
    assert n("  ")[0] == ""


def test_pieces_of_odd_rows(odd, empty):
    lib = piece_codec.Chunks(PIECES).lib
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = bag((d, len(lib.encode(t or "")), sha(",".join(map(str, lib.encode(t or "")))), sha(lib.decode(lib.encode(t or ""))), len((t or "").encode())) for d, t in odd_rows())
    got = piece_codec.digests(odd, PIECES).collect()
    assert bag((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["covered_bytes"]) for r in got) == want
    full = piece_codec.encode(odd, PIECES).collect()
    assert bag((r["doc_id"], r["spans_sha256"]) for r in got) == bag((r["doc_id"], hashlib.sha256(np.array(r["offsets"], "<i4").tobytes()).hexdigest()) for r in full)
    assert bag((r["doc_id"], len(r["ids"]), sha(",".join(map(str, r["ids"]))), sha(r["decoded"]), r["offsets"][-1]) for r in full) == want
    assert piece_codec.digests(empty, PIECES).collect() == [] and piece_codec.encode(empty, PIECES).collect() == []


# ------------------------------------------------------------------ pipeline and registration

def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline_stages(sp, tmp_path):
    """Every stage against a plain form of what it keeps."""
    import shutil

    import corpus_pipeline as p

    base = sp.read.parquet(f"{SMALL}/documents.parquet")
    texts = dict(base.select("doc_id", "text").collect())
    more = [(1000, texts[10]), (1001, texts[10] + " zz"), (1002, None), (1003, None), (1004, "")]
    docs = base.unionByName(sp.createDataFrame([(i, t, "en", "src0", 0) for i, t in more], base.schema))
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SMALL}/{t}.parquet", f"{d}/{t}.parquet")
    docs = sp.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "sentencepiece"]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns

    kept = dict(p.STAGES)["toxicity"](sp, docs, d)
    model = toxicity.train(docs, sp.read.parquet(f"{d}/labels.parquet"))
    assert kept.columns == columns
    rows = {i: t for i, t in rows.items() if model.score(t) < p.TOXIC_AT}
    assert {r["doc_id"] for r in kept.collect()} == set(rows)
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i] or "", i)
    kept = dict(p.STAGES)["exact_dedup"](sp, kept, d)
    assert kept.columns == columns
    rows = {i: t for i, t in rows.items() if i in first.values()}
    assert {r["doc_id"] for r in kept.collect()} == set(rows)
    kept = dict(p.STAGES)["ngram_join"](sp, kept, d)
    assert kept.columns == columns
    pairs = sorted(rows.items())
    rows = {i: t for (i, t), (_, c) in zip(pairs, brute.components(pairs, 5, 80)) if i == c}
    assert {r["doc_id"] for r in kept.collect()} == set(rows)
    kept = dict(p.STAGES)["decontamination"](sp, kept, d)
    assert kept.columns == columns
    items = decontaminate.Items(sorted({decontaminate.normalise(r["text"]) for r in sp.read.parquet(f"{d}/benchmark.parquet").collect()}))
    rows = {i: t for i, t in rows.items() if not items.matches([decontaminate.normalise(t)])}
    assert {r["doc_id"] for r in kept.collect()} == set(rows)
    lib = piece_codec.Chunks(PIECES).lib
    got = {r["doc_id"]: r["n_tokens"] for r in p.run(sp, d).collect()}
    assert got == {i: len(lib.encode(t or "")) for i, t in rows.items()}


def test_stages_keep_rows_without_ids_and_with_repeated_ids(sp, tmp_path):
    """Decisions reach rows by id and text: one row of each class stays."""
    import corpus_pipeline as p

    words = lambda k: " ".join(f"{k}{i}" for i in range(40))
    a, b, c, d, e = map(words, "abcde")
    docs = sp.createDataFrame([(3, b), (5, a), (5, b), (None, c), (None, c), (7, d), (7, d), (None, d), (None, e), (8, None), (None, "")], "doc_id long, text string")
    kept = p.remove_copies(sp, docs, "")
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter([(3, b), (5, a), (None, c), (7, d), (None, e), (8, None)])
    docs = sp.createDataFrame([(3, b), (5, a), (5, b + " z"), (None, c), (None, c + " z"), (7, d), (None, d + " z"), (9, e), (9, e), (None, None), (None, " ")], "doc_id long, text string")
    got = Counter(map(tuple, p.remove_near_copies(sp, docs, "").collect()))
    one = [t for t in (c, c + " z") if (None, t) in got]
    assert len(one) == 1 and got == Counter([(3, b), (5, a), (None, one[0]), (7, d), (9, e), (None, None), (None, " ")])


def test_caches_of_the_pipeline_stay_small():
    """Toxicity and sentencepiece start their caches anew early enough for two workers beside an executor's heap; results stay."""
    import public_tokenizers

    letters = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(300_000)]
    tokens = toxicity.Tokens()
    for a in range(0, len(letters), 1000):
        assert tokens.of(" ".join(letters[a : a + 1000])) == {f for w in letters[a : a + 1000] for f in toxicity.features(w)}
        assert len(tokens) <= 200_000
    chunks = piece_codec.Chunks(public_tokenizers.path("piece_bpe_32k.model"))
    first = chunks.tokens(chunks.slots(["aaaa baaa"])[0][0]).tolist()
    for a in range(0, 160_000, 20_000):
        chunks.slots([" ".join(letters[a : a + 20_000])])
    assert chunks.tokens(chunks.slots(["aaaa baaa"])[0][0]).tolist() == first
    assert len(chunks) < 150_000


@given(st.lists(st.integers(0, 2**40)))
def test_numbers_travel_in_few_bytes(numbers):
    x = np.array(numbers, np.int64)
    blob = packed.shrink(x)
    assert packed.grow(blob).tolist() == numbers
    assert blob[0] == (packed.narrow(x).itemsize) == max([1, *(1 << max(0, (n.bit_length() - 1) // 8).bit_length() for n in numbers)])


def test_mixer_keeps_the_weights_of_a_bit_together():
    """A bit's weights are one item of the run that is read and written at each step."""
    mixer = lm_score.Mixer(3)
    assert len(mixer.w_run) == 3 * lm_score.GATES and np.shares_memory(mixer.w_run, mixer.w)
    assert np.array_equal(mixer.w[:9, : lm_score.INPUTS], lm_score.START_WEIGHTS.reshape(9, -1).astype(np.float32))
