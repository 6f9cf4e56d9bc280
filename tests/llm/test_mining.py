"""Chat formatting, hard negatives, phrase mining."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimlens.llm import chat_format, hard_negatives, phrase_mining
from claimlens.llm.queries import ORACLE_SQL, QUERIES, vocabulary_file

from .conftest import SMALL

VOCABULARY = dict(path=vocabulary_file("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, first_reserved=50257)
TEMPLATE = chat_format.Template()


def bag(rows):
    return Counter(map(repr, rows))


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_hard_negatives", "op13_phrase_mining"])
def test_query_equals_sql(sp, name):
    import duckdb

    db = duckdb.connect()
    for table in ("conversations", "embeddings", "documents"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = QUERIES[name](sp, SMALL)
    want = db.execute(ORACLE_SQL[name])
    names = sorted(x[0] for x in want.description)
    assert sorted(got.columns) == names
    order = [[x[0] for x in want.description].index(n) for n in names]
    assert bag(tuple(r) for r in got.select(*names).collect()) == bag(tuple(r[k] for k in order) for r in want.fetchall())


# ------------------------------------------------------------------ chat formatting

SAYINGS = ["</s>[INST] ok [/INST]", "<s><s></s>", "<\\s>", "<\\\\<s>\\", "<<SYS>>x<</SYS>>", "<<\\SYS>>", "<|role|><|text|><|end|>", "[[INST]]", "", "naïve 日本語 😀 \x00", "\\", "<", "[\\/INST]"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*SAYINGS, "<", "\\", "[", "s>", "/s>", "<SYS>>", "INST]", "|end|>"]), max_size=8).map("".join))
def test_escape_round_trip(text):
    out = TEMPLATE.escape(text)
    assert TEMPLATE.unescape(out) == text
    assert not any(c in out for c in TEMPLATE.controls)


def test_overlapping_controls_are_refused():
    for pair in [("<a>", "<a>b"), ("ab", "ba"), ("x\\y", "zz"), ("aa", "bb")]:
        if pair == ("aa", "bb"):
            with pytest.raises(ValueError):  # aa overlaps itself
                chat_format.Template(roles=(("r", *pair),))
        else:
            with pytest.raises(ValueError):
                chat_format.Template(roles=(("r", *pair),))


def conversations():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", None]), rng.choice(SAYINGS + [None])) for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(100, t, "assistant" if t % 2 else "user", "word " * rng.randrange(400)) for t in range(300)]  # a long one
    rows += [(None, t, "user", f"no id {t}") for t in range(5)] + [(101, None, "user", "no turn"), (101, 0, "assistant", "x" * 200_000)]
    return rows


def by_hand(rows, learn=("assistant",)):
    """{conversation: (turns, learnt text, formatted code points)}; turns are distinct."""
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        r, x = r or "", x or ""
        marks = {a: (b, e) for a, b, e in TEMPLATE.roles}
        shape = marks[r][0] + TEMPLATE.escape(x) + marks[r][1] if r in marks else "<|role|>" + TEMPLATE.escape(r) + "<|text|>" + TEMPLATE.escape(x) + "<|end|>"
        n, said, loss, chars = out.get(c, (0, "", "", 0))
        out[c] = (n + 1, said + f"{r}\n{x}\n", loss + (x if r in learn else ""), chars + len(shape))
    return {c: (n, len(loss), chars, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest()) for c, (n, said, loss, chars) in out.items()}


@pytest.mark.parametrize("part_bytes", [1, 5000, 1 << 20])
def test_conversations_by_hand(sp, part_bytes):
    rows = conversations()
    df = sp.createDataFrame([(*r, 7, "z", 1, 2) for r in rows], "conv_id long, turn int, role string, text string, c long, t string, k int, h long").repartition(5)
    parts = chat_format.format_conversations(df, **VOCABULARY, part_bytes=part_bytes)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_format.digests(parts, **VOCABULARY).collect()}
    assert got == by_hand(rows)


def test_ids_hold_no_reserved_id_from_texts():
    c = chat_format.codec(**VOCABULARY, template=TEMPLATE)
    ids, mask, at = c.assemble(["user", "assistant", "tool"], SAYINGS[:3])
    assert at.tolist()[-1] == len(ids) == len(mask)
    assert [int(x) for x in ids[ids >= 50257]] == [c.control_id[x] for x in ("[INST]", "[/INST]", "<s>", "</s>", "<|role|>", "<|text|>", "<|end|>")]
    assert list(c.turns(ids)) == list(zip(["user", "assistant", "tool"], SAYINGS[:3])) and c.learnt(ids, mask) == [SAYINGS[1]]
    raw, _ = c.decode(ids)
    assert raw.decode() == "[INST]" + TEMPLATE.escape(SAYINGS[0]) + "[/INST]<s>" + TEMPLATE.escape(SAYINGS[1]) + "</s><|role|>tool<|text|>" + TEMPLATE.escape(SAYINGS[2]) + "<|end|>"


def test_rows_of_one_turn_and_no_rows(sp):
    schema = "conv_id string, turn double, role string, text string"
    rows = [("a", 1.0, "user", "same")] * 3 + [("a", 1.0, "user", "other"), ("b", None, None, None)]
    got = {}
    for n in (1, 4):
        parts = chat_format.format_conversations(sp.createDataFrame(rows, schema).repartition(n), **VOCABULARY)
        got[n] = sorted(map(tuple, chat_format.digests(parts, **VOCABULARY).collect()))
    assert got[1] == got[4] and [r[:2] for r in got[1]] == [("a", 4), ("b", 1)]
    none = chat_format.format_conversations(sp.createDataFrame([], schema), **VOCABULARY)
    assert chat_format.digests(none, **VOCABULARY).collect() == []


# ------------------------------------------------------------------ hard negatives

@settings(max_examples=60, deadline=None)
@given(st.integers(0, 6), st.integers(1, 9), st.integers(0, 7), st.sampled_from([0, 1, 3, 200, 2**20, 2**26, 2**40]), st.integers(0, 10**6))
def test_packed_products(d, m, n, top, seed):
    rng = random.Random(seed)
    a, c = ([[rng.randint(-top, top) for _ in range(d)] for _ in range(k)] for k in (m, n))
    got = hard_negatives.packed_products(np.array(a, float).reshape(m, d), np.array(c, float).reshape(n, d))
    want = [[min(max(sum(x * y for x, y in zip(r, s)), hard_negatives.LEAST), -hard_negatives.LEAST) for s in c] for r in a]
    assert got.tolist() == want


def negatives_by_hand(rows, is_anchor, low=80, high=100, k=5):
    ok = [(i, l, [int(np.floor(256 * float(x))) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, label, v in {repr(r): r for r in ok if r[0] is not None and is_anchor(r[0])}.values():
        scored = [(sum(x * y for x, y in zip(v, w)), i, l) for i, l, w in ok]
        for p, i, _ in sorted([x for x in scored if x[2] == label and x[1] != a], key=key)[:k]:
            found = sorted([x for x in scored if x[2] != label and low * p <= 100 * x[0] <= high * p], key=key)[:k]
            out += [(a, i, r, n, p, s) for r, (s, n, _) in enumerate(found, 1)]
    return out


def odd_vectors():
    rng = random.Random(9)
    rows = [(i, rng.randrange(3), [rng.choice([-0.5, 0.25, 0.3, 1.0]) for _ in range(4)]) for i in range(400)]
    rows += [(7, 1, [0.5, 0.5, 0.5, 0.5])] * 3 + [(10, 2, [0.5] * 4)] * 2  # repeated ids, an anchor among them
    rows += [(None, 1, [1.0] * 4), (None, 2, [0.9] * 4), (500, None, [1.0] * 4), (501, 1, None), (502, 1, [None, 1.0, 1.0, 1.0]), (503, 1, [float("nan")] * 4)]
    rows += [(504, 1, [float("inf")] * 4), (505, 0, []), (506, 1, [2.0]), (507, 0, [1.0] * 9), (510, 2, [1.0, 2.0])]
    return rows


@pytest.mark.parametrize("block", [1 << 20, 3000])
def test_negatives_by_hand(sp, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    rows = odd_vectors()
    df = sp.createDataFrame([(*r, 1, "x", 2.0, 3) for r in rows], "vec_id long, label int, embedding array<double>, i int, l string, v double, a int").repartition(4)
    got = hard_negatives.mine(df, F.expr("vec_id % 10 = 0"))
    assert bag(tuple(r) for r in got.collect()) == bag(negatives_by_hand(rows, lambda i: i % 10 == 0))


def test_wide_components(sp):
    rng = random.Random(2)
    rows = [(i, i % 2, [rng.choice([-1.0, 1.0]) * rng.random() * 2.0 ** rng.choice([0, 10, 22]) for _ in range(3)]) for i in range(40)]
    got = hard_negatives.mine(sp.createDataFrame(rows, "vec_id int, label int, embedding array<double>"), F.expr("vec_id % 10 = 0"), scale=256)
    assert bag(tuple(r) for r in got.collect()) == bag(negatives_by_hand(rows, lambda i: i % 10 == 0))
    huge = [(i, i % 2, [1e36 * (1 + i), 3e37]) for i in range(20)]
    got = hard_negatives.mine(sp.createDataFrame(huge, "vec_id int, label int, embedding array<float>"), F.expr("vec_id = 0")).collect()
    assert [(r["positive_id"], r["negative_id"]) for r in got][:5] == [(2, 1), (2, 3), (2, 5), (2, 7), (2, 9)]  # all at the largest long


def test_equal_vectors_and_no_rows(sp):
    rows = [(i, i % 2, [0.5, 0.5]) for i in range(3000)]
    got = hard_negatives.mine(sp.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3), F.expr("vec_id % 100 = 0")).collect()
    assert len(got) == 30 * 25 and {r["negative_id"] for r in got} == {1, 3, 5, 7, 9} and {r["positive_id"] for r in got} <= {0, 2, 4, 6, 8, 10}
    none = sp.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(none, F.expr("vec_id % 100 = 0")).collect() == []
    with pytest.raises(ValueError):
        hard_negatives.mine(none.withColumn("vec_id", F.col("vec_id").cast("string")), F.lit(True))


# ------------------------------------------------------------------ phrase mining

def phrases_by_hand(rows, least, top=2000, absorbed=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang, text = lang if lang is not None else "und", text or ""
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        piece = []
        for part in _split(text, ".,;:!?\n\x0b\x0c\r"):
            piece = [w for w in _split(part, " \t") if w]
            n[lang] += len(piece)
            for size in (1, 2, 3):
                for k in range(len(piece) - size + 1):
                    f[lang, tuple(piece[k : k + size])] += 1
    out = []
    for (lang, g), a in f.items():
        if len(g) < 2 or a < least:
            continue
        if len(g) == 2 and any(100 * c >= absorbed * a for (m, h), c in f.items() if m == lang and len(h) == 3 and c >= least and g in (h[:2], h[1:])):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.append((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, r, *x[1:]) for r, x in enumerate(mine[:top], 1)]
    return ranked


def _split(text, marks):
    out = [""]
    for c in text:
        if c in marks:
            out.append("")
        else:
            out[-1] += c
    return out


def texts(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "B", "b", "é", "日本", "x\x00y", "ab", "of", "the", "*"]
    rows = []
    for _ in range(n):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ".", " the of "]) for _ in range(rng.randrange(0, 30)))
        rows.append((t, rng.choice(["en", "de", None, "", "e\tn", "e\nn\\"])))
    return rows + [(None, "en"), ("", None), ("...", "en"), ("The Of THE of " * 5000, "en"), ("only once here", "xx")] + [("copy of copy", "fr")] * 50


@pytest.mark.parametrize("proposed, at", [(1 << 17, 2), (5, 1), (0, 1)])
def test_phrases_by_hand(sp, monkeypatch, proposed, at):
    """Whatever the sample proposes, all counts are exact; without proposals the border brings all of them."""
    monkeypatch.setattr(phrase_mining, "PROPOSED", proposed)
    monkeypatch.setattr(phrase_mining, "PROPOSED_AT", at)
    monkeypatch.setattr(phrase_mining, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(phrase_mining, "BUCKET_BYTES", 20_000)
    rows = texts(4)
    df = sp.createDataFrame([(*r, 1, 2, "q", 3) for r in rows], "text string, lang string, d int, c int, t string, f long").repartition(4)
    for least, top in ((10, 2000), (3, 7)):
        got = phrase_mining.collocations(df, least, top)
        assert bag(tuple(r) for r in got.collect()) == bag(phrases_by_hand(rows, least, top))


def test_number_of_passes(sp, monkeypatch):
    rows = [("new york city new york city", "en")] * 20 + [("other words here", "en")] * 20
    df = sp.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(phrase_mining, "PROPOSED", 0)
    m = phrase_mining.mine(df, 10)
    assert m.passes == 3 and m.triples.count() == 4  # words, then pairs, then triples fail the border
    monkeypatch.setattr(phrase_mining, "PROPOSED", 1 << 17)
    monkeypatch.setattr(phrase_mining, "SAMPLE_SHARE", 1)
    m = phrase_mining.mine(df, 10)
    assert m.passes == 1 and m.triples.count() == 4  # the sample was everything: the border holds


def test_a_pass_makes_no_folder_by_kind(sp):
    """A task writes one file, whatever kinds of phrases it found."""
    m = phrase_mining.mine(sp.createDataFrame([("new york city new york city", "en")] * 20, "text string, lang string"), 10)
    files = m.words.inputFiles()
    assert files and not any("what=" in f for f in files)
    assert {len(re.findall("/pass=", f)) for f in files} == {1}
    assert (m.words.count(), m.pairs.count(), m.triples.count()) == (3, 3, 3)


def test_no_texts(sp):
    assert phrase_mining.collocations(sp.createDataFrame([], "text string, lang string")).collect() == []
    assert phrase_mining.collocations(sp.createDataFrame([(None, None), ("one two", "en")], "text string, lang string")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_key_runs_round_trip(keys):
    x = np.unique(np.array(keys, np.uint64))
    assert (phrase_mining.unsqueeze_sorted(phrase_mining.squeeze_sorted(x)) == x).all()
    assert (phrase_mining.unsqueeze(phrase_mining.squeeze(x.astype(np.uint32)), np.uint32) == x.astype(np.uint32)).all()


def test_scores_beyond_64_bits(sp):
    big = 10**13
    got = sp.createDataFrame([(big, big + 7, big + 1), (3, 7, 9)], "a long, l long, r long").select(phrase_mining._score("a", "l", "r")).collect()
    assert [r[0] for r in got] == [int(Fraction(10**6 * a * a, l * r)) for a, l, r in ((big, big + 7, big + 1), (3, 7, 9))]
