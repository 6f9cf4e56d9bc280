"""Plain Python forms of what the operators compute."""

import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text, fold=False):
    b = (text or "").encode()
    return WORD.findall(b.translate(FOLD) if fold else b)


def components(rows, shingle, percent):
    """[(id, text)] -> [(n shingles, smallest id linked)] in the rows' order."""
    sets = []
    for _, t in rows:
        w = words(t, True)
        sets.append({tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(len(s), least.get(find(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def without_windows(rows, n):
    """[(id, text)] -> [(n words, n removed, kept text)]; null ids are larger than all others."""
    big = 2**63 - 1
    first = {}
    all_words = [words(t) for _, t in rows]
    for (d, _), w in zip(rows, all_words):
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            first[g] = min(first.get(g, big), big if d is None else d)
    out = []
    for (d, _), w in zip(rows, all_words):
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (big if d is None else d):
                gone.update(range(k, k + n))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def without_strings(rows, length):
    """[(id, text)] -> [(bytes, removed, spans, kept bytes)]"""
    count = Counter()
    texts = [(t or "").encode() for _, t in rows]
    for b in texts:
        for k in range(len(b) - length + 1):
            count[b[k : k + length]] += 1
    out = []
    for b in texts:
        end, gone = 0, bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                for p in range(max(k, end), k + length):
                    gone[p] = 1
                end = k + length
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out
