"""Brute-force versions of the operators: plain Python over all rows, written apart from the operators."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def substring(rows, width=35):
    """(doc_id, n_words, n_removed, kept_sha256) for (doc_id, text) rows."""
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (key, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((key, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def shingles(text, width):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(rows, width=2, percent=80):
    """(doc_id, n_shingles, component_id)."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    index = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in index[x])
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
        for x in s:
            index[x].append(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        least[r] = key if r not in least or least[r] is None else least[r] if key is None else min(least[r], key)
    return [(key, len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows)]


def licenses(rows, templates, phrases, threshold):
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    out = []
    for key, text in rows:
        low = (text or "").translate(UPPER)
        w = ALNUM.findall(low)
        at, base = [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    at.append(i)
                    base.add(label)
        score, found = 0.0, set()
        for label, t in templates.items():
            step = 1
            while step < len(t.split()):
                step *= 2
            words = set(t.split())
            for k in range(0, len(w), step):
                share = len(words & set(w[k : k + 2 * step])) / len(words)
                if share >= threshold - 1e-12:
                    found.add(label)
                    score = max(score, share)
        out.append((key, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score))
    return out


def water_levels(sizes, weights=(5, 2, 1), most=3):
    """Targets by source, by sharing the excess again and again; sizes: {source or None: words}."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
