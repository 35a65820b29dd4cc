"""Plain single-process versions that the operators are held against."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def byte_repeats(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[s : s + length] for _, t in texts for s in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        runs = sum(g and (not p) for p, g in zip([False, *gone], gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def word_repeats(rows, length=35):
    texts = [(i, words(t)) for i, t in rows]
    seen = Counter(tuple(w[s : s + length]) for _, w in texts for s in range(len(w) - length + 1))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] > 1:
                gone[s : s + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def jaccard_components(rows, n=4, share=(85, 100)):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    of, post = {i: i for i in sets}, defaultdict(list)

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in sorted(sets):
        common = Counter(j for g in sets[i] for j in post[g])
        for j, both in common.items():
            if share[1] * both >= share[0] * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                of[b] = a
        for g in sets[i]:
            post[g].append(i)
    return [(i, len(sets[i]), top(i)) for i in sets]
