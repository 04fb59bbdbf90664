"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, n=5):
    w = words(fold(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def jaccard(docs):
    """doc_id -> (set size, component)."""
    sets = {d: shingle_set(t) for d, t in docs}
    by = defaultdict(set)
    for d, s in sets.items():
        for g in s:
            by[g].add(d)
    pairs = {(a, b) for ds in by.values() for a in ds for b in ds if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = components(sets, links)
    return {d: (len(s), comp[d]) for d, s in sets.items()}


def removals(docs, n=13):
    """doc_id -> kept words."""
    least = {}
    split = [(d, words(t)) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            least[k] = min(least.get(k, d), d)
    out = {}
    for d, w in split:
        gone = {i + k for i in range(len(w) - n + 1) if least[tuple(w[i : i + n])] < d for k in range(n)}
        out[d] = [x for i, x in enumerate(w) if i not in gone]
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def mix(docs, weights=(5, 2, 1), share=1.5, repeats=2):
    """source -> target, by resharing the excess until nothing is above its cap."""
    size = defaultdict(int)
    for _, source, text in docs:
        size[source] += len(words(text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(size.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > repeats * size[s]]
        if not over:
            target.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            target[s] = float(repeats * size[s])
            open_.discard(s)
        left -= sum(target[s] for s in over)
    return size, target
