"""Plain restatements of the contracts, over small lists of (doc_id, text)."""

import hashlib
import re
from collections import defaultdict

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def key(x):
    return -(2**63) if x is None else x


def windows(rows, units, width):
    """Per row: which units lie in a window that starts earlier too."""
    seen, out = set(), []
    for _, text in sorted(rows, key=lambda x: key(x[0])):
        u = units(text)
        gone = [False] * len(u)
        for k in range(len(u) - width + 1):
            w = tuple(u[k : k + width])
            if w in seen:
                gone[k : k + width] = [True] * width
            seen.add(w)
        out.append((u, gone))
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()


def shingles(text, k=5):
    w = (text or "").encode().translate(LOW).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOW))


def contamination(rows, items, width=13):
    owners = defaultdict(set)
    for item, text in items:
        t = words(text)
        for k in range(max(1, len(t) - width + 1) if t else 0):
            owners[tuple(t[k : k + width])].add(item)
    out = {}
    for i, text in rows:
        t = words(text)
        hit, found = set(), set()
        for w, own in owners.items():
            for k in range(len(t) - len(w) + 1):
                if tuple(t[k : k + len(w)]) == w:
                    hit.update(range(k, k + len(w)))
                    found |= own
        out[i] = (len(t), len(hit), sorted(str(x) for x in found if x is not None))
    return out
