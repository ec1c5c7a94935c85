"""Plain versions of the operators, for small tables."""

import itertools

import numpy as np


def shingles(text, k=5):
    w = (text or "").lower().replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def classes(rows, similarity=0.8):
    """{row number: (class id, links, copies)} for (id, text) rows."""
    texts = sorted({t for _, t in rows if t and shingles(t)})
    sets = {t: shingles(t) for t in texts}
    near = {t: set() for t in texts}
    for a, b in itertools.combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if both and both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            near[a].add(b)
            near[b].add(a)
    root, seen = {}, set()
    for t in texts:
        if t in seen:
            continue
        stack, group = [t], []
        seen.add(t)
        while stack:
            x = stack.pop()
            group.append(x)
            for y in near[x] - seen:
                seen.add(y)
                stack.append(y)
        ids = [i for i, x in rows if x in set(group) and i is not None]
        root.update({x: min(ids, default=None) for x in group})
    out = []
    for i, t in rows:
        if t in near:
            out.append((i, root[t], len(near[t]), sum(x == t for _, x in rows)))
        else:
            out.append((i, i, 0, 1))
    return out


def nearest(ids, vectors, query, k):
    d = np.sqrt(((vectors - vectors[query]) ** 2).sum(1))
    return [(ids[j], d[j]) for j in np.lexsort((ids, d)) if j != query][:k]
