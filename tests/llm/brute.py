"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def least_reachable(nodes, links):
    """Smallest node reachable from each."""
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in nodes}


def jaccard_components(rows, num=75, den=100):
    """{doc_id: (size, component)} by comparing every pair that shares a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    at, links = {}, set()
    for i, s in sets.items():
        for g in s:
            at.setdefault(g, []).append(i)
    tried = set()
    for ids in at.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    both = len(sets[a] & sets[b])
                    if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                        links.add((a, b))
    least = least_reachable(sets, links)
    return {i: (len(s), least[i]) for i, s in sets.items()}
