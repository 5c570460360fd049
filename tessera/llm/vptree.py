"""Vantage-point trees over 64-bit fingerprints: all links at Hamming distance <= r, as a spanning forest.

A node holds a vantage point and a radius; points nearer than the radius go to its inner child, the others to
its outer one.  By the triangle inequality a pair at distance <= r that a node separates has an inner end
whose distance to the vantage point is at least radius - r: that end also *visits* the outer child.  Every
pair is thus met exactly where its two home paths part, and never lost.  The same rule routes fingerprints to
shards (a tree fitted on a bounded sample) and searches within a shard.

Distances of 64 random bits lie so close together that most points are within 3 of a boundary, and a tree over them
visits about 1.5 times as many shards a level.  Of two values that differ in r bits, one half differs in at most r // 2:
so a tree for each half, by the distance over that half's bits (a metric too) and the bound r // 2, meets every pair
with far fewer visits; all bits are compared only in the leaves.
"""

from __future__ import annotations

import numpy as np

#: Points that are compared all with all.
LEAF = 384


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def within(a: np.ndarray, b: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` (words of a fingerprint in columns) that differ in r bits at most."""
    d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for k in range(1, a.shape[1]):
        near = d <= r  # a sum of words only grows, so stop once none is near
        if not near.any():
            return near.nonzero()
        d = d.astype(np.uint16) + np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return (d <= r).nonzero()


def vantage(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int]:
    """Of a few candidates the vantage point with the widest spread of distances, and the median distance."""
    best = (-1.0, points[0], 0)
    some = points if len(points) <= 512 else points[rng.integers(0, len(points), 512)]
    for c in points[rng.integers(0, len(points), 5)]:
        d = distance(some, c)
        best = max(best, (float(d.var()), c, int(np.median(d))), key=lambda x: x[0])
    return np.uint64(best[1]), best[2]


def fit(sample: np.ndarray, depth: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """A complete tree of ``depth`` levels as heap arrays (vantage points, radii)."""
    rng = np.random.default_rng(seed)
    vps, radii = np.zeros(2**depth, np.uint64), np.zeros(2**depth, np.int16)
    parts = {1: sample}
    for node in range(1, 2**depth):
        pts = parts.pop(node)
        if len(pts):
            vps[node], radii[node] = vantage(pts, rng)
        near = distance(pts, vps[node]) < radii[node]
        parts[2 * node], parts[2 * node + 1] = pts[near], pts[~near]
    return vps, radii


def route(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray], r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the point, leaf, whether it is at home there) for every leaf that a point lives in or visits."""
    vps, radii = tree
    at, node, home = np.arange(len(points)), np.ones(len(points), np.int64), np.ones(len(points), bool)
    for _ in range(len(vps).bit_length() - 1):
        d, m = distance(points[at], vps[node]), radii[node]
        inner = np.where(home, d < m, d - r < m)
        outer = d + r >= m
        stays = home & (d >= m)  # an outer home never visits the inner child
        left = inner & ~stays
        at, node, home = np.concatenate([at[left], at[outer]]), np.concatenate([2 * node[left], 2 * node[outer] + 1]), np.concatenate([home[left], stays[outer]])
    return at, node - len(vps), home


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets that the edges (a, b) link; ``label`` always names a set by its least index."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (deeper := label[label] != label).any():
            label[deeper] = label[label[deeper]]


def search(points: np.ndarray, home: np.ndarray, r: int, keys: np.ndarray | None = None, near_r: int | None = None, cross: bool = False, leaf: int = LEAF, seed: int = 7) -> np.ndarray:
    """Labels of the sets that links between home points, and of visitors with home points, make; only the latter if ``cross``.

    ``points`` are fingerprints, of a word or with words in columns.  All links at distance <= r whose ends are within
    ``near_r`` (r if None) over ``keys`` (the points if None) are found.
    """
    points = points.reshape(len(points), -1)
    keys, bound = points[:, 0] if keys is None else keys, r if near_r is None else near_r
    label, rng = np.arange(len(points)), np.random.default_rng(seed)
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        p, v = todo.pop()
        if not len(p) or cross and not len(v):
            continue
        if len(p) > leaf:
            c, m = vantage(keys[p], rng)
            d = distance(keys[p], c)
            near = d < m
            if near.any() and not near.all():
                dv = distance(keys[v], c)
                todo.append((p[near], v[dv - bound < m]))
                todo.append((p[~near], np.concatenate([v[dv + bound >= m], p[near & (d + bound >= m)][: 0 if cross else None]])))
                continue
        # small, or too alike to part: then those within r of one are a set, and needn't be compared with each other
        star = np.zeros(len(p), np.int64)
        while len(p) > leaf and not cross and (rest := np.flatnonzero(star == 0)).size > leaf:
            hub = rest[0]
            own = rest[within(points[p[hub]][None], points[p[rest]], r)[1]]
            star[own] = star.max() + 1
            join_labels(label, np.full(len(own), p[hub]), p[own])
            if len(own) < len(rest) // 8:
                break
        groups = [p[star == k] for k in range(star.max() + 1)]
        for g, block in enumerate(groups):
            for i in range(0, len(block), leaf):
                some = block[i : i + leaf]
                mates = [] if cross else [block[i:]] * (g == 0) + groups[g + 1 :]
                for rest in (*mates, v):
                    for j in range(0, len(rest), 8192):
                        x, y = within(points[some], points[rest[j : j + 8192]], r)
                        join_labels(label, some[x], rest[j + y])
    return label
