"""Greedy one-by-one clustering and pairwise metrics on small arrays, for comparison."""

from __future__ import annotations

import numpy as np


def unit(vectors):
    vectors = np.asarray(vectors, dtype=float)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length == 0, 1, length)


def greedy(vectors, threshold, linkage="average"):
    """Labels: the least index of each cluster."""
    u = unit(vectors)
    distance = 1 - u @ u.T
    groups = {i: [i] for i in range(len(u))}
    join = {"average": np.mean, "complete": np.max, "single": np.min}[linkage]
    while len(groups) > 1:
        pairs = [(join(distance[np.ix_(groups[a], groups[b])]), a, b) for a in groups for b in groups if a < b]
        d, a, b = min(pairs)
        if not round(d, 12) < threshold:
            break
        groups[a] += groups.pop(b)
    labels = np.empty(len(u), int)
    for members in groups.values():
        labels[members] = min(members)
    return labels


def silhouette(vectors, labels):
    u = unit(vectors)
    d = 1 - u @ u.T
    sizes = {l: (labels == l).sum() for l in set(labels)}
    keep = np.array([sizes[l] > 1 for l in labels])
    multi = sorted({l for l in labels[keep]})
    if len(multi) < 2 or keep.sum() <= len(multi):
        return None
    scores = []
    for i in np.flatnonzero(keep):
        own = (labels == labels[i]) & keep
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == l].mean() for l in multi if l != labels[i])
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def intra(vectors, labels):
    u = unit(vectors)
    means = []
    for l in set(labels):
        m = np.flatnonzero(labels == l)
        if len(m) > 1:
            s = u[m] @ u[m].T
            means.append(s[np.triu_indices(len(m), 1)].mean())
    return float(np.mean(means)) if means else None
