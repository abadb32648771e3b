"""Clustering of small groups on the driver's side of an Arrow kernel, and its quality measures."""

from __future__ import annotations

import numpy as np


def k_medoids(d: np.ndarray, k: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Medoids and labels of a distance matrix: farthest-first starts, alternating assignment, ties to the lower index."""
    medoids = [int(d.sum(axis=1).argmin())]
    while len(medoids) < min(k, len(d)):
        medoids.append(int(d[:, medoids].min(axis=1).argmax()))
    medoids = np.array(medoids)
    for _ in range(rounds):
        labels = d[:, medoids].argmin(axis=1)
        new = np.array([(own := np.flatnonzero(labels == c))[d[np.ix_(own, own)].sum(axis=1).argmin()] if (labels == c).any() else medoids[c] for c in range(len(medoids))])
        if (new == medoids).all():
            break
        medoids = new
    return medoids, d[:, medoids].argmin(axis=1)


def affinity_propagation(s: np.ndarray, preference: float | None = None, damping: float = 0.8, rounds: int = 500, stable: int = 30) -> np.ndarray:
    """Exemplar of each item from similarities, by damped responsibilities and availabilities."""
    s = s.astype(np.float64).copy()
    n = len(s)
    np.fill_diagonal(s, np.median(s[~np.eye(n, dtype=bool)]) if preference is None else preference)
    s += np.arange(n) * 1e-12  # equal columns: the later index wins, always
    r, a, last, same = np.zeros((n, n)), np.zeros((n, n)), None, 0
    for _ in range(rounds):
        m = a + s
        i = m.argmax(axis=1)
        first = m[np.arange(n), i]
        m[np.arange(n), i] = -np.inf
        new = s - first[:, None]
        new[np.arange(n), i] = s[np.arange(n), i] - m.max(axis=1)
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        np.fill_diagonal(p, np.diag(r))
        new = p.sum(axis=0) - p
        d = np.diag(new).copy()
        new = np.minimum(new, 0)
        np.fill_diagonal(new, d)
        a = damping * a + (1 - damping) * new
        now = np.flatnonzero(np.diag(a + r) > 0)
        same = same + 1 if last is not None and np.array_equal(now, last) else 0
        last = now
        if same >= stable and len(now):
            break
    if not len(last):
        return np.zeros(n, np.int64)
    out = last[s[:, last].argmax(axis=1)]
    out[last] = last
    return out


def hierarchical(d: np.ndarray, k: int, linkage: str = "complete") -> np.ndarray:
    """Labels 0..k-1 of agglomerative clustering (complete, single or average linkage), merging the closest pair, ties to the lower indices."""
    n = len(d)
    d = d.astype(np.float64).copy()
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    for _ in range(n - min(k, n)):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        row = np.maximum(d[i], d[j]) if linkage == "complete" else np.minimum(d[i], d[j]) if linkage == "single" else (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def threshold_groups(x: np.ndarray, limit: float) -> np.ndarray:
    """Groups of points in order, pair first: a point without a group founds one with all groupless points within the limit of it; then one pass merges a group into the first earlier one whose centroid (of that time) lies within the limit of its own. So two groups that a bridge of points joins stay apart unless their centroids are near."""
    labels = np.full(len(x), -1)
    n = 0
    for i in range(len(x)):
        if labels[i] < 0:
            near = (labels < 0) & (((x - x[i]) ** 2).sum(axis=1) <= limit * limit)
            labels[near] = n
            n += 1
    for g in range(n):
        own = x[labels == g]
        for h in range(g):
            other = x[labels == h]
            if len(own) and len(other) and ((own.mean(axis=0) - other.mean(axis=0)) ** 2).sum() <= limit * limit:
                labels[labels == g] = h
                break
    return np.unique(labels, return_inverse=True)[1]


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    groups = np.unique(labels)
    means = np.stack([np.where(labels == g, d.T[labels == g].sum(axis=0) / np.maximum(1, (labels == g).sum() - 1), d.T[labels == g].mean(axis=0)) for g in groups], axis=1)
    own = means[np.arange(len(d)), np.searchsorted(groups, labels)]
    other = np.where(groups[None] == labels[:, None], np.inf, means).min(axis=1)
    single = np.isin(labels, [g for g in groups if (labels == g).sum() == 1])
    return float(np.where(single, 0, (other - own) / np.maximum(own, other)).mean())
