"""Clusters of numbers on a line, exactly: arrays in, arrays out."""

from __future__ import annotations

import numpy as np


def splits(values: np.ndarray, most: int) -> list[np.ndarray]:
    """For k = 1 .. most the clusters 0 .. k - 1 of each value that have the least sum of squares within.

    Clusters are runs of the sorted values, equal values are together. The best last run of each
    prefix moves right with the prefix, so a layer of runs takes n log n steps, level by level. With
    fewer different values than k there are as many clusters as values.
    """
    x, own, count = np.unique(values, return_inverse=True, return_counts=True)
    n, middle = len(x), x.mean() if len(x) else 0.0
    w = np.concatenate(([0], np.cumsum(count))).astype(float)
    s, q = (np.concatenate(([0.0], np.cumsum(count * (x - middle) ** p))) for p in (1, 2))

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return q[j] - q[i] - (s[j] - s[i]) ** 2 / np.maximum(w[j] - w[i], 1)

    best = cost(np.zeros(n + 1, dtype=int), np.arange(n + 1))
    out, lasts = [np.zeros(len(own), dtype=int)], []
    for k in range(2, most + 1):
        before = np.where(np.arange(n + 1) >= k - 1, best, np.inf)
        best, last = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        lo, hi, a, b = (np.array([v]) for v in (k, n, k - 1, n - 1))
        while (live := lo <= hi).any():
            lo, hi, a, b = lo[live], hi[live], a[live], b[live]
            mid = (lo + hi) // 2
            size = np.minimum(mid - 1, b) - a + 1
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            i = np.repeat(a - start, size) + np.arange(size.sum())
            value = before[i] + cost(i, np.repeat(mid, size))
            least = np.minimum.reduceat(value, start)
            at = np.flatnonzero(value == np.repeat(least, size))
            first = i[at[np.searchsorted(at, start)]]
            best[mid], last[mid] = least, first
            lo, hi, a, b = np.concatenate((lo, mid + 1)), np.concatenate((mid - 1, hi)), np.concatenate((a, first)), np.concatenate((first, b))
        lasts.append(last)
        label, end = np.zeros(n, dtype=int), n
        for c, layer in reversed(list(enumerate(lasts, 1))):
            if end > c and n >= k:
                label[layer[end] : end] = c
                end = layer[end]
            elif n >= k:
                label[end - 1 : end], end = c, end - 1
        out.append((label if n >= k else np.arange(n))[own])
    return out


def silhouette(values: np.ndarray, own: np.ndarray) -> float:
    """The mean silhouette of clusters that are runs of the sorted values; -1 of fewer than two.
    Distances to a run are sums over its sorted values, those to another run lie on one side."""
    clusters = np.unique(own)
    if len(clusters) < 2:
        return -1.0
    score = np.zeros(len(values))
    means = {c: values[own == c].mean() for c in clusters}
    for c in clusters:
        x = values[own == c]
        if len(x) == 1:
            continue
        order = np.argsort(x, kind="stable")
        sums = np.concatenate(([0.0], np.cumsum(x[order])))
        rank = np.empty(len(x), dtype=int)
        rank[order] = np.arange(len(x))
        inside = (x * rank - sums[rank] + (sums[-1] - sums[rank]) - x * (len(x) - rank)) / (len(x) - 1)
        outside = np.min([np.abs(m - x) for other, m in means.items() if other != c], axis=0)
        score[own == c] = (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-9)
    return float(score.mean())
