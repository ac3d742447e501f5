import itertools
import time

import numpy as np
import pytest

from corpusloom.functions.clusters import silhouette, splits


def _squares(x, own):
    return sum(((x[own == c] - x[own == c].mean()) ** 2).sum() for c in set(own))


def _plain_silhouette(x, own):
    score = []
    for i in range(len(x)):
        same = own == own[i]
        if same.sum() == 1:
            score.append(0.0)
            continue
        a = np.abs(x[same] - x[i]).sum() / (same.sum() - 1)
        b = min(np.abs(x[own == c] - x[i]).mean() for c in set(own) - {own[i]})
        score.append((b - a) / max(a, b, 1e-9))
    return float(np.mean(score))


@pytest.mark.parametrize("seed", range(12))
def test_splits_are_the_best_there_are(seed):
    rng = np.random.default_rng(seed)
    x = rng.choice([rng.normal(size=9) * 100, rng.integers(0, 5, 9).astype(float), np.repeat(rng.normal(size=3), 3)][seed % 3], 9)
    values = np.unique(x)
    for k, own in enumerate(splits(x, 4), 1):
        if k > len(values):
            assert len(set(own)) == len(values)
            continue
        best = min(_squares(x, np.searchsorted(np.array(cut), x, side="right")) for cut in itertools.combinations(values[1:], k - 1))
        assert len(set(own)) == k and _squares(x, own) == pytest.approx(best, abs=1e-6)
        assert all(a <= b for a, b in itertools.pairwise(own[np.argsort(x, kind="stable")]))
        if k > 1:
            assert silhouette(x, own) == pytest.approx(_plain_silhouette(x, own), abs=1e-9)


def test_large_and_empty_pages():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 3, 25_000) for c in (0, 200, 400, 600)])
    began = time.perf_counter()
    own = splits(x, 4)
    assert silhouette(x, own[3]) > 0.9 > silhouette(x, own[1]) and time.perf_counter() - began < 10
    assert sorted(np.bincount(own[3])) == [25_000] * 4
    assert [len(o) for o in splits(np.zeros(0), 3)] == [0, 0, 0]
    assert silhouette(np.array([1.0, 2.0]), np.array([0, 0])) == -1.0
