"""Greedy merges of more rows than one place takes, against merges of all pairs one by one."""

import numpy as np
import pytest

from millrace.operators import cluster
from millrace.plans import merges
from millrace.sources.tables import from_arrays


def one_by_one(x, linkage, k):
    held = {i: [i] for i in range(len(x))}
    while len(held) > k:
        found = []
        for a in held:
            for b in (b for b in held if b > a):
                m, n = len(held[a]), len(held[b])
                if linkage == "ward":
                    d = np.linalg.norm(x[held[a]].mean(0) - x[held[b]].mean(0)) * (1 if m + n == 2 else np.sqrt(m * n / (m + n)))
                else:
                    d = {"single": np.min, "complete": np.max, "average": np.mean}[linkage](np.linalg.norm(x[held[a]][:, None] - x[held[b]][None], axis=2))
                found.append((round(d, 9), a, b))
        _, a, b = min(found)
        held[a] += held.pop(b)
    return {i: c for c, a in enumerate(sorted(held)) for i in held[a]}


@pytest.mark.parametrize("linkage", ["ward", "average", "complete", "single"])
def test_merges_of_more_rows_than_one_place_takes(spark, monkeypatch, linkage):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 60, (50, 2)) / 4, rng.normal(0, 4, (40, 2))])
    x = np.concatenate([x, x[:10]])
    monkeypatch.setattr(cluster.AgglomerativeClustering, "max_rows", 60)
    monkeypatch.setattr(merges, "LAST", 20)
    rows = from_arrays(spark, x)
    out = cluster.AgglomerativeClustering(4, linkage).fit_predict(rows, ["x0", "x1"], id_col="id")
    assert {r.id: r.prediction for r in out.collect()} == one_by_one(x, linkage, 4)
