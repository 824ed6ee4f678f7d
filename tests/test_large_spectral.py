"""Spectral clustering of more rows than one place takes, against the eigenvectors of the whole matrix."""

import numpy as np
import pytest

from millrace.operators import cluster
from millrace.plans import laplacian
from millrace.sources.tables import from_arrays


def both(spark, monkeypatch, x, **named):
    rows = from_arrays(spark, x)
    one = cluster.SpectralClustering(3, random_state=0, **named)
    expected = one.fit_predict(rows, ["x0", "x1"], id_col="id")
    monkeypatch.setattr(cluster.SpectralClustering, "max_rows", 100)
    monkeypatch.setattr(laplacian, "CELLS", 40)
    many = cluster.SpectralClustering(3, random_state=0, **named)
    found = many.fit_predict(rows, ["x0", "x1"], id_col="id")
    labels = [np.array([r[0] for r in df.orderBy("id").select("prediction").collect()]) for df in (expected, found)]
    return one.embedding_, np.array([r.x for r in many.embedding_.orderBy("id").collect()]), *labels


@pytest.mark.parametrize("named", [{"affinity": "nearest_neighbors", "n_neighbors": 8}, {"affinity": "rbf", "gamma": 0.8}])
def test_eigenvectors_of_more_rows_than_one_place_takes(spark, monkeypatch, named):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.9, (140, 2)) + c for c in ([0, 0], [3.2, 0], [0.5, 3.4])])
    x = np.concatenate([x, x[:20]])
    expected, found, a, b = both(spark, monkeypatch, x, **named)
    assert np.allclose(expected @ expected.T, found @ found.T, atol=1e-3)  # the same but for a turn of the whole
    assert len({*zip(a, b)}) == 3


def test_components_stay_whole(spark, monkeypatch):
    rng = np.random.default_rng(4)
    part = np.repeat(np.arange(3), 60)
    _, found, a, b = both(spark, monkeypatch, rng.normal(0, 0.5, (180, 2)) + 20 * part[:, None], affinity="nearest_neighbors", n_neighbors=20)
    assert len({*zip(part, a)}) == len({*zip(part, b)}) == 3
    part = np.repeat(np.arange(7), 40)
    rows = from_arrays(spark, rng.normal(0, 0.5, (280, 2)) + 20 * part[:, None])
    out = cluster.SpectralClustering(3, "nearest_neighbors", n_neighbors=12).fit_predict(rows, ["x0", "x1"], id_col="id")
    labels = [r.prediction for r in out.orderBy("id").collect()]
    assert len({*zip(part, labels)}) == 7 and set(labels) == {0, 1, 2}
