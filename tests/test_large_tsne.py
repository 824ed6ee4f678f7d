"""t-SNE of more rows than one place takes, against t-SNE in one place."""

import numpy as np

from millrace.operators import decomposition
from millrace.plans import fields
from millrace.sources.tables import from_arrays


def test_tsne_of_more_rows_than_one_place_takes(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(90, 2)) * 3
    x = np.concatenate([x, np.repeat(x[:1], 70, axis=0)])  # one row has more copies than neighbours are asked for at first
    rows = from_arrays(spark, x)
    make = lambda: decomposition.TSNE(perplexity=4, n_iterations=30, exaggeration_iter=10, random_state=0)
    one = make()
    expected = {r.id: r.components for r in one.fit_transform(rows, ["x0", "x1"]).collect()}
    monkeypatch.setattr(decomposition.TSNE, "max_rows", 100)
    many = make()
    found = {r.id: r.components for r in many.fit_transform(rows, ["x0", "x1"]).collect()}
    assert found.keys() == expected.keys()
    scale = np.abs(np.array(list(expected.values()))).max()
    assert all(np.allclose(expected[i], found[i], atol=1e-5 * scale) for i in expected)
    assert np.isclose(one.kl_divergence_, many.kl_divergence_, rtol=1e-6)


def test_a_step_meets_no_pairs_of_rows():
    y = np.random.default_rng(3).normal(size=(400, 2)) * [4, 2]
    apart = y[:, None] - y[None]
    near = 1 / (1 + (apart**2).sum(axis=2))
    lattice, charges = fields.together([fields.charges_of(part, fields.STEP) for part in (y[:150], y[150:])])
    waves, inverse = lattice.waves(charges), lambda x, z: 1 / (1 + x * x + z * z)
    assert np.isclose(lattice.met(waves, inverse), near.sum(), rtol=1e-9)
    slopes = lattice.read(lattice.convolved(waves, lambda x, z: inverse(x, z) ** 2 * x, lambda x, z: inverse(x, z) ** 2 * z), y)
    assert np.allclose(slopes, np.einsum("ijk,ij->ik", apart, near**2), atol=1e-8)
    assert fields.charges_of(y * 1e4, fields.STEP) is None


def test_tsne_where_the_plane_is_too_wide(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(60, 2))
    rows = from_arrays(spark, np.concatenate([x, x]))
    make = lambda: decomposition.TSNE(perplexity=4, n_iterations=6, exaggeration_iter=2, random_state=0, divergence_after=(3,))
    one = make()
    expected = {r.id: r.components for r in one.fit_transform(rows, ["x0", "x1"]).collect()}
    monkeypatch.setattr(decomposition.TSNE, "max_rows", 100)
    for most in (fields.MOST, 0):
        monkeypatch.setattr(fields, "MOST", most)
        many = make()
        found = {r.id: r.components for r in many.fit_transform(rows, ["x0", "x1"]).collect()}
        scale = np.abs(np.array(list(expected.values()))).max()
        assert found.keys() == expected.keys() and all(np.allclose(expected[i], found[i], atol=1e-5 * scale) for i in expected)
        assert np.isclose(one.divergences_[3], many.divergences_[3], rtol=1e-6) and np.isclose(one.kl_divergence_, many.kl_divergence_, rtol=1e-6)
