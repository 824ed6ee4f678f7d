"""Fits of kernel machines to more rows than one place takes, against fits in one place."""

import numpy as np
import pytest

from millrace.operators import kernels
from millrace.sources.tables import from_arrays


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.stack([rng.uniform(-1, 4, 140), rng.integers(0, 3, 140)], axis=1)
    x = np.concatenate([x, x[:20]])
    return from_arrays(spark, x, (x[:, 0] + 0.5 * rng.normal(size=160) > 1.5).astype(int)).withColumnRenamed("label", "t").selectExpr("*", "sin(x0) + x1 AS v").persist()


def column(df, name):
    return np.array([r[0] for r in df.orderBy("id").select(name).collect()])


def test_gaussian_process_of_more_rows_than_one_place_takes(rows, monkeypatch):
    one = kernels.GaussianProcessRegressor("rbf", noise_var=0.01).fit(rows, ["x0", "x1"], "v", "id")
    expected = one.transform(rows, return_std=True)
    monkeypatch.setattr(kernels.GaussianProcessRegressor, "max_rows", 100)
    many = kernels.GaussianProcessRegressor("rbf", noise_var=0.01).fit(rows, ["x0", "x1"], "v", "id")
    found = many.transform(rows, return_std=True)
    assert len(many.x_train_) < 140
    for name in ("prediction", "std"):
        assert np.allclose(column(expected, name), column(found, name), atol=1e-7)
    assert np.isclose(one.log_marginal_likelihood(), many.log_marginal_likelihood(), rtol=1e-6)
    assert np.allclose(one.predict_cov(rows, "id")[2], many.predict_cov(rows, "id")[2], atol=1e-7)


def test_support_vectors_of_more_rows_than_one_place_takes(rows, monkeypatch):
    expected = kernels.SVC(tol=1e-5).fit(rows, ["x0", "x1"], "t", "id").transform(rows)
    monkeypatch.setattr(kernels.SVC, "max_rows", 100)
    model = kernels.SVC(tol=1e-5).fit(rows, ["x0", "x1"], "t", "id")
    assert np.allclose(column(expected, "rawPrediction"), column(model.transform(rows), "rawPrediction"), atol=1e-3)
    alpha, sign = column(model.coefficients(), "alpha"), 2 * column(rows, "t") - 1
    assert len(alpha) == 160 and -1e-9 <= alpha.min() and alpha.max() <= 1 + 1e-9 and abs((alpha * sign).sum()) < 1e-4
