"""Linear models. Least-squares fits run on the Gram matrix, so they read the rows once whatever the iterations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.core import Estimator, Features, partition_sums
from millrace.functions.expr import linear_form, sigmoid
from millrace.plans.moments import grams


class _Linear(Estimator):
    """Output: prediction, or with a threshold also probability."""

    def _form(self, df: DataFrame) -> Column:
        self._check_fitted()
        return linear_form(self._width(df).columns, self.weights_, self.bias_)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self._form(df))

    predict = transform


class _LeastSquares(_Linear):
    """Models fitted on the Gram matrix alone; those of several sets of rows add up."""

    def statistics(self, df: DataFrame, features, label: str, by: str | None = None) -> dict:
        """The Gram matrix of the rows of each value of `by`, or of all under None."""
        return grams(df, Features(df, features), label, by)

    def fit(self, df: DataFrame, features, label: str, id_col: str | None = None):
        own = Features(df, features)
        return self.fit_statistics(features, [grams(df, own, label)[None]])

    def fit_statistics(self, features, parts: list[np.ndarray]):
        """Fit on the rows of all parts, given by their statistics."""
        g = np.sum(parts, axis=0)
        if not parts or not g[0, 0]:
            raise ValueError("there are no rows to fit on")
        self.features, self.n_features_in_ = features, len(g) - 2
        g = g / g[0, 0]
        self._solve(g[1:-1, 1:-1], g[1:-1, -1], g[-1, -1], g[0, 1:-1], g[0, -1])
        self._fitted = True
        return self

    def prediction(self, df: DataFrame) -> Column:
        """The prediction as one expression."""
        return self._form(df)

    def _solve(self, xx: np.ndarray, xy: np.ndarray, yy: float, mx: np.ndarray, my: float) -> None:
        """From the means of products, features and label."""
        raise NotImplementedError


class LinearRegression(_LeastSquares):
    """Full-batch gradient descent on the mean squared error from zero; loss_history_ has the loss before each step."""

    penalty = 0.0

    def __init__(self, learning_rate: float = 0.01, n_iterations: int = 1000, fit_intercept: bool = True) -> None:
        self.learning_rate, self.n_iterations, self.fit_intercept = learning_rate, n_iterations, fit_intercept

    def _solve(self, xx: np.ndarray, xy: np.ndarray, yy: float, mx: np.ndarray, my: float) -> None:
        w, b = np.zeros(len(xy)), 0.0
        self.loss_history_ = []
        for _ in range(self.n_iterations):
            error = w @ xx @ w + 2 * b * (mx @ w) + b * b - 2 * (w @ xy) - 2 * b * my + yy
            slope = 2 * (xx @ w + b * mx - xy) + 2 * self.penalty * w
            b = b - self.learning_rate * 2 * (mx @ w + b - my) if self.fit_intercept else 0.0
            w = w - self.learning_rate * slope
            self.loss_history_.append(error + self.penalty * (w @ w))
        self.weights_, self.bias_ = w, b


class Ridge(LinearRegression):
    """Mean squared error plus alpha times the squared weights; the intercept is free."""

    def __init__(self, alpha: float = 1.0, learning_rate: float = 0.01, n_iterations: int = 1000, fit_intercept: bool = True) -> None:
        super().__init__(learning_rate, n_iterations, fit_intercept)
        self.alpha = self.penalty = alpha


class ElasticNet(_LeastSquares):
    """Cyclic coordinate descent on 1/(2n)|r|^2 + alpha*l1_ratio*|w|_1 + alpha*(1-l1_ratio)/2*|w|^2.

    The intercept is renewed at the start of each pass; passes end when no weight moved by `tol`.
    """

    def __init__(self, alpha: float = 1.0, l1_ratio: float = 0.5, n_iterations: int = 1000, fit_intercept: bool = True, tol: float = 1e-4) -> None:
        if not 0 <= l1_ratio <= 1:
            raise ValueError("l1_ratio must be between 0 and 1")
        self.alpha, self.l1_ratio, self.n_iterations, self.fit_intercept, self.tol = alpha, l1_ratio, n_iterations, fit_intercept, tol

    def _solve(self, xx: np.ndarray, xy: np.ndarray, yy: float, mx: np.ndarray, my: float) -> None:
        w, b = np.zeros(len(xy)), 0.0
        lasso, ridge = self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio)
        self.n_iter_ = 0
        for self.n_iter_ in range(1, self.n_iterations + 1):
            b = my - mx @ w if self.fit_intercept else 0.0
            moved = 0.0
            for j in range(len(w)):
                rho = xy[j] - b * mx[j] - xx[j] @ w + xx[j, j] * w[j]
                size = xx[j, j] + ridge
                new = np.sign(rho) * max(abs(rho) - lasso, 0.0) / size if size > 0 else 0.0
                moved, w[j] = max(moved, abs(new - w[j])), new
            if moved < self.tol:
                break
        self.weights_, self.bias_ = w, float(my - mx @ w if self.fit_intercept else 0.0)


class Lasso(ElasticNet):
    def __init__(self, alpha: float = 1.0, n_iterations: int = 1000, fit_intercept: bool = True, tol: float = 1e-4) -> None:
        super().__init__(alpha, 1.0, n_iterations, fit_intercept, tol)


class LogisticRegression(_Linear):
    """Full-batch gradient descent on the log-loss from zero, for labels 0 and 1; one pass of the rows a step.

    Rows are kept between steps (memory, then disk); only sums leave the partitions. probability is that of class 1.
    """

    def __init__(self, learning_rate: float = 0.1, n_iterations: int = 1000, threshold: float = 0.5) -> None:
        self.learning_rate, self.n_iterations, self.threshold = learning_rate, n_iterations, threshold

    def fit(self, df: DataFrame, features, label: str, id_col: str | None = None):
        self.features = features
        own = Features(df, features)
        self.n_features_in_ = d = len(own)
        rows = df.where(own.known & F.col(label).isNotNull()).select(own.vector.alias("x"), F.col(label).cast("double").alias("y")).persist()
        w = np.zeros(d + 1)
        self.loss_history_ = []
        try:
            for _ in range(self.n_iterations):
                def work(x: np.ndarray, y: np.ndarray, w=w) -> np.ndarray:
                    p = 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -500, 500)))
                    q = np.clip(p, 1e-15, 1 - 1e-15)
                    loss = -(y * np.log(q) + (1 - y) * np.log(1 - q)).sum()
                    return np.concatenate(([len(y), loss, (p - y).sum()], x.T @ (p - y)))

                sums = partition_sums(rows, [F.col("x"), F.col("y")], work)
                if not len(sums):
                    raise ValueError("there are no rows to fit on")
                self.loss_history_.append(sums[1] / sums[0])
                w = w - self.learning_rate * sums[2:] / sums[0]
        finally:
            rows.unpersist()
        self.weights_, self.bias_, self._fitted = w[1:], float(w[0]), True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("probability", sigmoid(self._form(df)))
        return out.withColumn("prediction", (F.col("probability") >= self.threshold).cast("int"))

    predict = predict_proba = transform
