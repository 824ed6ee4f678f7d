"""Support-vector machines and Gaussian-process regression.

Fits with kernels have all rows in one place up to LOCAL_ROWS. More rows stay where they are, and meet the factor of their kernel matrix
(`millrace.plans.lowrank`), exact to its tolerance. Scores are computed where the rows are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.core import LOCAL_ROWS, Estimator, Features, local_rows, partition_sums, score_rows, wide_sums
from millrace.functions.expr import by_sign, linear_form, uniform
from millrace.plans.interior import dual_optimum
from millrace.plans.lowrank import kernel_factor, solve_lower
from millrace.plans.pairs import distances
from millrace.storage import cut


def signed_labels(y: np.ndarray) -> np.ndarray:
    """-1 and 1: as they are if any is negative, else 0 becomes -1 and all others 1."""
    y = np.asarray(y, dtype=float)
    return np.where(y < 0, -1.0, np.where(y > 0, 1.0, 0.0)) if (y < 0).any() else np.where(y == 0, -1.0, 1.0)


class LinearSVC(Estimator):
    """Pegasos; the hinge step carries the factor C once more. Output: rawPrediction and prediction (0 or 1).

    By default a step takes one row, drawn by hash: only the drawn rows leave the frame, at most n_iterations of them. With `batch` "all" a
    step takes the mean over all rows (the first method of Shalev-Shwartz et al., 2011, with every row in its sample): a pass a step, of which each
    partition sends one row of sums, so rows stay where they are, however many there are.
    """

    def __init__(self, C: float = 1.0, n_iterations: int = 2000, random_state: int = 0, batch: str = "row") -> None:  # noqa: N803
        if C <= 0:
            raise ValueError("C must be positive")
        if batch not in ("row", "all"):
            raise ValueError("batch is 'row' or 'all'")
        self.C, self.n_iterations, self.random_state, self.batch = C, n_iterations, random_state, batch

    def _in_passes(self, rows: DataFrame, n: int, signed: bool, d: int) -> tuple[np.ndarray, float]:
        w, rate = np.zeros(d + 1), 1.0 / (self.C * n)
        held = rows.select("x", F.col("y") if signed else F.when(F.col("y") == 0, -1.0).otherwise(1.0).alias("y")).persist()
        try:
            for t in range(1, self.n_iterations + 1):
                def work(x: np.ndarray, y: np.ndarray, w=w) -> np.ndarray:
                    inside = y * (x @ w[1:] + w[0]) < 1
                    return np.concatenate(([y[inside].sum()], y[inside] @ x[inside]))

                eta = 1.0 / (rate * t)
                step = eta * self.C / n * partition_sums(held, [F.col("x"), F.col("y")], work)
                w = np.concatenate((w[:1] + step[:1], (1 - eta * rate) * w[1:] + step[1:]))
        finally:
            held.unpersist()
        return w[1:], float(w[0])

    def fit(self, df: DataFrame, features, label: str, id_col: str):
        self.features = features
        own = Features(df, features)
        self.n_features_in_ = d = len(own)
        rows = df.where(own.known & F.col(label).isNotNull()).select(F.col(id_col).alias("id"), own.vector.alias("x"), F.col(label).cast("double").alias("y"))
        n, least = rows.agg(F.count(F.lit(1)), F.min("y")).first()
        if not n:
            raise ValueError("there are no rows to fit on")
        if self.batch == "all":
            self.weights_, self.bias_ = self._in_passes(rows, n, least < 0, d)
            self._fitted = True
            return self
        # the first rows in order of their hash, again and again if they are fewer than the steps
        drawn = rows.orderBy(uniform(self.random_state, F.col("id")), "id").limit(self.n_iterations).collect()
        x = np.array([r["x"] for r in drawn])
        y = np.array([r["y"] for r in drawn])
        y = y if least < 0 else np.where(y == 0, -1.0, 1.0)
        rate = 1.0 / (self.C * n)
        w, b = np.zeros(d), 0.0
        for t in range(1, self.n_iterations + 1):
            i = (t - 1) % len(x)
            eta = 1.0 / (rate * t)
            inside = y[i] * (x[i] @ w + b) < 1
            w = (1 - eta * rate) * w
            if inside:
                w = w + eta * self.C * y[i] * x[i]
                b = b + eta * self.C * y[i]
        self.weights_, self.bias_, self._fitted = w, float(b), True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        out = df.withColumn("rawPrediction", linear_form(self._width(df).columns, self.weights_, self.bias_))
        return out.withColumn("prediction", by_sign(F.col("rawPrediction"), 1, 0))

    predict = decision_function = transform


class SVC(Estimator):
    """Kernel SVM: up to LOCAL_ROWS rows by steps on the pair that violates the optimality conditions most, more by an interior point method.

    n_iterations counts rounds of as many steps as there are rows; it ends when no pair violates them by more than 2 tol. The interior point method
    (Fine and Scheinberg, 2001) ends when the conditions hold on all rows; its support vectors are the pivots of the kernel's factor.
    """

    max_rows = LOCAL_ROWS

    def __init__(
        self, C: float = 1.0, kernel: str = "rbf", gamma: float | str = "scale", degree: int = 3, n_iterations: int = 100, tol: float = 1e-3
    ) -> None:  # noqa: N803
        if C <= 0 or kernel not in ("linear", "rbf", "poly"):
            raise ValueError("C > 0 and kernel 'linear', 'rbf' or 'poly' are required")
        self.C, self.kernel, self.gamma, self.degree, self.n_iterations, self.tol = C, kernel, gamma, degree, n_iterations, tol

    def _kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.kernel == "linear":
            return a @ b.T
        if self.kernel == "poly":
            return (self.gamma_ * a @ b.T + 1) ** self.degree
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        return np.exp(-self.gamma_ * np.maximum(square, 0))

    def _kernel_alone(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """The kernel without the fitted state, to be sent to the executors."""
        bare = SVC(self.C, self.kernel, self.gamma, self.degree)
        bare.gamma_ = self.gamma_
        return bare._kernel

    def fit(self, df: DataFrame, features, label: str, id_col: str):
        self.features = features
        own = Features(df, features)
        self.n_features_in_ = len(own)
        rows = df.where(own.known & F.col(label).isNotNull())
        if rows.limit(self.max_rows + 1).count() > self.max_rows:
            return self._fit_in_passes(rows, own, label, id_col)
        ids, x, y = local_rows(df, own, id_col, label, LOCAL_ROWS)
        y, n = signed_labels(y), len(x)
        rising = falling = np.zeros(n, dtype=bool)
        spread = x.var()
        self.gamma_ = (1.0 / (x.shape[1] * spread) if spread > 0 else 1.0) if self.gamma == "scale" else float(self.gamma)
        k = self._kernel(x, x)
        alpha, gap = np.zeros(n), -y.copy()  # gap: decision without intercept, less the label
        for _ in range(self.n_iterations * n):
            rising = np.where(y > 0, alpha < self.C, alpha > 0)  # alpha * y may grow
            falling = np.where(y > 0, alpha > 0, alpha < self.C)
            if not rising.any() or not falling.any():
                break
            i, j = int(np.where(rising, gap, np.inf).argmin()), int(np.where(falling, gap, -np.inf).argmax())
            if gap[j] - gap[i] <= 2 * self.tol:
                break
            room = min(self.C - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else self.C - alpha[j])
            step = min((gap[j] - gap[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), room)
            alpha[i] += y[i] * step
            alpha[j] -= y[j] * step
            gap += step * (k[i] - k[j])
        alpha = np.clip(alpha, 0, self.C)
        inside = (alpha > 1e-6) & (alpha < self.C - 1e-6)
        ends = [np.where(rising, gap, np.inf).min(), np.where(falling, gap, -np.inf).max()] if n else [0.0]
        middle = gap[inside].mean() if inside.any() else np.mean([e for e in ends if np.isfinite(e)] or [0.0])
        held = alpha > 1e-6
        self.alpha_, self.bias_ = alpha, float(-middle)
        self.support_vectors_, self.support_alpha_, self.support_labels_ = x[held], alpha[held], y[held]
        self.dual_coef_, self.intercept_ = self.support_alpha_ * self.support_labels_, self.bias_
        found = [(i.item() if hasattr(i, "item") else i, float(a)) for i, a in zip(ids, alpha)]
        self._alphas = df.sparkSession.createDataFrame(found, f"id {dict(df.dtypes)[id_col]}, alpha double")
        self._fitted = True
        return self

    def _fit_in_passes(self, df: DataFrame, own: Features, label: str, id_col: str):
        d = len(own)
        rows = cut(df.select(F.col(id_col).alias("id"), own.vector.alias("x"), F.col(label).cast("double").alias("y")), "svc-rows")
        n, least = rows.agg(F.count(F.lit(1)), F.min("y")).first()
        means = partition_sums(rows, [F.col("x")], lambda x: np.array([x.sum()]))[0] / (n * d)
        spread = partition_sums(rows, [F.col("x")], lambda x: np.array([((x - means) ** 2).sum()]))[0] / (n * d)
        self.gamma_ = (1.0 / (d * spread) if spread > 0 else 1.0) if self.gamma == "scale" else float(self.gamma)
        signed = F.signum("y") if least < 0 else F.when(F.col("y") == 0, -1.0).otherwise(1.0)
        rows = rows.withColumn("y", signed)
        groups = cut(rows.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n")), "svc-groups")  # equal rows share their coefficient
        factor = kernel_factor(groups, d, self._kernel_alone())
        w, bias, dual = dual_optimum(groups, d, factor, self.C, self.tol)
        self._alphas = rows.join(dual, ["x", "y"]).select("id", "alpha")
        self.alpha_, self.bias_ = None, bias
        self.support_vectors_, self.dual_coef_ = factor.pivots, np.linalg.solve(factor.factor.T, w)
        self.support_labels_, self.support_alpha_, self.intercept_ = np.sign(self.dual_coef_), np.abs(self.dual_coef_), bias
        self._fitted = True
        return self

    def coefficients(self) -> DataFrame:
        """(id, alpha) of every row of the fit."""
        self._check_fitted()
        return self._alphas

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        kernel, vectors, coefficients, intercept = self._kernel_alone(), self.support_vectors_, self.dual_coef_, self.intercept_

        def score(x: np.ndarray) -> dict[str, np.ndarray]:
            return {"rawPrediction": kernel(x, vectors) @ coefficients + intercept}

        out = score_rows(df, self._width(df), score, "rawPrediction double")
        return out.withColumn("prediction", by_sign(F.col("rawPrediction"), 1, 0))

    predict = decision_function = transform


def _rbf(a, b, length_scale, signal_var, **_):
    return signal_var * np.exp(-(distances(a, b, "euclidean") ** 2) / (2 * length_scale**2))


def _matern52(a, b, length_scale, signal_var, **_):
    z = np.sqrt(5) * distances(a, b, "euclidean") / length_scale
    return signal_var * (1 + z + z**2 / 3) * np.exp(-z)


def _periodic(a, b, length_scale, signal_var, period, **_):
    return signal_var * np.exp(-2 * np.sin(np.pi * distances(a, b, "euclidean") / period) ** 2 / length_scale**2)


def _linear(a, b, signal_var, bias, **_):
    return signal_var * (a @ b.T) + bias


GP_KERNELS = {"rbf": _rbf, "matern52": _matern52, "periodic": _periodic, "linear": _linear}


class GaussianProcessRegressor(Estimator):
    """Exact regression; a callable kernel gets the two matrices.

    Up to LOCAL_ROWS rows there is one Cholesky factor of them all. More rows stay where they are: with K = F F', the sums F'F and F'y of one pass
    are enough, and x_train_ and factor_ are those of F's pivots.
    """

    max_rows = LOCAL_ROWS

    def __init__(
        self, kernel: str | Callable = "rbf", *, length_scale: float = 1.0, signal_var: float = 1.0, noise_var: float = 1e-3,
        period: float = 1.0, bias: float = 0.0
    ) -> None:
        if not callable(kernel) and kernel not in GP_KERNELS:
            raise ValueError(f"kernel is callable or one of {sorted(GP_KERNELS)}")
        if noise_var < 0:
            raise ValueError("noise_var must not be negative")
        self.kernel, self.noise_var = kernel, noise_var
        self.parameters = {"length_scale": length_scale, "signal_var": signal_var, "period": period, "bias": bias}

    def __repr__(self) -> str:
        return f"GaussianProcessRegressor(kernel={self.kernel!r}, {', '.join(f'{k}={v}' for k, v in self.parameters.items())}, noise_var={self.noise_var})"

    def _k(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.kernel(a, b) if callable(self.kernel) else GP_KERNELS[self.kernel](a, b, **self.parameters)

    def fit(self, df: DataFrame, features, label: str, id_col: str):
        self.features = features
        own = Features(df, features)
        self.n_features_in_, self.inner_ = len(own), None
        rows = df.where(own.known & F.col(label).isNotNull())
        if rows.limit(self.max_rows + 1).count() > self.max_rows:
            return self._fit_in_passes(rows, own, label)
        _, self.x_train_, y = local_rows(df, own, id_col, label, LOCAL_ROWS)
        self.y_train_ = y.astype(float)
        self.factor_ = np.linalg.cholesky(self._k(self.x_train_, self.x_train_) + self.noise_var * np.eye(len(y)))
        self.alpha_ = np.linalg.solve(self.factor_.T, np.linalg.solve(self.factor_, self.y_train_))
        self._fitted = True
        return self

    def _fit_in_passes(self, df: DataFrame, own: Features, label: str):
        if self.noise_var <= 0:
            raise ValueError(f"more than {self.max_rows} rows need a positive noise_var")
        rows = cut(df.select(own.vector.alias("x"), F.col(label).cast("double").alias("y")), "gaussian-rows")
        factor = kernel_factor(rows, len(own), self._k)
        r = len(factor.pivots)

        def work(both: np.ndarray) -> np.ndarray:
            total = np.zeros((r + 1) * (r + 1) + 1)
            for at in range(0, len(both), 2048):
                x, y = both[at : at + 2048, :-1], both[at : at + 2048, -1:]
                f = np.concatenate((factor.rows(x), y), axis=1)
                total += np.append((f.T @ f).ravel(), len(x))
            return total

        sums = wide_sums(rows, F.concat("x", F.array("y")), (r + 1) * (r + 1) + 1, work)
        n, sums = sums[-1], sums[:-1].reshape(r + 1, r + 1)
        self.inner_ = np.linalg.cholesky(sums[:r, :r] + self.noise_var * np.eye(r))
        weights = np.linalg.solve(self.inner_.T, np.linalg.solve(self.inner_, sums[:r, r]))
        self.x_train_, self.factor_, self.y_train_ = factor.pivots, factor.factor, None
        self.alpha_ = np.linalg.solve(self.factor_.T, weights)
        determinant = (n - r) * np.log(self.noise_var) + 2 * np.log(np.diag(self.inner_)).sum()
        self.log_likelihood_ = float(-0.5 * ((sums[r, r] - sums[:r, r] @ weights) / self.noise_var + determinant + n * np.log(2 * np.pi)))
        self._fitted = True
        return self

    def _unexplained(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """v with k(x, x) - v'v the covariance, and what has to be added to it, from kernels with the training rows or pivots."""
        v = solve_lower(self.factor_, k.T)
        return v, (np.sqrt(self.noise_var) * solve_lower(self.inner_, v) if self.inner_ is not None else np.zeros((1, v.shape[1])))

    def kernel_times(self, df: DataFrame, values: str, id_col: str) -> DataFrame:
        """`df` with `product`, the row's kernels with all rows of `df` times their `values`."""
        self._check_fitted()
        own = self._width(df)
        if self.inner_ is None:
            _, points, a = local_rows(df, own, id_col, values, LOCAL_ROWS)
            return score_rows(df, own, lambda x: {"product": self._k(x, points) @ a.astype(float)}, "product double")
        known = df.where(own.known & F.col(values).isNotNull()).select(F.concat(own.vector, F.array(F.col(values).cast("double"))).alias("both"))
        sums = wide_sums(known, F.col("both"), len(self.x_train_), lambda both: solve_lower(self.factor_, self._k(self.x_train_, both[:, :-1])) @ both[:, -1])
        weights = np.linalg.solve(self.factor_.T, sums)
        return score_rows(df, own, lambda x: {"product": self._k(x, self.x_train_) @ weights}, "product double")

    def transform(self, df: DataFrame, return_std: bool = False, return_cov: bool = False, id_col: str = "id"):
        """`df` with prediction and, with `return_std`, std; with `return_cov` what `predict_cov` gives."""
        self._check_fitted()
        if return_std and return_cov:
            raise ValueError("return_std and return_cov exclude each other")
        if return_cov:
            return self.predict_cov(df, id_col)

        def score(x: np.ndarray) -> dict[str, np.ndarray]:
            k = self._k(x, self.x_train_)
            out = {"prediction": k @ self.alpha_}
            if return_std:
                v, more = self._unexplained(k)
                own = np.array([self._k(r[None], r[None])[0, 0] for r in x])
                out["std"] = np.sqrt(np.maximum(np.maximum(own - (v * v).sum(axis=0), 0) + (more * more).sum(axis=0), 0))
            return out

        return score_rows(df, self._width(df), score, "prediction double" + ", std double" * return_std)

    predict = transform

    def predict_cov(self, df: DataFrame, id_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, mean, covariance) of at most LOCAL_ROWS rows."""
        self._check_fitted()
        ids, x, _ = local_rows(df, self._width(df), id_col, most=LOCAL_ROWS)
        k = self._k(x, self.x_train_)
        v, more = self._unexplained(k)
        return ids, k @ self.alpha_, self._k(x, x) - v.T @ v + more.T @ more

    def sample_y(self, df: DataFrame, id_col: str, n_samples: int = 1, random_state: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, samples): draws from the posterior, a column each."""
        ids, mean, covariance = self.predict_cov(df, id_col)
        factor = np.linalg.cholesky(covariance + 1e-9 * np.eye(len(mean)))
        return ids, mean[:, None] + factor @ np.random.default_rng(random_state).standard_normal((len(mean), n_samples))

    def _likelihood(self, x: np.ndarray, y: np.ndarray) -> float:
        factor = np.linalg.cholesky(self._k(x, x) + self.noise_var * np.eye(len(y)))
        z = np.linalg.solve(factor, y)
        return float(-0.5 * z @ z - np.log(np.diag(factor)).sum() - 0.5 * len(y) * np.log(2 * np.pi))

    def log_marginal_likelihood(self, df: DataFrame | None = None, features=None, label: str | None = None, id_col: str = "id") -> float:
        """That of the fitted rows, or of the rows of `df`, which leaves the fit as it is."""
        if df is None and label is None:
            self._check_fitted()
            return self._likelihood(self.x_train_, self.y_train_) if self.inner_ is None else self.log_likelihood_
        if df is None or label is None:
            raise ValueError("rows and label go together")
        own = Features(df, features if features is not None else self.features)
        _, x, y = local_rows(df, own, id_col, label, LOCAL_ROWS)
        return self._likelihood(x, y.astype(float))

    def score(self, df: DataFrame, label: str) -> float:
        """R squared; 1 where the label has no spread."""
        row = self.transform(df).select(F.sum((F.col(label) - F.col("prediction")) ** 2), F.count(label) * F.var_pop(F.col(label).cast("double"))).first()
        return 1.0 if not row[1] else float(1 - row[0] / row[1])
