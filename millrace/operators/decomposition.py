"""Decompositions: PCA, discriminant analysis, ICA, NMF and t-SNE. Fits read sums over rows; the d x d algebra is the driver's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.core import LOCAL_ROWS, Estimator, Features, local_rows, partition_sums, score_rows, wide_sums
from millrace.functions.expr import linear_form, softmax
from millrace.plans.fields import Lattice, charges_of, step_of, together
from millrace.plans.moments import gram
from millrace.plans.pairs import distances
from millrace.plans.pivots import nearest
from millrace.plans.scan import ranked
from millrace.storage import cut, ship


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Rows with their largest entry positive, so results don't depend on the eigensolver."""
    top = np.abs(vectors).argmax(axis=1)
    return vectors * np.where(vectors[np.arange(len(vectors)), top] < 0, -1.0, 1.0)[:, None]


class _Projection(Estimator):
    """Output: `components`, an array; as many expressions as components."""

    def _project(self, df: DataFrame, weights: np.ndarray, shift: np.ndarray) -> DataFrame:
        """`df` with (x - shift) @ weights.T."""
        columns = self._width(df).columns
        return df.withColumn("components", F.array(*[linear_form(columns, w, -float(w @ shift)) for w in weights]))

    def _back(self, df: DataFrame, weights: np.ndarray, shift: np.ndarray, column: str) -> DataFrame:
        """`df` with components @ weights + shift as `restored`."""
        parts = [F.get(column, F.lit(k)) for k in range(weights.shape[0])]
        return df.withColumn("restored", F.array(*[linear_form(parts, weights[:, j], float(shift[j])) for j in range(weights.shape[1])]))


class PCA(_Projection):
    """Eigenvectors of the sample covariance; each with its largest loading positive.

    The solver "full" takes the covariance of all features in one pass. "randomized", for thousands of features and few components, finds the range of
    the covariance by powers of it on random vectors (Halko, Martinsson and Tropp, 2011): n_power + 3 passes that each leave sums of features
    times (components + OVERSAMPLE) numbers; then covariance_ is None.
    """

    OVERSAMPLE = 10

    def __init__(self, n_components: int | None = None, solver: str = "full", n_power: int = 4, random_state: int | None = None) -> None:
        if solver not in ("full", "randomized") or (solver == "randomized" and not n_components):
            raise ValueError("solver is 'full', or 'randomized' with a number of components")
        self.n_components, self.solver, self.n_power, self.random_state = n_components, solver, n_power, random_state

    def _in_range(self, rows: DataFrame, own: Features) -> PCA:
        d = len(own)
        first = wide_sums(rows, own.vector, 1 + 2 * d, lambda x: np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0))))
        n = first[0]
        if n < 2:
            raise ValueError("PCA needs two rows")
        self.mean_, width = first[1 : 1 + d] / n, min(d, self.n_components + self.OVERSAMPLE)
        total = float((first[1 + d :] - n * self.mean_**2).sum() / (n - 1))

        def times_covariance(q: np.ndarray) -> np.ndarray:
            shift = self.mean_ @ q
            sums = wide_sums(rows, own.vector, d * width, lambda x: x.T @ (x @ q - shift)).reshape(d, width)
            return sums / (n - 1)  # the centred products sum to 0, so x need not be centred as well

        q = np.linalg.qr(np.random.default_rng(self.random_state or 0).standard_normal((d, width)))[0]
        for _ in range(self.n_power + 1):
            q = np.linalg.qr(times_covariance(q))[0]
        small = q.T @ times_covariance(q)
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")[: min(self.n_components, d)]
        self.covariance_, self.components_, self.n_components_ = None, _signed((q @ vectors[:, order]).T), len(order)
        self.explained_variance_ = values[order]
        self.explained_variance_ratio_ = values[order] / total if total > 0 else np.zeros(len(order))
        self._fitted = True
        return self

    def fit(self, df: DataFrame, features, label=None, id_col=None) -> PCA:
        self.features = features
        own = Features(df, features)
        self.n_features_in_ = d = len(own)
        if self.solver == "randomized":
            return self._in_range(df.where(own.known), own)
        g = gram(df, own)
        n = g[0, 0]
        if n < 2:
            raise ValueError("PCA needs two rows")
        self.mean_ = g[0, 1:] / n
        covariance = (g[1:, 1:] - n * np.outer(self.mean_, self.mean_)) / (n - 1)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[: min(self.n_components or d, d)]
        self.covariance_, self.components_ = covariance, _signed(vectors.T[order])
        self.n_components_ = len(order)
        self.explained_variance_ = values[order]
        total = values.sum()
        self.explained_variance_ratio_ = values[order] / total if total > 0 else np.zeros(len(order))
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        return self._project(df, self.components_, self.mean_)

    def inverse_transform(self, df: DataFrame, column: str = "components") -> DataFrame:
        self._check_fitted()
        return self._back(df, self.components_, self.mean_, column)


class LinearDiscriminantAnalysis(_Projection):
    """Fisher's discriminants; scores are log prior less half the squared distance to the class means in the projection."""

    def __init__(self, n_components: int | None = None, solver: str = "eigen", tol: float = 1e-4, priors=None) -> None:
        if solver not in ("eigen", "svd"):
            raise ValueError("solver is 'eigen' or 'svd'")
        self.n_components, self.solver, self.tol, self.priors = n_components, solver, tol, priors

    def statistics(self, df: DataFrame, features, label: str, by: str | None = None) -> dict:
        """(classes, rows and sums of each class, products of all rows) of each value of `by`, or of all rows under None."""
        own = Features(df, features)
        d, rows = len(own), df.where(own.known & F.col(label).isNotNull())
        names = rows.select(*([by] if by else []), label).distinct().collect()  # a row for each class and value of `by`
        classes = sorted({r[label] for r in names})
        keys = sorted({r[by] for r in names}) if by else [None]
        k = len(classes)
        if not k:
            return {key: ([], np.zeros(0), np.zeros((0, d)), np.zeros((d, d))) for key in keys}
        code = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1).cast("int")
        part = (F.array_position(F.array(*[F.lit(c) for c in keys]), F.col(by)) - 1).cast("int") if by else F.lit(0)

        def work(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> np.ndarray:
            out = np.zeros((len(keys), k + k * d + d * d))
            for j in range(len(keys)):
                own = x[part == j]
                hot = np.eye(k)[y[part == j].astype(int)]
                out[j] = np.concatenate((hot.sum(0), (hot.T @ own).ravel(), (own.T @ own).ravel()))
            return out

        sums = partition_sums(rows, [own.vector, code, part], work).reshape(len(keys), -1)
        return {key: (classes, s[:k], s[k : k + k * d].reshape(k, d), s[k + k * d :].reshape(d, d)) for key, s in zip(keys, sums)}

    def fit(self, df: DataFrame, features, label: str, id_col=None) -> LinearDiscriminantAnalysis:
        return self.fit_statistics(features, [self.statistics(df, features, label)[None]])

    def fit_statistics(self, features, parts: list[tuple]) -> LinearDiscriminantAnalysis:
        """Fit on the rows of all parts, given by their statistics, which have the same classes."""
        counts, totals, xx = (np.sum([p[j] for p in parts], axis=0) for j in (1, 2, 3))
        here = counts > 0
        self.features, self.n_features_in_ = features, len(xx)
        self.classes_ = [c for c, has in zip(parts[0][0], here) if has]
        counts, totals, k, d = counts[here], totals[here], int(here.sum()), len(xx)
        if k < 2:
            raise ValueError("there must be two classes")
        n = counts.sum()
        priors = counts if self.priors is None else np.asarray(self.priors, dtype=float)
        if len(priors) != k:
            raise ValueError(f"{len(priors)} priors for {k} classes")
        self.priors_ = priors / priors.sum()
        self.means_ = totals / counts[:, None]
        self.xbar_ = self.priors_ @ self.means_
        within = xx - (self.means_.T * counts) @ self.means_
        spread = self.means_ - self.xbar_
        most = min(k - 1, d)
        self.n_components_ = min(self.n_components or most, most)
        if self.solver == "eigen":
            between = (spread.T * counts) @ spread
            values, vectors = np.linalg.eig(np.linalg.solve(within + self.tol * np.eye(d), between))
            order = np.argsort(-values.real, kind="stable")[: self.n_components_]
            self.scalings_, values = _signed(vectors.real[:, order].T), values.real
        else:  # whiten the within-class rows by their singular values, then those of the class means
            values_w, axes = np.linalg.eigh(within)
            keep = values_w > self.tol**2 * values_w.max()  # a singular value counts by its share of the largest
            white = axes[:, keep] / np.sqrt(values_w[keep])
            _, s, turn = np.linalg.svd((np.sqrt(counts)[:, None] * spread) @ white, full_matrices=False)
            self.scalings_, values = _signed((white @ turn.T[:, : self.n_components_]).T), s**2
        values = np.sort(np.maximum(values, 0))[::-1]
        total, values = values.sum(), values[: self.n_components_]
        self.explained_variance_ratio_ = values / total if total > 0 else np.zeros_like(values)
        self.components_ = self.scalings_
        self._class_points = (self.means_ - self.xbar_) @ self.scalings_.T
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with components, rawPrediction, probability and prediction."""
        self._check_fitted()
        out = self._project(df, self.scalings_, self.xbar_).withColumn("rawPrediction", self._scores(F.col("components")))
        return out.withColumn("probability", softmax(F.col("rawPrediction"))).withColumn("prediction", self._best(F.col("rawPrediction")))

    def _scores(self, components: Column) -> Column:
        scores: list[Column] = []
        for prior, point in zip(self.priors_, self._class_points):
            score = F.lit(float(np.log(prior)))
            for j, p in enumerate(point):
                gap = F.get(components, F.lit(j)) - float(p)
                score = score - 0.5 * gap * gap
            scores.append(score)
        return F.array(*scores)

    def _best(self, scores: Column) -> Column:
        place = (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
        return F.get(F.array(*[F.lit(c) for c in self.classes_]), place)

    def prediction(self, df: DataFrame) -> Column:
        """The prediction as one expression."""
        self._check_fitted()
        columns = self._width(df).columns
        return self._best(self._scores(F.array(*[linear_form(columns, w, -float(w @ self.xbar_)) for w in self.scalings_])))

    predict = predict_proba = transform


class FastICA(_Projection):
    """Independent components by fixed-point steps, each one pass over the rows; E[g'] is one number for all components."""

    def __init__(
        self, n_components: int | None = None, algorithm: str = "parallel", fun: str = "logcosh", fun_alpha: float = 1.0,
        max_iter: int = 200, tol: float = 1e-4, whiten: bool = True, random_state: int | None = None
    ) -> None:
        if algorithm not in ("parallel", "deflation") or fun not in ("logcosh", "exp", "cube"):
            raise ValueError("algorithm 'parallel' or 'deflation' and fun 'logcosh', 'exp' or 'cube' are required")
        self.n_components, self.algorithm, self.fun, self.fun_alpha = n_components, algorithm, fun, fun_alpha
        self.max_iter, self.tol, self.whiten, self.random_state = max_iter, tol, whiten, random_state

    def _contrast(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.fun == "logcosh":
            g = np.tanh(self.fun_alpha * u)
            return g, self.fun_alpha * (1 - g**2)
        if self.fun == "exp":
            e = np.exp(-(u**2) / 2)
            return u * e, (1 - u**2) * e
        return u**3, 3 * u**2

    def fit(self, df: DataFrame, features, label=None, id_col=None) -> FastICA:
        self.features = features
        own = Features(df, features)
        self.n_features_in_ = d = len(own)
        c = min(self.n_components or d, d)
        g = gram(df, own)
        n = g[0, 0]
        self.mean_ = g[0, 1:] / n
        if self.whiten:
            values, vectors = np.linalg.eigh((g[1:, 1:] - n * np.outer(self.mean_, self.mean_)) / (n - 1))
            order = np.argsort(-values)[:c]
            self.whitening_ = vectors[:, order].T / np.sqrt(np.maximum(values[order], 1e-12))[:, None]
        else:
            self.whitening_ = np.eye(d)[:c]
        rows = df.where(own.known).select(own.vector.alias("x")).persist()

        def moments(w: np.ndarray) -> tuple[np.ndarray, float]:
            def work(x: np.ndarray) -> np.ndarray:
                z = (x - self.mean_) @ self.whitening_.T
                value, slope = self._contrast(z @ w.T)
                return np.concatenate(([len(x), slope.sum()], (value.T @ z).ravel()))

            sums = partition_sums(rows, [F.col("x")], work)
            return sums[2:].reshape(len(w), c) / sums[0], sums[1] / (sums[0] * len(w))

        def settle(w: np.ndarray, tidy: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
            """Steps from the rows of `w`, each tidied up to be orthonormal, until no row turns any more."""
            w = tidy(w)
            for self.n_iter_ in range(1, self.max_iter + 1):
                first, slope = moments(w)
                w, before = tidy(first - slope * w), w
                if np.abs(np.abs((w * before).sum(axis=1)) - 1).max() < self.tol:
                    break
            return w

        start = np.random.default_rng(self.random_state).standard_normal((c, c))
        try:
            if self.algorithm == "parallel":
                w = settle(start, _orthogonal)
            else:  # a row at a time, kept off the rows before it
                w = np.zeros((0, c))
                for row in start:
                    w = np.vstack([w, settle(row[None], lambda v, w=w: _unit(v - (v @ w.T) @ w))])
        finally:
            rows.unpersist()
        self.components_ = w @ self.whitening_
        self.mixing_ = np.linalg.pinv(self.components_)
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        return self._project(df, self.components_, self.mean_)

    def inverse_transform(self, df: DataFrame, column: str = "components") -> DataFrame:
        self._check_fitted()
        return self._back(df, self.mixing_.T, self.mean_, column)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _orthogonal(w: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(w @ w.T)
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T @ w


class NMF(_Projection):
    """X = W H with no negative entries, by multiplicative updates (frobenius or kl) or alternating least squares.

    H is the driver's; a row's W follows from its features and H, by `inner` updates from the row's mean. So no W is held
    anywhere: each step is one pass that replays W in the partitions. A penalty takes l1 off an updated factor and divides it by
    1 + l2; in least squares l2 is added to the diagonal. No entry falls below eps. reconstruction_err_ is the Frobenius norm of X - W H.
    """

    def __init__(
        self, n_components: int = 2, solver: str = "mu", beta_loss: str = "frobenius", max_iter: int = 200, tol: float = 1e-4,
        random_state: int | None = None, l1_reg_W: float = 0.0, l1_reg_H: float = 0.0, l2_reg_W: float = 0.0, l2_reg_H: float = 0.0,  # noqa: N803
        eps: float = 1e-10, inner: int = 20,
    ) -> None:
        if solver not in ("mu", "als") or beta_loss not in ("frobenius", "kl") or n_components < 1:
            raise ValueError("n_components >= 1, solver 'mu' or 'als' and beta_loss 'frobenius' or 'kl' are required")
        if solver == "als" and beta_loss == "kl":
            raise ValueError("least squares has the frobenius loss only")
        self.n_components, self.solver, self.beta_loss, self.max_iter, self.tol = n_components, solver, beta_loss, max_iter, tol
        self.random_state, self.eps, self.inner = random_state, eps, inner
        self.l1_reg_W, self.l1_reg_H, self.l2_reg_W, self.l2_reg_H = l1_reg_W, l1_reg_H, l2_reg_W, l2_reg_H

    def _penalised(self, factor: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.maximum((factor - l1) / (1 + l2), self.eps)

    def _solved(self, square: np.ndarray, target: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.maximum(np.linalg.solve(square + (l2 + self.eps) * np.eye(len(square)), target) - l1, self.eps)

    def _rows(self, x: np.ndarray, h: np.ndarray, steps: int, kl: bool = False, plain: bool = False) -> np.ndarray:
        """W of rows for a given H; `plain` takes no penalties."""
        l1, l2 = (0.0, 0.0) if plain else (self.l1_reg_W, self.l2_reg_W)
        if self.solver == "als" and not plain:
            return self._solved(h @ h.T, h @ x.T, l1, l2).T
        w = np.repeat(np.sqrt(np.maximum(x.mean(axis=1, keepdims=True), self.eps) / len(h)), len(h), axis=1)
        for _ in range(steps):
            if kl:
                w = np.maximum(w * ((x / (w @ h + self.eps)) @ h.T) / (h.sum(axis=1) + self.eps), self.eps)
            else:
                w = self._penalised(w * (x @ h.T) / (w @ (h @ h.T) + self.eps), l1, l2)
        return w

    def fit(self, df: DataFrame, features, label=None, id_col=None) -> NMF:
        self.features = features
        own = Features(df, features)
        self.n_features_in_ = d = len(own)
        k, kl = self.n_components, self.beta_loss == "kl"
        rows = df.where(own.known).select(own.vector.alias("x")).persist()
        try:
            least, mean = rows.select(F.min(F.array_min("x")), F.avg(F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / d)).first()
            if least is None or least < 0:
                raise ValueError("NMF needs rows without negative values")
            h = np.random.default_rng(self.random_state).uniform(0, 2, (k, d)) * np.sqrt(max(mean, self.eps) / k) + self.eps
            for self.n_iter_ in range(1, self.max_iter + 1):
                def work(x: np.ndarray, h=h) -> np.ndarray:
                    w = self._rows(x, h, self.inner, kl)
                    miss = ((x - w @ h) ** 2).sum()[None]
                    if kl:
                        return np.concatenate((miss, (w.T @ (x / (w @ h + self.eps))).ravel(), w.sum(axis=0)))
                    return np.concatenate((miss, (w.T @ x).ravel(), (w.T @ w).ravel()))

                sums = partition_sums(rows, [F.col("x")], work)
                error, wx, rest = float(np.sqrt(sums[0])), sums[1 : 1 + k * d].reshape(k, d), sums[1 + k * d :]
                self.components_, before = h, getattr(self, "reconstruction_err_", None) if self.n_iter_ > 1 else None
                self.reconstruction_err_ = error
                if before is not None and abs(before - error) < self.tol * (before + self.eps):
                    break
                if kl:
                    h = np.maximum(h * wx / (rest[:, None] + self.eps), self.eps)
                elif self.solver == "als":
                    h = self._solved(rest.reshape(k, k), wx, self.l1_reg_H, self.l2_reg_H)
                else:
                    h = self._penalised(h * wx / (rest.reshape(k, k) @ h + self.eps), self.l1_reg_H, self.l2_reg_H)
        finally:
            rows.unpersist()
        self.n_components_, self._fitted = k, True
        return self

    def fit_transform(self, df: DataFrame, features, label=None, id_col=None) -> DataFrame:
        """`df` with `components`, the rows of W that the fit ended with."""
        self.fit(df, features)
        last, kl = self.components_, self.beta_loss == "kl"
        return score_rows(df, self._width(df), lambda x: {"components": self._rows(x, last, self.inner, kl)}, "components array<double>")

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with `components`, the non-negative least squares solution for the fitted H by 100 updates."""
        self._check_fitted()
        return score_rows(df, self._width(df), lambda x: {"components": self._rows(x, self.components_, 100, plain=True)}, "components array<double>")

    def inverse_transform(self, df: DataFrame, column: str = "components") -> DataFrame:
        self._check_fitted()
        return self._back(df, self.components_, np.zeros(self.components_.shape[1]), column)


class TSNE(Estimator):
    """Exact t-SNE.

    Up to LOCAL_ROWS rows are in one place, where each step meets all pairs. Of more the executors keep the affinities above the floor of 1e-12, by row, found
    among nearest neighbours so many that the rest weighs nothing in any row's sum, equal rows being one neighbour with their number; a step sends the
    places of all rows, `n_components` numbers each, and brings back the next. What all rows do to each other is summed in the plane over a lattice
    (plans/fields.py, to some 1e-10), so a step's work grows with the rows and their affinities. Where the plane is too wide for a lattice, or there are not
    two components, a step meets all pairs.

    `divergence_after` names numbers of steps after which the divergence is wanted on the way: `divergences_`.
    """

    max_rows, FLOOR = LOCAL_ROWS, 1e-12

    def __init__(
        self, n_components: int = 2, perplexity: float = 30.0, learning_rate: float | str = 200.0, n_iterations: int = 1000,
        early_exaggeration: float = 12.0, exaggeration_iter: int = 250, momentum: float = 0.5, final_momentum: float = 0.8,
        momentum_switch_iter: int = 250, min_gain: float = 0.01, random_state: int | None = None, divergence_after: tuple[int, ...] = ()
    ) -> None:
        self.divergence_after = divergence_after
        self.n_components, self.perplexity, self.learning_rate, self.n_iterations = n_components, perplexity, learning_rate, n_iterations
        self.early_exaggeration, self.exaggeration_iter, self.momentum, self.final_momentum = early_exaggeration, exaggeration_iter, momentum, final_momentum
        self.momentum_switch_iter, self.min_gain, self.random_state = momentum_switch_iter, min_gain, random_state

    @staticmethod
    def row_affinities(square: np.ndarray, entropy: float, steps: int = 50, tol: float = 1e-5) -> np.ndarray:
        """Conditional affinities of a row from its squared distances to the others, at the given entropy: bisection of the precision."""
        low, high, beta = 0.0, np.inf, 1.0
        for _ in range(steps):
            p = np.exp(-(square - square.min()) * beta)
            total = p.sum()
            p /= total
            h = -(p * np.log(np.maximum(p, 1e-300))).sum()
            if abs(h - entropy) < tol:
                break
            if h > entropy:
                low, beta = beta, beta * 2 if np.isinf(high) else (beta + high) / 2
            else:
                high, beta = beta, (low + beta) / 2
        return p

    def fit_transform(self, df: DataFrame, features, label=None, id_col: str = "id") -> DataFrame:
        """(id, components); kl_divergence_ is set."""
        own = Features(df, features)
        known = df.where(own.known).select(F.col(id_col).alias("id"), own.vector.alias("x"))
        if known.limit(self.max_rows + 1).count() > self.max_rows:
            return self._in_passes(known, len(own), id_col)
        ids, x, _ = local_rows(df, own, id_col, most=LOCAL_ROWS)
        n = len(x)
        if n < 2 or self.perplexity >= n:
            raise ValueError("t-SNE needs two rows and more rows than its perplexity")
        square = np.vstack([distances(x[i : i + 64], x, "euclidean") for i in range(0, n, 64)]) ** 2
        p = np.zeros((n, n))
        for i in range(n):
            others = np.arange(n) != i
            p[i, others] = self.row_affinities(square[i, others], np.log(self.perplexity))
        p = np.maximum((p + p.T) / (2 * n), 1e-12)
        rate = max(200.0, n / self.early_exaggeration) if self.learning_rate == "auto" else self.learning_rate

        def divergence_at(y: np.ndarray) -> float:
            return float((p * np.log(p / np.maximum(self._low(y)[0], 1e-12))).sum())

        def moved(scale: float, momentum: float, y: np.ndarray, velocity: np.ndarray, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return self._moved(self._slope(scale * p, y), rate, momentum, y, velocity, gains)

        y = self._descend(n, moved, divergence_at)
        self.embedding_, self.kl_divergence_ = y, divergence_at(y)
        found = [(i.item() if hasattr(i, "item") else i, v.tolist()) for i, v in zip(ids, y)]
        return df.sparkSession.createDataFrame(found, f"{id_col} {dict(df.dtypes)[id_col]}, components array<double>")

    def _moved(
        self, slope: np.ndarray, rate: float, momentum: float, y: np.ndarray, velocity: np.ndarray, gains: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of rows after a step, their velocities and their gains."""
        gains = np.where(slope * velocity > 0, 0.8 * gains, gains + 0.2).clip(min=self.min_gain)
        velocity = momentum * velocity - rate * gains * slope
        return y + velocity, velocity, gains

    def _descend(self, n: int, moved: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]], divergence_at: Callable[[np.ndarray], float]) -> np.ndarray:
        y = np.random.default_rng(self.random_state).normal(0, 1e-4, (n, self.n_components))
        velocity, gains, self.divergences_ = np.zeros_like(y), np.ones_like(y), {}
        for t, (scale, momentum) in enumerate(self._schedule(), 1):
            y, velocity, gains = moved(scale, momentum, y, velocity, gains)
            y = y - y.mean(axis=0)
            if t in self.divergence_after:
                self.divergences_[t] = divergence_at(y)
        return y

    @staticmethod
    def rows_affinities(square: np.ndarray, copies: np.ndarray, entropy: float, steps: int = 50, tol: float = 1e-5) -> np.ndarray:
        """`row_affinities` of many rows at once, to places of which each stands for so many copies."""
        least = np.where(copies > 0, square, np.inf).min(axis=1, keepdims=True)
        low, high, beta = np.zeros(len(square)), np.full(len(square), np.inf), np.ones(len(square))
        out, todo = np.zeros_like(square), np.arange(len(square))
        for _ in range(steps):
            p = np.exp(-np.maximum(square[todo] - least[todo], 0) * beta[todo, None])
            p /= (copies[todo] * p).sum(axis=1, keepdims=True)
            out[todo] = p
            h = -(copies[todo] * p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
            far = np.abs(h - entropy) >= tol
            todo, more = todo[far], (h > entropy)[far]
            if not len(todo):
                break
            now = beta[todo]
            low[todo], high[todo] = np.where(more, now, low[todo]), np.where(more, high[todo], now)
            with np.errstate(invalid="ignore"):
                beta[todo] = np.where(np.isinf(high[todo]), now * 2, (low[todo] + high[todo]) / 2)
        return out

    def _affinities(self, places: DataFrame, d: int, n: int) -> DataFrame:
        """(a, b, p) of the places whose rows have an affinity above the floor, either way round, for places (id, x, value), `value` being the number of their rows."""
        entropy, m = np.log(self.perplexity), places.count()
        k, todo, found = min(m - 1, max(50, int(12 * self.perplexity))), places, None
        while True:
            def work(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
                for whole in batches:
                    for at in range(0, len(whole), 1024):
                        batch = whole.slice(at, 1024)
                        near = batch.column(1).flatten()
                        width = len(near) // len(batch)  # the same for all rows, itself included
                        others, square, copies = (near.field(name).to_numpy().reshape(-1, width) for name in ("id", "distance", "value"))
                        own = others == batch.column(0).to_numpy()[:, None]
                        copies = (copies - own).astype(float)
                        p = TSNE.rows_affinities(square**2, copies, entropy)
                        done = np.full(len(batch), True) if k == m - 1 else p[:, -1] * n < 1e-13
                        p[copies == 0] = 0
                        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), width).cast(pa.list_(t)) for v, t in ((others, pa.int64()), (p, pa.float64()))]
                        yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(done)], names=["a", "b", "p", "whole"])

            near = nearest(todo.select("id", "x"), places, d, k + 1)[0]
            part = cut(near.mapInArrow(work, "a long, b array<long>, p array<double>, whole boolean"), "tsne-near")
            done = part.where("whole").select("a", "b", "p")
            found = done if found is None else found.unionByName(done)
            if not part.where("NOT whole").limit(1).count():
                break
            todo = cut(todo.join(part.where("NOT whole").select(F.col("a").alias("id")), "id"), "tsne-places")
            k = min(m - 1, 4 * k)  # places with many others as near as their last neighbour
        own = found.select("a", F.explode(F.arrays_zip("b", "p")).alias("e")).select("a", F.col("e.b").alias("b"), F.col("e.p").alias("p")).where("p > 0")
        both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"), "p"))
        return cut(both.groupBy("a", "b").agg((F.sum("p") / (2 * n)).alias("p")).where(F.col("p") > self.FLOOR), "tsne-affinities")

    def _blocks(self, numbered: DataFrame, d: int, n: int) -> DataFrame:
        """The affinities of blocks of rows: (i, n, j, p), the rows, how many affinities each has, to which rows, and how large."""
        spark = numbered.sparkSession
        places = cut(numbered.groupBy("x").agg(F.min("i").alias("id"), F.count(F.lit(1)).alias("value")), "tsne-places")
        pairs = self._affinities(places, d, n)
        own = cut(numbered.join(places.select("x", F.col("id").alias("a")), "x").select("i", "a"), "tsne-rows")
        members = own.groupBy(F.col("a").alias("b")).agg(F.collect_list("i").alias("j"))
        lists = pairs.join(members, "b").groupBy("a").agg(F.collect_list(F.struct("p", "j")).alias("near"))
        parts = max(spark.sparkContext.defaultParallelism, n // 20_000)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), 512):
                    batch = whole.slice(at, 512)
                    i, near = batch.column(0).to_numpy(), batch.column(1)
                    groups = near.flatten()
                    per_row = np.nan_to_num(near.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(int)
                    per_group = groups.field("j").value_lengths().to_numpy(zero_copy_only=False)
                    j = groups.field("j").flatten().to_numpy()
                    p, row = np.repeat(groups.field("p").to_numpy(), per_group), np.repeat(np.repeat(np.arange(len(i)), per_row), per_group)
                    other = j != i[row]
                    counts = np.bincount(row[other], minlength=len(i))
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (i, counts, j[other], p[other])], names=["i", "n", "j", "p"])

        rows = own.join(lists, "a", "left").select("i", "near").repartition(parts, "i")
        return cut(rows.mapInArrow(work, "i binary, n binary, j binary, p binary"), "tsne-blocks")

    def _in_passes(self, known: DataFrame, d: int, id_col: str) -> DataFrame:
        spark = known.sparkSession
        ship(spark)
        numbered = cut(ranked(known, [F.col("id")], rank="i").select(F.col("i").cast("long").alias("i"), "id", "x"), "tsne-rows")
        n = numbered.count()
        if n < 2 or self.perplexity >= n:
            raise ValueError("t-SNE needs two rows and more rows than its perplexity")
        blocks = self._blocks(numbered.select("i", "x"), d, n)
        floor, context, c = self.FLOOR, spark.sparkContext, self.n_components
        rate = max(200.0, n / self.early_exaggeration) if self.learning_rate == "auto" else self.learning_rate

        def opened(rows: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            if rows := list(rows):
                i, counts, j = (np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) for k in ("i", "n", "j"))
                yield i, counts, j.astype(np.int32), np.concatenate([np.frombuffer(r.p) for r in rows])

        rows = blocks.rdd.mapPartitions(opened).persist(StorageLevel.MEMORY_AND_DISK)

        def passed(y: np.ndarray, work: Callable[..., tuple], *sent) -> list[tuple]:
            """What `work` gives for the rows of each block."""
            held = context.broadcast((y, *sent))

            def run(blocks: Iterator) -> Iterator[tuple]:
                y, *sent = held.value
                for i, counts, j, p in blocks:
                    yield work(y, i, np.repeat(np.arange(len(i)), counts), j, p, *sent)

            found = rows.mapPartitions(run).collect()
            held.destroy()
            return found

        def charges(y, i, row, j, p, step):
            return charges_of(y[i], step) if c == 2 else None

        def inverse_of(y: np.ndarray, i: np.ndarray) -> np.ndarray:
            norm = (y * y).sum(axis=1)
            inverse = 1 / (1 + np.maximum(norm[i][:, None] + norm[None] - 2 * y[i] @ y.T, 0))
            inverse[np.arange(len(i)), i] = 0
            return inverse

        def pieces(i: np.ndarray) -> Iterator[np.ndarray]:
            for at in range(0, len(i), 128):
                yield i[at : at + 128]

        def totals(y, i, row, j, p):
            return sum(inverse_of(y, own).sum() for own in pieces(i))

        def repulsion(y, i, scale, total):
            for own in pieces(i):
                inverse = inverse_of(y, own)
                weight = (scale * floor - np.maximum(inverse / total, floor)) * inverse
                yield weight.sum(axis=1)[:, None] * y[own] - weight @ y

        def steps(y, i, row, j, p, velocity, gains, scale, momentum, total, field):
            apart = y[i][row] - y[j]
            weight = scale * (p - floor) / (1 + (apart * apart).sum(axis=1))
            slope = np.stack([np.bincount(row, weight * column, len(i)) for column in apart.T], axis=1)
            slope += np.concatenate(list(repulsion(y, i, scale, total))) if field is None else field[0].read(field[1], y[i])
            found = self._moved(4 * slope, rate, momentum, y[i], velocity[i], gains[i])
            return i, *found, charges(found[0], slice(None), row, j, p, step_of(y))

        def nearby(y, i, row, j, p, total):
            """The affinities' part of the divergence, as what they have over the floor."""
            apart = y[i][row] - y[j]
            q = np.log(np.maximum(1 / (1 + (apart * apart).sum(axis=1)) / total, floor))
            return (p * (np.log(p) - q) - floor * (np.log(floor) - q)).sum()

        def divergence(y, i, row, j, p, total):
            low = 0.0
            for own in pieces(i):
                inverse = inverse_of(y, own)
                inverse[np.arange(len(own)), own] = total  # of a row with itself nothing counts
                low += np.log(np.maximum(inverse / total, floor)).sum()
            return nearby(y, i, row, j, p, total) + floor * ((len(y) - 1) * len(i) * np.log(floor) - low)

        inverse = lambda x, z: 1 / (1 + x * x + z * z)
        spread = None  # the charges of the places at hand, which a step takes on its way

        def moved(scale: float, momentum: float, y: np.ndarray, velocity: np.ndarray, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            nonlocal spread
            if (charged := spread or together(passed(y, charges, step_of(y)))) is None:
                field, total = None, float(sum(passed(y, totals)))
            else:
                lattice, waves = charged[0], charged[0].waves(charged[1])
                total = lattice.met(waves, inverse) - n

                def weight(x: np.ndarray, z: np.ndarray) -> np.ndarray:
                    near = inverse(x, z)
                    return (scale * floor - np.maximum(near / total, floor)) * near

                field = lattice, lattice.convolved(waves, lambda x, z: weight(x, z) * x, lambda x, z: weight(x, z) * z)
            out = [np.empty_like(y) for _ in range(3)]
            found = passed(y, steps, velocity, gains, scale, momentum, total, field)
            for i, *values, _ in found:
                for whole, own in zip(out, values):
                    whole[i] = own
            if spread := together([part[-1] for part in found]):
                spread[0].origin = out[0].mean(axis=0)  # which is taken off the places
            return tuple(out)

        def divergence_at(y: np.ndarray) -> float:
            if (charged := together(passed(y, charges, step_of(y)))) is None:
                return float(sum(passed(y, divergence, float(sum(passed(y, totals))))))
            lattice, waves = charged[0], charged[0].waves(charged[1])
            total = lattice.met(waves, inverse) - n
            low = lattice.met(waves, lambda x, z: np.log(np.maximum(inverse(x, z) / total, floor))) + n * np.log(total)  # without the rows themselves
            return float(sum(passed(y, nearby, total))) + floor * (n * (n - 1) * np.log(floor) - low)

        try:
            y = self._descend(n, moved, divergence_at)
            self.embedding_, self.kl_divergence_ = y, divergence_at(y)
        finally:
            rows.unpersist()
        places = spark.createDataFrame(pa.table({"i": np.arange(n), "components": pa.array(y.tolist(), pa.list_(pa.float64()))}))
        return numbered.select("i", F.col("id").alias(id_col)).join(places, "i").select(id_col, "components")

    def _schedule(self) -> Iterator[tuple[float, float]]:
        """(exaggeration, momentum) of each step."""
        for t in range(self.n_iterations):
            yield self.early_exaggeration if t < self.exaggeration_iter else 1.0, self.momentum if t < self.momentum_switch_iter else self.final_momentum

    def _slope(self, p: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The gradient of the divergence, as the Laplacian of the pull between the points times the points."""
        q, inverse = self._low(y)
        laplacian = (q - p) * inverse
        laplacian[np.diag_indices(len(y))] -= laplacian.sum(axis=1)
        return 4 * laplacian @ y

    @staticmethod
    def _low(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = (y * y).sum(axis=1)
        inverse = 1 / (1 + np.maximum(s[:, None] + s[None] - 2 * y @ y.T, 0))
        np.fill_diagonal(inverse, 0.0)
        return np.maximum(inverse / inverse.sum(), 1e-12), inverse
