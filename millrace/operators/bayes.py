"""Naive Bayes: one grouped aggregate to fit, one expression for each class to score."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.core import Estimator, Features
from millrace.functions.expr import linear_form, softmax


class _Bayes(Estimator):
    """Output: rawPrediction (joint log-likelihood of each class), probability and prediction. Classes are sorted."""

    def _functions(self) -> list:
        """What is aggregated of every feature."""
        raise NotImplementedError

    @staticmethod
    def _merge(n: int, own: list, m: int, other: list) -> list:
        """The aggregates of n and m rows together: sums, unless a class says otherwise."""
        return [[a + b for a, b in zip(x, y)] for x, y in zip(own, other)]

    def statistics(self, df: DataFrame, features, label: str, by: str | None = None) -> dict:
        """{class: (rows, aggregates)} of each value of `by`, or of all rows under None, in one pass."""
        own = Features(df, features)
        parts = [f(c).alias(f"f{j}_{i}") for i, c in enumerate(own.columns) for j, f in enumerate(self._functions())]
        rows = df.where(own.known & F.col(label).isNotNull()).groupBy(*([by] if by else []), label).agg(F.count(F.lit(1)).alias("__n"), *parts).collect()
        found: dict = {} if by else {None: {}}
        for r in rows:
            sums = [[r[f"f{j}_{i}"] for i in range(len(own))] for j in range(len(self._functions()))]
            found.setdefault(r[by] if by else None, {})[r[label]] = (r["__n"], sums)
        return found

    def fit(self, df: DataFrame, features, label: str, id_col: str | None = None):
        return self.fit_statistics(features, [self.statistics(df, features, label)[None]])

    def fit_statistics(self, features, parts: list[dict]):
        """Fit on the rows of all parts, given by their statistics."""
        whole: dict = {}
        for part in parts:
            for name, (n, own) in part.items():
                m, held = whole.get(name, (0, None))
                whole[name] = (n, own) if held is None else (m + n, self._merge(m, held, n, own))
        if not whole:
            raise ValueError("there are no rows to fit on")
        self.features, self.classes_ = features, sorted(whole)
        self.class_count_ = [whole[c][0] for c in self.classes_]
        total = sum(self.class_count_)
        self.class_log_prior_ = [math.log(n / total) for n in self.class_count_]
        self._sums = [list(rows) for rows in zip(*(whole[c][1] for c in self.classes_))]
        self.n_features_in_ = len(self._sums[0][0])
        self._solve()
        self._fitted = True
        return self

    def _solve(self) -> None:
        """Set the parameters from the aggregates, by class, in `_sums`."""
        raise NotImplementedError

    def _log_likelihoods(self, own: Features) -> list[Column]:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        scores = F.array(*self._log_likelihoods(self._width(df)))
        out = df.withColumn("rawPrediction", scores).withColumn("probability", softmax(F.col("rawPrediction")))
        return out.withColumn("prediction", self._best(F.col("rawPrediction")))

    def _best(self, scores: Column) -> Column:
        place = F.array_position(scores, F.array_max(scores)).cast("int") - 1
        return F.get(F.array(*[F.lit(c) for c in self.classes_]), place)

    def prediction(self, df: DataFrame) -> Column:
        """The prediction as one expression."""
        self._check_fitted()
        return self._best(F.array(*self._log_likelihoods(self._width(df))))

    predict = predict_proba = predict_log_proba = transform


class GaussianNB(_Bayes):
    """Normal features; var_smoothing times the largest variance of any class is added to every variance."""

    def __init__(self, var_smoothing: float = 1e-9) -> None:
        self.var_smoothing = var_smoothing

    def _functions(self) -> list:
        return [F.avg, F.var_pop]

    @staticmethod
    def _merge(n: int, own: list, m: int, other: list) -> list:
        both = [(n * a + m * b) / (n + m) for a, b in zip(own[0], other[0])]
        apart = [n * m * (a - b) * (a - b) / (n + m) for a, b in zip(own[0], other[0])]
        return [both, [(n * v + m * w + g) / (n + m) for v, w, g in zip(own[1], other[1], apart)]]

    def _solve(self) -> None:
        self.theta_, variance = self._sums
        self.epsilon_ = self.var_smoothing * max(v for row in variance for v in row)
        self.var_ = self.sigma_ = [[v + self.epsilon_ for v in row] for row in variance]

    def _log_likelihoods(self, own: Features) -> list[Column]:
        out = []
        for prior, mean, variance in zip(self.class_log_prior_, self.theta_, self.var_):
            score = F.lit(prior - 0.5 * sum(math.log(2 * math.pi * v) for v in variance))
            for c, m, v in zip(own.columns, mean, variance):
                score = score - (c - m) * (c - m) / (2 * v)
            out.append(score)
        return out


class MultinomialNB(_Bayes):
    """Counts; feature sums are smoothed by alpha, priors are not."""

    def __init__(self, alpha: float = 1.0) -> None:
        self.alpha = alpha

    def _functions(self) -> list:
        return [F.sum, F.min]

    @staticmethod
    def _merge(n: int, own: list, m: int, other: list) -> list:
        return [[a + b for a, b in zip(own[0], other[0])], [min(a, b) for a, b in zip(own[1], other[1])]]

    def _solve(self) -> None:
        if min(v for row in self._sums[1] for v in row) < 0:
            raise ValueError("features must not be negative")
        smooth = [[s + self.alpha for s in row] for row in self._sums[0]]
        self.feature_log_prob_ = [[math.log(s / sum(row)) for s in row] for row in smooth]

    def _log_likelihoods(self, own: Features) -> list[Column]:
        return [linear_form(own.columns, w, p) for w, p in zip(self.feature_log_prob_, self.class_log_prior_)]


class BernoulliNB(_Bayes):
    """Presence of features: x > binarize (None takes features as they are); absent ones count as well."""

    def __init__(self, alpha: float = 1.0, binarize: float | None = 0.0) -> None:
        self.alpha, self.binarize = alpha, binarize

    def _present(self, x: Column) -> Column:
        return x if self.binarize is None else F.when(x > self.binarize, 1.0).when(x.isNotNull(), 0.0)

    def _functions(self) -> list:
        return [lambda c: F.sum(self._present(c))]

    def _solve(self) -> None:
        self.feature_prob_ = [[(s + self.alpha) / (n + 2 * self.alpha) for s in row] for row, n in zip(self._sums[0], self.class_count_)]
        self.feature_log_prob_ = [[math.log(p) for p in row] for row in self.feature_prob_]

    def _log_likelihoods(self, own: Features) -> list[Column]:
        out = []
        for prior, p in zip(self.class_log_prior_, self.feature_prob_):
            constant = prior + sum(math.log(1 - q) for q in p)
            out.append(linear_form([self._present(c) for c in own.columns], [math.log(q) - math.log(1 - q) for q in p], constant))
        return out
