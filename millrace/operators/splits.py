"""Fold assignment and cross-validation.

A fold is a column: training rows are those with another fold. Fold sizes differ by one at most, larger ones first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.core import Features
from millrace.functions.expr import uniform
from millrace.operators.metrics import accuracy_of
from millrace.plans.scan import ranked
from millrace.storage import cut


def _ntile(df: DataFrame, order: list[Column], n: int, by: str | None, fold: str) -> DataFrame:
    """ntile by counts, within each class if one is given."""
    out = ranked(df, order, by, "__rank", "__rows")
    rank, rows = F.col("__rank"), F.col("__rows")
    small, more = F.floor(rows / n), rows % n
    edge = more * (small + 1)
    large_fold, small_fold = F.floor(rank / (small + 1)), F.floor((rank - edge) / F.greatest(small, F.lit(1))) + more
    return out.withColumn(fold, F.when(rank < edge, large_fold).otherwise(small_fold).cast("int")).drop("__rank", "__rows")


class KFold:
    """Contiguous folds in order of the id, or of a hash of it with `shuffle`."""

    def __init__(self, n_splits: int = 5, shuffle: bool = False, random_state: int | None = None) -> None:
        if n_splits < 2:
            raise ValueError("n_splits must be at least 2")
        self.n_splits, self.shuffle, self.random_state = n_splits, shuffle, random_state

    def get_n_splits(self) -> int:
        return self.n_splits

    def _order(self, id_col: str) -> list[Column]:
        return [*([uniform(self.random_state or 0, F.col(id_col))] if self.shuffle else []), F.col(id_col)]

    def assign(self, df: DataFrame, id_col: str, label: str | None = None, fold: str = "fold") -> DataFrame:
        """`df` with its fold, 0 to n_splits - 1."""
        return _ntile(df, self._order(id_col), self.n_splits, None, fold)

    def split(self, df: DataFrame, id_col: str, label: str | None = None):
        """(training rows, validation rows) of each fold."""
        dealt = cut(self.assign(df, id_col, label, "__fold"), "folds")
        for k in range(self.n_splits):
            yield dealt.where(F.col("__fold") != k).drop("__fold"), dealt.where(F.col("__fold") == k).drop("__fold")


class StratifiedKFold(KFold):
    """Folds within each class, so that each has the share of every class."""

    def assign(self, df: DataFrame, id_col: str, label: str | None = None, fold: str = "fold") -> DataFrame:
        if label is None:
            raise ValueError("a stratified split needs a label")
        return _ntile(df, self._order(id_col), self.n_splits, label, fold)


def cross_val_score(
    estimator, df: DataFrame, features, label: str, id_col: str, cv: int | KFold = 5, scoring: Callable[[str, str], Column] | None = None
) -> np.ndarray:
    """The score of each fold: the aggregate `scoring(label, prediction)`, accuracy by default. An integer `cv` stratifies.

    Estimators whose fit is a function of statistics that add up (naive Bayes, least squares, discriminants) read the rows twice whatever the
    number of folds: once for the statistics of every fold, of which a training set has all but one, and once to score each row by the
    model that has not seen it. Others are fitted fold by fold.
    """
    splitter = StratifiedKFold(cv) if isinstance(cv, int) else cv
    if hasattr(estimator, "fit_statistics") and hasattr(splitter, "assign"):
        return _scores_in_two_passes(estimator, cut(splitter.assign(df, id_col, label, "__fold"), "folds"), features, label, splitter.n_splits, scoring)
    scores = []
    for train, held in splitter.split(df, id_col, label):
        estimator.fit(train, features, label, id_col)
        scores.append(estimator.transform(held).select((scoring or accuracy_of)(label, "prediction")).first()[0])
    return np.array(scores, dtype=float)


def _scores_in_two_passes(estimator, dealt: DataFrame, features, label: str, folds: int, scoring) -> np.ndarray:
    parts = estimator.statistics(dealt, features, label, "__fold")
    prediction = F.lit(None)
    for k in range(folds):
        estimator.fit_statistics(features, [own for fold, own in parts.items() if fold != k])
        prediction = F.when(F.col("__fold") == k, estimator.prediction(dealt)).otherwise(prediction)
    scored = dealt.withColumn("prediction", F.when(Features(dealt, features).known, prediction))
    found = scored.groupBy("__fold").agg((scoring or accuracy_of)(label, "prediction").alias("score")).collect()
    by_fold = {r["__fold"]: r.score for r in found}
    return np.array([by_fold.get(k) for k in range(folds)], dtype=float)
