"""k nearest neighbours. The training rows are the index, searched by pivots; ties go to the smaller id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.core import Estimator, Features
from millrace.plans.pivots import nearest


def _vector(df: DataFrame, own: Features) -> Column:
    """The row's vector; one of floats stays as it is, half as long as doubles where it is exchanged."""
    return F.col(own.array) if own.array and dict(df.dtypes)[own.array] == "array<float>" else own.vector


class _Neighbors(Estimator):
    """Exact by default. With `probes` a row is compared only with the training rows in the cells of its so many nearest pivots: approximate."""

    def __init__(self, k: int = 5, metric: str = "euclidean", weights: str = "uniform", probes: int | None = None) -> None:
        if probes is not None and probes < 1:
            raise ValueError("probes must be at least 1")
        if k < 1:
            raise ValueError("k must be at least 1")
        if weights not in ("uniform", "distance"):
            raise ValueError("weights are 'uniform' or 'distance'")
        self.k, self.metric, self.weights, self.probes = k, metric, weights, probes

    def fit(self, df: DataFrame, features, label: str, id_col: str):
        self.features, self.id_col = features, id_col
        own = Features(df, features)
        self.n_features_in_ = len(own)
        rows = df.where(own.known & F.col(label).isNotNull())
        self.index_ = rows.select(F.col(id_col).alias("id"), _vector(df, own).alias("x"), F.col(label).alias("value"))
        self._fitted = True
        return self

    def kneighbors(self, df: DataFrame) -> DataFrame:
        """(id, near): the k nearest training rows, nearest first. Where they are exchanged, pairs_compared_ is the number of pairs compared."""
        self._check_fitted()
        if self.metric not in ("euclidean", "manhattan"):
            raise ValueError("the metric is 'euclidean' or 'manhattan'")
        own = self._width(df)
        rows = df.where(own.known).select(F.col(self.id_col).alias("id"), _vector(df, own).alias("x"))
        near, self.pairs_compared_ = nearest(rows, self.index_, len(own), self.k, self.metric, self.probes)
        return near

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with its prediction; df's ids are taken to be unique."""
        votes = self.kneighbors(df).select(F.col("id").alias("__id"), self._vote(F.col("near")).alias("prediction"))
        return df.join(votes, df[self.id_col] == votes["__id"], "left").drop("__id")

    predict = transform

    def _vote(self, near: Column) -> Column:
        raise NotImplementedError


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _weight(n: Column) -> Column:
    """1/distance; rows at distance 0, if any, are the only ones that count."""
    return F.when(n["distance"] > 0, 1 / F.nullif(n["distance"], F.lit(0.0))).otherwise(0.0)


class KNNClassifier(_Neighbors):
    """A majority vote; of equal counts the class met first. By distance: the largest sum of weights, of equal ones the smallest class."""

    def _vote(self, near: Column) -> Column:
        exact = F.filter(near, lambda n: n["distance"] == 0)
        if self.weights == "uniform":
            counts = F.transform(
                near, lambda n,
                i: F.struct((-F.size(F.filter(near, lambda m: m["value"] == n["value"]))).alias("c"), i.alias("i"), n["value"].alias("v"))
            )
            return F.array_min(counts)["v"]
        weight = lambda n: F.when(F.size(exact) > 0, (n["distance"] == 0).cast("double")).otherwise(_weight(n))
        sums = F.transform(
            near,
            lambda n: F.struct((-_sum(F.transform(F.filter(near, lambda m: m["value"] == n["value"]), weight))).alias("c"), n["value"].alias("v"))
        )
        return F.array_min(sums)["v"]


class KNNRegressor(_Neighbors):
    """The mean of the neighbours, or by distance their weighted mean; exact matches alone count if there are any."""

    def _vote(self, near: Column) -> Column:
        values = lambda a: F.transform(a, lambda n: n["value"].cast("double"))
        mean = lambda a: _sum(values(a)) / F.nullif(F.size(a).cast("double"), F.lit(0.0))
        if self.weights == "uniform":
            return mean(near)
        exact = F.filter(near, lambda n: n["distance"] == 0)
        weighted = _sum(F.transform(near, lambda n: _weight(n) * n["value"].cast("double"))) / F.nullif(_sum(F.transform(near, _weight)), F.lit(0.0))
        return F.when(F.size(exact) > 0, mean(exact)).otherwise(weighted)
