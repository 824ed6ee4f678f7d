"""Scalers and encoders: one aggregate to fit, plain column expressions to apply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.core import Estimator


class _Scaler(Estimator):
    """Replaces each feature column by its scaled value; `suffix` keeps the original and appends to the new name."""

    suffix = ""

    def _stats(self, df: DataFrame, *functions) -> list[list[float]]:
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{i}_{j}") for i, c in enumerate(self.features) for j, f in enumerate(functions)]).first()
        if row[0] is None:
            raise ValueError("there are no rows to fit on")
        return [[row[f"{i}_{j}"] for i in range(len(self.features))] for j in range(len(functions))]

    def _apply(self, df: DataFrame, expression) -> DataFrame:
        self._check_fitted()
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"expected {self.n_features_in_} features; {missing} are missing")
        return df.withColumns({c + self.suffix: expression(i, F.col(c).cast("double")) for i, c in enumerate(self.features)})


class StandardScaler(_Scaler):
    """(x - mean) / population deviation; a constant column is only centred."""

    def fit(self, df: DataFrame, features: Sequence[str], label=None, id_col=None) -> StandardScaler:
        self.features, self.n_features_in_ = list(features), len(features)
        self.mean_, deviation = self._stats(df, F.avg, F.stddev_pop)
        self.scale_ = [d if d > 0 else 1.0 for d in deviation]
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, lambda i, x: (x - self.mean_[i]) / self.scale_[i])

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, lambda i, x: x * self.scale_[i] + self.mean_[i])


class MinMaxScaler(_Scaler):
    """To the range (low, high) by the least and the largest value; a constant column becomes low, and comes back whole."""

    def __init__(self, feature_range: tuple[float, float] = (0.0, 1.0)) -> None:
        if feature_range[0] >= feature_range[1]:
            raise ValueError("feature_range must be ascending")
        self.feature_range = feature_range

    def fit(self, df: DataFrame, features: Sequence[str], label=None, id_col=None) -> MinMaxScaler:
        self.features, self.n_features_in_ = list(features), len(features)
        self.data_min_, self.data_max_ = self._stats(df, F.min, F.max)
        low, high = self.feature_range
        self.scale_ = [(high - low) / (b - a) if b > a else 0.0 for a, b in zip(self.data_min_, self.data_max_)]
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, lambda i, x: (x - self.data_min_[i]) * self.scale_[i] + float(self.feature_range[0]))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        low = float(self.feature_range[0])
        return self._apply(df, lambda i, x: (x - low) / self.scale_[i] + self.data_min_[i] if self.scale_[i] else x * 0 + self.data_min_[i])


#: Categories that are written into an expression; more are joined as a table.
LITERAL_CATEGORIES = 1_000


class LabelEncoder(Estimator):
    """Labels to their rank among the sorted distinct ones. An unknown label is an error when it is met."""

    def fit(self, df: DataFrame, column: str) -> LabelEncoder:
        self.column = column
        # the distinct values that become classes; they are the model, whose size is the number of classes
        self.classes_ = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
        self._fitted = True
        return self

    @property
    def n_classes_(self) -> int:
        self._check_fitted()
        return len(self.classes_)

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        self._check_fitted()
        out = out or self.column
        unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.col(self.column).cast("string"))).cast("int")
        if len(self.classes_) <= LITERAL_CATEGORIES:
            place = F.array_position(F.array(*[F.lit(c) for c in self.classes_]), F.col(self.column)).cast("int") - 1
            return df.withColumn(out, F.when(F.col(self.column).isNull() | (place >= 0), place).otherwise(unknown))
        codes = df.sparkSession.createDataFrame(list(enumerate(self.classes_)), ["__code", "__value"])
        joined = df.join(codes, df[self.column] == codes["__value"], "left")
        code = F.when(F.col(self.column).isNull() | F.col("__code").isNotNull(), F.col("__code").cast("int")).otherwise(unknown)
        return joined.withColumn(out, code).drop("__code", "__value")

    def inverse_transform(self, df: DataFrame, column: str, out: str | None = None) -> DataFrame:
        self._check_fitted()
        code = F.col(column).cast("int")
        value = F.get(F.array(*[F.lit(c) for c in self.classes_]), code)
        bad = F.raise_error(F.concat(F.lit("no label has the code "), code.cast("string")))
        inside = code.isNull() | ((code >= 0) & (code < len(self.classes_)))
        return df.withColumn(out or column, F.when(inside, value).otherwise(bad))

    def fit_transform(self, df: DataFrame, column: str, out: str | None = None) -> DataFrame:
        return self.fit(df, column).transform(df, out)


class OneHotEncoder(Estimator):
    """A 0/1 column for each sorted category of each column, but for the first one with drop='first' (if there are more)."""

    def __init__(self, drop: str | None = "first") -> None:
        if drop not in ("first", None):
            raise ValueError("drop is 'first' or None")
        self.drop = drop

    def fit(self, df: DataFrame, columns: Sequence[str]) -> OneHotEncoder:
        self.columns = list(columns)
        # one pass for all columns
        sets = df.agg(*[F.array_sort(F.collect_set(c)).alias(f"c{i}") for i, c in enumerate(self.columns)]).first()
        self.categories_ = [list(s) for s in sets]
        self._fitted = True
        return self

    def _kept(self, i: int) -> list:
        own = self.categories_[i]
        return own[1:] if self.drop == "first" and len(own) > 1 else own

    def get_feature_names_out(self) -> list[str]:
        self._check_fitted()
        return [f"x{i}_{c}" for i in range(len(self.columns)) for c in self._kept(i)]

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns {missing} are missing")

        def known(i: int, c: str) -> Column:
            bad = F.raise_error(F.concat(F.lit("unknown category: "), F.col(c).cast("string"))).cast("double")
            return F.when(F.col(c).isNull() | F.col(c).isin(self.categories_[i]), F.lit(0.0)).otherwise(bad)

        new = {f"x{i}_{v}": F.when(F.col(c) == v, F.lit(1.0)).otherwise(known(i, c)) for i, c in enumerate(self.columns) for v in self._kept(i)}
        return df.withColumns(new)

    def fit_transform(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        return self.fit(df, columns).transform(df)
