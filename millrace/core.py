"""What all estimators share: feature columns, fitted state, matrices of partitions and guarded local matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.storage import ship

#: Rows that a solver which needs all of them in one place takes at most.
LOCAL_ROWS = 5_000


class Features:
    """The feature columns of a frame: a list of numeric columns, or one array column."""

    def __init__(self, df: DataFrame, features: Sequence[str] | str, width: int | None = None) -> None:
        if isinstance(features, str):
            if width is None:  # a null array has no size; of arrays of several sizes the longest counts
                width = df.select(F.max(F.when(F.col(features).isNotNull(), F.size(features)))).first()[0] or 0
            self.names, self.array = [f"{features}[{i}]" for i in range(width)], features
            self.columns = [F.get(features, F.lit(i)).cast("double") for i in range(len(self.names))]
        else:
            self.names, self.array = list(features), None
            self.columns = [F.col(c).cast("double") for c in self.names]
        if not self.names:
            raise ValueError("there are no features")

    def __len__(self) -> int:
        return len(self.names)

    @property
    def vector(self) -> Column:
        return F.col(self.array).cast("array<double>") if self.array else F.array(*self.columns)

    @property
    def known(self) -> Column:
        """Whether no feature of the row is null."""
        if self.array:
            whole = F.size(self.array) == len(self.names)
            return F.coalesce(whole & F.forall(self.array, lambda x: x.isNotNull()), F.lit(False))
        test = F.lit(True)
        for c in self.columns:
            test = test & c.isNotNull()
        return test


class Estimator:
    """Base of the estimators: `fit` sets attributes that end in an underscore, `transform` needs them.

    Rows with a null feature or label are left out of a fit; their scores are null. Alignment is by row: a label
    stands in the same row as its features, and where an order matters it is that of the id column.
    """

    features: Sequence[str] | str
    _fitted = False

    def _check_fitted(self) -> None:
        if not self._fitted:
            raise RuntimeError(f"Call fit() before using {type(self).__name__}")

    def _width(self, df: DataFrame) -> Features:
        own = Features(df, self.features, self.n_features_in_)
        if len(own) != self.n_features_in_:
            raise ValueError(f"expected {self.n_features_in_} features, found {len(own)}")
        return own

    def fit_transform(self, df: DataFrame, *args, **named) -> DataFrame:
        return self.fit(df, *args, **named).transform(df)

    fit_predict = fit_transform


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """An array<double> column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def partition_sums(df: DataFrame, columns: Sequence[Column], work: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over all partitions of what `work` gives for each Arrow batch.

    Vector columns (array<double>) reach `work` as matrices, others as arrays. One short row leaves each partition, so what
    the driver gets does not grow with the rows. An empty frame gives an empty array.
    """
    ship(df.sparkSession)
    named = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    wide = [t.startswith("array") for _, t in named.dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                parts = [matrix_of(c, len(c.flatten()) // len(c)) if w else c.to_numpy(zero_copy_only=False) for c, w in zip(batch.columns, wide)]
                found = np.asarray(work(*parts), dtype=float)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    rows = [np.array(r[0]) for r in named.mapInArrow(run, "sums array<double>").collect()]
    return np.sum(rows, axis=0) if rows else np.zeros(0)


#: Numbers of a piece of a wide sum, and groups in which the partitions' pieces are added up before they go to the driver.
PIECE, MERGERS = 1 << 14, 16


def wide_sums(df: DataFrame, column: Column, size: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """`partition_sums` for one vector column and results of `size` numbers, which may be many.

    They leave the partitions in pieces that are added up on the executors, so the driver gets MERGERS results whatever the partitions.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += np.asarray(work(matrix_of(batch.column(0), len(batch.column(0).flatten()) // len(batch))), dtype=float).ravel()
        part = TaskContext.get().partitionId() % MERGERS
        for k, at in enumerate(range(0, size, PIECE)):
            piece = pa.array([total[at : at + PIECE]], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), piece], names=["piece", "part", "sums"])

    def add(group: pa.Table) -> pa.Table:
        sums = group.column("sums").combine_chunks()
        total = matrix_of(sums, len(sums[0])).sum(axis=0)
        return pa.table({"piece": group.column("piece").slice(0, 1), "sums": pa.array([total], pa.list_(pa.float64()))})

    parts = df.select(column.alias("x")).mapInArrow(run, "piece int, part int, sums array<double>")
    out = np.zeros(size)
    for r in parts.groupBy("piece", "part").applyInArrow(add, "piece int, sums array<double>").collect():
        out[r.piece * PIECE : r.piece * PIECE + len(r.sums)] += r.sums
    return out


def local_rows(df: DataFrame, own: Features, id_col: str, label: str | None = None, most: int = LOCAL_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(ids, matrix, labels) in order of id, for solvers that need all rows in one place; more than `most` rows are refused."""
    rows = df.where(own.known if label is None else own.known & F.col(label).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), own.vector.alias("x"), *([F.col(label).alias("y")] if label else []))
    table = rows.limit(most + 1).toPandas()
    if len(table) > most:
        raise ValueError(f"this solver needs all rows in one place and takes {most} at most")
    table = table.sort_values("id", kind="stable")
    x = np.array(table["x"].tolist(), dtype=float).reshape(len(table), len(own))
    return table["id"].to_numpy(), x, table["y"].to_numpy() if label else None


def score_rows(df: DataFrame, own: Features, score: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """`df` with the columns of `schema` that `score` gives for each matrix of rows; null where a feature is null."""
    ship(df.sparkSession)
    names = df.columns
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    extra = [F.lit(None).cast(kind).alias(name) for name, kind in fields]
    out_schema = df.select(*names, *extra).schema
    width = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(len(names) + 1).to_numpy(zero_copy_only=False).astype(bool)
            picked = batch.column(len(names)).filter(pa.array(known))
            found = score(matrix_of(picked, width)) if len(picked) else {}
            columns, place = list(batch.columns[: len(names)]), np.where(known, np.cumsum(known) - 1, -1)
            for name, _ in fields:
                values = found.get(name)
                if values is None:
                    columns.append(pa.nulls(len(batch), out_arrow[name]))
                    continue
                if values.ndim == 2:
                    flat, bounds = pa.array(values.ravel()), pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
                    own = pa.ListArray.from_arrays(bounds, flat)
                else:
                    own = pa.array(values)
                columns.append(own.take(pa.array(place, mask=~known)).cast(out_arrow[name]))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *[n for n, _ in fields]])

    out_arrow = {f.name: f.type for f in to_arrow_schema(out_schema)}
    framed = df.select(*names, own.vector.alias("__vector"), own.known.alias("__known"))
    return framed.mapInArrow(run, out_schema)
