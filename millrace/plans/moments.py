"""Sufficient statistics: the Gram matrix of features, label and 1 in one pass over the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.core import Features, partition_sums

#: Up to so many columns the products are plain aggregates in generated code; more go through matrix products of batches.
PLAIN_COLUMNS = 14


def grams(df: DataFrame, own: Features, label: str | None = None, by: str | None = None) -> dict:
    """`gram` of the rows of each value of the column `by`, of which there are few, all in one pass; of all rows, under None, without it."""
    rows = df.where(own.known if label is None else own.known & F.col(label).isNotNull())
    columns = [*own.columns, *([F.col(label).cast("double")] if label else [])]
    n = len(columns) + 1
    found: dict = {}
    if n - 1 <= PLAIN_COLUMNS:
        z = [F.lit(1.0), *columns]
        products = [F.sum(z[i] * z[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)]
        for sums in (rows.groupBy(by).agg(*products) if by else rows.agg(*products)).collect():
            out = found[sums[by] if by else None] = np.zeros((n, n))
            for i in range(n):
                for j in range(i, n):
                    out[i, j] = out[j, i] = sums[f"s{i}_{j}"] or 0.0
        return found or {None: np.zeros((n, n))}
    vector = F.array(*columns) if label or not own.array else own.vector
    if by is None:
        whole = partition_sums(rows, [vector], lambda x: _products(x))
        return {None: whole.reshape(n, n) if len(whole) else np.zeros((n, n))}
    keys = [r[0] for r in rows.select(by).distinct().collect()]
    code = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col(by)) - 1

    def work(x: np.ndarray, key: np.ndarray) -> np.ndarray:
        return np.stack([_products(x[key == k]) for k in range(len(keys))])

    parts = partition_sums(rows, [vector, code], work) if keys else np.zeros(0)
    return dict(zip(keys, parts.reshape(-1, n, n))) if len(parts) else {None: np.zeros((n, n))}


def _products(x: np.ndarray) -> np.ndarray:
    z = np.column_stack([np.ones(len(x)), x])
    return z.T @ z


def gram(df: DataFrame, own: Features, label: str | None = None) -> np.ndarray:
    """Z'Z for Z = (1, features, label): square, symmetric, with the row count first. Rows with nulls are left out."""
    return grams(df, own, label)[None]
