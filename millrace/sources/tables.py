"""Reading and writing tables. Parquet goes through Spark, so filters and columns reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.expr import normal


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def from_arrays(spark: SparkSession, x, y=None, id_col: str = "id") -> DataFrame:
    """A frame with id, x0.., and label from arrays held by the driver."""
    x = np.asarray(x, dtype=float)
    x = x[:, None] if x.ndim == 1 else x
    names = [id_col, *[f"x{i}" for i in range(x.shape[1])], *(["label"] if y is not None else [])]
    rows = [(i, *map(float, r), *([y[i].item() if hasattr(y[i], "item") else y[i]] if y is not None else [])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, names)


def blobs(spark: SparkSession, rows: int, centres: Sequence[Sequence[float]], scale: float = 1.0, seed: int = 0) -> DataFrame:
    """id, x0.., label: normal clouds around centres, made in place from hashed numbers, the same on any cluster."""
    base = spark.range(rows).withColumn("label", (F.col("id") % len(centres)).cast("int"))
    for j in range(len(centres[0])):
        centre = F.get(F.array(*[F.lit(float(c[j])) for c in centres]), F.col("label"))
        base = base.withColumn(f"x{j}", centre + scale * normal(seed, j, F.col("id")))
    return base


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
