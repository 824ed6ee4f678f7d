"""Evaluation metrics as aggregates over two columns of a frame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.core import Features
from millrace.functions.expr import clip
from millrace.plans.pairs import INDEX_ROWS, blocked_sums


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def mse_of(y: str, p: str) -> Column:
    return F.avg((_d(y) - _d(p)) * (_d(y) - _d(p)))


def rmse_of(y: str, p: str) -> Column:
    return F.sqrt(mse_of(y, p))


def mae_of(y: str, p: str) -> Column:
    return F.avg(F.abs(_d(y) - _d(p)))


def r2_of(y: str, p: str) -> Column:
    """1 - residual over total squares; with no spread in y, 1 for a perfect prediction and 0 otherwise."""
    residual, total = F.sum((_d(y) - _d(p)) * (_d(y) - _d(p))), F.count(F.lit(1)) * F.var_pop(_d(y))
    return F.when(total == 0, F.when(residual == 0, 1.0).otherwise(0.0)).otherwise(1 - residual / F.nullif(total, F.lit(0.0)))


def accuracy_of(y: str, p: str) -> Column:
    return F.avg((F.col(y) == F.col(p)).cast("double"))


def log_loss_of(y: str, p: str, eps: float = 1e-15) -> Column:
    q = clip(_d(p), eps, 1 - eps)
    return -F.avg(_d(y) * F.log(q) + (1 - _d(y)) * F.log(1 - q))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def precision_recall_f1_of(y: str, p: str, positive=1) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of the positive label; 0 where a denominator is 0."""
    tp = F.count_if((F.col(y) == positive) & (F.col(p) == positive))
    precision, recall = _ratio(tp, F.count_if(F.col(p) == positive)), _ratio(tp, F.count_if(F.col(y) == positive))
    return precision, recall, _ratio(2 * precision * recall, precision + recall)


def _value(df: DataFrame, column: Column) -> float:
    return df.select(column).first()[0]


def mse(df: DataFrame, y: str, p: str) -> float:
    return _value(df, mse_of(y, p))


def rmse(df: DataFrame, y: str, p: str) -> float:
    return _value(df, rmse_of(y, p))


def mae(df: DataFrame, y: str, p: str) -> float:
    return _value(df, mae_of(y, p))


def r2_score(df: DataFrame, y: str, p: str) -> float:
    return _value(df, r2_of(y, p))


def accuracy(df: DataFrame, y: str, p: str) -> float:
    return _value(df, accuracy_of(y, p))


def log_loss(df: DataFrame, y: str, p: str, eps: float = 1e-15) -> float:
    return _value(df, log_loss_of(y, p, eps))


def precision_recall_f1(df: DataFrame, y: str, p: str, positive=1) -> tuple[float, float, float]:
    return tuple(df.select(*precision_recall_f1_of(y, p, positive)).first())


def _classes(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.select(F.col(y).alias("label")).unionByName(df.select(F.col(p).alias("label"))).distinct()


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """(truth, predicted, n) for each pair of classes that occur on either side, zeros included; rows of classes, not of data, are crossed."""
    classes = _classes(df, y, p)
    cells = classes.select(F.col("label").alias("truth")).crossJoin(classes.select(F.col("label").alias("predicted")))
    counts = df.groupBy(F.col(y).alias("truth"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def classification_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """(label, precision, recall, f1, support) of each class, then 'macro avg' and 'weighted avg'."""
    counts = df.groupBy(F.col(y).alias("t"), F.col(p).alias("q")).agg(F.count(F.lit(1)).alias("n"))
    sides = counts.select(
        F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).alias("called"),
        F.when(F.col("t") == F.col("q"), F.col("n")).otherwise(0).alias("tp")
    ).unionByName(
        counts.select(F.col("q").alias("label"), F.lit(0).alias("support"), F.col("n").alias("called"), F.lit(0).alias("tp")))
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "called", "tp")])
    precision, recall = _ratio(F.col("tp"), F.col("called")), _ratio(F.col("tp"), F.col("support"))
    each = sums.select(
        F.col("label").cast("string").alias("label"), precision.alias("precision"), recall.alias("recall"),
        F.col("support").cast("long").alias("support")
    )
    each = each.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    three = ("precision", "recall", "f1")
    macro = each.agg(*[F.avg(c).alias(c) for c in three], F.sum("support").alias("support")).withColumn("label", F.lit("macro avg"))
    weighted = each.agg(
        *[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in three], F.sum("support").alias("support")
    ).withColumn("label", F.lit("weighted avg"))
    order = ["label", *three, "support"]
    return each.select(order).unionByName(macro.select(order)).unionByName(weighted.select(order))


def format_report(report: DataFrame, digits: int = 3) -> str:
    rows = report.collect()
    width = max([12, *(len(r["label"]) for r in rows)])
    lines = [f"{'':>{width}} precision recall f1 support"]
    return "\n".join([
        *lines,
        *(f"{r['label']:>{width}} {r['precision']:.{digits}f} {r['recall']:.{digits}f} {r['f1']:.{digits}f} {r['support']}" for r in rows)
    ])


def silhouette_samples(df: DataFrame, features, label: str, id_col: str) -> DataFrame:
    """(id, label, a, b, s) of every labelled row; label -1 is noise and left out.

    a is the mean distance to the rows of the own cluster that are not at distance 0, b the least mean distance to another
    cluster; a singleton has a = 0. The rows are compared with blocks of at most INDEX_ROWS rows that are sent to all.
    """
    own = Features(df, features)
    rows = df.where(own.known & F.col(label).isNotNull() & (F.col(label).cast("string") != "-1"))
    rows = rows.select(F.col(id_col).alias("id"), F.col(label).cast("string").alias("label"), own.vector.alias("x"))
    labels = [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]

    def sums(x: np.ndarray, other: np.ndarray, code: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 3 * len(labels)))
        square = np.maximum((x * x).sum(1)[:, None] + (other * other).sum(1)[None, :] - 2 * x @ other.T, 0)
        near = square < 1e-9 * (1 + (x * x).sum(1)[:, None])  # cancellation there: take the differences
        for i, j in zip(*np.nonzero(near)):
            square[i, j] = ((x[i] - other[j]) ** 2).sum()
        distance = np.sqrt(square)
        for k in range(len(labels)):
            mine = distance[:, code == k]
            out[:, 3 * k], out[:, 3 * k + 1], out[:, 3 * k + 2] = mine.sum(1), mine.shape[1], (mine > 0).sum(1)
        return out

    summed = blocked_sums(
        rows, rows.select("x", F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("label")).alias("code")), len(own), sums,
        3 * len(labels), INDEX_ROWS
    )
    mine = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("label")).cast("int") - 1
    at = lambda k, j: F.get("sums", (k * 3 + j).cast("int"))
    others = F.array_min(F.transform(F.filter(F.sequence(F.lit(0), F.lit(max(len(labels) - 1, 0))), lambda k: k != mine), lambda k: at(k, 0) / at(k, 1)))
    a = F.when(at(mine, 2) > 0, at(mine, 0) / F.nullif(at(mine, 2), F.lit(0.0))).otherwise(0.0)
    out = summed.select("id", "label", a.alias("a"), others.alias("b"))
    top = F.greatest("a", "b")
    return out.withColumn("s", F.when(top > 0, (F.col("b") - F.col("a")) / F.nullif(top, F.lit(0.0))).otherwise(0.0))


def silhouette_score(df: DataFrame, features, label: str, id_col: str) -> float:
    """The mean of s over the labelled rows; 0 with fewer than two clusters."""
    clusters = df.where(F.col(label).cast("string") != "-1").select(label).distinct().limit(2).count()
    return float(silhouette_samples(df, features, label, id_col).agg(F.avg("s")).first()[0]) if clusters > 1 else 0.0


