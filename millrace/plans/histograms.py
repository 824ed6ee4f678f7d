"""Feature values in quantile bins, rows as bin codes, and histograms of rows by the node of a tree that they have come to.

A feature with at most as many distinct values as bins has a bin for each; others are cut at approximate quantiles, which Spark's mergeable
sketch gives in one aggregate. The driver gets the least and the largest value of each bin: features x bins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.core import matrix_of
from millrace.storage import cut, ship

#: Cells of a histogram that a task holds as a dense array; cells that it holds as (cell, sums) before they are merged; rows it looks at at once.
DENSE_CELLS, SPARSE_CELLS, BLOCK_ROWS = 1 << 22, 1 << 22, 1 << 14


@dataclass
class Bins:
    """By feature the least and the largest value of each bin, ascending."""

    low: list[np.ndarray]
    high: list[np.ndarray]

    @property
    def most(self) -> int:
        return max(len(h) for h in self.high)

    @property
    def kind(self) -> np.dtype:
        return np.dtype("u1") if self.most <= 256 else np.dtype("<u2")

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The bin of each value; what is above all bins, or not a number, is in the last."""
        out = np.empty(x.shape, dtype=self.kind)
        for f, high in enumerate(self.high):
            out[:, f] = np.minimum(np.searchsorted(high, x[:, f], side="left"), len(high) - 1)
        return out

    def threshold(self, f: int, lower: float, upper: float) -> float:
        """Half way between two bins of a feature, given as codes."""
        return float((self.high[f][int(lower)] + self.low[f][int(upper)]) / 2)


def find_bins(rows: DataFrame, d: int, most: int, column: str = "x") -> Bins:
    """Bins of the d entries of an array column without nulls, at most `most` for each; ValueError without rows."""
    if not 2 <= most <= 1 << 16:
        raise ValueError("there are 2 to 65,536 bins")
    spark = rows.sparkSession
    ship(spark)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray | None] = [np.zeros(0)] * d
        for batch in batches:
            x = matrix_of(batch.column(0), d)
            for f, own in enumerate(held):
                if own is not None:
                    own = np.unique(np.concatenate((own, x[:, f])))
                    held[f] = own if len(own) <= most else None
        parts = [(f, [None] if own is None else own.tolist()) for f, own in enumerate(held)]
        features = [f for f, own in parts for _ in own]
        yield pa.RecordBatch.from_arrays([pa.array(features, pa.int32()), pa.array([v for _, own in parts for v in own], pa.float64())], names=["f", "v"])

    values = cut(rows.select(column).mapInArrow(distinct, "f int, v double").distinct(), "bin-values")
    counts = values.groupBy("f").agg(F.count("v").alias("n"), F.max(F.col("v").isNull().cast("int")).alias("many")).collect()
    if not any(r.n or r.many for r in counts):
        raise ValueError("there are no rows to fit on")
    few = [r.f for r in counts if not r.many and r.n <= most]
    low: list[np.ndarray] = [np.zeros(0)] * d
    high = list(low)
    for r in values.where(F.col("f").isin(few)).groupBy("f").agg(F.array_sort(F.collect_list("v")).alias("v")).collect():
        low[r.f] = high[r.f] = np.array(r.v)
    many = [f for f in range(d) if f not in few]
    if many:
        shares = [k / most for k in range(1, most)]
        found = rows.agg(*[F.percentile_approx(F.get(column, F.lit(f)), shares, 50 * most).alias(f"e{f}") for f in many]).first()
        edges = {f: np.unique(found[f"e{f}"]) for f in many}

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least = {f: np.full(len(e) + 1, np.inf) for f, e in edges.items()}
            largest = {f: np.full(len(e) + 1, -np.inf) for f, e in edges.items()}
            for batch in batches:
                x = matrix_of(batch.column(0), d)
                for f, e in edges.items():
                    at = np.searchsorted(e, x[:, f], side="left")
                    np.minimum.at(least[f], at, x[:, f])
                    np.maximum.at(largest[f], at, x[:, f])
            out = [(f, b, least[f][b], largest[f][b]) for f in edges for b in np.flatnonzero(least[f] <= largest[f]).tolist()]
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["f", "b", "low", "high"])

        bounds = rows.select(column).mapInArrow(ends, "f int, b int, low double, high double").groupBy("f", "b")
        got = sorted(bounds.agg(F.min("low").alias("low"), F.max("high").alias("high")).collect())
        for f in many:
            low[f], high[f] = (np.array([r[k] for r in got if r.f == f]) for k in ("low", "high"))
    return Bins(low, high)


def encode(rows: DataFrame, bins: Bins, keep: Sequence[str], column: str = "x") -> DataFrame:
    """The columns `keep` of `rows` and `codes`, the bins of the array column as bytes; written once."""
    spark = rows.sparkSession
    ship(spark)
    held, d = spark.sparkContext.broadcast(bins), len(bins.high)
    names = [*keep, "codes"]
    schema = rows.select(*keep, F.lit(b"").alias("codes")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = held.value.codes(matrix_of(batch.column(len(keep)), d))
            width = codes.dtype.itemsize * d
            offsets = pa.py_buffer((np.arange(len(batch) + 1, dtype=np.int32) * width).tobytes())
            data = pa.Array.from_buffers(pa.binary(), len(batch), [None, offsets, pa.py_buffer(np.ascontiguousarray(codes).tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], data], names=names)

    return cut(rows.select(*keep, column).mapInArrow(run, schema), "codes")


def codes_of(column: pa.Array, kind: np.dtype, d: int) -> np.ndarray:
    """Codes as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, d)


@dataclass
class Walk:
    """The upper nodes of trees as arrays: rows go left where their code of `feature` is at most `edge`; `slot` numbers where they end, -1 for nowhere."""

    feature: list[np.ndarray]
    edge: list[np.ndarray]
    left: list[np.ndarray]
    right: list[np.ndarray]
    slot: list[np.ndarray]

    def ends(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The node that each row of a matrix (codes, or values if edges are thresholds) comes to."""
        feature, edge = self.feature[tree], self.edge[tree]
        at, go = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while True:
            go = go[feature[at[go]] >= 0]
            if not len(go):
                return at
            node = at[go]
            at[go] = np.where(x[go, feature[node]] <= edge[node], self.left[tree][node], self.right[tree][node])

    def slots(self, tree: int, x: np.ndarray) -> np.ndarray:
        return self.slot[tree][self.ends(tree, x)]


class _Sums:
    """Sums of channels by cell, dense where there are few cells and sparse where there are many."""

    def __init__(self, cells: int, channels: int) -> None:
        self.cells, self.channels = cells, channels
        self.dense = np.zeros((channels, cells)) if cells * channels <= DENSE_CELLS else None
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, cell: np.ndarray, values: list[np.ndarray]) -> None:
        if self.dense is not None:
            for c, v in enumerate(values):
                self.dense[c] += np.bincount(cell, v, self.cells)
            return
        own, number = np.unique(cell, return_inverse=True)
        self.parts.append((own, np.stack([np.bincount(number, v, len(own)) for v in values])))
        self.held += len(own)
        if self.held > SPARSE_CELLS:
            self.parts = [self.merged()]
            self.held = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if self.dense is not None:
            some = np.flatnonzero(self.dense[0])
            return some, self.dense[:, some]
        if not self.parts:
            return np.zeros(0, dtype=np.int64), np.zeros((self.channels, 0))
        cells = np.concatenate([p[0] for p in self.parts])
        own, number = np.unique(cells, return_inverse=True)
        return own, np.stack([np.bincount(number, np.concatenate([p[1][c] for p in self.parts]), len(own)) for c in range(self.channels)])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def weights_of(batch: pa.RecordBatch, column: int | None, tree: int) -> np.ndarray:
    """The weights of the rows in a tree; 1 where there are none."""
    if column is None:
        return np.ones(len(batch))
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(batch), -1)[:, tree].astype(float)


def histograms(coded: DataFrame, bins: Bins, walk: Walk, slots: int, picked: np.ndarray | None, stats: list[str], weights: str | None) -> DataFrame:
    """(slot, f, b, w, the stats): sums of weights and of weighted stats of the rows that come to each slot, by feature and bin.

    `picked` names the features of each slot, all by default. A task sends a row for each of its cells, so no more than slots x features x bins.
    """
    spark = coded.sparkSession
    ship(spark)
    d, most, kind = len(bins.high), bins.most, bins.kind
    held = spark.sparkContext.broadcast((walk, picked))
    columns = ["codes", *stats, *([weights] if weights else [])]
    at_weights = len(columns) - 1 if weights else None
    names = ["slot", "f", "b", "w", *stats]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, picked = held.value
        sums = _Sums(slots * d * most, 1 + len(stats))
        for batch in blocks(batches):
            codes = codes_of(batch.column(0), kind, d)
            values = [batch.column(1 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(stats))]
            for tree in range(len(walk.feature)):
                if not (walk.slot[tree] >= 0).any():
                    continue
                w = weights_of(batch, at_weights, tree)
                rows = np.flatnonzero(w > 0)
                slot = walk.slots(tree, codes[rows])
                rows, slot = rows[slot >= 0], slot[slot >= 0]
                if not len(rows):
                    continue
                f = np.arange(d)[None] if picked is None else picked[slot]
                cell = ((slot[:, None] * d + f) * most + codes[rows[:, None], f]).ravel()
                each = f.shape[1]
                sums.add(cell, [np.repeat(w[rows], each), *(np.repeat(v[rows] * w[rows], each) for v in values)])
        cell, found = sums.merged()
        place = [pa.array(cell // (d * most), pa.int64()), pa.array(cell // most % d, pa.int32()), pa.array(cell % most, pa.int32())]
        yield pa.RecordBatch.from_arrays([*place, *(pa.array(c) for c in found)], names=names)

    schema = "slot long, f int, b int, " + ", ".join(f"{n} double" for n in names[3:])
    parts = coded.select(*columns).mapInArrow(run, schema)
    return parts.groupBy("slot", "f", "b").agg(*[F.sum(n).alias(n) for n in names[3:]])


def small_weights(count: Column, trees: int) -> Column:
    """An array of a small whole number for each tree; `count` makes it from the tree's number."""
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: count(t).cast("smallint"))
