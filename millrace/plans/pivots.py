"""Exact nearest neighbours and range joins by pivots, in any number of dimensions.

Sampled rows of the index are pivots; each index row belongs to the cell of its nearest pivot, whose least and largest distance from the pivot
are known. By the triangle inequality, and by the plane between two pivots, a row's distances to the pivots bound from below its distance
to all that a cell holds, so a row is sent only to the cells that may hold what it asks for. For neighbours it first meets the
nearest cells with k rows between them; the k-th distance found there decides which others it has to meet.

An index of up to SENT_ROWS rows is sent to all, by cell, and searched in the same way where the rows are. A larger one is exchanged by cell for the nearest
cells and then by tiles of neighbouring cells: a row is sent once to a tile, whose task takes bounds again and compares it with the cells it needs, so what
is exchanged is rows times tiles even where bounds rule out nothing. Crowded cells are dealt into parts, on both sides, and of index rows with equal vectors the k smallest ids are enough. The driver holds the pivots and a
count for each cell. Bounds are loosened by more than their rounding error, and distances are taken by differences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.core import matrix_of
from millrace.storage import cut, ship

#: Rows of an index that is sent to all; pivots at most; rows of a part of a cell, on either side.
SENT_ROWS, PIVOTS, PART = 20_000, 1_024, 20_000
#: Rows of a tile, on either side: neighbouring cells are met together, so a row is sent once for all that it needs of them.
TILE = 50_000
#: Bounds are loosened by this times the norms and distances they are made from.
SLACK = 1e-6


def pivot_distances(x: np.ndarray, points: np.ndarray, metric: str) -> np.ndarray:
    """Distances to the pivots, good enough for bounds."""
    if metric == "manhattan":
        return np.stack([np.abs(x - p).sum(axis=1) for p in points], axis=1)
    square = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


def _length(x: np.ndarray, metric: str) -> np.ndarray:
    return np.abs(x).sum(axis=1) if metric == "manhattan" else np.sqrt((x * x).sum(axis=1))


@dataclass
class Cells:
    """Pivots and what is known of their cells: rows, least and largest distance from the pivot."""

    points: np.ndarray
    counts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    metric: str

    @cached_property
    def apart(self) -> np.ndarray:
        """Distances of the pivots from each other."""
        return pivot_distances(self.points, self.points, self.metric)

    def least(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        """A lower bound of the distance from each row to all in each cell; `to` are its distances to the pivots."""
        home = to.argmin(axis=1)
        near = to[np.arange(len(x)), home][:, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            if self.metric == "manhattan":
                beyond = (to - near) / 2
            else:  # the plane half way between the pivots
                apart = self.apart[home]
                beyond = np.where(apart > 0, (to * to - near * near) / (2 * apart), 0)
        bound = np.maximum(np.maximum(to - self.high, self.low - to), np.nan_to_num(beyond, nan=0.0, posinf=0.0, neginf=0.0))
        scale = _length(x, self.metric)[:, None] + (_length(self.points, self.metric).max() + self.high.max(initial=0))
        # a plane's distance has the square of two distances over a third, so close pivots loosen it most
        rough = SLACK * scale * (1 if self.metric == "manhattan" else 1 + scale / np.maximum(apart, SLACK * scale))
        return np.where(self.counts > 0, np.maximum(bound - rough, 0), np.inf)

    def first(self, to: np.ndarray, k: int, least: int = 1) -> list[list[int]]:
        """For each row the nearest cells that hold k rows between them, `least` cells at least."""
        out, full = [], self.counts > 0
        for row in np.where(full, to, np.inf):
            j = int(row.argmin())
            if self.counts[j] >= k and least == 1:
                out.append([j])
                continue
            order = np.argsort(row, kind="stable")[: int(full.sum())]
            need = int(np.searchsorted(np.cumsum(self.counts[order]), k)) + 1
            out.append(order[: max(need, least)].tolist())
        return out


class Coarse:
    """Manhattan distances of rows to others from whole numbers of 16 bits, and by how much they may be wrong.

    |a - b| is a + b - 2 min(a, b), so a feature of a pair takes a minimum and a sum of short numbers. Entries are cut to as many steps as keep a row's sum in 16 bits.
    """

    def __init__(self, x: np.ndarray, other: np.ndarray) -> None:
        low = np.minimum(x.min(axis=0), other.min(axis=0))
        most = 32_767 // x.shape[1]
        self.step = float((np.maximum(x.max(axis=0), other.max(axis=0)) - low).max()) / most or 1.0
        (self.own, self.own_error), (whole, errors) = self._cut(x, low, most), self._cut(other, low, most)
        self.other, self.error = np.ascontiguousarray(whole.T), float(errors.max())
        self.own_sum, self.other_sum = self.own.sum(axis=1, dtype=np.int32), whole.sum(axis=1, dtype=np.int32)

    def _cut(self, x: np.ndarray, low: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        whole = np.clip(np.rint((x - low) / self.step), 0, most)
        return whole.astype(np.int16), np.abs(x - (low + whole * self.step)).sum(axis=1)

    def distances(self, at: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Of rows at .. at + step, and what each may be off."""
        own = self.own[at : at + step]
        out = np.empty((len(own), self.other.shape[1]), dtype=np.int32)
        for here in range(0, out.shape[1], 1024):  # so much as stays near a core
            other = self.other[:, here : here + 1024]
            shared, least = np.zeros((len(own), other.shape[1]), dtype=np.int16), np.empty((len(own), other.shape[1]), dtype=np.int16)
            for k in range(len(other)):
                np.minimum(own[:, k, None], other[k][None], out=least)
                np.add(shared, least, out=shared)
            np.multiply(shared, -2, out=out[:, here : here + 1024], dtype=np.int32)
        out += self.other_sum
        out += self.own_sum[at : at + step, None]
        return out, (self.own_error[at : at + step, None] + self.error) * (1 + 1e-9) + 1e-9 * self.step * 32_767


def closest(x: np.ndarray, other: np.ndarray, k: int, metric: str, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest of `other` for each row, of equal distances the first; fewer if there are fewer.

    With `limit`, a distance for each row, only those up to it; where they are fewer than k the others have distance inf.
    """
    k = min(k, len(other))
    places, far = np.zeros((len(x), k), dtype=np.int64), np.full((len(x), k), 0.0 if limit is None else np.inf)
    norm = (other * other).sum(axis=1)
    coarse = Coarse(x, other) if metric == "manhattan" and k and len(x) and 8 <= x.shape[1] <= 256 and len(other) > 4 * k else None
    step = 64 if coarse else max(1, (1 << 21) // max(1, len(other) * (1 if metric == "euclidean" else other.shape[1])))
    for at in range(0, len(x) if k else 0, step):
        own = x[at : at + step]
        unit = 1.0
        if coarse:
            rough, slack = coarse.distances(at, step)
            unit = coarse.step
        elif metric == "manhattan":
            rough, slack = np.abs(own[:, None, :] - other[None]).sum(axis=2), np.zeros((len(own), 1))
        else:
            own_norm = (own * own).sum(axis=1)[:, None]
            rough, slack = own_norm + norm[None] - 2 * (own @ other.T), 1e-9 * (own_norm + norm.max())
        hits, reach = None, np.inf
        if limit is not None:
            reach = limit[at : at + step, None]
            reach = ((reach if metric == "manhattan" else reach * reach) * (1 + 1e-9) + slack) / unit
            hits = rough <= reach
        if hits is None or np.count_nonzero(hits) > 16 * k * len(own):
            edge = np.partition(rough, k - 1, axis=1)[:, k - 1 : k] + (2 * slack / unit if coarse else slack)
            hits = rough <= np.minimum(edge, reach)
        row, col = np.nonzero(hits)
        if metric == "manhattan":
            d = np.abs(own[row] - other[col]).sum(axis=1) if coarse else rough[row, col]
        else:
            apart = own[row] - other[col]
            d = np.sqrt(np.einsum("ij,ij->i", apart, apart))
        if limit is not None:
            inside = d <= limit[at + row] * (1 + 1e-9)  # sums of other batches may differ in their last bit
            row, col, d = row[inside], col[inside], d[inside]
        order = np.lexsort((col, d, row))
        row, col, d = row[order], col[order], d[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        kept = nth < k
        places[at + row[kept], nth[kept]], far[at + row[kept], nth[kept]] = col[kept], d[kept]
    return places, far


def within(x: np.ndarray, other: np.ndarray, eps: float, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all pairs at most eps apart."""
    rows, cols = [], []
    norm = (other * other).sum(axis=1)
    most = max(norm.max(initial=0), (x * x).sum(axis=1).max(initial=0))
    short = metric == "euclidean" and 1e-20 < most < 1e20  # floats of 32 bits leave out what is far; the others have their distance taken
    if short:
        both = np.concatenate((other, norm[:, None]), axis=1).astype(np.float32).T
    step = max(1, (1 << 21) // max(1, len(other) * (1 if metric == "euclidean" else other.shape[1])))
    for at in range(0, len(x) if len(other) else 0, step):
        own = x[at : at + step]
        if metric == "manhattan":
            row, col = np.nonzero(np.abs(own[:, None, :] - other[None]).sum(axis=2) <= eps)
        else:
            own_norm = (own * own).sum(axis=1)[:, None]
            if short:
                near = np.concatenate((2 * own, np.full((len(own), 1), -1.0)), axis=1).astype(np.float32) @ both
                least = own_norm - eps * eps * (1 + 1e-9) - 1e-6 * (x.shape[1] + 8) * most
                row, col = np.divmod(np.flatnonzero(near >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))), len(other))
            else:
                row, col = np.nonzero(own_norm + norm[None] - 2 * (own @ other.T) <= eps * eps * (1 + 1e-9) + 1e-9 * (own_norm + norm.max()))
            apart = own[row] - other[col]
            near = np.sqrt(np.einsum("ij,ij->i", apart, apart)) <= eps
            row, col = row[near], col[near]
        rows.append(row + at)
        cols.append(col)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def within_edge(x: np.ndarray, other: np.ndarray, eps: float, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """`within` with the distances at the very edge summed in the order of the features, as column expressions do."""
    row, col = within(x, other, eps * (1 + 1e-9), metric)
    kept = np.ones(len(row), dtype=bool)
    for at in range(0, len(row), 1 << 14):
        apart = x[row[at : at + (1 << 14)]] - other[col[at : at + (1 << 14)]]
        d = np.abs(apart).sum(axis=1) if metric == "manhattan" else np.sqrt((apart * apart).sum(axis=1))
        edge = np.abs(d - eps) <= 1e-9 * eps
        if edge.any():
            steps = np.abs(apart[edge]) if metric == "manhattan" else apart[edge] ** 2
            ordered = steps.cumsum(axis=1)[:, -1]
            d[edge] = ordered if metric == "manhattan" else np.sqrt(ordered)
        kept[at : at + len(d)] = d <= eps
    return row[kept], col[kept]


def tiles_of(cells: Cells) -> np.ndarray:
    """The tile of each cell: a cell and its nearest free ones, up to TILE rows."""
    tile, number = np.full(len(cells.points), -1), 0
    while (tile < 0).any():
        near = np.argsort(cells.apart[int(np.flatnonzero(tile < 0)[0])], kind="stable")
        free = near[tile[near] < 0]
        free = free[: max(1, int((np.cumsum(cells.counts[free]) <= TILE).sum()))]
        tile[free], number = number, number + 1
    return tile


def choose_pivots(index: DataFrame, total: int) -> np.ndarray:
    """Distinct vectors of rows taken by the hash of their id, about the square root of the rows, PIVOTS at most."""
    most = min(PIVOTS, max(1, isqrt(total)))
    rows = index.select("x", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(2 * most).collect()
    return np.array(list(dict.fromkeys(tuple(r.x) for r in rows))[:most], dtype=float)


def into_cells(index: DataFrame, points: np.ndarray, metric: str) -> tuple[DataFrame, Cells]:
    """`index` with the cell of each row, as a written table, and the cells."""
    spark = index.sparkSession
    ship(spark)
    held, names, width = spark.sparkContext.broadcast(points), index.columns, points.shape[1]
    at = names.index("x")
    schema = index.select("*", F.lit(0).cast("int").alias("cell"), F.lit(0.0).alias("radius")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.slice(start, 1024)
                to = pivot_distances(matrix_of(batch.column(at), width), held.value, metric)
                cell = to.argmin(axis=1)
                columns = [*batch.columns, pa.array(cell, pa.int32()), pa.array(to[np.arange(len(to)), cell])]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "cell", "radius"])

    table = cut(index.mapInArrow(run, schema), "cells")
    counts, low, high = np.zeros(len(points), dtype=np.int64), np.zeros(len(points)), np.zeros(len(points))
    for r in table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")).collect():
        counts[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high  # a row for each pivot
    return table.drop("radius"), Cells(points, counts, low, high, metric)


def ask(rows: DataFrame, cells: Cells, wanted, columns: list[str], width: int) -> DataFrame:
    """`rows` with `cells`, the array of cells that `wanted` gives for a matrix and the batch."""
    spark = rows.sparkSession
    ship(spark)
    held, at = spark.sparkContext.broadcast(cells), columns.index("x")
    schema = rows.select(*columns, F.lit(None).cast("array<int>").alias("cells")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.slice(start, 1024)
                found = wanted(held.value, matrix_of(batch.column(at), width), batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*columns, "cells"])

    return rows.select(*columns).mapInArrow(run, schema)


def meet(asked: DataFrame, table: DataFrame, counts: np.ndarray, work, schema: str, part: int | None = None) -> tuple[DataFrame, int]:
    """What `work` gives for the rows that ask for a cell and the cell's rows, part by part; and the number of pairs so met.

    `asked` is a written table with the columns id and cell, `table` the index with its cells, of which `counts` has the rows; a cell may stand for a tile.
    """
    spark, part = asked.sparkSession, part or PART
    # of few rows the asking side is dealt smaller, so that all cores have some
    row_part = part
    if part > 5_000 and part == TILE:
        share = -(-asked.select("id").distinct().count() // spark.sparkContext.defaultParallelism)
        row_part = max(5_000, min(part, share))
    n = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row for each pivot at most
    parts = [(j, -(-c // row_part), -(-int(counts[j]) // part)) for j, c in n.items()]
    compared = sum(c * int(counts[j]) for j, c in n.items())
    parts_frame = F.broadcast(spark.createDataFrame(parts, "cell int, rows_parts int, own_parts int"))

    def dealt(df: DataFrame, own: str, other: str, key: Column) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.col(own)).cast("int")
        return df.join(parts_frame, "cell").select(
            *df.columns, mine.alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    left, right = dealt(asked, "rows_parts", "own_parts", F.col("id")), dealt(table, "own_parts", "rows_parts", F.col("id"))
    keys = ["cell", "rows_parts", "own_parts"]
    empty = to_arrow_schema(spark.createDataFrame([], schema).schema).empty_table()

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        return work(rows, own) if rows.num_rows and own.num_rows else empty

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema), compared


def meet_tiles(rows: DataFrame, columns: list[str], table: DataFrame, cells: Cells, needed, work, schema: str, width: int) -> tuple[DataFrame, int]:
    """What `work` gives for rows (`columns`, with id and x) and the cells they need, tile by tile; and the number of pairs of rows and needed cells' rows.

    `needed` gives a boolean matrix (row, cell) for a matrix of rows and their table. `work` gets the rows' table and matrix, the tile's table in order of
    cell with its matrix, and a list of (rows' places, slice of the tile) for each cell.
    """
    tile = tiles_of(cells)
    sizes = np.bincount(tile, cells.counts).astype(int)
    held = rows.sparkSession.sparkContext.broadcast(cells)

    def wanted(c: Cells, x: np.ndarray, batch: pa.RecordBatch) -> list[list[int]]:
        return [np.append(np.unique(tile[own]), -1 - min(int(c.counts[own].sum()), 2**31 - 2)).tolist() for own in needed(c, x, pa.Table.from_batches([batch]))]

    # the last entry has the cost of the row
    asked = cut(ask(rows, cells, wanted, columns, width), "asked").select(*columns, F.explode("cells").alias("cell"))
    compared = int(asked.where("cell < 0").agg(F.sum(-1 - F.col("cell").cast("long"))).first()[0] or 0)
    asked = asked.where("cell >= 0")
    tile_of = F.get(F.lit(tile.tolist()), F.col("own_cell")).cast("int")
    tiled = table.withColumnRenamed("cell", "own_cell").withColumn("cell", tile_of)

    def run(own: pa.Table, block: pa.Table) -> pa.Table:
        block = block.sort_by([("own_cell", "ascending"), ("id", "ascending")])
        other, code = _matrix(block, width), block.column("own_cell").to_numpy()
        here, start = np.unique(code, return_index=True)
        ends = np.append(start[1:], len(code))
        found = []
        for at in range(0, own.num_rows, 2048):
            part = own.slice(at, 2048)
            x = _matrix(part, width)
            need = needed(held.value, x, part)[:, here]
            pieces = [(np.flatnonzero(need[:, i]), slice(start[i], ends[i])) for i in np.flatnonzero(need.any(axis=0))]
            found.append(work(part, x, block, other, _joined(pieces)))
        return pa.concat_tables(found)

    return meet(asked, tiled, sizes, run, schema, TILE)[0], compared


def _joined(pieces: list[tuple[np.ndarray, slice]]) -> list[tuple[np.ndarray, slice]]:
    """Neighbouring cells, up to 8,192 rows, as one piece where that adds no more than a quarter to their pairs: `work` may meet cells it has not asked for."""
    out: list[tuple[np.ndarray, slice]] = []
    for rows, cell in pieces:
        if out and out[-1][1].stop == cell.start and cell.stop - out[-1][1].start <= 8_192:
            before, own = out[-1]
            both = np.union1d(before, rows)
            if 4 * len(both) * (cell.stop - own.start) <= 5 * (len(before) * (own.stop - own.start) + len(rows) * (cell.stop - cell.start)):
                out[-1] = both, slice(own.start, cell.stop)
                continue
        out.append((rows, cell))
    return out


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    return matrix_of(table.column("x").combine_chunks(), width)


def _near_lists(index: pa.Table, places: np.ndarray, far: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Lists of (distance, id, value); the first sizes[i] entries of row i count."""
    inside = np.arange(places.shape[1])[None] < sizes[:, None]
    picked = pa.array(places[inside])
    fields = [pa.array(far[inside]), *(index.column(c).combine_chunks().take(picked) for c in ("id", "value"))]
    near = pa.StructArray.from_arrays(fields, names=["distance", "id", "value"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), near)


class SentIndex:
    """An index by cell in one place; order of id is kept in `rank`."""

    def __init__(self, table: pa.Table, points: np.ndarray, width: int, metric: str) -> None:
        self.table = table.sort_by("id")
        x = _matrix(self.table, width)
        to = pivot_distances(x, points, metric)
        cell = to.argmin(axis=1)
        radius = to[np.arange(len(x)), cell]
        self.rank = np.argsort(cell, kind="stable")  # by cell, then id
        self.x, self.bounds = x[self.rank], np.searchsorted(cell[self.rank], np.arange(len(points) + 1))
        counts = np.diff(self.bounds)
        low, high = np.zeros(len(points)), np.zeros(len(points))
        low[counts > 0] = np.minimum.reduceat(radius[self.rank], self.bounds[:-1][counts > 0])
        high[counts > 0] = np.maximum.reduceat(radius[self.rank], self.bounds[:-1][counts > 0])
        self.cells = Cells(points, counts, low, high, metric)

    def search(self, x: np.ndarray, k: int, probes: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places by id and distances of the k nearest of each row, and the index rows it was compared with; with `probes` in its nearest cells only."""
        k, cells = min(k, len(self.x)), self.cells
        to = pivot_distances(x, cells.points, cells.metric)
        least, first = cells.least(x, to), cells.first(to, k, probes or 1)
        far, place = np.full((len(x), k), np.inf), np.full((len(x), k), len(self.x))
        todo, compared = np.zeros(least.shape, dtype=bool), np.zeros(len(x), dtype=np.int64)
        for i, own in enumerate(first):
            todo[i, own] = True
        for rest in (False, True) if probes is None else (False,):
            if rest:
                todo = (least <= far[:, -1:]) & ~todo
            for j in np.flatnonzero(todo.any(axis=0)):
                rows = np.flatnonzero(todo[:, j])
                if rest:  # the k-th distance has come down since
                    rows = rows[least[rows, j] <= far[rows, -1]]
                own = slice(self.bounds[j], self.bounds[j + 1])
                places, d = closest(x[rows], self.x[own], k, cells.metric, far[rows, -1] if rest else None)
                compared[rows] += cells.counts[j]
                both_d = np.concatenate((far[rows], d), axis=1)
                both = np.concatenate((place[rows], self.rank[own][places]), axis=1)
                order = np.lexsort((both, both_d), axis=1)[:, :k]
                far[rows], place[rows] = np.take_along_axis(both_d, order, axis=1), np.take_along_axis(both, order, axis=1)
        return place, far, compared


def nearest(
    rows: DataFrame, index: DataFrame, width: int, k: int, metric: str = "euclidean", probes: int | None = None
) -> tuple[DataFrame, int | None]:
    """(id, near) of every row (id, x): its k nearest index rows (id, x, value) as (distance, id, value), nearest first, ties by id.

    With `probes` a row meets its nearest `probes` cells only (more where these have not k rows), so the lists are approximate.
    Vectors have `width` entries, none null; rows' ids are unique. With it, for an index that is exchanged, the number of pairs that were
    compared. An empty index gives empty lists.
    """
    spark = rows.sparkSession
    ship(spark)
    rows, index = rows.select("id", "x"), cut(index.select("id", "x", "value"), "index")
    kinds, id_kind = dict(index.dtypes), dict(rows.dtypes)["id"]
    near_kind = f"array<struct<distance:double,id:{kinds['id']},value:{kinds['value']}>>"
    total = index.count()
    if not total:
        return rows.select("id", F.array().cast(near_kind).alias("near")), 0
    points = choose_pivots(index, total)
    if total <= SENT_ROWS:
        sent = spark.sparkContext.broadcast(SentIndex(index.toArrow(), points, width, metric))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                for start in range(0, len(batch), 2048):
                    part = batch.slice(start, 2048)
                    places, far, _ = own.search(matrix_of(part.column(1), width), k, probes)
                    lists = _near_lists(own.table, places, far, np.full(len(part), places.shape[1]))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "near"])

        return rows.mapInArrow(run, f"id {id_kind}, near {near_kind}"), None

    # beyond the k smallest ids of equal vectors no row can be among anyone's k nearest
    same = Window.partitionBy("x").orderBy("id")
    index = index.withColumn("__nth", F.row_number().over(same)).where(F.col("__nth") <= k).drop("__nth")
    table, cells = into_cells(index, points, metric)

    def work(own: pa.Table, block: pa.Table) -> pa.Table:
        block = block.sort_by("id")
        places, far = closest(_matrix(own, width), _matrix(block, width), k, metric)
        lists = _near_lists(block, places, far, np.full(len(places), places.shape[1]))
        return pa.table({"id": own.column("id"), "x": own.column("x"), "first": own.column("first"), "near": lists})

    schema = f"id {id_kind}, x {dict(rows.dtypes)['x']}, first array<int>, near {near_kind}"
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)  # lists of k from the parts a row has met
    homes = ask(rows, cells, lambda c, x, _: c.first(pivot_distances(x, c.points, c.metric), k, probes or 1), ["id", "x"], width)
    asked = cut(homes.select("id", "x", F.col("cells").alias("first"), F.explode("cells").alias("cell")), "asked")
    found, compared = meet(asked, table, cells.counts, work, schema)
    found = cut(found.groupBy("id").agg(F.any_value("x").alias("x"), F.any_value("first").alias("first"), merged.alias("near")), "near")

    if probes is not None:
        return found.select("id", "near"), compared

    def others(c: Cells, x: np.ndarray, batch: pa.Table) -> np.ndarray:
        reach = batch.column("reach").to_numpy().astype(float)
        need = c.least(x, pivot_distances(x, c.points, c.metric)) <= reach[:, None]
        for i, met in enumerate(batch.column("first").to_pylist()):
            need[i, met] = False
        return need & (c.counts > 0)

    def rest_of(own: pa.Table, x: np.ndarray, block: pa.Table, other: np.ndarray, pieces: list) -> pa.Table:
        reach = own.column("reach").to_numpy().astype(float)
        names = block.column("id").combine_chunks()
        order = np.empty(len(names), dtype=np.int64)  # the place of each row of the tile in order of id
        order[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        far, place = np.full((len(x), k), np.inf), np.full((len(x), k), len(order))
        cell_of, met = block.column("own_cell").to_numpy(), np.zeros((len(x), len(points)), dtype=bool)
        for i, first in enumerate(own.column("first").to_pylist()):
            met[i, first] = True
        for rows_, own_cell in pieces:
            d_places, d = closest(x[rows_], other[own_cell], k, metric, np.minimum(reach, far[:, -1])[rows_])
            d[met[rows_[:, None], cell_of[own_cell][d_places]]] = np.inf  # the row has these already
            both_d = np.concatenate((far[rows_], d), axis=1)
            both = np.concatenate((place[rows_], order[own_cell][d_places]), axis=1)
            nearest_ = np.lexsort((both, both_d), axis=1)[:, :k]
            far[rows_], place[rows_] = np.take_along_axis(both_d, nearest_, axis=1), np.take_along_axis(both, nearest_, axis=1)
        sizes = (np.isfinite(far) & (far <= reach[:, None])).sum(axis=1)
        kept = np.flatnonzero(sizes)
        lists = _near_lists(block.sort_by("id"), place[kept], far[kept], sizes[kept])
        return pa.table({"id": own.column("id").take(pa.array(kept)), "near": lists})

    # with k rows or more in the first cells, the k-th distance is there
    far = F.coalesce(F.get(F.col("near"), F.lit(k - 1))["distance"], F.lit(float("inf"))).alias("reach")
    columns = ["id", "x", "first", "reach"]
    rest, again = meet_tiles(found.select("id", "x", "first", far), columns, table, cells, others, rest_of, f"id {id_kind}, near {near_kind}", width)
    both = found.select("id", "near").unionByName(rest)
    return both.groupBy("id").agg(merged.alias("near")), compared + again


def range_pairs(points: DataFrame, width: int, eps: float, metric: str = "euclidean") -> tuple[DataFrame, int]:
    """(id, other) of all pairs of rows (id, x) at most eps apart, either way round and each with itself; and the number of pairs compared.

    Points are met cell by cell, so hot vectors should be grouped before: equal points all pair.
    """
    points = cut(points.select("id", "x"), "range-points")
    kind, total = dict(points.dtypes)["id"], points.count()
    if not total:
        return points.sparkSession.createDataFrame([], f"id {kind}, other {kind}"), 0
    table, cells = into_cells(points, choose_pivots(points, total), metric)

    def work(own: pa.Table, x: np.ndarray, block: pa.Table, other: np.ndarray, pieces: list) -> pa.Table:
        rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for places, cell in pieces:
            row, col = within_edge(x[places], other[cell], eps, metric)
            rows.append(places[row])
            cols.append(col + cell.start)
        row, col = np.concatenate(rows), np.concatenate(cols)
        return pa.table({"id": own.column("id").take(pa.array(row)), "other": block.column("id").take(pa.array(col))})

    return meet_tiles(points, ["id", "x"], table, cells, _reach(eps), work, f"id {kind}, other {kind}", width)


def dense_links(points: DataFrame, width: int, eps: float, least: int, metric: str = "euclidean") -> tuple[DataFrame, int]:
    """What density clusters need of the pairs of `range_pairs`, for rows (id, x, n) of distinct vectors that stand for n points; and the number of pairs compared.

    (id, other, n, sure): without `other`, n points are within eps of the row, to be added up. Else rows at most eps apart, as they are, where `sure` is false. Of
    pairs whose rows have, both, `least` points around them in the task already, there is only a link from each row to the least id they reach: `sure` is true.
    """
    points = cut(points.select("id", "x", "n"), "range-points")
    kind, total = dict(points.dtypes)["id"], points.count()
    schema = f"id {kind}, other {kind}, n long, sure boolean"
    if not total:
        return points.sparkSession.createDataFrame([], schema), 0
    table, cells = into_cells(points, choose_pivots(points, total), metric)

    def work(own: pa.Table, x: np.ndarray, block: pa.Table, other: np.ndarray, pieces: list) -> pa.Table:
        mine, theirs = (t.column("id").combine_chunks() for t in (own, block))
        ids = pa.concat_arrays([mine, theirs])
        order = pc.sort_indices(ids).to_numpy().astype(np.int64)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        weight, counts = own.column("n").to_numpy(), np.zeros(own.num_rows, dtype=np.int64)
        left, right, sure = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for places, cell in pieces:
            row, col = within_edge(x[places], other[cell], eps, metric)
            row, size = places[row], cell.stop - cell.start
            of_piece = block.column("n").slice(cell.start, size).to_numpy()
            counts += np.bincount(row, of_piece[col], own.num_rows).astype(np.int64)
            both = (counts >= least)[row] & (np.bincount(col, weight[row], size) >= least)[col]
            first = own.num_rows + cell.start
            left.append(row[~both])
            right.append(first + col[~both])
            row, col = row[both], col[both]
            label, own_label = rank[first : first + size].copy(), rank[: own.num_rows].copy()
            while True:  # the least rank that each row reaches
                before = label.sum() + own_label.sum()
                np.minimum.at(own_label, row, label[col])
                np.minimum.at(label, col, own_label[row])
                if before == label.sum() + own_label.sum():
                    break
            row, col = np.unique(row), np.unique(col)
            left += [row, first + col]
            right += [order[own_label[row]], order[label[col]]]
            sure += [np.zeros(len(both) - both.sum(), bool), np.ones(len(row) + len(col), bool)]
        left, right, sure = (np.concatenate(v) for v in (left, right, sure))
        pairs = pa.table({"id": ids.take(pa.array(left)), "other": ids.take(pa.array(right)), "n": pa.nulls(len(left), pa.int64()), "sure": pa.array(sure)})
        none = len(counts)
        return pa.concat_tables([pairs, pa.table({"id": mine, "other": pa.nulls(none, ids.type), "n": pa.array(counts), "sure": pa.nulls(none, pa.bool_())})])

    return meet_tiles(points, ["id", "x", "n"], table, cells, _reach(eps), work, schema, width)


def _reach(eps: float):
    return lambda c, x, _: (c.least(x, pivot_distances(x, c.points, c.metric)) <= eps) & (c.counts > 0)
