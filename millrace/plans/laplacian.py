"""First eigenvectors of the normalised Laplacian I - D^-1/2 W D^-1/2 of a graph whose nodes and links stay on the executors.

A block of vectors is a table with a node's entries in its row. Steps are those of LOBPCG (Knyazev, 2001): the best vectors in the space of the present ones, their
residuals and the last moves; here the space also has the residuals' corrections on a coarse graph, whose nodes are cells of neighbouring nodes, so the
steps hardly grow with the rows. A step takes one product with W and leaves two sums: small matrices, and the residuals by cell.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.core import matrix_of, partition_sums, wide_sums
from millrace.functions.expr import normal
from millrace.plans.closure import closure
from millrace.plans.pairs import against_index, distances
from millrace.plans.pivots import nearest, pivot_distances
from millrace.storage import cut, drop_table, new_folder, ship, tables

#: Cells of the coarse graph for each component; vectors beyond those asked for; steps at most.
CELLS, SPARE, STEPS = 1_000, 3, 300
#: A vector is found when its residual is below this share of the gap to the next eigenvalue, or below FLOOR.
SHARE, FLOOR = 1e-4, 1e-8

#: From rows (id, x, v) to (id, m): the products of W with the vectors v.
Product = Callable[[DataFrame, int], DataFrame]


def _sums(name: str, width: int) -> Column:
    return F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(width)])


def neighbour_links(points: DataFrame, width: int, k: int) -> DataFrame:
    """(u, v), both ways, of points (id, x) of which one is among the k nearest others of the other, ties by id."""
    near = nearest(points, points.withColumn("value", F.lit(0)), width, k + 1)[0]
    others = F.slice(F.filter(F.transform("near", lambda n: n["id"]), lambda i: i != F.col("id")), 1, k)
    one_way = near.select(F.col("id").alias("u"), F.explode(others).alias("v"))
    return one_way.unionByName(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def link_product(links: DataFrame) -> Product:
    """W has a 1 for each link."""
    return lambda rows, width: links.join(rows.select(F.col("id").alias("v"), F.col("v").alias("m")), "v").groupBy(F.col("u").alias("id")).agg(_sums("m", width).alias("m"))


def rbf_product(d: int, gamma: float) -> Product:
    """W has exp(-distance^2 / (2 gamma^2)), with ones on the diagonal; all pairs of rows meet in blocks."""

    def product(rows: DataFrame, width: int) -> DataFrame:
        def work(index: pa.Table, own: pa.Table) -> pa.Table:
            x, y = (matrix_of(t.column("x").combine_chunks(), d) for t in (own, index))
            v = matrix_of(index.column("v").combine_chunks(), width)
            m = np.concatenate([np.exp(-(distances(x[i : i + 64], y, "euclidean") ** 2) / (2 * gamma**2)) @ v for i in range(0, len(x), 64)])
            bounds = pa.array(np.arange(len(m) + 1, dtype=np.int32) * width)
            return pa.table({"id": own.column("id"), "m": pa.ListArray.from_arrays(bounds, pa.array(m.ravel()))})

        out, many = against_index(rows.select("id", "x"), rows.select("id", "x", "v"), work, f"id {dict(rows.dtypes)['id']}, m array<double>")
        return out.groupBy("id").agg(_sums("m", width).alias("m")) if many else out

    return product


def component_directions(named: DataFrame, k: int, seed: int) -> DataFrame:
    """(id, x) of nodes (id, label, deg) in k or more components: their rows of k vectors that span a part of the Laplacian's null space.

    That has a vector for each component, sqrt(deg) on it; any k orthonormal ones among them are first eigenvectors. They are taken at random, by
    hashes of the components, so components keep apart and their nodes together.
    """
    spans = named.groupBy("label").agg(F.array(*[normal(seed, "direction", j, F.col("label")) for j in range(k)]).alias("g"))
    spans = cut(spans, "directions")
    gram = partition_sums(spans, [F.col("g")], lambda g: g.T @ g).reshape(k, k)
    values, basis = np.linalg.eigh(gram)
    turn = basis / np.sqrt(values) @ basis.T
    turned = [sum((F.get("g", F.lit(i)) * float(turn[i, j]) for i in range(k)), F.lit(0.0)) for j in range(k)]
    return named.select("id", "label").join(spans.select("label", F.array(*turned).alias("x")), "label").select("id", "x")


def into_cells(named: DataFrame, links: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(id, x, deg, cell) of nodes (id, x, deg, label), and the coarse graph's weights: links between cells, which are nearest sampled places by component."""
    ship(named.sparkSession)
    places = np.array([r.x for r in named.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(CELLS).collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column("x"), width)
            near = [pivot_distances(x[i : i + 1024], places, "euclidean").argmin(axis=1) for i in range(0, len(x), 1024)]
            yield batch.append_column("place", pa.array(np.concatenate(near) if near else [], pa.int32()))

    placed = cut(named.select("id", "x", "deg", "label").mapInArrow(run, named.select("id", "x", "deg", "label", F.lit(0).alias("place")).schema), "placed")
    found = sorted(map(tuple, placed.select("label", "place").distinct().collect()))
    kinds = dict(placed.dtypes)
    codes = named.sparkSession.createDataFrame([(*key, i) for i, key in enumerate(found)], f"label {kinds['label']}, place int, cell int")
    nodes = cut(placed.join(F.broadcast(codes), ["label", "place"]).select("id", "x", "deg", "cell"), "nodes")
    ends = [nodes.select(F.col("id").alias(end), F.col("cell").alias(f"c{end}")) for end in "uv"]
    met = links.join(ends[0], "u").join(ends[1], "v").groupBy("cu", "cv").count().toArrow()
    weights = np.zeros((len(found), len(found)))
    weights[met.column("cu").to_numpy(), met.column("cv").to_numpy()] = met.column("count").to_numpy()
    return nodes, weights


class _Block:
    """Rows of present vectors x, last moves p and new directions g, each beside its product with the Laplacian, in one matrix."""

    def __init__(self, path: str, widths: tuple[int, int, int]) -> None:
        self.path, self.widths, self.size = path, widths, sum(widths)

    def turned(self, s: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
        """x, Lx, p and Lp of the next block."""
        move = c.copy()
        move[: self.widths[0]] = 0
        own, laplace = s[:, : self.size], s[:, self.size :]
        return [own @ c, laplace @ c, own @ move, laplace @ move]


def _best(gram: np.ndarray, laplace: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, coefficients) of the b best vectors in a space with these inner products."""
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300)) * (np.diag(gram) > 1e-300)
    values, basis = np.linalg.eigh(gram * scale[:, None] * scale[None])
    basis = scale[:, None] * (basis / np.sqrt(np.maximum(values, 1e-300)))[:, values > 1e-11 * values[-1]]
    theta, turn = np.linalg.eigh(basis.T @ laplace @ basis)
    return theta[:b], basis @ turn[:, :b]


def first_vectors(nodes: DataFrame, product: Product, own: float, weights: np.ndarray, k: int, seed: int) -> DataFrame:
    """(id, x): the rows of the first k eigenvectors for nodes (id, x, deg, cell); `own` is what the product has on its diagonal and W has not.

    `weights` are the coarse graph's. Blocks are deleted as soon as the next is there.
    """
    spark, b = nodes.sparkSession, k + SPARE
    ship(spark)
    cells = len(weights)
    coarse = np.diag(weights.sum(axis=1)) - weights
    root = 1 / np.sqrt(np.maximum(weights.sum(axis=1), 1e-12))
    values, basis = np.linalg.eigh(root[:, None] * coarse * root[None])
    basis = root[:, None] * basis
    inverse = (basis * np.where(values > 1e-10, 1 / np.where(values > 1e-10, values, 1), 0)) @ basis.T
    lead = basis[:, : min(b, cells)]
    floor = F.sqrt(F.greatest("deg", F.lit(1e-12)))

    def written(rows: DataFrame, widths: tuple[int, int, int], path: str) -> _Block:
        """The block of rows (id, x, deg, cell, old, olds, g): old and olds hold x and p and their products."""
        product_of = product(rows.select("id", "x", F.transform("g", lambda a: a / floor).alias("v")), widths[2])
        joined = rows.join(product_of, "id", "left")
        laplace = F.transform(F.sequence(F.lit(0), F.lit(widths[2] - 1)), lambda i: F.get("g", i) - (F.coalesce(F.get("m", i), F.lit(0.0)) - own * F.get("g", i) / floor) / floor)
        joined.select("id", "x", "deg", "cell", F.concat("old", "g", "olds", laplace).alias("s")).write.option("compression", "zstd").parquet(path)
        return _Block(path, widths)

    def given(x: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().astype(float)))

    def mapped(table: DataFrame, work: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
        schema = table.select("id", "x", "deg", "cell", *[F.array().cast("array<double>").alias(n) for n in ("old", "olds", "g")]).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    columns = [batch.column(n) for n in ("id", "x", "deg", "cell")] + [given(a) for a in work(batch)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "deg", "cell", "old", "olds", "g"])

        return table.mapInArrow(run, schema)

    def numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.sqrt(np.maximum(batch.column("deg").to_numpy().astype(float), 1e-12)), batch.column("cell").to_numpy()

    drawn = nodes.withColumn("s", F.array(*[normal(seed, "start", j, F.col("id")) for j in range(b)]))

    def start(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        deg, cell = numbers(batch)
        g = matrix_of(batch.column("s"), b)
        g[:, : lead.shape[1]] = deg[:, None] * lead[cell]
        return g[:, :0], g[:, :0], g

    path = new_folder(spark, "vectors")
    with tables(spark):
        block = written(mapped(drawn, start), (0, 0, b), path)
    for step in range(STEPS + 1):
        table = spark.read.parquet(block.path)
        width = 2 * block.size

        def inner(s: np.ndarray, size: int = block.size) -> np.ndarray:
            return np.concatenate((s[:, :size].T @ s[:, :size], s[:, :size].T @ s[:, size:]))

        gram, laplace = partition_sums(table, [F.col("s")], inner).reshape(2, block.size, block.size)
        theta, c = _best(gram, (laplace + laplace.T) / 2, b)

        def residuals(rows: np.ndarray, block: _Block = block, theta: np.ndarray = theta, c: np.ndarray = c) -> np.ndarray:
            x, lx, _, _ = block.turned(rows[:, 2:], c)
            r, out = lx - x * theta, np.zeros((cells + 1, b))
            np.add.at(out, rows[:, 1].astype(int), np.sqrt(np.maximum(rows[:, :1], 1e-12)) * r)
            out[cells] = (r * r).sum(axis=0)
            return out

        sums = wide_sums(table, F.concat(F.array(F.col("deg").cast("double"), F.col("cell").cast("double")), "s"), (cells + 1) * b, residuals).reshape(cells + 1, b)
        rest = np.sqrt(sums[cells])
        if rest[:k].max() <= max(SHARE * (theta[k] - theta[k - 1]), FLOOR) or step == STEPS:
            break
        y = inverse @ sums[:cells]

        def directions(batch: pa.RecordBatch, block: _Block = block, theta: np.ndarray = theta, c: np.ndarray = c, y: np.ndarray = y, width: int = width):
            deg, cell = numbers(batch)
            x, lx, p, lp = block.turned(matrix_of(batch.column("s"), width), c)
            return np.hstack((x, p)), np.hstack((lx, lp)), np.hstack((lx - x * theta, deg[:, None] * y[cell]))

        path = new_folder(spark, "vectors")
        with tables(spark):
            after = written(mapped(table, directions), (b, b, 2 * b), path)
        drop_table(spark, block.path)
        block = after
    if step == STEPS:
        warnings.warn(f"after {STEPS} steps an eigenvector has a residual of {rest[:k].max():.1e}", stacklevel=2)
    turned = [sum((F.get("s", F.lit(i)) * float(c[i, j]) for i in range(block.size)), F.lit(0.0)) for j in range(k)]
    return table.select("id", F.array(*turned).alias("x"))


def spectral_rows(points: DataFrame, width: int, k: int, neighbours: int | None, gamma: float, seed: int) -> DataFrame:
    """(id, x) of points (id, x): rows of the first k eigenvectors, each of length 1, for links with nearest neighbours or, without, the rbf kernel.

    A graph in k or more components has as many vectors for the eigenvalue 0; then `component_directions` are taken.
    """
    points = cut(points, "points")
    if neighbours is None:
        product = rbf_product(width, gamma)
        deg = product(points.withColumn("v", F.array(F.lit(1.0))), 1).select("id", (F.get("m", F.lit(0)) - 1).alias("deg"))
        nodes = cut(points.join(deg, "id").select("id", "x", "deg", F.lit(0).alias("cell")), "nodes")
        found = first_vectors(nodes, product, 1.0, np.zeros((1, 1)), k, seed)
    else:
        links = cut(neighbour_links(points, width, neighbours), "links")
        named = points.join(closure(points, links), "id").join(links.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("deg")), "id")
        named = cut(named, "named")
        if named.select("label").distinct().limit(k).count() >= k:
            found = component_directions(named, k, seed)
        else:
            nodes, weights = into_cells(named, links, width)
            found = first_vectors(nodes, link_product(links), 0.0, weights, k, seed)
    length = F.greatest(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)), F.lit(1e-12))
    return found.select("id", F.transform("x", lambda v: v / length).alias("x"))
