"""Ball k-means over integer vectors, exact to the last bit.

A cluster is a ball: its centroid, and a radius no member is beyond. After centroids have moved, a ball's radius is at most the old one plus
the shift of its centroid; only balls whose centroids are within twice that radius are its neighbours, as a member can be no nearer to any other. Members
nearer to their centroid than half the way to the closest neighbour are the stable core and keep their cluster. The others lie in annuli between
half the ways to one neighbour and the next, and are compared with the neighbours within their annulus, exactly. All of it is in integers
(squared distances), so that ties are seen: among equal distances the smaller cluster number wins.

Each round is one pass over a table of (vector, cluster, distance) that writes the next one, and one aggregate of sums by cluster and
component. The driver holds centroids and radii only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import drop_table, ship, write_table

#: Components of a vector and centroids lie within this, so that squared distances of up to 64 components fit 64 bits.
LARGEST = 1 << 27


def _up(square: int) -> int:
    """The least integer whose square is not below `square`."""
    return isqrt(square - 1) + 1 if square > 0 else 0


def matrix_ints(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def distance(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = x - centroid
    return np.einsum("ij,ij->i", apart, apart)


def assign_all(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its squared distance, compared with all of them; of equal ones the first."""
    best, far = np.zeros(len(x), dtype=np.int64), distance(x, centroids[0])
    for j in range(1, len(centroids)):
        d = distance(x, centroids[j])
        nearer = d < far
        best[nearer], far[nearer] = j, d[nearer]
    return best, far


def neighbours(centroids: np.ndarray, radii: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each ball its neighbours, nearest first, and the squared distances to them; `radii` bound the members' distances."""
    out = []
    for j, radius in enumerate(radii):
        apart = distance(centroids, centroids[j])
        order = np.argsort(apart, kind="stable")
        order = order[(order != j) & (apart[order] <= 4 * radius * radius)]
        out.append((order, apart[order]))
    return out


def assign_balls(
    x: np.ndarray, cluster: np.ndarray, centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each row, its squared distance and the number of centroids compared; each row starts from its cluster's ball."""
    best, far, compared = cluster.copy(), distance(x, centroids[cluster]), np.ones(len(x), dtype=np.int64)
    for j in np.unique(cluster):
        members = np.flatnonzero(cluster == j)
        own = far[members]
        members = members[np.argsort(-own, kind="stable")]
        reach = -far[members]  # ascending
        for i, apart in zip(*near[j]):
            # half the way to neighbour i is within reach where 4 * own >= apart; further neighbours concern fewer rows
            outer = members[: np.searchsorted(reach, -int(apart) // 4, side="right")]
            if not len(outer):
                break
            compared[outer] += 1
            d = distance(x[outer], centroids[i])
            nearer = (d < far[outer]) | ((d == far[outer]) & (i < best[outer]))
            moved = outer[nearer]
            best[moved], far[moved] = i, d[nearer]
    return best, far, compared


def _assigned(rows: DataFrame, width: int, centroids: np.ndarray, radii: list[int] | None) -> DataFrame:
    """(id, x, cluster, distance, compared) of rows (id, x), or where there are radii (id, x, cluster)."""
    spark = rows.sparkSession
    ship(spark)
    near = None if radii is None else neighbours(centroids, radii)
    held = spark.sparkContext.broadcast((centroids, near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, near = held.value
        for batch in batches:
            x = matrix_ints(batch.column(1), width)
            if near is None:
                best, far = assign_all(x, centroids)
                compared = np.full(len(x), len(centroids))
            else:
                best, far, compared = assign_balls(x, batch.column(2).to_numpy().astype(np.int64), centroids, near)
            columns = [*batch.columns[:2], pa.array(best, pa.int32()), pa.array(far, pa.int64()), pa.array(compared, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "cluster", "distance", "compared"])

    columns = ["id", "x"] if near is None else ["id", "x", "cluster"]
    kind = dict(rows.dtypes)["id"]
    return rows.select(*columns).mapInArrow(run, f"id {kind}, x array<bigint>, cluster int, distance bigint, compared int")


def _sums(assigned: DataFrame, width: int) -> tuple[dict[int, np.ndarray], dict[int, int], dict[int, int]]:
    """Of each cluster the componentwise sums (Python integers), the count and the largest squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            x, cluster, far = matrix_ints(batch.column(0), width), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for j in np.unique(cluster).tolist():
                own = cluster == j
                held = found.setdefault(j, [np.zeros(width, dtype=np.int64), 0, 0])
                held[0] += x[own].sum(axis=0)
                held[1] += int(own.sum())
                held[2] = max(held[2], int(far[own].max()))
        if found:
            lists = pa.array([v[0].tolist() for v in found.values()], pa.list_(pa.int64()))
            columns = [pa.array(list(found), pa.int32()), lists, *(pa.array([v[k] for v in found.values()], pa.int64()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "sums", "n", "far"])

    parts = assigned.select("x", "cluster", "distance").mapInArrow(run, "cluster int, sums array<bigint>, n bigint, far bigint")
    each = [F.sum(F.get("sums", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *each).collect()  # a row for each cluster
    return {r.cluster: [int(r[f"s{k}"]) for k in range(width)] for r in rows}, {r.cluster: r.n for r in rows}, {r.cluster: r.far for r in rows}


def ball_kmeans(
    vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id",
    vector_col: str = "embedding", work: bool = False,
) -> DataFrame:
    """Clusters of all vectors with exactly `width` components, none null, NaN or infinite; other rows have none and are left out.

    Components x become floor(scale * x). Centroids start as the k kept vectors whose id, as "<seed>:<id>", has the smallest SHA-256, in that
    order; of rows that repeat an id, the lesser vector first, and a null id counts as an empty text. Each round assigns all vectors and moves each
    centroid that has any to the floor of their mean; then they are assigned once more. With fewer than k vectors there are as many clusters.

    Returns for each vector, repeated ones too, the id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256, with
    `work` also `compared`, the number of centroids it was compared with in the last assignment. An empty table gives no rows. Other columns play no
    part, whatever their names. A component of 2^27 or more after scaling is an error, as distances would not fit 64 bits.
    """
    if min(k, width, scale) < 1 or rounds < 0:
        raise ValueError("k, width and scale are at least 1, rounds not negative")
    if width > 64:
        raise ValueError("squared distances of over 64 components do not fit 64 bits")
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = vectors.where((F.size(vector_col) == width) & whole)
    bad = F.raise_error(F.lit("a component is too large for 64-bit distances"))
    checked = F.transform(vector, lambda v: F.when(F.abs(v * scale) < LARGEST, F.floor(v * scale)).otherwise(bad.cast("bigint")))
    path = write_table(kept.select(F.col(id_col).alias("id"), checked.alias("x")), "vectors")
    kind = dict(vectors.dtypes)[id_col]
    schema = f"id {kind}, x array<bigint>"
    rows = spark.read.schema(schema).parquet(path)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = [r.x for r in rows.select("x", key.alias("key")).orderBy("key", "x").limit(k).collect()]
    out_schema = f"{id_col} {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out_schema + (", compared int" if work else ""))
    centroids, radii = np.array(first, dtype=np.int64), None
    for left in range(rounds, -1, -1):
        new = write_table(_assigned(rows, width, centroids, radii), "clusters")
        drop_table(spark, path)
        path = new
        rows = spark.read.schema(f"{schema}, cluster int, distance bigint, compared int").parquet(path)
        if left:
            sums, counts, far = _sums(rows, width)
            moved = centroids.copy()
            for j, total in sums.items():
                moved[j] = [s // counts[j] for s in total]
            shift = distance(moved, centroids)
            radii = [_up(far.get(j, 0)) + _up(int(shift[j])) for j in range(len(moved))]
            centroids = moved
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(j, inertia[j], sum(inertia.values()), digests[j]) for j in sorted(inertia)]
    facts_frame = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = rows.drop("x").withColumnRenamed("id", id_col).join(F.broadcast(facts_frame), "cluster")  # a row for each of k clusters
    extra = ["compared"] if work else []
    return out.select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", *extra)
