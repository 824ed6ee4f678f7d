"""Greedy merges of clusters, exact, for more rows than one place holds.

Equal rows are at distance 0 and merge first, so what is merged are distinct vectors with weights. Clusters that are closer than a threshold are linked;
for these linkages a merge below the threshold brings no cluster nearer than it to one outside of its component (reducibility; for ward, whose single
rows are further apart than its formula says, by the formula's distance), so each component is merged up to the threshold by a task of its own,
whatever the others do. A component that is too large for a task waits for a lower threshold. What is left, LAST clusters or as many as
the number asked for, is merged on the driver from the distances between clusters, which blocks of rows give on the executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.core import LOCAL_ROWS, matrix_of
from millrace.functions.expr import euclidean
from millrace.plans.closure import closure
from millrace.plans.pairs import against_index, distances
from millrace.plans.pivots import nearest, range_pairs
from millrace.plans.scan import ranked
from millrace.storage import cut, ship

#: Clusters and distinct vectors of a component that a task merges; clusters that the driver merges; rounds without progress before giving up.
TASK_CLUSTERS, TASK_ROWS, LAST, PATIENCE = 2_000, 20_000, 1_000, 12

_FOLD = {"single": np.minimum, "complete": np.maximum, "average": np.add}


def ward_distances(means: np.ndarray, size: np.ndarray, to: np.ndarray, to_size: np.ndarray) -> np.ndarray:
    """sqrt(n m / (n + m)) times the distance of the means; plain distances between single rows."""
    both = size[:, None] + to_size[None]
    return np.where(both == 2, 1.0, np.sqrt(size[:, None] * to_size[None] / both)) * distances(means, to, "euclidean")


def cluster_distances(x: np.ndarray, weight: np.ndarray, code: np.ndarray, y: np.ndarray, y_weight: np.ndarray, y_code: np.ndarray,
                      linkage: str, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of x, codes of y, matrix): least or largest distance, or the weighted sum of all, between the rows of two codes; y is in order of code."""
    own, place = np.unique(code, return_inverse=True)
    other, start = np.unique(y_code, return_index=True)
    fold = _FOLD[linkage]
    out = np.full((len(own), len(other)), np.inf if linkage == "single" else 0.0)
    step = max(1, (1 << 21) // (len(y) * x.shape[1]))
    for at in range(0, len(x), step):
        d = distances(x[at : at + step], y, metric)
        if linkage == "average":
            d = d * weight[at : at + step, None] * y_weight[None]
        fold.at(out, place[at : at + step], fold.reduceat(d, start, axis=1))
    return own, other, out


def greedy(far: np.ndarray, size: np.ndarray, means: np.ndarray, linkage: str, fewest: int, limit: float = np.inf) -> np.ndarray:
    """The first row of each row's cluster after merging nearest pairs, ties by first rows, while they are nearer than `limit` and over `fewest` are left."""
    n = len(size)
    far, size, means, label = far.copy(), size.astype(float), means.astype(float), np.arange(n)
    np.fill_diagonal(far, np.inf)
    live = np.ones(n, dtype=bool)
    key = np.round(far, 9)  # distances that differ by rounding errors only are equal
    key[np.tril_indices(n)] = np.inf
    at = key.argmin(axis=1) if n else np.zeros(0, dtype=int)
    best = key[np.arange(n), at]
    for _ in range(n - fewest):
        a = int(best.argmin())
        if not best[a] < limit:
            break
        b = int(at[a])
        if linkage == "average":
            new = (size[a] * far[a] + size[b] * far[b]) / (size[a] + size[b])
        elif linkage != "ward":
            new = _FOLD[linkage](far[a], far[b])
        means[a] = (size[a] * means[a] + size[b] * means[b]) / (size[a] + size[b])
        size[a] += size[b]
        live[b] = False
        if linkage == "ward":
            new = ward_distances(means[a][None], size[a][None], means, size)[0]
        new = np.where(live, new, np.inf)
        new[a] = np.inf
        far[a], far[:, a], far[b], far[:, b] = new, new, np.inf, np.inf
        rounded = np.round(new, 9)
        key[b], key[:, b], key[:a, a], key[a, a + 1 :] = np.inf, np.inf, rounded[:a], rounded[a + 1 :]
        best[b] = np.inf
        # rows whose nearest was a or b look again, as does a; for the others a may be nearer now
        again = np.flatnonzero(((at == a) | (at == b)) & live & (np.arange(n) < b))
        again = np.union1d(again, [a])
        near = np.flatnonzero(live[:a] & ((rounded[:a] < best[:a]) | ((rounded[:a] == best[:a]) & (a < at[:a]))))
        best[near], at[near] = rounded[near], a
        at[again] = key[again].argmin(axis=1)
        best[again] = key[again, at[again]]
        label[label == b] = a
    return label


def start_distances(x: np.ndarray, weight: np.ndarray, code: np.ndarray, linkage: str, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distances, sizes, means) of clusters from their rows in order of code, which counts from 0."""
    size = np.bincount(code, weight)
    means = np.stack([np.bincount(code, weight * column) / size for column in x.T], axis=1)
    if linkage == "ward":
        return np.vstack([ward_distances(means[i : i + 64], size[i : i + 64], means, size) for i in range(0, len(size), 64)]), size, means
    far = cluster_distances(x, weight, code, x, weight, code, linkage, metric)[2]
    return far / (size[:, None] * size[None]) if linkage == "average" else far, size, means


def _merged_once(held: DataFrame, clusters: DataFrame, limit: float, d: int, linkage: str, metric: str) -> tuple[DataFrame, int]:
    """(cluster, to) of clusters merged below `limit`, and how many clusters stand in components too large for a task."""
    radius = limit * (1 + 1e-6) + 1e-8
    if linkage == "ward":  # of clusters of n rows or more the formula gives sqrt(n / 2) times the distance of the means at least
        radius *= float(np.sqrt(2 / clusters.agg(F.min("n")).first()[0]))
    links = range_pairs(clusters.select(F.col("cluster").alias("id"), "x"), d, radius, metric)[0].where("id < other")
    if linkage == "ward":
        ends = clusters.select(F.col("cluster").alias("id"), "n", "x"), clusters.select(F.col("cluster").alias("other"), F.col("n").alias("m"), F.col("x").alias("y"))
        links = links.join(ends[0], "id").join(ends[1], "other")
        links = links.where(F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m"))) * euclidean(F.col("x"), F.col("y")) <= limit * (1 + 1e-6) + 1e-8)
    named = closure(clusters.select(F.col("cluster").alias("id")), links.select(F.col("id").alias("u"), F.col("other").alias("v")))
    named = cut(named.select(F.col("id").alias("cluster"), "label").join(clusters.select("cluster", "rows"), "cluster"), "merge-components")
    sizes = cut(named.groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.sum("rows").alias("r")).where("c > 1"), "merge-sizes")
    small = (F.col("c") <= TASK_CLUSTERS) & ((F.col("r") <= TASK_ROWS) | F.lit(linkage == "ward"))
    waiting = sizes.where(~small).agg(F.sum("c")).first()[0] or 0
    own = named.join(sizes.where(small).select("label"), "label").select("cluster", "label")
    rows = (clusters.select("cluster", "x", "n") if linkage == "ward" else held.select("cluster", "x", "n")).join(own, "cluster").select("label", "cluster", "x", "n")
    kind = dict(clusters.dtypes)["cluster"]

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("cluster")
        names, code = np.unique(group.column("cluster").to_numpy(), return_inverse=True)
        x = matrix_of(group.column("x").combine_chunks(), d)
        to = greedy(*start_distances(x, group.column("n").to_numpy().astype(float), code, linkage, metric), linkage, 1, limit)
        return pa.table({"cluster": names, "to": names[to]})

    ship(clusters.sparkSession)
    return rows.groupBy("label").applyInArrow(merge, f"cluster {kind}, to {kind}"), waiting


def _last(held: DataFrame, clusters: DataFrame, d: int, k: int, linkage: str, metric: str) -> DataFrame:
    """(cluster, prediction) when the driver merges the clusters, of which there are few."""
    spark = held.sparkSession
    rows = sorted(clusters.select("cluster", "n", "x").collect())
    size, means = np.array([r.n for r in rows], dtype=float), np.array([r.x for r in rows])
    codes = F.broadcast(spark.createDataFrame([(r.cluster, i) for i, r in enumerate(rows)], f"cluster {dict(clusters.dtypes)['cluster']}, code int"))
    if linkage == "ward":
        far = np.vstack([ward_distances(means[i : i + 64], size[i : i + 64], means, size) for i in range(0, len(size), 64)])
    else:
        own = cut(held.join(codes, "cluster").select("id", "code", "x", "n").repartitionByRange("code", "id").sortWithinPartitions("code"), "merge-rows")

        def meet(block: pa.Table, part: pa.Table) -> pa.Table:
            block = block.sort_by("code")
            sides = [(matrix_of(t.column("x").combine_chunks(), d), t.column("n").to_numpy().astype(float), t.column("code").to_numpy()) for t in (part, block)]
            a, b, found = cluster_distances(*sides[0], *sides[1], linkage, metric)
            i, j = np.nonzero(a[:, None] < b[None])
            return pa.table({"a": pa.array(a[i], pa.int32()), "b": pa.array(b[j], pa.int32()), "far": found[i, j]})

        fold = {"single": F.min, "complete": F.max, "average": F.sum}[linkage]
        met = against_index(own, own, meet, "a int, b int, far double")[0].groupBy("a", "b").agg(fold("far").alias("far")).toArrow()
        far, a, b = np.full((len(rows), len(rows)), np.inf), met.column("a").to_numpy(), met.column("b").to_numpy()
        far[a, b] = far[b, a] = met.column("far").to_numpy() / (size[a] * size[b] if linkage == "average" else 1.0)
    label = np.unique(greedy(far, size, means, linkage, k), return_inverse=True)[1]
    return spark.createDataFrame([(r.cluster, int(v)) for r, v in zip(rows, label)], f"cluster {dict(clusters.dtypes)['cluster']}, prediction int")


def _summed(held: DataFrame, d: int) -> DataFrame:
    mean = F.array(*[F.sum(F.get("x", F.lit(i)) * F.col("n")) / F.sum("n") for i in range(d)])
    return cut(held.groupBy("cluster").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), mean.alias("x")), "merge-clusters")


def merged(points: DataFrame, d: int, k: int, linkage: str, metric: str) -> DataFrame:
    """(id, prediction) of points (id, x): k clusters numbered by their least id."""
    points = cut(points, "merge-points")
    held = cut(points.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("cluster", F.col("id")), "merge-rows")
    named = points.join(held.select("x", "cluster"), "x")
    total = held.count()
    if total <= k:  # only equal rows merge, those of the least first row first
        spare = k - total
        later = named.where(F.col("id") != F.col("cluster"))
        kept = later.orderBy(F.col("cluster").desc(), F.col("id").desc()).limit(spare).select("id", F.col("id").alias("own"))
        own = named.join(kept, "id", "left").select("id", F.coalesce("own", "cluster").alias("cluster"))
        number = ranked(own.select("cluster").distinct(), [F.col("cluster")], rank="prediction")
        return own.join(number, "cluster").select("id", F.col("prediction").cast("int"))
    if k > LOCAL_ROWS:
        raise ValueError(f"{LOCAL_ROWS} clusters at most are made of more rows than that")
    clusters, idle, limit = _summed(held, d), 0, None
    while total > max(LAST, k) and idle < PATIENCE:
        if limit is None:
            some = clusters.select(F.col("cluster").alias("id"), "x").orderBy(F.xxhash64("cluster")).limit(256)
            index = clusters.select(F.col("cluster").alias("id"), "x", "n").withColumnRenamed("n", "value")
            near = nearest(some, index, d, 2, metric)[0].select(F.get("near", F.lit(1))["distance"].alias("d"))
            limit = 2 * near.agg(F.percentile("d", 0.5)).first()[0]
        found, waiting = _merged_once(held, clusters, limit, d, linkage, metric)
        moved = cut(held.join(found, "cluster", "left").select("id", "x", "n", F.coalesce("to", "cluster").alias("cluster")), "merge-rows")
        after = _summed(moved, d)
        left = after.count()
        if left < k:  # the last merges have to be told apart
            limit, idle = limit / 1.5, idle + 1
            continue
        idle = idle + 1 if left > 0.98 * total else 0
        limit = limit / 1.5 if waiting > 0.2 * total else limit * 1.7
        held, clusters, total = moved, after, left
    if total > LOCAL_ROWS:
        raise ValueError(f"{total} clusters are left that neither tasks of {TASK_ROWS} rows nor the driver can merge")
    of = _last(held, clusters, d, k, linkage, metric)
    final = held.select(F.col("id").alias("first"), "cluster").join(F.broadcast(of), "cluster").select("first", "prediction")
    return named.select("id", F.col("cluster").alias("first")).join(final, "first").select("id", "prediction")
