"""Clustering: k-means, DBSCAN, Gaussian mixtures, agglomerative and spectral clustering."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.core import LOCAL_ROWS, Estimator, Features, local_rows, partition_sums, score_rows
from millrace.functions.expr import euclidean, manhattan, squared_distance, uniform
from millrace.plans.closure import closure
from millrace.plans.laplacian import spectral_rows
from millrace.plans.merges import greedy, merged, start_distances
from millrace.plans.pairs import distances
from millrace.plans.pivots import dense_links
from millrace.plans.scan import ranked
from millrace.storage import cut, new_folder, tables


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, of equal ones the first."""
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)


def _hashed(*keys) -> float:
    """What `uniform` gives for these keys, on the driver."""
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:8], 16) / 4294967296.0


def _weighted_start(places: np.ndarray, weights: np.ndarray, u: np.ndarray) -> np.ndarray:
    """k-means++ over weighted places: each centre is the first in a race of exponential clocks, of equal ones the first place."""
    far, centres = np.ones(len(places)), []
    for draws in u:
        with np.errstate(divide="ignore"):
            clock = np.where(weights * far > 0, -np.log(draws) / (weights * far), np.inf)
        centres.append(places[clock.argmin()])
        apart = ((places - centres[-1]) ** 2).sum(axis=1)
        far = apart if len(centres) == 1 else np.minimum(far, apart)
    return np.array(centres)


def _best_of(rows: DataFrame, k: int, seeds: Sequence[int], steps: int = 100) -> np.ndarray:
    """The k centres of least cost for rows (id, x) after k-means from a k-means++ start for each seed; all seeds share each pass."""

    def near(x: np.ndarray, all_: np.ndarray) -> np.ndarray:
        return ((x[None, :, None, :] - all_[:, None]) ** 2).sum(axis=3)

    rows, centres = rows.select("id", "x").persist(), [[] for _ in seeds]
    try:
        for j in range(k):
            clocks = []
            for seed, held in zip(seeds, centres):
                clock = -F.log(F.greatest(uniform(seed, j, F.col("id")), F.lit(1e-12)))
                if held:
                    far = F.least(*[squared_distance(F.col("x"), F.array(*[F.lit(float(v)) for v in c])) for c in held], F.lit(float("inf")))
                    clock = F.when(far > 1e-12, clock / far).otherwise(F.lit(float("inf")))
                clocks.append(F.min_by("x", F.struct(clock.alias("c"), F.col("id"))))
            for held, best in zip(centres, rows.select(*clocks).first()):
                held.append(np.array(best))
        centres = np.array(centres)
        for step in range(steps + 1):
            def work(x: np.ndarray, centres: np.ndarray = centres) -> np.ndarray:
                total = np.zeros((len(centres), k, x.shape[1] + 2))
                for at in range(0, len(x), 1024):
                    part = x[at : at + 1024]
                    far = near(part, centres)
                    for r, (own, cost) in enumerate(zip(far.argmin(axis=2), far.min(axis=2))):
                        np.add.at(total[r], own, np.column_stack([part, np.ones(len(part)), cost]))
                return total

            sums = partition_sums(rows, [F.col("x")], work).reshape(len(centres), k, -1)
            cost, many = sums[:, :, -1].sum(axis=1), sums[:, :, -2:-1]
            new = np.where(many > 0, sums[:, :, :-2] / np.maximum(many, 1), centres)
            if step == steps or np.allclose(new, centres):
                return centres[cost.argmin()]
            centres = new
    finally:
        rows.unpersist()


class KMeans(Estimator):
    """Lloyd's iterations from k-means++, k-means|| or given centres; only sums for each cluster leave the partitions.

    `init` is a matrix of centres, None for k-means++, whose k draws take a pass each, or "k-means||" (Bahmani et al., 2012): in each of ROUNDS passes
    every row is taken with a chance of 2k times its share of the squared distances, and of those taken, weighted by the rows nearest to them,
    k-means++ draws the centres on the driver. An empty cluster keeps its centre; iterations end when all centres together moved by less than `tol`.
    """

    ROUNDS = 5

    def __init__(self, k: int = 3, n_iterations: int = 300, tol: float = 1e-4, random_state: int | None = None, init: np.ndarray | str | None = None) -> None:
        if k < 1:
            raise ValueError("k must be at least 1")
        if isinstance(init, str) and init != "k-means||":
            raise ValueError("init is a matrix of centres, 'k-means||' or None")
        self.k, self.n_iterations, self.tol, self.random_state, self.init = k, n_iterations, tol, random_state, init

    def _start(self, rows: DataFrame) -> np.ndarray:
        """k-means++: each centre drawn by squared distance; the draw is a race of exponential clocks over hashed numbers."""
        seed, centres = self.random_state or 0, []
        for j in range(self.k):
            u = F.greatest(uniform(seed, j, F.col("id")), F.lit(1e-12))
            if not centres:
                clock = -F.log(u)
            else:
                far = F.least(*[squared_distance(F.col("x"), F.array(*[F.lit(float(v)) for v in c])) for c in centres], F.lit(float("inf")))
                clock = F.when(far > 0, -F.log(u) / F.nullif(far, F.lit(0.0))).otherwise(F.lit(float("inf")))
            best = rows.select(F.min_by("x", F.struct(clock.alias("c"), F.col("id")))).first()[0]
            if best is None:
                raise ValueError("there are no rows to fit on")
            centres.append(np.array(best))
        return np.array(centres)

    def _oversampled(self, rows: DataFrame) -> np.ndarray:
        """k-means||; all draws are hashes, so any engine can make them again. Some 2k rows a round go to the driver."""
        seed = self.random_state or 0
        first = rows.orderBy(uniform(seed, "first", F.col("id")), "id").select("id", "x").limit(1).collect()
        if not first:
            raise ValueError("there are no rows to fit on")
        taken = {first[0].id: np.array(first[0].x)}

        def far_from(places: list[np.ndarray]):
            return lambda x: ((x[:, None, :] - np.array(places)[None]) ** 2).sum(axis=2)

        for step in range(self.ROUNDS):
            gap = far_from(list(taken.values()))
            total = float(partition_sums(rows, [F.col("x")], lambda x, gap=gap: gap(x).min(axis=1).sum()[None])[0])
            if total <= 0:
                break
            own = Features(rows, "x", len(first[0].x))
            spread = score_rows(rows, own, lambda x, gap=gap: {"far": gap(x).min(axis=1)}, "far double")
            picked = spread.where(uniform(seed, "round", step, F.col("id")) * total < 2.0 * self.k * F.col("far")).select("id", "x")
            for r in sorted(picked.collect()):
                taken.setdefault(r.id, np.array(r.x))
        ids, places = sorted(taken), [taken[i] for i in sorted(taken)]
        gap = far_from(places)
        weights = partition_sums(rows, [F.col("x")], lambda x: np.bincount(gap(x).argmin(axis=1), minlength=len(places)).astype(float))
        u = np.array([[_hashed(seed, "centre", j, i) for i in ids] for j in range(self.k)])
        return _weighted_start(np.array(places), weights, np.maximum(u, 1e-12))

    def fit(self, df: DataFrame, features, label=None, id_col: str = "id") -> KMeans:
        self.features = features
        own = Features(df, features)
        self.n_features_in_ = d = len(own)
        rows = df.where(own.known).select(F.col(id_col).alias("id"), own.vector.alias("x")).persist()
        try:
            if isinstance(self.init, str):
                centres = self._oversampled(rows)
            else:
                centres = np.array(self.init, dtype=float) if self.init is not None else self._start(rows)
            for self.n_iter_ in range(1, self.n_iterations + 1):
                def work(x: np.ndarray, centres=centres) -> np.ndarray:
                    near = _near(x, centres)
                    sums = np.zeros((len(centres), d + 1))
                    np.add.at(sums, near, np.column_stack([x, np.ones(len(x))]))
                    return sums

                sums = partition_sums(rows, [F.col("x")], work).reshape(self.k, d + 1)
                full = sums[:, d] > 0
                new = np.where(full[:, None], sums[:, :d] / np.maximum(sums[:, d:], 1), centres)
                moved, centres = np.linalg.norm(new - centres), new
                if moved < self.tol:
                    break
            self.inertia_ = float(partition_sums(rows, [F.col("x")], lambda x: ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()[None])[0])
        finally:
            rows.unpersist()
        self.centroids_, self._fitted = centres, True
        self.labels_ = self.transform(df).select(id_col, "prediction")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        own = self._width(df)
        x = own.vector
        far = [F.struct(squared_distance(x, F.array(*[F.lit(float(v)) for v in c])).alias("d"), F.lit(j).alias("j")) for j, c in enumerate(self.centroids_)]
        return df.withColumn("prediction", F.when(own.known, F.array_min(F.array(*far))["j"]))

    predict = transform


NOISE = -1


class DBSCAN(Estimator):
    """Density clusters in closed form: components of core points, numbered by their least id; a border point joins the lowest adjacent cluster.

    With over GRID_FEATURES features equal points are taken together, and a range join by pivots in all features counts those within eps and gives a link for each that is surely core, pairs only for the others;
    pairs_compared_ says how many pairs it compared. With fewer, points are put into grid cells whose points all lie within eps of each other. So all points of a cell of min_samples are core, core points of a cell belong together, and distances
    are needed only for points of thinner cells, and between cells whose bounds leave it open whether two of their core points
    are neighbours. Which cells are near is read off the grid. A crowded cell is dealt into parts of about PART points, so no task holds it whole.
    """

    GRID_FEATURES, PART = 3, 5_000

    def __init__(self, eps: float = 0.5, min_samples: int = 5, metric: str = "euclidean") -> None:
        if eps <= 0 or min_samples < 1 or metric not in ("euclidean", "manhattan"):
            raise ValueError("eps > 0, min_samples >= 1 and metric 'euclidean' or 'manhattan' are required")
        self.eps, self.min_samples, self.metric = eps, min_samples, metric

    def _cells(self, points: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
        """Points with their cell, and pairs (cell, other) of cells that may hold neighbours, each cell with itself included."""
        axes = range(d)
        side = self.eps / (np.sqrt(d) if self.metric == "euclidean" else d) * (1 - 1e-9)
        reach = int(np.floor(self.eps / side)) + 1
        points = cut(points.withColumn("cell", F.array(*[F.floor(F.get("x", F.lit(i)) / F.lit(float(side))) for i in axes])), "dbscan-points")
        cells = cut(points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / self.PART).alias("parts")), "dbscan-cells")
        around = cells.select(F.col("cell").alias("other"), F.col("n").alias("n_other"), F.col("parts").alias("parts_other"))
        for i in axes:
            around = around.withColumn(f"a{i}", F.explode(F.sequence(F.get("other", F.lit(i)) - reach, F.get("other", F.lit(i)) + reach)))
        near = cells.withColumns({f"a{i}": F.get("cell", F.lit(i)) for i in axes}).join(around, [f"a{i}" for i in axes])
        return points, cut(near.select("cell", "n", "other", "n_other", "parts_other"), "dbscan-near")

    def _fit_balls(self, points: DataFrame, d: int) -> None:
        """By cells of equal points, named by their least id: a range join by pivots finds how many are within eps of each, and which core cells are linked."""
        points = cut(points, "dbscan-points")
        cells = cut(points.groupBy("x").agg(F.min("id").alias("cell"), F.count(F.lit(1)).alias("n")), "dbscan-cells")
        named = cut(points.join(cells.select("x", "cell"), "x").select("id", "cell"), "dbscan-points")
        found, self.pairs_compared_ = dense_links(cells.select(F.col("cell").alias("id"), "x", "n"), d, self.eps, self.min_samples, self.metric)
        found = cut(found.toDF("cell", "other", "n", "sure"), "dbscan-links")
        pairs, around = found.where("NOT sure").select("cell", "other"), found.where("other IS NULL").groupBy("cell").agg(F.sum("n").alias("n"))
        core = cut(around.where(F.col("n") >= self.min_samples).select("cell"), "dbscan-core")
        links = pairs.where("cell < other").join(core, "cell", "left_semi").join(core.withColumnRenamed("cell", "other"), "other", "left_semi").select("cell", "other")
        links = cut(links.unionByName(found.where("sure AND cell <> other").select("cell", "other")).distinct(), "dbscan-core-links")
        labels = cut(closure(core.select(F.col("cell").alias("id")), links.select(F.col("cell").alias("u"), F.col("other").alias("v"))), "dbscan-labels")
        number = ranked(labels.select("label").distinct(), [F.col("label")], rank="cluster").withColumn("cluster", F.col("cluster").cast("int"))
        of_core = cut(labels.join(number, "label").select(F.col("id").alias("cell"), "cluster"), "dbscan-clusters")
        open_pairs = pairs.join(core, "cell", "left_anti").join(of_core.withColumnRenamed("cell", "other"), "other")
        of_border = open_pairs.groupBy("cell").agg(F.min("cluster").alias("cluster"))
        of_cell = of_core.withColumn("core", F.lit(True)).unionByName(of_border.withColumn("core", F.lit(False)))
        labelled = named.join(of_cell, "cell", "left")
        self.labels_ = cut(
            labelled.select("id", F.coalesce("cluster", F.lit(NOISE)).alias("prediction"), F.coalesce("core", F.lit(False)).alias("core")), "dbscan-result")
        self.core_samples_ = self.core_sample_indices_ = self.labels_.where("core").select("id")
        self.n_clusters_ = number.count()

    def _distance(self, x: Column, y: Column) -> Column:
        return (euclidean if self.metric == "euclidean" else manhattan)(x, y)

    def _neighbours(self, points: DataFrame, near: DataFrame, others: DataFrame) -> DataFrame:
        """(id, x, others' columns) for points (id, x, cell) and those of `others` within eps; others' cells are met part by part."""
        part = F.pmod(F.xxhash64("j"), F.col("parts_other")).alias("part")
        dealt = others.join(near.select(F.col("other").alias("cell_other"), "parts_other").distinct(), "cell_other").select("*", part).drop("parts_other")
        asked = points.join(near.select("cell", F.col("other").alias("cell_other"), "parts_other"), "cell")
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_other") - 1))).drop("parts_other")
        return asked.join(dealt, ["cell_other", "part"]).where(self._distance(F.col("x"), F.col("y")) <= self.eps)

    def _cell_links(self, core: DataFrame, near: DataFrame, d: int) -> DataFrame:
        """(u, v): the least core ids of cells of which a core point of one is a neighbour of one of the other."""
        axes = range(d)
        low, high = (F.array(*[f(F.get("x", F.lit(i))) for i in axes]) for f in (F.min, F.max))
        bounds = cut(
            core.groupBy("cell").agg(F.min("id").alias("rep"), low.alias("low"), high.alias("high"), F.ceil(F.count(F.lit(1)) / self.PART).alias("parts")),
            "dbscan-bounds"
        )
        other = bounds.select(*[F.col(c).alias(f"{c}_other") for c in bounds.columns])
        pairs = near.select("cell", F.col("other").alias("cell_other")).join(bounds, "cell").join(other, "cell_other").where("rep < rep_other")
        gap = F.zip_with(
            F.zip_with("low", "high_other", lambda a, b: a - b), F.zip_with("low_other", "high", lambda a, b: a - b), lambda a,
            b: F.greatest(a, b, F.lit(0.0))
        )
        span = F.zip_with(
            F.zip_with("high", "low_other", lambda a, b: a - b), F.zip_with("high_other", "low", lambda a, b: a - b), lambda a,
            b: F.greatest(a, b)
        )
        zero = F.transform(gap, lambda _: F.lit(0.0))
        slack = 1e-9 * self.eps  # pairs so close to the edge are left to the distances of the points
        pairs = pairs.withColumns({"least": self._distance(gap, zero), "most": self._distance(span, zero)}).where(F.col("least") <= self.eps + slack)
        pairs = cut(
            pairs.select("cell", "cell_other", "rep", "rep_other", "parts", "parts_other", (F.col("most") <= self.eps - slack).alias("sure")),
            "dbscan-pairs"
        )
        tiles = pairs.where("NOT sure").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        tiles = tiles.withColumn("part_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_other") - 1))).drop("parts", "parts_other", "sure")
        distinct = core.groupBy("cell", "x").agg(F.min("id").alias("id")).join(bounds.select("cell", "parts"), "cell")
        distinct = distinct.select("cell", "x", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
        met = tiles.join(distinct, ["cell", "part"]).join(
            distinct.select(F.col("cell").alias("cell_other"), F.col("x").alias("y"), F.col("part").alias("part_other")),
            ["cell_other", "part_other"]
        )
        open_links = met.where(self._distance(F.col("x"), F.col("y")) <= self.eps).select("rep", "rep_other").distinct()
        return pairs.where("sure").select("rep", "rep_other").unionByName(open_links).toDF("u", "v")

    def fit(self, df: DataFrame, features, label=None, id_col: str = "id") -> DBSCAN:
        self.features, self.id_col = features, id_col
        own = Features(df, features)
        self.n_features_in_ = d = len(own)
        rows = df.where(own.known).select(F.col(id_col).alias("id"), own.vector.alias("x"))
        if d > self.GRID_FEATURES:
            self._fit_balls(rows, d)
            self._fitted = True
            return self
        points, near = self._cells(rows, d)
        crowded = near.where(F.col("n") >= self.min_samples).select("cell").distinct()
        thin = points.join(crowded, "cell", "left_anti")
        around = points.select(F.col("id").alias("j"), F.col("x").alias("y"), F.col("cell").alias("cell_other"))
        enough = self._neighbours(thin, near, around).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.min_samples).select("id")
        core = cut(
            points.join(crowded, "cell", "left_semi").select("id", "x", "cell").unionByName(thin.join(enough, "id", "left_semi").select("id", "x", "cell")),
            "dbscan-core"
        )
        reps = core.groupBy("cell").agg(F.min("id").alias("rep"))
        labels = closure(reps.select(F.col("rep").alias("id")), self._cell_links(core, near, d))
        number = ranked(labels.select("label").distinct(), [F.col("label")], rank="cluster").withColumn("cluster", F.col("cluster").cast("int"))
        of_cell = reps.join(labels, reps["rep"] == labels["id"]).join(number, "label").select("cell", "cluster")
        of_core = cut(core.join(of_cell, "cell"), "dbscan-labels")
        rest = thin.join(of_core, "id", "left_anti")
        core_around = of_core.select(F.col("id").alias("j"), F.col("x").alias("y"), F.col("cell").alias("cell_other"), "cluster")
        border = self._neighbours(rest, near, core_around).groupBy("id").agg(F.min("cluster").alias("cluster"))
        of_rest = rest.select("id").join(border, "id", "left").select("id", F.coalesce("cluster", F.lit(NOISE)).alias("prediction"), F.lit(False).alias("core"))
        self.labels_ = of_core.select("id", F.col("cluster").alias("prediction"), F.lit(True).alias("core")).unionByName(of_rest)
        self.core_samples_ = self.core_sample_indices_ = core.select("id")
        self.n_clusters_ = number.count()
        self._fitted = True
        return self

    def fit_predict(self, df: DataFrame, features, label=None, id_col: str = "id") -> DataFrame:
        """`df` with prediction (-1 for noise) and core; both null where a feature is null."""
        self.fit(df, features, label, id_col)
        return df.join(self.labels_.withColumnRenamed("id", "__id"), F.col(id_col) == F.col("__id"), "left").drop("__id")


class GaussianMixture(Estimator):
    """Expectation-maximisation; each step is one pass that leaves weighted sums of a component from each partition.

    Starts from given means, or from rows drawn by hash, with the pooled variance. Output: prediction and probability.
    """

    def __init__(
        self, n_components: int = 1, max_iter: int = 100, tol: float = 1e-3, covariance_type: str = "full", reg_covar: float = 1e-6,
        random_state: int | None = None, means_init: np.ndarray | None = None
    ) -> None:
        if n_components < 1 or covariance_type not in ("full", "diag", "spherical"):
            raise ValueError("n_components >= 1 and covariance_type 'full', 'diag' or 'spherical' are required")
        self.n_components, self.max_iter, self.tol, self.covariance_type = n_components, max_iter, tol, covariance_type
        self.reg_covar, self.random_state, self.means_init = reg_covar, random_state, means_init

    def _log_joint(self, x: np.ndarray) -> np.ndarray:
        d, out = x.shape[1], np.empty((len(x), self.n_components))
        for k in range(self.n_components):
            chol = self._factors[k]
            z = np.linalg.solve(chol, (x - self.means_[k]).T)
            out[:, k] = np.log(self.weights_[k]) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(chol)).sum() - 0.5 * d * np.log(2 * np.pi)
        return out

    def _responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joint = self._log_joint(x)
        top = joint.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
        return np.exp(joint - total[:, None]), total

    def _set(self, weights: np.ndarray, means: np.ndarray, full: np.ndarray) -> None:
        """Parameters from weights, means and full covariances; the other types keep the diagonal, or its mean."""
        d = means.shape[1]
        diagonal = np.array([np.diag(c) for c in full]) + self.reg_covar
        if self.covariance_type == "full":
            self.covariances_ = full + self.reg_covar * np.eye(d)
            shapes = self.covariances_
        elif self.covariance_type == "diag":
            self.covariances_ = diagonal
            shapes = np.array([np.diag(v) for v in diagonal])
        else:
            self.covariances_ = diagonal.mean(axis=1)
            shapes = np.array([v * np.eye(d) for v in self.covariances_])
        self.weights_, self.means_ = weights, means
        self._factors = np.array([np.linalg.cholesky(s) for s in shapes])

    def fit(self, df: DataFrame, features, label=None, id_col: str = "id") -> GaussianMixture:
        self.features = features
        own = Features(df, features)
        self.n_features_in_, k = len(own), self.n_components
        d = len(own)
        rows = df.where(own.known).select(F.col(id_col).alias("id"), own.vector.alias("x")).persist()
        try:
            first = partition_sums(rows, [F.col("x")], lambda x: np.concatenate(([len(x)], x.sum(0), (x * x).sum(0))))
            if not len(first) or first[0] < k:
                raise ValueError("there are fewer rows than components")
            n = first[0]
            variance = first[1 + d :] / n - (first[1 : 1 + d] / n) ** 2
            if self.means_init is not None:
                means = np.array(self.means_init, dtype=float)
            else:
                picked = rows.orderBy(uniform(self.random_state or 0, F.col("id")), "id").limit(k).select("x").collect()
                means = np.array([r[0] for r in picked])
            self._set(np.full(k, 1 / k), means, np.array([np.diag(variance)] * k))
            self.converged_, self.lower_bound_ = False, -np.inf
            for self.n_iter_ in range(1, self.max_iter + 1):
                def work(x: np.ndarray) -> np.ndarray:
                    r, total = self._responsibilities(x)
                    second = np.einsum("nk,ni,nj->kij", r, x, x)
                    return np.concatenate(([total.sum()], r.sum(0), (r.T @ x).ravel(), second.ravel()))

                sums = partition_sums(rows, [F.col("x")], work)
                mass = sums[1 : 1 + k] + 10 * np.finfo(float).eps
                means = sums[1 + k : 1 + k + k * d].reshape(k, d) / mass[:, None]
                full = sums[1 + k + k * d :].reshape(k, d, d) / mass[:, None, None] - np.einsum("ki,kj->kij", means, means)
                bound = sums[0] / n
                self._set(mass / n, means, full)
                done = abs(bound - self.lower_bound_) < self.tol
                self.lower_bound_ = float(bound)
                if done:
                    self.converged_ = True
                    break
        finally:
            rows.unpersist()
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()

        def score(x: np.ndarray) -> dict[str, np.ndarray]:
            r, _ = self._responsibilities(x)
            return {"prediction": r.argmax(axis=1), "probability": r}

        return score_rows(df, self._width(df), score, "prediction int, probability array<double>")

    predict = predict_proba = transform

    def score(self, df: DataFrame) -> float:
        """The mean log-likelihood of a row."""
        own = self._width(df)
        sums = partition_sums(df.where(own.known), [own.vector], lambda x: np.array([self._responsibilities(x)[1].sum(), len(x)]))
        return float(sums[0] / sums[1])

    def _parameters(self) -> int:
        d, k = self.n_features_in_, self.n_components
        shape = {"full": d * (d + 1) // 2, "diag": d, "spherical": 1}[self.covariance_type]
        return k * shape + k * d + k - 1

    def bic(self, df: DataFrame) -> float:
        n = df.where(self._width(df).known).count()
        return -2 * self.score(df) * n + self._parameters() * float(np.log(n))

    def aic(self, df: DataFrame) -> float:
        n = df.where(self._width(df).known).count()
        return -2 * self.score(df) * n + 2 * self._parameters()


class _Local(Estimator):
    """Labels from a solver that has up to `max_rows` rows in one place; more stay where they are, and `labels_` is then a table (id, prediction)."""

    max_rows = LOCAL_ROWS

    def fit(self, df: DataFrame, features, label=None, id_col: str = "id"):
        self.features = features
        own = Features(df, features)
        self.n_features_in_, self.n_clusters_ = len(own), self.n_clusters
        rows = df.where(own.known).select(F.col(id_col).alias("id"), own.vector.alias("x"))
        if rows.limit(self.max_rows + 1).count() > self.max_rows:
            self._ids, self.labels_ = None, self._solve_rows(rows)
        else:
            self._ids, x, _ = local_rows(df, own, id_col, most=self.max_rows)
            self.labels_ = self._solve(x)
        self._fitted = True
        return self

    def _solve(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def _solve_rows(self, rows: DataFrame) -> DataFrame:
        """(id, prediction) of rows (id, x)."""
        raise NotImplementedError

    def fit_predict(self, df: DataFrame, features, label=None, id_col: str = "id") -> DataFrame:
        self.fit(df, features, label, id_col)
        if isinstance(self.labels_, DataFrame):
            return df.join(self.labels_.withColumnRenamed("id", "__id"), F.col(id_col) == F.col("__id"), "left").drop("__id")
        found = df.sparkSession.createDataFrame(
            [(i.item() if hasattr(i, "item") else i, int(k)) for i, k in zip(self._ids, self.labels_)],
            f"__id {dict(df.dtypes)[id_col]}, prediction int"
        )
        return df.join(F.broadcast(found), F.col(id_col) == F.col("__id"), "left").drop("__id")


class AgglomerativeClustering(_Local):
    """Greedy merges by single, complete, average or ward linkage.

    Ward starts from plain distances between single rows and goes on with sqrt(n m / (n + m)) times the distance of the means.
    Labels number the clusters by their first row.
    """

    def __init__(self, n_clusters: int = 2, linkage: str = "ward", metric: str = "euclidean") -> None:
        if n_clusters < 1 or linkage not in ("single", "complete", "average", "ward") or metric not in ("euclidean", "manhattan"):
            raise ValueError("n_clusters >= 1, a known linkage and metric are required")
        if linkage == "ward" and metric != "euclidean":
            raise ValueError("ward needs the euclidean metric")
        self.n_clusters, self.linkage, self.metric = n_clusters, linkage, metric

    def _solve_rows(self, rows: DataFrame) -> DataFrame:
        return cut(merged(rows, self.n_features_in_, self.n_clusters, self.linkage, self.metric), "merged")

    def _solve(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        if n < self.n_clusters:
            raise ValueError("there are fewer rows than clusters")
        far, size, means = start_distances(x, np.ones(n), np.arange(n), self.linkage, self.metric)
        return np.unique(greedy(far, size, means, self.linkage, self.n_clusters), return_inverse=True)[1]


class SpectralClustering(_Local):
    """k-means on the rows of the first eigenvectors of the normalised Laplacian.

    rbf affinity is exp(-d^2 / (2 gamma^2)); nearest_neighbors links each row with its n_neighbors nearest others, either way. Up to LOCAL_ROWS rows
    have one matrix; more have their eigenvectors from `millrace.plans.laplacian`, and `embedding_` is then a table (id, x), without `affinity_matrix_`.
    """

    def __init__(self, n_clusters: int = 2, affinity: str = "rbf", gamma: float = 1.0, n_neighbors: int = 10, random_state: int | None = None) -> None:
        if n_clusters < 2 or affinity not in ("rbf", "nearest_neighbors") or gamma <= 0 or n_neighbors < 1:
            raise ValueError("n_clusters >= 2, affinity 'rbf' or 'nearest_neighbors', gamma > 0 and n_neighbors >= 1 are required")
        self.n_clusters, self.affinity, self.gamma, self.n_neighbors, self.random_state = n_clusters, affinity, gamma, n_neighbors, random_state

    def _solve_rows(self, rows: DataFrame) -> DataFrame:
        if self.max_rows < self.n_clusters and rows.limit(self.n_clusters).count() < self.n_clusters:
            raise ValueError("there are fewer rows than clusters")
        seed, neighbours = self.random_state or 0, self.n_neighbors if self.affinity == "nearest_neighbors" else None
        path = new_folder(rows.sparkSession, "embedding")
        with tables(rows.sparkSession):
            spectral_rows(rows, self.n_features_in_, self.n_clusters, neighbours, self.gamma, seed).write.parquet(path)
        z = self.embedding_ = rows.sparkSession.read.parquet(path)
        model = KMeans(self.n_clusters, init=_best_of(z, self.n_clusters, range(10 * seed, 10 * seed + 10)))
        model.features, model.n_features_in_, model._fitted, model.centroids_ = "x", self.n_clusters, True, model.init
        return cut(model.transform(z).select("id", "prediction"), "spectral")

    def _solve(self, x: np.ndarray) -> np.ndarray:
        if len(x) < self.n_clusters:
            raise ValueError("there are fewer rows than clusters")
        far = np.vstack([distances(x[i : i + 64], x, "euclidean") for i in range(0, len(x), 64)])
        if self.affinity == "rbf":
            link = np.exp(-(far**2) / (2 * self.gamma**2))
        else:
            np.fill_diagonal(far, -1.0)
            order = np.argsort(far, axis=1, kind="stable")[:, 1 : self.n_neighbors + 1]
            link = np.zeros_like(far)
            np.put_along_axis(link, order, 1.0, axis=1)
            link = np.maximum(link, link.T)
        np.fill_diagonal(link, 0.0)
        self.affinity_matrix_ = link
        scale = 1 / np.sqrt(np.maximum(link.sum(axis=1), 1e-12))
        _, vectors = np.linalg.eigh(np.eye(len(x)) - scale[:, None] * link * scale[None, :])
        z = vectors[:, : self.n_clusters]
        z = self.embedding_ = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        rng, best, out = np.random.default_rng(self.random_state), np.inf, np.zeros(len(x), dtype=int)
        for _ in range(10):
            centres = z[[int(rng.integers(len(z)))]]
            while len(centres) < self.n_clusters:
                weight = ((z[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
                weight = weight + 1e-12
                centres = np.vstack([centres, z[rng.choice(len(z), p=weight / weight.sum())]])
            for _ in range(100):
                near = _near(z, centres)
                new = np.array([z[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(self.n_clusters)])
                if np.allclose(new, centres):
                    break
                centres = new
            cost = ((z - centres[near]) ** 2).sum()
            if cost < best:
                best, out = cost, near
        return out
