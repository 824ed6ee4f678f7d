"""Neighbours of rows without structure: what is exchanged does not grow with the number of cells."""

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import cluster, neighbors
from millrace.plans import pivots
from millrace.sources.tables import from_arrays


def test_rows_are_sent_to_tiles_once(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(400, 24)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<float>, label int")
    sizes, cut = [], pivots.cut

    def counted(df, label):
        out = cut(df, label)
        if label == "asked":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(pivots, "cut", counted)
    monkeypatch.setattr(pivots, "SENT_ROWS", 50)
    monkeypatch.setattr(pivots, "TILE", 150)
    near = neighbors.KNNRegressor(5).fit(rows, "v", "label", "id").kneighbors(rows).collect()
    far = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(axis=2))
    for r in near:
        assert [n.id for n in r.near] == np.lexsort((np.arange(400), far[r.id]))[:5].tolist()
    assert max(sizes) <= 600  # before, a row for each of the 20 cells that a row had to meet
    sizes.clear()
    eps = float(np.sort(far, axis=1)[:, 4].mean())
    found = cluster.DBSCAN(eps, 5).fit_predict(rows, "v", id_col="id").collect()
    assert {r.id for r in found if r.core} == set(np.flatnonzero((far <= eps).sum(axis=1) >= 5).tolist()) and max(sizes) <= 400


def test_whole_numbers_and_limits_leave_the_nearest_as_they_are():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 64)).astype(np.float32).astype(float)
    x[200:210], x[5] = x[0], x[5] * 50
    for metric in ("manhattan", "euclidean"):
        apart = x[:40, None] - x[None]
        d = np.abs(apart).sum(axis=2) if metric == "manhattan" else np.sqrt((apart**2).sum(axis=2))
        order = np.argsort(d, axis=1, kind="stable")[:, :5]
        for limit in (None, np.take_along_axis(d, order, axis=1)[:, -1]):
            places, far = pivots.closest(x[:40], x, 5, metric, limit)
            assert (places == order).all() and np.allclose(far, np.take_along_axis(d, order, axis=1), rtol=1e-12)
        places, far = pivots.closest(x[:40], x, 5, metric, np.zeros(40))
        assert (np.isfinite(far) == (np.take_along_axis(d, order, axis=1) == 0)).all()


def test_dense_rows_are_linked_without_all_their_pairs(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(150, 8)) * 0.1, rng.normal(size=(150, 8)) * 0.1 + 5, rng.normal(size=(30, 8)) * 3, rng.normal(size=(20, 8)) * 0.1 + [0.5] * 8])
    df = from_arrays(spark, x)
    names = [f"x{j}" for j in range(8)]
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.5
    for least in (1, 4, 12):
        core, expected, number = near.sum(axis=1) >= least, np.full(len(x), -1), 0
        for i in np.flatnonzero(core):
            if expected[i] < 0:
                todo = [i]
                while todo:
                    j = todo.pop()
                    if expected[j] < 0:
                        expected[j] = number
                        todo += np.flatnonzero(near[j] & core & (expected < 0)).tolist()
                number += 1
        for i in np.flatnonzero(~core):
            expected[i] = min(expected[near[i] & core], default=-1)
        found = {r.id: (r.prediction, r.core) for r in cluster.DBSCAN(0.5, least).fit_predict(df, names).collect()}
        assert [found[i] for i in range(len(x))] == list(zip(expected.tolist(), core.tolist()))
    points = df.select("id", F.array(*names).alias("x"), F.lit(1).cast("long").alias("n"))
    assert pivots.dense_links(points, 8, 0.5, 4)[0].where("other IS NOT NULL").count() < near.sum() / 5
