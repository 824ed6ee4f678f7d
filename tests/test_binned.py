"""Trees by histograms: the trees of exact thresholds where values are few, and close to them where they are many."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import binned, trees
from millrace.plans import histograms


def frame(spark, x, y, parts=3):
    rows = [(i, [float(e) for e in r], int(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x array<double>, y int").repartition(parts)


def noise(n=900, values=12, d=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, values, (n, d))
    y = ((x[:, 0] + x[:, 1] > values) ^ (rng.random(n) < 0.2)).astype(int) + (x[:, 2] == 3)
    return x, y


def scores(model, df):
    return {r.id: (r.prediction, tuple(np.round(r.probability, 9))) for r in model.transform(df).collect()}


@pytest.mark.parametrize(("make", "local_rows"), [
    (lambda **o: trees.DecisionTreeClassifier(6, 5, 2, **o), 1), (lambda **o: trees.DecisionTreeClassifier(**o), 40),
    (lambda **o: trees.RandomForestClassifier(4, 5, random_state=3, **o), 5_000), (lambda **o: trees.RandomForestClassifier(4, 5, random_state=3, **o), 60),
    (lambda **o: trees.RandomForestClassifier(3, None, 2, 1, 4, False, 3, **o), 100),
], ids=["tree", "deep tree", "small forest", "forest", "all features"])
def test_few_values_give_the_exact_trees(spark, make, local_rows):
    df = frame(spark, *noise())
    model = make(max_bins=16, local_rows=local_rows).fit(df, "x", "y", "id")
    assert scores(model, df) == scores(make().fit(df, "x", "y", "id"), df)


def test_large_forests_stay_in_tables(spark, monkeypatch):
    df = frame(spark, *noise())
    make = lambda: trees.RandomForestClassifier(5, random_state=1, max_bins=16, local_rows=60)
    whole = make().fit(df, "x", "y", "id")
    wanted = scores(whole, df)
    monkeypatch.setattr(binned, "SENT_NODES", 100)
    monkeypatch.setattr(binned, "PART", 50)
    model = make().fit(df, "x", "y", "id")
    upper = sum(len(t.nodes) for t in model.forest_.trees)
    assert model.trees_ is None and model.forest_.below > 2000 and upper < 400
    assert scores(model, df) == wanted
    odd = spark.createDataFrame([(1, None, 0), (2, [1.0, None, 2.0, 3.0], 0), (3, [0.5] * 4, 0), (3, [99.0] * 4, 0)], "id long, x array<double>, y int")
    out = model.transform(odd)
    assert out.columns[:3] == odd.columns and sorted((r.id, r.prediction is None) for r in out.collect()) == [(1, True), (2, True), (3, False), (3, False)]
    tree = trees.DecisionTreeClassifier(max_bins=16, local_rows=60).fit(df, "x", "y", "id")
    assert tree.tree_ is None
    monkeypatch.setattr(binned, "SENT_NODES", 10**6)
    again = trees.DecisionTreeClassifier(max_bins=16).fit(df, "x", "y", "id")
    assert scores(tree, df) == scores(again, df)


def test_many_values_are_cut_at_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(0, 1, (1500, 3)), rng.normal(3, 1, (1500, 3))))
    x[:, 2] = np.exp(x[:, 2])
    y = np.repeat([0, 1], 1500)
    df = frame(spark, x, y)
    bins = histograms.find_bins(df, 3, 32)
    assert all(20 <= len(h) <= 32 for h in bins.high)
    codes = bins.codes(x)
    for f in range(3):
        shares = np.bincount(codes[:, f]) / len(x)
        assert shares.max() < 3 / 32 and (x[:, f] >= bins.low[f][codes[:, f]]).all() and (x[:, f] <= bins.high[f][codes[:, f]]).all()
    for cells in (1 << 22, 10):  # histograms as arrays, and as cells
        monkeypatch.setattr(histograms, "DENSE_CELLS", cells)
        model = trees.RandomForestClassifier(5, 6, random_state=0, max_bins=32, local_rows=100).fit(df, "x", "y", "id")
        assert model.transform(df).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] > 0.97
    boosted = trees.GradientBoostingClassifier(5, 0.3, 2, max_bins=32, local_rows=100).fit(df, "x", "y", "id")
    assert boosted.transform(df).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] > 0.95


def test_histograms_have_a_row_for_each_cell(spark):
    x, y = noise(4000)
    df = frame(spark, x, y, 4)
    bins = histograms.find_bins(df, 4, 16)
    coded = histograms.encode(df.withColumn("s0", (F.col("y") == 1).cast("double")), bins, ["s0"])
    walk = histograms.Walk([np.array([0, -1, -1])], [np.array([5.0, 0, 0])], [np.array([1, 0, 0])], [np.array([2, 0, 0])], [np.array([-1, 0, 1])])
    rows = histograms.histograms(coded, bins, walk, 2, None, ["s0"], None).collect()
    left = x[:, 0] <= 5
    wanted = {(int(not side), f, v): (float((own := (left == side) & (x[:, f] == v)).sum()), float((own & (y == 1)).sum()))
              for side in (True, False) for f in range(4) for v in range(12) if ((left == side) & (x[:, f] == v)).any()}
    assert {(r.slot, r.f, r.b): (r.w, r.s0) for r in rows} == wanted


def test_bins_at_their_edges(spark):
    df = spark.createDataFrame([(0, [1.0, float("nan")]), (1, [1.0, -0.0]), (2, [1.0, 0.0])], "id long, x array<double>")
    bins = histograms.find_bins(df, 2, 2)
    assert bins.high[0].tolist() == [1.0] and bins.codes(np.array([[1.0, np.nan], [7.0, -5.0]])).tolist() == [[0, len(bins.high[1]) - 1], [0, 0]]
    with pytest.raises(ValueError):
        histograms.find_bins(df.limit(0), 2, 2)
    with pytest.raises(ValueError):
        histograms.find_bins(df, 2, 1)
    with pytest.raises(ValueError):
        trees.ExtraTreesClassifier(2, max_bins=8)


def test_samples_have_exactly_as_many_rows(spark):
    df = frame(spark, *noise(500))
    from millrace.plans.sampling import bootstrap

    rows = bootstrap(df, "id", 4, 2).collect()
    counts = np.array([r.weights for r in rows])
    assert (counts.sum(axis=0) == 500).all() and len(rows) == 500 and not (counts[:, 0] == counts[:, 1]).all()
    assert 0.55 < (counts > 0).mean() < 0.7 and bootstrap(df.limit(0), "id", 4).count() == 0
    make = lambda **o: trees.RandomForestClassifier(3, 4, random_state=2, exact_samples=True, **o).fit(df, "x", "y", "id")
    exact, histogram = make(), make(max_bins=16, local_rows=100)
    assert all(t.nodes[0].size == 500 for t in [*exact.trees_, *histogram.trees_]) and scores(exact, df) == scores(histogram, df)
