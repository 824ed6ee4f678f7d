"""The library as a whole: without its optional parts, on a cluster, and the plans that operators share."""

from __future__ import annotations

import json
import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyspark
import pytest
from pyspark.sql import functions as F

from millrace.operators import bayes, cluster, decomposition, kernels, linear, metrics, neighbors, neural, splits, trees
from millrace.plans import pairs, pivots
from millrace.plans.scan import exact_percentile, ranked

ROOT = Path(__file__).resolve().parents[1]


def copy_without_llm(folder: Path) -> Path:
    shutil.copytree(ROOT, folder / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    return folder / "copy"


def names(folder: Path, before: str = "pass") -> list[list[str]]:
    code = f"import json, sys; {before}; import __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    path = os.pathsep.join([str(folder), *filter(None, [os.environ.get("PYTHONPATH")])])
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env={**os.environ, "PYTHONPATH": path}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    return json.loads(done.stdout.strip().splitlines()[-1])


def test_queries_without_the_optional_subpackage(tmp_path):
    found, sql = names(copy_without_llm(tmp_path))
    assert "gaussian_nb" in found and not [n for n in found + sql if n.startswith("op") or n == "pipeline"]


def test_queries_without_an_optional_library():
    found, _ = names(ROOT, "sys.modules['public_tokenizers'] = None")
    assert "gaussian_nb" in found and "pipeline" not in found


def test_bench_goes_on_after_a_failure():
    code = (
        "import __spark_entry__ as e, bench; real = e.queries()\n"
        "def broken(spark, folder): raise ValueError('broken on purpose')\n"
        "e.queries = lambda: {'kfold': real['kfold'], 'dbscan': broken, 'pca': real['pca']}\n"
        "bench.main()"
    )
    env = {**os.environ, "PYTHONPATH": str(ROOT), "BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2"}
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, capture_output=True, text=True, timeout=600)
    line = json.loads(done.stdout.strip().splitlines()[-1])
    assert done.returncode == 0 and set(line["queries"]) == {"kfold", "pca"} and "broken on purpose" in line["errors"]["dbscan"]


def own_spark_home(folder: Path) -> dict[str, str]:
    """Settings for a Spark of its own: the workers of a local cluster write below Spark's home, which need not be writable."""
    home = folder / "spark"
    (home / "work").mkdir(parents=True)
    for part in Path(pyspark.__file__).parent.iterdir():
        if part.name != "work":
            (home / part.name).symlink_to(part)
    return {
        "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(folder / "local"),
        "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "--driver-memory 1g pyspark-shell",
    }


def test_one_cluster_session_runs_python_steps(tmp_path):
    """Executors of their own, which have the package only as Spark sends it."""
    shared = tmp_path / "shared"
    shared.mkdir()
    code = (
        "from pyspark.sql import SparkSession\n"
        "spark = (SparkSession.builder.master('local-cluster[1,2,1024]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2')\n"
        f"    .config('spark.driver.host', '127.0.0.1').config('spark.checkpoint.dir', 'file://{shared}').getOrCreate())\n"
        "import __spark_entry__ as e\n"
        "q, folder = e.queries(), '/root/testdata/sf0.001'\n"
        "counts = [q['silhouette'](spark, folder).count(), *(q[n](spark, folder).count() for n in ('op5_token_counts', 'knn_regress') if n in q)]\n"
        "print('COUNTS', *counts)\n"
        "spark.stop()\n"
    )
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | own_spark_home(tmp_path) | {"PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, capture_output=True, text=True, timeout=900)
    counts = [line for line in done.stdout.splitlines() if line.startswith("COUNTS")]
    logs = "".join(p.read_text(errors="replace")[-1500:] for p in sorted((tmp_path / "spark/work").glob("*/*/stderr")))
    said = f"{done.stdout[-1000:]}\n{done.stderr[:3000]}\n...\n{done.stderr[-3000:]}\n{logs}"
    assert done.returncode == 0 and counts and all(int(n) > 0 for n in counts[0].split()[1:]), said
    assert (shared / "millrace").exists() and not list((shared / "millrace").iterdir())  # intermediate tables are gone


def test_clusters_need_a_shared_folder():
    from types import SimpleNamespace

    from millrace.storage import shared_dir

    nothing = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))
    context = SimpleNamespace(master="spark://somewhere:7077", _jsc=SimpleNamespace(sc=lambda: nothing))
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_tables_of_a_scope_are_deleted(spark):
    from millrace import storage

    df = spark.createDataFrame([(i, float(i % 7), i % 2) for i in range(50)], "id long, x double, y int")
    kept = storage.cut(df, "kept")
    first = len(storage._made)
    with pytest.raises(KeyError), storage.tables(spark):
        trees.DecisionTreeClassifier(3, max_bins=8).fit(df, ["x"], "y", "id").transform(df).count()
        held = storage._made[first:]
        assert held and any(storage.exists(spark, path) for path in held)
        raise KeyError
    assert not any(storage.exists(spark, path) for path in held) and kept.count() == 50 and len(storage._made) == first


# plans

def test_ranks_and_percentiles(spark, monkeypatch):
    from millrace.plans import scan

    rng = random.Random(1)
    rows = [(i, rng.randrange(40), rng.choice([None, 1.0, 2.5, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k int, v double")
    out = ranked(df, [F.col("id")], "k", size="n").collect()
    for k in range(40):
        own = sorted((r.id, r["rank"], r.n) for r in out if r.k == k)
        assert [r for _, r, _ in own] == list(range(len(own))) and all(n == len(own) for _, _, n in own)
    values = np.array([v for _, _, v in rows if v is not None])
    for most in (10**6, 10):
        monkeypatch.setattr(scan, "BUCKET_ROWS", most)
        for share in (0.0, 0.05, 0.5, 0.77, 1.0):
            assert np.isclose(exact_percentile(df, F.col("v"), share), np.percentile(values, 100 * share))
    assert exact_percentile(df.limit(0), F.col("v"), 0.5) is None


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_large_index_meets_in_blocks(spark, monkeypatch, metric):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (90, 3)).astype(float)
    df = spark.createDataFrame([(i, r.tolist(), i % 3) for i, r in enumerate(x)], "id long, x array<double>, label int")
    silhouette = {r.id: r.s for r in metrics.silhouette_samples(df, "x", "label", "id").collect()}
    whole = {r.id: r.near for r in neighbors.KNNRegressor(4, metric).fit(df, "x", "label", "id").kneighbors(df).collect()}
    far = np.abs(x[:, None] - x[None]).sum(2) if metric == "manhattan" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(90):
        assert [n.id for n in whole[i]] == sorted(range(90), key=lambda j: (far[i, j], j))[:4]
    monkeypatch.setattr(pivots, "SENT_ROWS", 25)
    monkeypatch.setattr(pivots, "PART", 7)
    monkeypatch.setattr(metrics, "INDEX_ROWS", 25)
    assert {r.id: r.near for r in neighbors.KNNRegressor(4, metric).fit(df, "x", "label", "id").kneighbors(df).collect()} == whole
    again = {r.id: r.s for r in metrics.silhouette_samples(df, "x", "label", "id").collect()}
    assert all(np.isclose(again[i], s) for i, s in silhouette.items())


def test_few_pairs_meet_by_pivots(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 20, (12, 16))
    x = np.concatenate([c + rng.normal(0, 1, (60, 16)) for c in centres])
    x = np.concatenate([x, np.repeat(x[:1], 80, axis=0)])  # a hot vector
    df = spark.createDataFrame([(i, r.tolist(), float(i)) for i, r in enumerate(x)], "id long, x array<double>, label double").repartition(3)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    wanted = {i: sorted(range(len(x)), key=lambda j: (far[i, j], j))[:7] for i in range(len(x))}
    sent = pivots.SentIndex(df.select("id", "x", F.col("label").alias("value")).toArrow(), x[::27], 16, "euclidean")
    places, _, compared = sent.search(x, 7)
    assert {i: p.tolist() for i, p in enumerate(places)} == wanted and compared.sum() < len(x) ** 2 / 5
    monkeypatch.setattr(pivots, "SENT_ROWS", 100)
    model = neighbors.KNNRegressor(7).fit(df, "x", "label", "id")
    assert {r.id: [n.id for n in r.near] for r in model.kneighbors(df).collect()} == wanted
    assert model.pairs_compared_ < len(x) ** 2 / 5
    rough = neighbors.KNNRegressor(7, probes=4).fit(df, "x", "label", "id")
    for most in (10**6, 100):  # sent, exchanged
        monkeypatch.setattr(pivots, "SENT_ROWS", most)
        near = {r.id: {n.id for n in r.near} for r in rough.kneighbors(df).collect()}
        assert sum(len(near[i] & set(ids)) for i, ids in wanted.items()) >= 0.9 * 7 * len(x)
    assert rough.pairs_compared_ < len(x) ** 2 / 2
    found, compared = pivots.range_pairs(df, 16, 4.0)
    assert sorted(map(tuple, found.collect())) == sorted(zip(*(a.tolist() for a in np.nonzero(far <= 4.0)))) and compared < len(x) ** 2 / 5


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_bounds_of_cells_hold(metric):
    rng = np.random.default_rng(1)
    for scale, shift in ((1, 0), (1e-3, 1e6), (1e9, 0)):
        x = rng.normal(0, scale, (300, 5)) + shift
        points = np.concatenate((x[:20], x[:1] + scale * 1e-9))
        to = pivots.pivot_distances(x, points, metric)
        cell = to.argmin(axis=1)
        radius = to[np.arange(300), cell]
        counts = np.bincount(cell, minlength=21)
        low, high = (np.array([f(radius[cell == j]) if counts[j] else 0 for j in range(21)]) for f in (np.min, np.max))
        own = rng.normal(0, 3 * scale, (50, 5)) + shift
        least = pivots.Cells(points, counts, low, high, metric).least(own, pivots.pivot_distances(own, points, metric))
        far = pairs.distances(own, x, metric)
        assert all((far[:, cell == j].min(axis=1) >= least[:, j]).all() for j in range(21) if counts[j])


def test_no_neighbours_of_an_empty_index(spark):
    df = spark.createDataFrame([(1, [0.0], 1.0)], "id long, x array<double>, label double")
    none = neighbors.KNNRegressor(2).fit(df, "x", "label", "id")
    none.index_ = none.index_.limit(0)
    assert none.transform(df).first().prediction is None and none.kneighbors(df.limit(0)).count() == 0


# operators at their edges

def brute_dbscan(x, eps, least, metric):
    gap = np.abs(x[:, None] - x[None])
    near = (gap.sum(2) if metric == "manhattan" else np.sqrt((gap**2).sum(2))) <= eps
    core, label = near.sum(1) >= least, np.full(len(x), -1)
    k = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = k
                    todo += [m for m in np.flatnonzero(near[j] & core) if label[m] < 0]
            k += 1
    border = [(min([label[j] for j in np.flatnonzero(near[i] & core)], default=-1)) if not core[i] else label[i] for i in range(len(x))]
    return [(int(b), bool(c)) for b, c in zip(border, core)]


@pytest.mark.parametrize(("d", "metric", "part"), [(1, "euclidean", 5000), (2, "euclidean", 3), (3, "manhattan", 5000), (5, "euclidean", 4)])
def test_dbscan_equals_brute_force(spark, monkeypatch, d, metric, part):
    monkeypatch.setattr(cluster.DBSCAN, "PART", part)
    rng = np.random.default_rng(d)
    x = np.vstack([rng.normal(0, 0.4, (50, d)), rng.normal(2, 0.4, (40, d)), rng.uniform(-2, 4, (30, d)), np.zeros((12, d))])
    x = np.round(x, 1)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, None)], "id long, x array<double>")
    eps = 0.5 * d**0.5
    out = {r.id: (r.prediction, r.core) for r in cluster.DBSCAN(eps, 5, metric).fit_predict(df, "x", id_col="id").collect()}
    assert out.pop(900) == (None, None)
    assert [out[i] for i in range(len(x))] == brute_dbscan(x, eps, 5, metric)


def test_deep_trees(spark):
    rows = spark.createDataFrame([(i, float(i), i % 2) for i in range(70)], "id long, x double, y int")
    model = trees.DecisionTreeClassifier().fit(rows, ["x"], "y", "id")
    assert model.transform(rows).where("prediction <> y").count() == 0 and model.tree_.depth() >= 6


def test_large_trees_score_alike(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame(
        [(i, float(rng.random()), float(rng.random()), int(rng.integers(0, 3))) for i in range(80)] + [(99, None, 1.0, 1)],
        "id long, a double, b double, y int"
    )
    model = trees.DecisionTreeClassifier(6).fit(rows, ["a", "b"], "y", "id")
    plain = {r.id: (r.prediction, r.probability) for r in model.transform(rows).collect()}
    monkeypatch.setattr(trees, "CASE_NODES", 1)
    assert {r.id: (r.prediction, r.probability) for r in model.transform(rows).collect()} == plain
    assert plain[99] == (None, None)


@pytest.mark.parametrize("name", ["tree", "forest", "extra", "boosting"])
def test_levels_and_single_tasks_find_the_same_trees(spark, monkeypatch, name):
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.integers(0, 9)), float(rng.random()), float(rng.integers(0, 2)), int(rng.integers(0, 3))) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int")
    make = {
        "tree": lambda: trees.DecisionTreeClassifier(4, min_samples_leaf=2), "forest": lambda: trees.RandomForestClassifier(3, 3, n_features=2, random_state=2),
        "extra": lambda: trees.ExtraTreesClassifier(3, 3, random_state=2), "boosting": lambda: trees.GradientBoostingRegressor(2, 0.5, 2),
    }[name]
    found = []
    for most in (50_000, 40, 0):
        monkeypatch.setattr(trees, "LOCAL_ROWS", most)
        out = make().fit(df, ["a", "b", "c"], "y", "id").transform(df)
        found.append({r.id: (round(float(r.prediction), 9), [round(p, 9) for p in (r.probability if name != "boosting" else [])]) for r in out.collect()})
    assert found[0] == found[1] == found[2]


def test_first_row_without_vector(spark):
    df = spark.createDataFrame([(0, None), (1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [0.0, None])], "id long, x array<double>")
    out = {r.id: r.components for r in decomposition.PCA(1).fit(df, "x").transform(df).collect()}
    assert len(out[1]) == 1 and out[1][0] is not None and (out[0] is None or out[0][0] is None)


def test_discriminant_priors_and_ratio(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0, 0], [4, 1, 0], [0, 3, 2], [2, 2, 5]])
    rows = [(i, *map(float, rng.normal(0, 1, 3) + centres[i % 4]), i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int")
    for solver in ("eigen", "svd"):
        full = decomposition.LinearDiscriminantAnalysis(solver=solver).fit(df, ["a", "b", "c"], "y")
        one = decomposition.LinearDiscriminantAnalysis(1, solver, priors=[2, 2, 4, 8]).fit(df, ["a", "b", "c"], "y")
        assert np.isclose(full.explained_variance_ratio_.sum(), 1) and one.explained_variance_ratio_.sum() < 0.95
        assert np.allclose(one.priors_, [0.125, 0.125, 0.25, 0.5])
    with pytest.raises(ValueError):
        decomposition.LinearDiscriminantAnalysis(priors=[1, 1]).fit(df, ["a", "b", "c"], "y")


def test_factorisation_losses(spark):
    rng = np.random.default_rng(5)
    x = rng.random((60, 3)) @ rng.random((3, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    for solver, loss in (("mu", "frobenius"), ("mu", "kl"), ("als", "frobenius")):
        model = decomposition.NMF(3, solver, loss, max_iter=60, random_state=0)
        w = np.array([r.components for r in model.fit_transform(df, "x").orderBy("id").collect()])
        assert np.isclose(np.linalg.norm(x - w @ model.components_), model.reconstruction_err_)
        assert model.reconstruction_err_ < 0.25 * np.linalg.norm(x) and (w >= 0).all()
    for wrong in ({"solver": "als", "beta_loss": "kl"}, {"beta_loss": "other"}):
        with pytest.raises(ValueError):
            decomposition.NMF(2, **wrong)


def test_gaussian_process_likelihood_of_other_rows(spark):
    rows = spark.createDataFrame([(i, i / 5.0, float(np.sin(i / 5))) for i in range(30)], "id long, x double, y double")
    model = kernels.GaussianProcessRegressor("rbf", noise_var=0.1).fit(rows, ["x"], "y", "id")
    assert np.isclose(model.log_marginal_likelihood(), model.log_marginal_likelihood(rows, ["x"], "y"))
    assert model.log_marginal_likelihood(rows.limit(10), ["x"], "y") != model.log_marginal_likelihood()
    ids, mean, covariance = model.predict(rows, return_cov=True)
    assert len(ids) == 30 and covariance.shape == (30, 30)
    with pytest.raises(ValueError):
        model.predict(rows, return_std=True, return_cov=True)
    with pytest.raises(ValueError):
        model.log_marginal_likelihood(rows)


def test_subsample_takes_the_share_exactly(spark, monkeypatch):
    sizes, real = [], trees.grow

    def grow(rows, *args, **named):
        sizes.append(rows.count())
        return real(rows, *args, **named)

    monkeypatch.setattr(trees, "grow", grow)
    rows = spark.createDataFrame([(i, float(i % 7), float(i)) for i in range(50)], "id long, x double, y double")
    trees.GradientBoostingRegressor(2, max_depth=1, subsample=0.5).fit(rows, ["x"], "y", "id")
    assert sizes == [25, 25]


def test_stratified_folds_have_equal_shares(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else None if i % 2 else "b") for i in range(100)], "id long, y string")
    out = splits.StratifiedKFold(4, True, 3).assign(rows, "id", "y").groupBy("y", "fold").count().collect()
    for y in ("a", "b", None):
        own = [r["count"] for r in out if r.y == y]
        assert len(own) == 4 and max(own) - min(own) <= 1


@pytest.mark.parametrize("make", [
    lambda: bayes.GaussianNB(), lambda: bayes.MultinomialNB(), lambda: bayes.BernoulliNB(binarize=2.0), lambda: linear.Ridge(0.1, 0.01, 40),
    lambda: linear.Lasso(0.05, 30), lambda: decomposition.LinearDiscriminantAnalysis(), lambda: linear.LinearRegression(0.001, 20)
], ids=["gaussian", "multinomial", "bernoulli", "ridge", "lasso", "discriminants", "wide"])
def test_folds_in_two_passes_score_as_one_by_one(spark, request, make):
    wide = request.node.callspec.id == "wide"
    rng = np.random.default_rng(9)
    x = rng.integers(0, 6, (150, 16 if wide else 3)).astype(float)
    y = (x[:, 0] + x[:, 1] + rng.normal(0, 1, 150) > 5).astype(int) + (x[:, 2] > 4)
    rows = [(i, r.tolist(), int(v)) for i, (r, v) in enumerate(zip(x, y))]
    rows += [(500, None, 1), (501, [1.0, None, *x[0, 2:].tolist()], 0), (502, x[0].tolist(), None)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int")
    score = metrics.mse_of if isinstance(make(), linear.LinearRegression | linear.ElasticNet) else None
    splitter = splits.KFold(4, True, 3)

    class OneByOne:
        def split(self, *args):
            return splitter.split(*args)

    model = make()
    model.fit = None  # is not called
    found = splits.cross_val_score(model, df, "x", "y", "id", splitter, score)
    assert np.allclose(found, splits.cross_val_score(make(), df, "x", "y", "id", OneByOne(), score), atol=1e-9)
    if make().__class__.__name__.endswith("NB"):  # a class that a training set lacks
        few = df.where("id IS NULL OR y < 2 OR id % 7 = 0")
        own = splits.KFold(3)
        assert len(splits.cross_val_score(make(), few, "x", "y", "id", own)) == 3


def test_wide_rows_by_a_randomized_range(spark):
    rng = np.random.default_rng(6)
    d, base = 2_050, np.linalg.qr(rng.normal(0, 1, (2_050, 3)))[0].T
    x = rng.normal(0, 1, (240, 3)) * [30, 20, 10] @ base + rng.normal(0, 0.2, (240, d)) + 3
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "id long, x array<double>").repartition(5)
    model = decomposition.PCA(3, "randomized", random_state=1).fit(df, "x")
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(model.explained_variance_, values[::-1][:3], rtol=1e-6)
    assert np.allclose(np.abs((model.components_ * vectors[:, ::-1][:, :3].T).sum(axis=1)), 1, atol=1e-6)
    assert np.allclose(model.explained_variance_ratio_, values[::-1][:3] / values.sum()) and np.allclose(model.mean_, x.mean(axis=0))
    narrow = df.selectExpr("id", "slice(x, 1, 6) AS x")
    full, own = (decomposition.PCA(2, **o).fit(narrow, "x") for o in ({}, {"solver": "randomized", "n_power": 12}))
    assert np.allclose(full.components_, own.components_, atol=1e-6)
    with pytest.raises(ValueError):
        decomposition.PCA(solver="randomized")


def test_oversampled_starts(spark):
    df = spark.createDataFrame([(i, float(i % 3 * 10)) for i in range(60)], "id long, x double")
    model = cluster.KMeans(3, 5, init="k-means||", random_state=4).fit(df, ["x"])
    assert sorted(model.centroids_.ravel().tolist()) == [0.0, 10.0, 20.0] and model.inertia_ == 0
    same = cluster.KMeans(3, 2, init="k-means||").fit(df.where("x = 0"), ["x"])  # fewer distinct rows than centres
    assert (same.centroids_ == 0).all()
    with pytest.raises(ValueError):
        cluster.KMeans(2, init="random")
    with pytest.raises(ValueError):
        cluster.KMeans(2, init="k-means||").fit(df.limit(0), ["x"])


def test_full_batch_fits_equal_fits_in_one_place(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, (90, 3))
    y = (x[:, 0] - x[:, 1] > 0).astype(int)
    rows = [(i, r.tolist(), int(v), [float(r[0]), float(r[2])]) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*rows, (900, None, 1, None), (901, x[0].tolist(), None, None)], "id long, x array<double>, y int, z array<double>").repartition(3)
    for kind, label in ((neural.MLPClassifier, "y"), (neural.MLPRegressor, "z"), (neural.MLPRegressor, "y")):
        make = lambda size, kind=kind: kind((4, 3), "relu", 0.1, 6, size, random_state=1)
        whole, passes = (make(size).fit(df, "x", label, "id") for size in (200, None))
        assert all(np.allclose(a, b) for a, b in zip(whole.weights_ + whole.biases_, passes.weights_ + passes.biases_))
        assert np.allclose(whole.loss_history_, passes.loss_history_)
        assert sum(r.prediction is None for r in passes.transform(df).collect()) == 1
    with pytest.raises(ValueError):
        neural.MLPClassifier((4,), weights_init=[(np.zeros((3, 3)), np.zeros(3))], batch_size=None).fit(df, "x", "y", "id")
    with pytest.raises(ValueError):
        neural.MLPRegressor((4,), batch_size=None).fit(df.limit(0), "x", "y", "id")
    svc = kernels.LinearSVC(1.0, 60, batch="all").fit(df.where("y IS NOT NULL"), "x", "y", "id")
    assert svc.transform(df).where("y IS NOT NULL AND x IS NOT NULL").agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] > 0.95
