"""Machine-learning operators: floors of quality, invariants and contracts on small invented data."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import expr
from millrace.operators import bayes, cluster, decomposition, kernels, linear, metrics, neighbors, neural, preprocessing, splits, trees, voting
from millrace.sources.tables import blobs, from_arrays

X2 = ["x0", "x1"]


@pytest.fixture(scope="module")
def two(spark):
    """Two clouds that hardly meet."""
    return blobs(spark, 160, [[-2.0, -2.0], [2.0, 2.0]], 0.8, seed=1).persist()


@pytest.fixture(scope="module")
def three(spark):
    return blobs(spark, 150, [[0.0, 0.0], [6.0, 0.0], [0.0, 6.0]], 0.6, seed=2).persist()


def share(df, label="label"):
    return df.agg(F.avg((F.col(label) == F.col("prediction")).cast("double"))).first()[0]


def agreement(df):
    """Share of rows in the commonest label of their cluster."""
    counts = df.groupBy("prediction", "label").count().groupBy("prediction").agg(F.max("count").alias("c")).agg(F.sum("c")).first()[0]
    return counts / df.count()


# metrics

def test_metrics(spark):
    df = spark.createDataFrame(
        [(1.0, 1.5, 1, 1, 0.9), (2.0, 2.0, 0, 1, 0.6), (4.0, 3.0, 1, 0, 0.2), (3.0, 3.0, 0, 0, 0.1)],
        "y double, p double, t int, g int, q double"
    )
    assert metrics.mse(df, "y", "p") == pytest.approx(1.25 / 4)
    assert metrics.rmse(df, "y", "p") == pytest.approx((1.25 / 4) ** 0.5)
    assert metrics.mae(df, "y", "p") == pytest.approx(1.5 / 4)
    assert metrics.r2_score(df, "y", "p") == pytest.approx(1 - 1.25 / 5)
    assert metrics.accuracy(df, "t", "g") == 0.5
    assert metrics.precision_recall_f1(df, "t", "g") == (0.5, 0.5, 0.5)
    assert metrics.precision_recall_f1(df, "t", "g", positive=9) == (0.0, 0.0, 0.0)
    assert metrics.log_loss(df, "t", "q") == pytest.approx(-np.mean(np.log([0.9, 0.4, 0.2, 0.9])))
    cells = {(r.truth, r.predicted): r.n for r in metrics.confusion_matrix(df, "t", "g").collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    assert "macro avg" in metrics.format_report(metrics.classification_report(df, "t", "g"))
    same = df.select(F.lit(2.0).alias("y"), F.lit(2.0).alias("p"))
    assert metrics.r2_score(same, "y", "p") == 1.0
    assert metrics.r2_score(same.withColumn("p", F.lit(3.0)), "y", "p") == 0.0


def test_silhouette(spark, three):
    assert metrics.silhouette_score(three, X2, "label", "id") > 0.7
    assert metrics.silhouette_score(three.withColumn("label", F.lit(1)), X2, "label", "id") == 0.0
    copies = from_arrays(spark, [[0.0], [0.0], [5.0], [5.0], [99.0]], [0, 0, 1, 1, -1])
    assert metrics.silhouette_score(copies, ["x0"], "label", "id") == 1.0


# splits

def test_folds(spark, two):
    sizes = [r["count"] for r in splits.KFold(7).assign(two, "id").groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [23] * 6 + [22]
    by = splits.StratifiedKFold(4, True, 3).assign(two, "id", "label").groupBy("fold", "label").count().collect()
    assert {r["count"] for r in by} == {20}
    with pytest.raises(ValueError):
        splits.KFold(1)
    a, b = ([r.fold for r in splits.KFold(3, True, s).assign(two, "id").orderBy("id").collect()] for s in (1, 2))
    assert a != b
    for train, held in splits.KFold(4).split(two, "id"):
        assert train.count() + held.count() == 160 and train.join(held, "id").count() == 0


def test_cross_validation(two):
    scores = splits.cross_val_score(bayes.GaussianNB(), two, X2, "label", "id", 3)
    assert len(scores) == 3 and scores.mean() > 0.95


# preprocessing

def test_scalers(spark):
    df = from_arrays(spark, [[1.0, 5.0], [2.0, 5.0], [6.0, 5.0]])
    s = preprocessing.StandardScaler().fit(df, X2)
    out = np.array([[r.x0, r.x1] for r in s.transform(df).orderBy("id").collect()])
    assert np.allclose(out[:, 0].std(), 1) and np.allclose(out[:, 1], 0)
    assert [r.x0 for r in s.inverse_transform(s.transform(df)).orderBy("id").collect()] == pytest.approx([1, 2, 6])
    m = preprocessing.MinMaxScaler((2, 4)).fit(df, X2)
    assert [r.x0 for r in m.transform(df).orderBy("id").collect()] == pytest.approx([2, 2.4, 4])
    assert {r.x1 for r in m.transform(df).collect()} == {2.0}
    assert {r.x1 for r in m.inverse_transform(m.transform(df)).collect()} == {5.0}
    with pytest.raises(RuntimeError):
        preprocessing.StandardScaler().transform(df)
    with pytest.raises(ValueError):
        preprocessing.MinMaxScaler((1, 1))
    with pytest.raises(ValueError):
        s.transform(df.drop("x1"))


def test_encoders(spark):
    df = spark.createDataFrame([(0, "b", "u"), (1, "a", "u"), (2, "c", "u")], "id int, c string, d string")
    e = preprocessing.LabelEncoder().fit(df, "c")
    assert [r.k for r in e.transform(df, "k").orderBy("id").collect()] == [1, 0, 2] and e.n_classes_ == 3
    assert [r.back for r in e.inverse_transform(e.transform(df, "k"), "k", "back").orderBy("id").collect()] == ["b", "a", "c"]
    with pytest.raises(Exception, match="unknown label"):
        e.transform(df.withColumn("c", F.lit("z")), "k").collect()
    with pytest.raises(Exception, match="no label"):
        e.inverse_transform(df.select(F.lit(7).alias("k")), "k").collect()
    o = preprocessing.OneHotEncoder().fit(df, ["c", "d"])
    assert o.get_feature_names_out() == ["x0_b", "x0_c", "x1_u"]
    assert [tuple(r) for r in o.transform(df).select("x0_b", "x0_c", "x1_u").orderBy("id").collect()] == [(1, 0, 1), (0, 0, 1), (0, 1, 1)]
    with pytest.raises(ValueError):
        preprocessing.OneHotEncoder("last")


# linear models

@pytest.fixture(scope="module")
def line(spark):
    base = spark.range(240).select("id", *[expr.normal(3, j, F.col("id")).alias(f"x{j}") for j in range(4)])
    return base.withColumn("label", 2.5 * F.col("x0") - F.col("x1") + 4 + 0.1 * expr.normal(4, F.col("id"))).persist()


def test_least_squares(line):
    names = [f"x{j}" for j in range(4)]
    plain = linear.LinearRegression(0.1, 300).fit(line, names, "label")
    assert plain.weights_[:2] == pytest.approx([2.5, -1], abs=0.1) and plain.bias_ == pytest.approx(4, abs=0.1)
    assert all(a >= b - 1e-9 for a, b in zip(plain.loss_history_, plain.loss_history_[1:]))
    assert metrics.r2_score(plain.transform(line), "label", "prediction") > 0.95
    ridge = linear.Ridge(1.0, 0.1, 300).fit(line, names, "label")
    assert np.linalg.norm(ridge.weights_) < np.linalg.norm(plain.weights_)
    lasso = linear.Lasso(0.3).fit(line, names, "label")
    assert np.allclose(lasso.weights_[2:], 0) and lasso.weights_[0] > 1.5
    net = linear.ElasticNet(0.3, 0.5).fit(line, names, "label")
    assert metrics.r2_score(net.transform(line), "label", "prediction") > 0.7
    with pytest.raises(ValueError):
        linear.ElasticNet(l1_ratio=2)
    with pytest.raises(RuntimeError):
        linear.Lasso().transform(line)


def test_wide_gram_equals_plain(spark, line, monkeypatch):
    from millrace.core import Features
    from millrace.plans import moments

    own = Features(line, [f"x{j}" for j in range(4)])
    plain = moments.gram(line, own, "label")
    monkeypatch.setattr(moments, "PLAIN_COLUMNS", 1)
    assert np.allclose(plain, moments.gram(line, own, "label"))


def test_logistic(two):
    model = linear.LogisticRegression(0.5, 25).fit(two, X2, "label")
    assert share(model.transform(two)) > 0.95 and model.loss_history_[-1] < model.loss_history_[0]


# naive Bayes, neighbours, votes

def test_bayes(spark, three):
    assert share(bayes.GaussianNB().fit_transform(three, X2, "label")) > 0.97
    counts = blobs(spark, 120, [[9.0, 1.0, 3.0], [1.0, 9.0, 3.0]], 0.8, seed=5)
    counts = counts.select("id", "label", *[F.greatest(F.round(f"x{j}"), F.lit(0.0)).alias(f"x{j}") for j in range(3)])
    names = ["x0", "x1", "x2"]
    assert share(bayes.MultinomialNB().fit_transform(counts, names, "label")) > 0.97
    assert share(bayes.BernoulliNB(binarize=5.0).fit_transform(counts, names, "label")) > 0.95
    with pytest.raises(ValueError):
        bayes.MultinomialNB().fit(three, X2, "label")
    out = bayes.GaussianNB().fit_transform(three, X2, "label").select(F.aggregate("probability", F.lit(0.0), lambda a, v: a + v).alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in out)


def test_neighbours(spark, two, monkeypatch):
    assert share(neighbors.KNNClassifier(3).fit(two, X2, "label", "id").transform(two)) > 0.95
    few = from_arrays(spark, [[0.0], [1.0], [2.0], [10.0]], [0.0, 1.0, 2.0, 10.0])
    one = neighbors.KNNRegressor(2, weights="distance").fit(few, ["x0"], "label", "id")
    assert [r.prediction for r in one.transform(few).orderBy("id").collect()] == pytest.approx([0, 1, 2, 10])
    tie = from_arrays(spark, [[0.0], [2.0]], [7, 5])
    at = from_arrays(spark, [[1.0]])
    assert neighbors.KNNClassifier(2).fit(tie, ["x0"], "label", "id").transform(at).first().prediction == 7
    assert neighbors.KNNClassifier(2, weights="distance").fit(tie, ["x0"], "label", "id").transform(at).first().prediction == 5
    from millrace.plans import pivots

    own = neighbors.KNNClassifier(5).fit(two, X2, "label", "id")
    whole = {r.id: r.near for r in own.kneighbors(two).collect()}
    monkeypatch.setattr(pivots, "SENT_ROWS", 50)
    assert {r.id: r.near for r in own.kneighbors(two).collect()} == whole
    with pytest.raises(ValueError):
        neighbors.KNNClassifier(0)
    with pytest.raises(ValueError):
        neighbors.KNNClassifier(metric="cosine").fit(two, X2, "label", "id").transform(two)


def test_votes(two):
    both = [("a", bayes.GaussianNB()), ("b", trees.DecisionTreeClassifier(2))]
    for kind in ("hard", "soft"):
        model = voting.VotingClassifier(both, kind, [1, 2]).fit(two, X2, "label", "id")
        assert share(model.transform(two)) > 0.9
    with pytest.raises(AttributeError):
        voting.VotingClassifier(both).fit(two, X2, "label", "id").predict_proba(two)
    with pytest.raises(ValueError):
        voting.VotingClassifier(both, "loud").fit(two, X2, "label", "id")


# trees

def test_trees(two):
    tree = trees.DecisionTreeClassifier(3).fit(two, X2, "label", "id")
    assert share(tree.transform(two)) > 0.95 and tree.tree_.depth() <= 3
    assert {tuple(r.probability) for r in tree.transform(two).collect()} <= {(0.0, 1.0), (1.0, 0.0)}


def test_buckets_change_no_split(two, monkeypatch):
    from millrace.plans import scan

    plain = trees.DecisionTreeClassifier(3).fit(two, X2, "label", "id").tree_.nodes
    stumps = trees.AdaBoostClassifier(3).fit(two, X2, "label").stumps_
    monkeypatch.setattr(scan, "BUCKET_ROWS", 10)
    monkeypatch.setattr(scan, "BUCKETS", 7)
    assert trees.DecisionTreeClassifier(3).fit(two, X2, "label", "id").tree_.nodes == plain
    for a, b in zip(trees.AdaBoostClassifier(3).fit(two, X2, "label").stumps_, stumps):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3])


def test_full_tree_fits_all(spark):
    df = from_arrays(spark, [[0, 0], [0, 1], [1, 0], [1, 1], [2, 2], [2, 2]], ["a", "b", "b", "a", "a", "b"])
    tree = trees.DecisionTreeClassifier().fit(df, X2, "label", "id")
    assert share(tree.transform(df)) == 0.5 and tree.tree_.depth() == 0  # no first split of these rows gains anything
    deep = from_arrays(spark, [[i, (i * 7) % 5] for i in range(20)], ["ab"[(i // 3) % 2] for i in range(20)])
    assert share(trees.DecisionTreeClassifier().fit(deep, X2, "label", "id").transform(deep)) == 1
    one = trees.DecisionTreeClassifier().fit(df.withColumn("label", F.lit("a")), X2, "label", "id")
    assert share(one.transform(df.withColumn("label", F.lit("a")))) == 1


def test_forests(two):
    for model in (trees.RandomForestClassifier(6, 3, random_state=1), trees.ExtraTreesClassifier(6, 4, random_state=1)):
        out = model.fit(two, X2, "label", "id").transform(two)
        assert share(out) > 0.95
    again = trees.RandomForestClassifier(6, 3, random_state=1).fit(two, X2, "label", "id")
    assert [t.nodes for t in again.trees_] == [t.nodes for t in trees.RandomForestClassifier(6, 3, random_state=1).fit(two, X2, "label", "id").trees_]


def test_boosting(two, line):
    assert share(trees.AdaBoostClassifier(5).fit(two, X2, "label").transform(two)) > 0.95
    model = trees.GradientBoostingClassifier(5, 0.5, 2).fit(two, X2, "label", "id")
    assert share(model.transform(two)) > 0.9 and model.train_loss_[-1] < model.train_loss_[0]
    for loss in ("mse", "mae"):
        fitted = trees.GradientBoostingRegressor(6, 0.5, 2, loss=loss).fit(line, X2, "label", "id")
        assert fitted.train_loss_[-1] < fitted.train_loss_[0]
    with pytest.raises(ValueError):
        trees.AdaBoostClassifier().fit(two.withColumn("label", F.lit(1)), X2, "label")


def test_isolation(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (200, 2)), rng.uniform(6, 9, (10, 2))])
    df = from_arrays(spark, x, [1] * 200 + [-1] * 10)
    out = trees.IsolationForest(40, contamination=0.05, random_state=0).fit(df, X2, id_col="id").transform(df)
    found = {(r.label, r.prediction): r["count"] for r in out.groupBy("label", "prediction").count().collect()}
    assert found.get((-1, -1), 0) >= 8 and found.get((1, 1), 0) >= 176
    assert trees.average_path(1) == 0 and trees.average_path(2) == 1
    with pytest.raises(ValueError):
        trees.IsolationForest(contamination=0.9)


# clusters

def test_kmeans(three):
    model = cluster.KMeans(3, random_state=1).fit(three, X2, id_col="id")
    assert agreement(model.transform(three)) > 0.95 and model.inertia_ > 0
    with pytest.raises(RuntimeError):
        cluster.KMeans().transform(three)


def test_dbscan(spark, three):
    model = cluster.DBSCAN(1.0, 4)
    out = model.fit_predict(three, X2, id_col="id")
    assert model.n_clusters_ == 3 and agreement(out.where("prediction >= 0")) > 0.98
    df = from_arrays(spark, [[0.0, 0], [0.5, 0], [1.0, 0], [1.5, 0], [50, 50]])
    out = [r.prediction for r in cluster.DBSCAN(0.6, 3).fit_predict(df, X2, id_col="id").orderBy("id").collect()]
    assert out == [0, 0, 0, 0, -1]
    with pytest.raises(ValueError):
        cluster.DBSCAN(0)


def test_mixture(three):
    for kind in ("full", "diag", "spherical"):
        model = cluster.GaussianMixture(3, 25, covariance_type=kind, means_init=[[1, 1], [5, 0], [0, 5]]).fit(three, X2, id_col="id")
        assert model.weights_.sum() == pytest.approx(1) and agreement(model.transform(three)) > 0.97
    assert model.bic(three) > model.aic(three)


def test_local_clusters(three):
    for linkage in ("single", "complete", "average", "ward"):
        assert agreement(cluster.AgglomerativeClustering(3, linkage).fit_predict(three, X2, id_col="id")) > (0.6 if linkage == "single" else 0.95)
    assert agreement(cluster.SpectralClustering(3, "nearest_neighbors", random_state=0).fit_predict(three, X2, id_col="id")) > 0.95
    with pytest.raises(ValueError):
        cluster.AgglomerativeClustering(2, "ward", "manhattan")


# decompositions

def test_pca(line):
    names = ["x0", "x1", "x2"]
    model = decomposition.PCA(3).fit(line, names)
    assert np.allclose(model.components_ @ model.components_.T, np.eye(3)) and model.explained_variance_ratio_.sum() == pytest.approx(1)
    back = model.inverse_transform(model.transform(line)).select(*[(F.abs(F.get("restored", F.lit(j)) - F.col(f"x{j}")) < 1e-9).alias(f"k{j}") for j in range(3)])
    assert all(all(r) for r in back.collect())


def test_discriminants(three):
    for solver in ("eigen", "svd"):
        model = decomposition.LinearDiscriminantAnalysis(solver=solver).fit(three, X2, "label")
        assert share(model.transform(three)) > 0.9


def test_ica(spark):
    rng = np.random.default_rng(0)
    sources = rng.laplace(size=(500, 2))
    df = from_arrays(spark, sources @ np.array([[1.0, 0.5], [0.4, 1.0]]))
    for algorithm in ("parallel", "deflation"):
        out = decomposition.FastICA(2, algorithm, random_state=0, max_iter=15).fit_transform(df, X2).orderBy("id").collect()
        found = np.array([r.components for r in out])
        corr = np.abs(np.corrcoef(found.T, sources.T)[:2, 2:])
        assert corr.max(axis=1).min() > 0.75


def test_nmf(spark):
    rng = np.random.default_rng(0)
    df = from_arrays(spark, rng.random((60, 2)) @ rng.random((2, 6)))
    names = [f"x{j}" for j in range(6)]
    for solver, loss in (("mu", "frobenius"), ("als", "frobenius"), ("mu", "kl")):
        model = decomposition.NMF(2, solver, loss, 30, random_state=1).fit(df, names)
        out = model.inverse_transform(model.transform(df)).orderBy("id").collect()
        x, back = np.array([[r[n] for n in names] for r in out]), np.array([r.restored for r in out])
        assert np.linalg.norm(x - back) / np.linalg.norm(x) < 0.25 and (model.components_ >= 0).all()
    with pytest.raises(ValueError):
        decomposition.NMF().fit(df.withColumn("x0", F.lit(-1.0)), names)


def test_tsne(three):
    model = decomposition.TSNE(perplexity=10, n_iterations=60, random_state=0)
    out = model.fit_transform(three.limit(60), X2, id_col="id").collect()
    y = np.array([r.components for r in out])
    assert np.isfinite(y).all() and np.allclose(y.mean(axis=0), 0, atol=1e-8) and model.kl_divergence_ >= 0
    p = model.row_affinities(np.array([1.0, 2.0, 3.0, 9.0]), np.log(2.0))
    assert abs(-(p * np.log(p)).sum() - np.log(2.0)) < 0.05
    with pytest.raises(ValueError):
        decomposition.TSNE(perplexity=99).fit_transform(three.limit(10), X2, id_col="id")


# kernel machines, Gaussian processes, perceptrons

def test_machines(two):
    assert share(kernels.LinearSVC(1.0, 1000).fit(two, X2, "label", "id").transform(two)) > 0.9
    for kernel in ("linear", "rbf"):
        model = kernels.SVC(kernel=kernel, n_iterations=20).fit(two, X2, "label", "id")
        assert share(model.transform(two)) > 0.88 and len(model.support_vectors_) < 160
    with pytest.raises(ValueError):
        kernels.SVC(kernel="cosine")
    assert kernels.signed_labels(np.array([0, 1, 2])).tolist() == [-1, 1, 1]


def test_gaussian_process(spark):
    x = np.linspace(0, 6, 40)
    df = from_arrays(spark, x, np.sin(x))
    model = kernels.GaussianProcessRegressor(noise_var=1e-6).fit(df, ["x0"], "label", "id")
    assert model.score(df, "label") > 0.98 and np.isfinite(model.log_marginal_likelihood())
    out = model.transform(df, return_std=True).collect()
    assert max(abs(r.prediction - r.label) for r in out) < 1e-2 and all(r.std >= 0 for r in out)
    ids, draws = model.sample_y(df, "id", 3, random_state=0)
    assert draws.shape == (40, 3) and len(ids) == 40
    same = kernels.GaussianProcessRegressor(lambda a, b: a @ b.T + 1.0, noise_var=0.1).fit(df, ["x0"], "label", "id")
    assert same.transform(df).count() == 40


def test_perceptrons(two, line):
    model = neural.MLPClassifier((8,), learning_rate=0.1, n_iterations=20, random_state=0).fit(two, X2, "label", "id")
    assert share(model.transform(two)) > 0.92 and model.loss_history_[-1] < model.loss_history_[0]
    fitted = neural.MLPRegressor((16,), "tanh", 0.05, 40, random_state=0).fit(line, [f"x{j}" for j in range(4)], "label", "id")
    assert metrics.r2_score(fitted.transform(line), "label", "prediction") > 0.9
    pair = line.withColumn("label", F.array("label", F.col("x2")))
    assert len(neural.MLPRegressor((4,), n_iterations=1, random_state=0).fit(pair, X2, "label", "id").transform(pair).first().prediction) == 2


# expressions and nulls

def test_expressions(spark):
    row = spark.range(1).select(
        expr.log_sum_exp(F.array(F.lit(1000.0), F.lit(1000.0))).alias("l"), expr.softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("s"), expr.sigmoid(F.lit(-9999.0)).alias("z"),
        expr.soft_threshold(F.lit(-3.0), 1.0).alias("t"), expr.gini([F.lit(2.0), F.lit(2.0)]).alias("g"), expr.manhattan(F.array(F.lit(1.0)), F.array(F.lit(4.0))).alias("m")).first()
    assert row.l == pytest.approx(1000 + np.log(2)) and list(row.s) == [0.5, 0.5] and row.z < 1e-200 and row.t == -2 and row.g == 0.5 and row.m == 3
    u = [r.u for r in spark.range(2000).select(expr.uniform(1, F.col("id")).alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.03
    w = spark.range(4000).select(F.avg(expr.poisson_one(expr.uniform(2, F.col("id"))))).first()[0]
    assert abs(w - 1) < 0.06


def test_null_features(spark, two):
    df = two.withColumn("x0", F.when(F.col("id") % 10 != 0, F.col("x0")))
    models = [
        bayes.GaussianNB(), cluster.KMeans(2, random_state=0), trees.RandomForestClassifier(2, 2, random_state=0), trees.AdaBoostClassifier(2), linear.LogisticRegression(n_iterations=3),
        trees.GradientBoostingClassifier(2, max_depth=1), kernels.LinearSVC(n_iterations=50), trees.IsolationForest(4, random_state=0),
    ]
    for model in models:
        out = model.fit(df, X2, "label", id_col="id").transform(df)
        assert out.count() == 160 and out.where("prediction IS NULL").count() == 16, model
    assert cluster.GaussianMixture(2, 3, random_state=0).fit(df, X2, id_col="id").transform(df).where("prediction IS NULL").count() == 16


def test_streaming_statistics(spark, tmp_path):
    from millrace.streaming.running import windowed_class_stats

    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).alias("label"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    found = windowed_class_stats(stream, "ts", "label", ["v"], "1 hour", "10 minutes")
    run = found.writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/state").start()
    run.awaitTermination(120)
    whole = windowed_class_stats(rows, "ts", "label", ["v"], "1 hour", "10 minutes")
    assert sorted(map(tuple, spark.table("stats").collect())) == sorted(map(tuple, whole.collect()))
