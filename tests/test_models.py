"""Saved models score as before; estimators work as stages of pyspark.ml."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.operators import bayes, binned, cluster, decomposition, kernels, linear, neighbors, neural, preprocessing, trees, voting
from millrace.sources.models import FittedStage, Stage, load_model, save_model


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(0, 1, (60, 2)), rng.normal(4, 1, (60, 2))))
    data = [(i, float(a), float(b), int(i >= 60)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame([*data, (500, None, 1.0, 0)], "id long, x0 double, x1 double, y int").cache()


MODELS = {
    "gaussian": lambda: bayes.GaussianNB(), "bernoulli": lambda: bayes.BernoulliNB(binarize=1.0), "ridge": lambda: linear.Ridge(0.1, 0.01, 20),
    "logistic": lambda: linear.LogisticRegression(0.1, 5), "neighbours": lambda: neighbors.KNNClassifier(3), "tree": lambda: trees.DecisionTreeClassifier(3),
    "forest": lambda: trees.RandomForestClassifier(3, 3, max_bins=16), "adaboost": lambda: trees.AdaBoostClassifier(3),
    "boosting": lambda: trees.GradientBoostingClassifier(2), "isolation": lambda: trees.IsolationForest(3, 32), "k-means": lambda: cluster.KMeans(2, 3, random_state=1),
    "mixture": lambda: cluster.GaussianMixture(2, 3, random_state=1), "pca": lambda: decomposition.PCA(1), "discriminants": lambda: decomposition.LinearDiscriminantAnalysis(),
    "svc": lambda: kernels.SVC(1.0), "perceptron": lambda: neural.MLPClassifier((3,), n_iterations=5, random_state=0), "scaler": lambda: preprocessing.StandardScaler(),
    "votes": lambda: voting.VotingClassifier([("a", bayes.GaussianNB()), ("b", trees.DecisionTreeClassifier(2))], "soft"),
}


@pytest.mark.parametrize("name", MODELS)
def test_saved_models_score_as_before(spark, rows, tmp_path, name):
    model = Stage(MODELS[name](), ["x0", "x1"], "y", "id").fit(rows).model
    save_model(spark, model, f"file://{tmp_path}/m")
    own = spark.newSession()
    again = load_model(own, f"file://{tmp_path}/m")
    assert sorted(map(str, again.transform(own.createDataFrame(rows.collect(), rows.schema)).collect())) == sorted(map(str, model.transform(rows).collect()))


def test_large_forests_are_saved_with_their_tables(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(binned, "SENT_NODES", 10)
    model = trees.RandomForestClassifier(3, max_bins=64, local_rows=50, random_state=1).fit(rows, ["x0", "x1"], "y", "id")
    assert model.trees_ is None
    save_model(spark, model, f"file://{tmp_path}/m")
    again = load_model(spark, f"file://{tmp_path}/m")
    assert again.forest_.path.startswith(f"file://{tmp_path}/m/")
    assert sorted(map(str, again.transform(rows).collect())) == sorted(map(str, model.transform(rows).collect()))


def test_pipelines_of_pyspark(spark, rows, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    stages = [Stage(preprocessing.StandardScaler(), ["x0", "x1"]), Stage(bayes.GaussianNB(), ["x0", "x1"], "y")]
    fitted = Pipeline(stages=stages).fit(rows)
    scaled = preprocessing.StandardScaler().fit(rows, ["x0", "x1"]).transform(rows)
    wanted = bayes.GaussianNB().fit(scaled, ["x0", "x1"], "y").transform(scaled)
    assert sorted(map(str, fitted.transform(rows).collect())) == sorted(map(str, wanted.collect()))
    fitted.save(f"file://{tmp_path}/p")
    again = PipelineModel.load(f"file://{tmp_path}/p")
    assert all(isinstance(s, FittedStage) for s in again.stages)
    assert sorted(map(str, again.transform(rows).collect())) == sorted(map(str, wanted.collect()))


def test_what_cannot_be_saved(spark, rows, tmp_path):
    with pytest.raises(RuntimeError):
        save_model(spark, bayes.GaussianNB(), f"file://{tmp_path}/m")
    model = bayes.GaussianNB().fit(rows, ["x0", "x1"], "y")
    model.extra = lambda: 1
    with pytest.raises(ValueError):
        save_model(spark, model, f"file://{tmp_path}/n")
