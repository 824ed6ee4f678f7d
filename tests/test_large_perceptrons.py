"""Mini-batches of more rows than one place takes."""

import numpy as np

from millrace.operators import neural
from millrace.sources.tables import from_arrays


def test_mini_batches_of_more_rows_than_one_place_takes(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(900, 2))
    rows = from_arrays(spark, x, (x[:, 0] > x[:, 1]).astype(int)).selectExpr("*", "x0 - x1 AS v", "array(x0, 2 * x1) AS w")
    monkeypatch.setattr(neural, "MAX_ROWS", 300)
    monkeypatch.setattr(neural, "GROUP_ROWS", 250)
    model = neural.MLPClassifier((8,), learning_rate=0.1, n_iterations=8, random_state=0).fit(rows, ["x0", "x1"], "label", "id")
    assert model.transform(rows).where("prediction = label").count() > 850
    assert len(model.loss_history_) == 8 and model.loss_history_[-1] < 0.7 * model.loss_history_[0]
    other = neural.MLPClassifier((8,), learning_rate=0.1, n_iterations=8, random_state=0).fit(rows.repartition(7), ["x0", "x1"], "label", "id")
    assert all(np.allclose(a, b) for a, b in zip(model.weights_, other.weights_))
    for label in ("v", "w"):
        own = neural.MLPRegressor((8,), learning_rate=0.05, n_iterations=8, random_state=0).fit(rows, ["x0", "x1"], label, "id")
        assert own.transform(rows).count() == 900 and own.loss_history_[-1] < 0.5 * own.loss_history_[0]
