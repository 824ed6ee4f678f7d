"""Votes of several fitted-together classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.core import Estimator


class VotingClassifier(Estimator):
    """Hard: the most votes by weight, of equal sums the smallest class. Soft: the largest weighted mean probability.

    Estimators are (name, estimator); each scores in turn on the same rows, so no join is needed.
    """

    def __init__(self, estimators: Sequence[tuple[str, Estimator]], voting: str = "hard", weights: Sequence[float] | None = None) -> None:
        self.estimators, self.voting, self.weights = list(estimators), voting, weights

    def fit(self, df: DataFrame, features, label: str, id_col: str):
        if self.voting not in ("hard", "soft"):
            raise ValueError("voting is 'hard' or 'soft'")
        names = [n for n, _ in self.estimators]
        if not names or len(set(names)) != len(names):
            raise ValueError("estimators need distinct names")
        if self.weights is not None and len(self.weights) != len(names):
            raise ValueError("there must be a weight for each estimator")
        self.classes_ = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]
        for _, e in self.estimators:
            e.fit(df, features, label, id_col)
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with prediction, votes (weight for each class) and, for soft voting, probability."""
        self._check_fitted()
        weights = [float(w) for w in (self.weights or [1.0] * len(self.estimators))]
        classes = F.array(*[F.lit(c) for c in self.classes_])
        out, parts = df, []
        for k, (_, e) in enumerate(self.estimators):
            scored = e.transform(out)
            added = [c for c in ("prediction", "probability", "rawPrediction") if c in scored.columns]
            if self.voting == "soft":
                if "probability" not in added or not hasattr(e, "classes_"):
                    raise AttributeError("soft voting needs estimators with class probabilities")
                # the estimator's classes may be fewer than all: the others have probability 0
                places = [list(e.classes_).index(c) if c in e.classes_ else -1 for c in self.classes_]
                part = F.array(*[F.get("probability", F.lit(i)) if i >= 0 else F.lit(0.0) for i in places])
            else:
                part = F.transform(classes, lambda c: (c == F.col("prediction")).cast("double"))
            out = scored.withColumn(f"__vote{k}", part).drop(*added)
            parts.append((f"__vote{k}", weights[k]))
        total = sum(weights)
        sums = F.array(*[sum((F.get(v, F.lit(i)) * w for v, w in parts), F.lit(0.0)) for i in range(len(self.classes_))])
        out = out.withColumn("votes", sums).drop(*[v for v, _ in parts])
        if self.voting == "soft":
            out = out.withColumn("probability", F.transform("votes", lambda v: v / total))
        return out.withColumn("prediction", F.get(classes, (F.array_position("votes", F.array_max("votes")) - 1).cast("int")))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        if self.voting != "soft":
            raise AttributeError("only soft voting has probabilities")
        return self.transform(df)

    predict = transform
