"""Multilayer perceptrons by gradient descent; n_iterations counts epochs.

With `batch_size=None` a step takes all rows: each partition sends the sums of its rows' gradients, so rows stay where they are, however many there
are. With mini-batches, whose steps follow one another row by row, a fit of up to MAX_ROWS rows keeps them in one place. More are dealt by the hash of
their id into groups of about GROUP_ROWS: in an epoch each group takes its own steps over all its rows from the weights at hand, and the groups' weights are averaged by
their rows (Zinkevich et al., "Parallelized Stochastic Gradient Descent", 2010). Scoring sends the weights to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.core import Estimator, Features, local_rows, matrix_of, partition_sums, score_rows
from millrace.functions.expr import uniform
from millrace.storage import ship

MAX_ROWS, GROUP_ROWS = 200_000, 50_000


def _activate(name: str, z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) if name == "relu" else np.tanh(z) if name == "tanh" else 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _slope(name: str, a: np.ndarray) -> np.ndarray:
    """The derivative, from the activation's value."""
    return (a > 0).astype(float) if name == "relu" else 1 - a**2 if name == "tanh" else a * (1 - a)


class _Perceptron(Estimator):
    def __init__(
        self, hidden_layer_sizes: tuple[int, ...] = (100,), activation: str = "relu", learning_rate: float = 1e-3, n_iterations: int = 500,
        batch_size: int | None = 32, random_state: int | None = None, weights_init: list[tuple[np.ndarray, np.ndarray]] | None = None
    ) -> None:
        if activation not in ("relu", "tanh", "sigmoid"):
            raise ValueError("activation is 'relu', 'tanh' or 'sigmoid'")
        self.hidden_layer_sizes, self.activation, self.learning_rate = tuple(hidden_layer_sizes), activation, learning_rate
        self.n_iterations, self.batch_size, self.random_state, self.weights_init = n_iterations, batch_size, random_state, weights_init

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        layers = [x]
        for k, (w, b) in enumerate(zip(self.weights_, self.biases_)):
            z = layers[-1] @ w + b
            layers.append(self._output(z) if k == len(self.weights_) - 1 else _activate(self.activation, z))
        return layers

    def _first_weights(self, inputs: int, outputs: int) -> np.random.Generator:
        """Set the weights that training starts from: those given, or normal numbers scaled by the inputs of a layer."""
        rng = np.random.default_rng(self.random_state)
        sizes = [inputs, *self.hidden_layer_sizes, outputs]
        scale = 2.0 if self.activation == "relu" else 1.0
        self.weights_ = [rng.normal(0, np.sqrt(scale / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.biases_ = [np.zeros(b) for b in sizes[1:]]
        if self.weights_init is not None:
            given = [(np.array(w, dtype=float), np.array(b, dtype=float)) for w, b in self.weights_init]
            if [w.shape for w, _ in given] != [w.shape for w in self.weights_] or [b.shape for _, b in given] != [b.shape for b in self.biases_]:
                raise ValueError("weights_init has other shapes than the layers")
            self.weights_, self.biases_ = [w for w, _ in given], [b for _, b in given]
        self.loss_history_ = []
        return rng

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """The sums over the rows of each layer's gradient, and the output. Both losses have the same gradient there: output - target."""
        layers = self._forward(x)
        delta, found = layers[-1] - y, []
        for k in range(len(self.weights_) - 1, -1, -1):
            found.append((layers[k].T @ delta, delta.sum(axis=0)))
            if k:
                delta = delta @ self.weights_[k].T * _slope(self.activation, layers[k])
        return found[::-1], layers[-1]

    def _step(self, gradients: list[tuple[np.ndarray, np.ndarray]], rows: float) -> None:
        for k, (w, b) in enumerate(gradients):
            self.weights_[k] = self.weights_[k] - self.learning_rate * w / rows
            self.biases_[k] = self.biases_[k] - self.learning_rate * b / rows

    def _train(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = self._first_weights(x.shape[1], y.shape[1])
        for _ in range(self.n_iterations):
            order = rng.permutation(len(x))
            for at in range(0, len(x), self.batch_size):
                rows = order[at : at + self.batch_size]
                self._step(self._gradients(x[rows], y[rows])[0], len(rows))
            self.loss_history_.append(self._loss(self._forward(x)[-1], y))

    def _train_in_groups(self, df: DataFrame, own: Features, target: Column, outputs: int, id_col: str, total: int) -> None:
        """Epochs of mini-batches, each a pass in which every group of rows steps by itself."""
        self._first_weights(len(own), outputs)
        spark, d, size = df.sparkSession, len(own), self.batch_size
        ship(spark)
        groups = -(-total // GROUP_ROWS)
        both = F.concat(own.vector, target.cast("array<double>")).alias("both")
        order = uniform(self.random_state or 0, F.col(id_col)).alias("order")
        dealt = df.select(F.pmod(F.xxhash64(id_col), F.lit(groups)).cast("int").alias("group"), order, F.col(id_col).alias("id"), both)
        # a partition may have several groups, one after another, so a group is the same however they are dealt
        rows = dealt.repartition(groups, "group").sortWithinPartitions("group", "order", "id").select("group", "both").persist()
        shapes = [part.shape for pair in zip(self.weights_, self.biases_) for part in pair]
        ends = np.cumsum([0, *(int(np.prod(shape)) for shape in shapes)])

        def flat(model: _Perceptron) -> np.ndarray:
            return np.concatenate([part.ravel() for pair in zip(model.weights_, model.biases_) for part in pair])

        def place(model: _Perceptron, numbers: np.ndarray) -> None:
            parts = [numbers[a:b].reshape(shape).copy() for a, b, shape in zip(ends[:-1], ends[1:], shapes)]
            model.weights_, model.biases_ = parts[::2], parts[1::2]

        def epoch(start: np.ndarray, number: int) -> np.ndarray:
            bare = type(self)(self.hidden_layer_sizes, self.activation, self.learning_rate, 1, size)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                now, seen, rest, total = None, 0, np.zeros((0, d + outputs)), np.zeros(len(start) + 2)

                def steps(block: np.ndarray, last: bool) -> np.ndarray:
                    whole = len(block) if last else len(block) // size * size
                    for at in range(0, whole, size):
                        part = block[at : min(at + size, whole)]
                        bare._step(bare._gradients(part[:, :d], part[:, d:])[0], len(part))
                    return block[whole:]

                def finished() -> None:
                    nonlocal rest
                    steps(rest, True)
                    rest = rest[:0]
                    total[0] += seen
                    total[2:] += seen * flat(bare)

                place(bare, start)
                loss = type(self)(self.hidden_layer_sizes, self.activation)
                place(loss, start)
                for batch in batches:
                    if not len(batch):
                        continue
                    group, values = batch.column(0).to_numpy(), matrix_of(batch.column(1), d + outputs)
                    total[1] += loss._loss(loss._forward(values[:, :d])[-1], values[:, d:]) * len(values)
                    for own_group in np.unique(group):
                        block = values[group == own_group]
                        if own_group != now:
                            if now is not None:
                                finished()
                            now, seen = own_group, 0
                            place(bare, start)
                        seen += len(block)
                        block = block[np.random.default_rng([number, int(own_group), seen]).permutation(len(block))]
                        rest = steps(np.concatenate((rest, block)), False)
                if now is not None:
                    finished()
                    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

            return np.sum([np.array(r[0]) for r in rows.mapInArrow(run, "sums array<double>").collect()], axis=0)

        try:
            for number in range(self.n_iterations):
                found = epoch(flat(self), number)
                if number:  # a pass has the loss that the epoch before led to
                    self.loss_history_.append(float(found[1] / found[0]))
                place(self, found[2:] / found[0])
            if self.n_iterations:
                self.loss_history_.append(float(
                    partition_sums(rows, [F.col("both")], lambda m: np.array([self._loss(self._forward(m[:, :d])[-1], m[:, d:]) * len(m)]))[0] / total))
        finally:
            rows.unpersist()

    def _many_rows(self, df: DataFrame, features, label: str) -> tuple[DataFrame, Features, int]:
        """The rows that a fit takes and, where they are more than MAX_ROWS, how many they are, else 0."""
        self.features = features
        own = Features(df, features)
        self.n_features_in_ = len(own)
        rows = df.where(own.known & F.col(label).isNotNull())
        return rows, own, rows.count() if rows.limit(MAX_ROWS + 1).count() > MAX_ROWS else 0

    def _train_in_passes(self, df: DataFrame, features, target: Column, outputs: int) -> None:
        """Full-batch steps, a pass each; `target` is an array column, null where there is no label."""
        self.features = features
        own = Features(df, features)
        self.n_features_in_ = len(own)
        self._first_weights(len(own), outputs)
        rows = df.where(own.known & target.isNotNull()).select(own.vector.alias("x"), target.cast("array<double>").alias("y")).persist()

        def work(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            found, out = self._gradients(x, y)
            return np.concatenate([[len(x), self._loss(out, y) * len(x)], *(part.ravel() for both in found for part in both)])

        try:
            for step in range(self.n_iterations + 1):  # a pass has the loss that the step before led to
                sums = partition_sums(rows, [F.col("x"), F.col("y")], work)
                if not len(sums):
                    raise ValueError("there are no rows to fit on")
                if step:
                    self.loss_history_.append(sums[1] / sums[0])
                if step < self.n_iterations:
                    shapes = [part.shape for both in zip(self.weights_, self.biases_) for part in both]
                    ends = np.cumsum([0, *(int(np.prod(shape)) for shape in shapes)]) + 2
                    flat = [sums[a:b].reshape(shape) for a, b, shape in zip(ends[:-1], ends[1:], shapes)]
                    self._step(list(zip(flat[::2], flat[1::2])), sums[0])
        finally:
            rows.unpersist()

    def _start(self, df: DataFrame, features, label: str, id_col: str) -> tuple[np.ndarray, np.ndarray]:
        self.features = features
        own = Features(df, features)
        self.n_features_in_ = len(own)
        _, x, y = local_rows(df, own, id_col, label, MAX_ROWS)
        if not len(x):
            raise ValueError("there are no rows to fit on")
        return x, y


class MLPClassifier(_Perceptron):
    """Softmax output, cross-entropy. Output: probability and prediction."""

    @staticmethod
    def _output(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    @staticmethod
    def _loss(p: np.ndarray, y: np.ndarray) -> float:
        return float(-(y * np.log(np.maximum(p, 1e-12))).sum(axis=1).mean())

    def fit(self, df: DataFrame, features, label: str, id_col: str):
        if self.batch_size is None:
            self.classes_ = sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().collect())
            hot = F.array(*[(F.col(label) == c).cast("double") for c in self.classes_])
            self._train_in_passes(df, features, F.when(F.col(label).isNotNull(), hot), len(self.classes_))
            self._fitted = True
            return self
        rows, own, total = self._many_rows(df, features, label)
        if total:
            self.classes_ = sorted(r[0] for r in rows.select(label).distinct().collect())
            hot = F.array(*[(F.col(label) == c).cast("double") for c in self.classes_])
            self._train_in_groups(rows, own, hot, len(self.classes_), id_col, total)
            self._fitted = True
            return self
        x, y = self._start(df, features, label, id_col)
        self.classes_ = sorted(set(y.tolist()))
        self._train(x, np.eye(len(self.classes_))[[self.classes_.index(v) for v in y.tolist()]])
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        out = score_rows(df, self._width(df), lambda x: {"probability": self._forward(x)[-1]}, "probability array<double>")
        best = (F.array_position("probability", F.array_max("probability")) - 1).cast("int")
        return out.withColumn("prediction", F.get(F.array(*[F.lit(c) for c in self.classes_]), best))

    predict = predict_proba = transform


class MLPRegressor(_Perceptron):
    """Linear output, half the squared error. A label that is an array has an output for each entry."""

    @staticmethod
    def _output(z: np.ndarray) -> np.ndarray:
        return z

    @staticmethod
    def _loss(p: np.ndarray, y: np.ndarray) -> float:
        return float(0.5 * ((p - y) ** 2).sum(axis=1).mean())

    def fit(self, df: DataFrame, features, label: str, id_col: str):
        if self.batch_size is None:
            self._many = dict(df.dtypes)[label].startswith("array")
            outputs = (df.agg(F.max(F.size(label))).first()[0] or 1) if self._many else 1
            target = F.when(F.col(label).isNotNull(), F.col(label) if self._many else F.array(F.col(label)))
            self._train_in_passes(df, features, target, outputs)
            self._fitted = True
            return self
        rows, own, total = self._many_rows(df, features, label)
        if total:
            self._many = dict(df.dtypes)[label].startswith("array")
            outputs = (rows.agg(F.max(F.size(label))).first()[0] or 1) if self._many else 1
            self._train_in_groups(rows, own, F.col(label) if self._many else F.array(F.col(label)), outputs, id_col, total)
            self._fitted = True
            return self
        x, y = self._start(df, features, label, id_col)
        self._many = dict(df.dtypes)[label].startswith("array")
        self._train(x, np.array(y.tolist(), dtype=float).reshape(len(x), -1))
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        if self._many:
            return score_rows(df, self._width(df), lambda x: {"prediction": self._forward(x)[-1]}, "prediction array<double>")
        return score_rows(df, self._width(df), lambda x: {"prediction": self._forward(x)[-1][:, 0]}, "prediction double")

    predict = transform
