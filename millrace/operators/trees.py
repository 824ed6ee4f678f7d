"""Trees, grown level by level for all trees at once.

The rows that a level still has to split are counted by (tree, node, feature, value); running sums over the distinct values, in
buckets where they are many, give the counts on either side of each threshold, and the best split of each node goes to the
driver: a row for each open node. Rows then move to the children by a join with these splits. A node of at most LOCAL_ROWS rows
is finished by one task, which grows all that is below it; many such nodes are finished at once. Both ways find the same
splits. Scoring compiles a small tree to a nested CASE and walks a large one over arrays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.core import Estimator, Features, score_rows
from millrace.functions.expr import by_sign, poisson_one, sigmoid, uniform
from millrace.plans.histograms import Bins, encode, find_bins, small_weights
from millrace.plans.sampling import bootstrap
from millrace.plans.scan import bucket_bounds, exact_percentile, ranked, running_sums
from millrace.storage import cut as stored
from millrace.storage import ship

#: Nodes up to which a tree is scored as a nested CASE, and rows of a node that one task finishes.
CASE_NODES, LOCAL_ROWS = 255, 50_000


@dataclass
class Node:
    """A split on feature <= threshold, or a leaf with a value (class shares, or a mean).

    `path` numbers the node by its place (0, and 2p + 1 and 2p + 2 below p): random draws depend on it.
    """

    value: list[float]
    size: float
    path: int = 0
    feature: int = -1
    threshold: float = 0.0
    left: int = -1
    right: int = -1


@dataclass
class Tree:
    """Nodes numbered as they were made; 0 is the root."""

    nodes: list[Node] = field(default_factory=list)

    def column(self, columns: Sequence[Column], leaf, at: int = 0) -> Column:
        """The tree as a nested CASE; `leaf` turns a node's value into a column."""
        node = self.nodes[at]
        if node.feature < 0:
            return leaf(node.value)
        return F.when(columns[node.feature] <= node.threshold, self.column(columns, leaf, node.left)).otherwise(self.column(columns, leaf, node.right))

    def depth(self) -> int:
        below = [0] * len(self.nodes)
        for k in range(len(self.nodes) - 1, -1, -1):  # children come after their parents
            node = self.nodes[k]
            if node.feature >= 0:
                below[k] = 1 + max(below[node.left], below[node.right])
        return below[0]

    def apply(self, x: np.ndarray, leaf) -> np.ndarray:
        """The leaf value of each row of a matrix."""
        feature, left, right = (np.array([getattr(n, a) for n in self.nodes]) for a in ("feature", "left", "right"))
        threshold, values = np.array([n.threshold for n in self.nodes]), np.array([leaf(n.value) for n in self.nodes])
        at = np.zeros(len(x), dtype=int)
        go = np.arange(len(x))
        while True:
            go = go[feature[at[go]] >= 0]
            if not len(go):
                return values[at]
            node = at[go]
            at[go] = np.where(x[go, feature[node]] <= threshold[node], left[node], right[node])


def _draw(*keys) -> float:
    """What `uniform` gives for these keys, on the driver."""
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:8], 16) / 4294967296.0


@dataclass
class _Rules:
    """How splits are chosen, wherever it is done."""

    criterion: str
    max_depth: int | None
    min_split: float
    min_leaf: float
    n_features: int | None
    seed: int
    random_thresholds: bool
    zero_gain: bool
    bins: Bins | None = None  # features are codes of these bins

    def closed(self, value: Sequence[float], size: float) -> bool:
        """Whether a node is not to be split any more."""
        return size < self.min_split or (self.criterion == "gini" and sum(v > 0 for v in value) <= 1)

    def picked(self, d: int, tree: int, path: int) -> list[int]:
        """The features that a node tries."""
        if self.n_features is None or self.n_features >= d:
            return list(range(d))
        return sorted(sorted(range(d), key=lambda f: (_draw(self.seed, "feature", tree, path, f), f))[: self.n_features])

    def impurity(self, sums: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Weighted: n times Gini, or the sum of squares about the mean; sums of stats are in the last axis."""
        if self.criterion == "gini":
            return size - (sums * sums).sum(axis=-1) / size
        return sums[..., 1] - sums[..., 0] * sums[..., 0] / size

    def best(self, x: np.ndarray, w: np.ndarray, stats: np.ndarray, tree: int, path: int) -> tuple | None:
        """(feature, threshold, largest value on the left) of the best split of a node's rows; with bins the latter is a code."""
        found, whole, size = None, stats.sum(axis=0), w.sum()
        for f in self.picked(x.shape[1], tree, path):
            order = np.argsort(x[:, f], kind="stable")
            v = x[order, f]
            upto = np.cumsum(np.column_stack([w, stats])[order], axis=0)
            last = np.flatnonzero(v[1:] > v[:-1])  # the last row of each value but the largest
            if not len(last):
                continue
            if self.random_thresholds:
                at = v[0] + _draw(self.seed, "cut", tree, path, f) * (v[-1] - v[0])
                last = np.array([np.searchsorted(v, at, side="right") - 1])
            left_size, left = upto[last, 0], upto[last, 1:]
            fits = (left_size >= self.min_leaf) & (size - left_size >= self.min_leaf)
            if not fits.any():
                continue
            left_size, left, last = left_size[fits], left[fits], last[fits]
            with np.errstate(divide="ignore", invalid="ignore"):
                rest = self.impurity(left, left_size) + self.impurity(whole - left, size - left_size)
            gain = np.round((self.impurity(whole, size) - rest) / size, 10)
            gain = np.where(np.isfinite(gain) & (self.zero_gain | (gain > 0)), gain, -np.inf)
            k = int(gain.argmax())  # the first, so the lowest threshold, of equal ones
            if np.isfinite(gain[k]) and (found is None or gain[k] > found[0]):
                if self.bins is not None:
                    t, edge = self.bins.threshold(f, v[last[k]], v[last[k] + 1]), v[last[k]]
                else:
                    t = edge = at if self.random_thresholds else float((v[last[k]] + v[last[k] + 1]) / 2)
                found = (gain[k], f, t, edge)
        return found and found[1:]

    def finish(self, x: np.ndarray, w: np.ndarray, stats: np.ndarray, tree: int, path: int, depth: int) -> list[Node]:
        """The nodes below and with one, by its rows; numbered from 0."""
        nodes = [Node(stats.sum(axis=0).tolist(), float(w.sum()), path)]
        todo = [(0, np.arange(len(x)), depth)]
        while todo:
            k, rows, depth = todo.pop()
            node = nodes[k]
            if depth == self.max_depth or self.closed(node.value, node.size):
                continue
            split = self.best(x[rows], w[rows], stats[rows], tree, node.path)
            if split is None:
                continue
            node.feature, node.threshold, edge = split
            below = x[rows, node.feature] <= edge
            node.left, node.right = len(nodes), len(nodes) + 1
            for side, own in ((1, rows[below]), (2, rows[~below])):
                nodes.append(Node(stats[own].sum(axis=0).tolist(), float(w[own].sum()), 2 * node.path + side))
                todo.append((len(nodes) - 1, own, depth + 1))
        return nodes


_NODE_SCHEMA = "tree int, top long, number int, value array<double>, size double, feature int, threshold double, left int, right int"


def _finish_nodes(work: DataFrame, forest: list[Tree], small: list[tuple[int, int]], level: int, stats: list[str], rules: _Rules) -> None:
    """Grow what is below small nodes, a task for each, and put it into their trees."""
    spark = work.sparkSession
    ship(spark)
    paths = spark.createDataFrame([(t, k, str(forest[t].nodes[k].path)) for t, k in small], "tree int, node long, path string")
    columns = ["tree", "node", "path", "w", "x", *stats]

    def run(group: pa.Table) -> pa.Table:
        width = len(group.column("x")[0])
        x = group.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        w, own = group.column("w").to_numpy(), np.column_stack([group.column(s).to_numpy() for s in stats])
        tree, top, path = (group.column(c)[0].as_py() for c in ("tree", "node", "path"))
        nodes = rules.finish(x, w, own, tree, int(path), level)
        fields = [[n.value for n in nodes], *([getattr(n, a) for n in nodes] for a in ("size", "feature", "threshold", "left", "right"))]
        kinds = [pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
        head = [pa.array([tree] * len(nodes), pa.int32()), pa.array([top] * len(nodes), pa.int64()), pa.array(range(len(nodes)), pa.int32())]
        names = [c.split()[0] for c in _NODE_SCHEMA.split(", ")]
        return pa.Table.from_arrays([*head, *(pa.array(f, k) for f, k in zip(fields, kinds))], names=names)

    rows = work.join(F.broadcast(paths), ["tree", "node"]).select(*columns)
    found: dict[tuple[int, int], list] = {}
    for r in rows.groupBy("tree", "node").applyInArrow(run, _NODE_SCHEMA).collect():
        found.setdefault((r["tree"], r["top"]), []).append(r)
    for t, top in small:
        nodes, base = forest[t].nodes, len(forest[t].nodes) - 1  # number 0 is there already
        for r in sorted(found.get((t, top), []), key=lambda r: r["number"]):
            if r["number"]:
                nodes.append(Node(r["value"], r["size"]))
            node = nodes[base + r["number"] if r["number"] else top]
            if r["feature"] >= 0:
                node.feature, node.threshold, node.left, node.right = r["feature"], r["threshold"], base + r["left"], base + r["right"]


def grow(
    rows: DataFrame, d: int, stats: list[str], criterion: str, trees: int = 1, max_depth: int | None = None, min_split: float = 2, min_leaf: float = 1,
    n_features: int | None = None, seed: int = 0, random_thresholds: bool = False, zero_gain: bool = False,
) -> list[Tree]:
    """Grow trees on `rows`: tree, id, x (array), w (weight) and the `stats` columns, already multiplied by w.

    gini: stats are class indicators. variance: stats are (y, y * y). Of equal gains the lowest feature and threshold win. With
    `random_thresholds` each feature of a node has one threshold, drawn between its least and largest value by hash.
    """
    spark = rows.sparkSession
    forest = [Tree() for _ in range(trees)]
    work = rows.withColumn("node", F.lit(0).cast("long"))
    root = work.groupBy("tree").agg(F.sum("w").alias("w"), *[F.sum(s).alias(s) for s in stats]).collect()
    for r in root:
        forest[r["tree"]].nodes.append(Node([r[s] for s in stats], r["w"]))
    if not root:
        raise ValueError("there are no rows to fit on")
    rules = _Rules(criterion, max_depth, min_split, min_leaf, n_features, seed, random_thresholds, zero_gain)
    bounds = None

    def impurity(values: list[Column], n: Column) -> Column:
        """Weighted: n times Gini, or the sum of squares about the mean."""
        if criterion == "gini":
            return n - sum((v * v for v in values[1:]), values[0] * values[0]) / F.nullif(n, F.lit(0.0))
        return values[1] - values[0] * values[0] / F.nullif(n, F.lit(0.0))

    level, edge = 0, [(t, 0) for t, tree in enumerate(forest) if tree.nodes]
    while max_depth is None or level < max_depth:
        edge = [(t, k) for t, k in edge if not rules.closed(forest[t].nodes[k].value, forest[t].nodes[k].size)]
        small = [(t, k) for t, k in edge if forest[t].nodes[k].size <= LOCAL_ROWS]  # a row weighs 1 at least
        if small:
            _finish_nodes(work, forest, small, level, stats, rules)
        done = set(small)
        edge = [e for e in edge if e not in done]
        if not edge:
            break
        if bounds is None and not random_thresholds:
            bounds = bucket_bounds(rows, d)
        live = work.join(F.broadcast(spark.createDataFrame(edge, "tree int, node long")), ["tree", "node"], "left_semi")
        pos = live.select("tree", "node", "w", *stats, F.posexplode("x").alias("f", "v"))
        if n_features is not None and n_features < d:
            picked = []
            for t, k in edge:
                picked += [(t, k, f) for f in rules.picked(d, t, forest[t].nodes[k].path)]
            pos = pos.join(F.broadcast(spark.createDataFrame(picked, "tree int, node long, f int")), ["tree", "node", "f"])
        group = ["tree", "node", "f"]
        if random_thresholds:
            drawn = spark.createDataFrame(
                [(t, k, f, _draw(seed, "cut", t, forest[t].nodes[k].path, f)) for t, k in edge for f in range(d)],
                "tree int, node long, f int, u double"
            )
            ends = pos.groupBy(*group).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi").join(F.broadcast(drawn), group)
            cut = ends.select(*group, (F.col("lo") + F.col("u") * (F.col("hi") - F.col("lo"))).alias("t"))
            on_left = F.col("v") <= F.col("t")
            joined = pos.join(F.broadcast(cut), group).groupBy(*group, "t").agg(
                F.sum("w").alias("w"), F.sum(F.when(on_left, F.col("w")).otherwise(0.0)).alias("lw"),
                *[F.sum(s).alias(s) for s in stats], *[F.sum(F.when(on_left, F.col(s)).otherwise(0.0)).alias(f"l_{s}") for s in stats])
        else:
            values = pos.groupBy(*group, "v").agg(*[F.sum(s).alias(s) for s in ("w", *stats)])
            scan = running_sums(values, group, ["w", *stats], bounds).where("nxt IS NOT NULL")
            joined = scan.select(
                *group, ((F.col("v") + F.col("nxt")) / 2).alias("t"), F.col("all_w").alias("w"), F.col("upto_w").alias("lw"),
                *[F.col(f"all_{s}").alias(s) for s in stats], *[F.col(f"upto_{s}").alias(f"l_{s}") for s in stats])
        parent = impurity([F.col(s) for s in stats], F.col("w"))
        left = impurity([F.col(f"l_{s}") for s in stats], F.col("lw"))
        right = impurity([F.col(s) - F.col(f"l_{s}") for s in stats], F.col("w") - F.col("lw"))
        gain = F.round((parent - left - right) / F.col("w"), 10)  # sums in other orders must not decide between equal gains
        fits = joined.withColumn("gain", gain).where((F.col("lw") >= min_leaf) & (F.col("w") - F.col("lw") >= min_leaf))
        if not zero_gain:
            fits = fits.where("gain > 0")
        best = F.max_by(
            F.struct("f", "t", "lw", "w", *[f"l_{s}" for s in stats], *stats),
            F.struct(F.col("gain"), (-F.col("f")).alias("nf"), (-F.col("t")).alias("nt"))
        ).alias("b")
        splits = fits.groupBy("tree", "node").agg(best).collect()
        open_ = set(edge)
        made, edge = [], []
        for r in splits:
            t, k, b = r["tree"], r["node"], r["b"]
            nodes = forest[t].nodes
            node = nodes[k]
            if (t, k) not in open_:
                continue
            node.feature, node.threshold, node.left, node.right = b["f"], float(b["t"]), len(nodes), len(nodes) + 1
            nodes.append(Node([b[f"l_{s}"] for s in stats], b["lw"], 2 * node.path + 1))
            nodes.append(Node([b[s] - b[f"l_{s}"] for s in stats], b["w"] - b["lw"], 2 * node.path + 2))
            made.append((t, k, node.feature, node.threshold, node.left, node.right))
            edge += [(t, node.left), (t, node.right)]
        level += 1
        if not made or level == max_depth:
            break
        moves = spark.createDataFrame(made, "tree int, node long, f int, t double, l long, r long")
        work = work.join(F.broadcast(moves), ["tree", "node"])  # rows of done nodes drop out; splits: one row for each open node
        work = work.withColumn("node", F.when(F.get("x", F.col("f")) <= F.col("t"), F.col("l")).otherwise(F.col("r"))).drop("f", "t", "l", "r")
        work = stored(work, "tree-rows")
    return forest


def _class_rows(df: DataFrame, own: Features, label: str, id_col: str, classes: list) -> tuple[DataFrame, list[str]]:
    stats = [f"s{i}" for i in range(len(classes))]
    rows = df.where(own.known & F.col(label).isNotNull()).select(
        F.lit(0).alias("tree"), F.col(id_col).alias("id"), own.vector.alias("x"), F.lit(1.0).alias("w"),
        *[F.when(F.col(label) == c, 1.0).otherwise(0.0).alias(s) for c, s in zip(classes, stats)])
    return rows, stats


def _sorted_classes(df: DataFrame, label: str) -> list:
    return [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]


def _share_of_first_largest(value: list[float]) -> int:
    return int(np.argmax(value))


def _most_voted(df: DataFrame, classes: list) -> DataFrame:
    """`df` with the class of the largest probability, of equal ones the first."""
    best = F.array_position("probability", F.array_max("probability")).cast("int") - 1
    return df.withColumn("prediction", F.get(F.array(*[F.lit(c) for c in classes]), best))


def _grow_classes(model, rows: DataFrame, d: int, stats: list[str], trees: int, n_features: int | None, sampled: bool, seed: int):
    """A forest by histograms from what `_class_rows` gives."""
    from millrace.operators.binned import grow_binned

    bins = find_bins(rows, d, model.max_bins)
    keep = list(stats)
    if sampled:
        if model.exact_samples:
            rows = bootstrap(rows, "id", trees, seed)
        else:
            rows = rows.withColumn("weights", small_weights(lambda t: poisson_one(uniform(seed, "boot", t, F.col("id"))), trees))
        keep.append("weights")
    coded = encode(rows, bins, keep)
    return grow_binned(
        coded, bins, stats, "gini", trees, model.max_depth, model.min_samples_split, model.min_samples_leaf, n_features, seed,
        weights="weights" if sampled else None, local_rows=model.local_rows)


class DecisionTreeClassifier(Estimator):
    """CART by Gini impurity, midpoint thresholds. probability is 1 for the leaf's majority class (of equal counts the first).

    With `max_bins` thresholds lie between so many quantile bins a feature, and a level exchanges histograms (see `binned`): for many rows.
    """

    def __init__(
        self, max_depth: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1, n_features: int | None = None,
        random_state: int | None = None, max_bins: int | None = None, local_rows: int | None = None
    ) -> None:
        self.max_depth, self.min_samples_split, self.min_samples_leaf = max_depth, min_samples_split, min_samples_leaf
        self.n_features, self.random_state, self.max_bins, self.local_rows = n_features, random_state, max_bins, local_rows

    def fit(self, df: DataFrame, features, label: str, id_col: str):
        self.features = features
        own = Features(df, features)
        self.n_features_in_, self.classes_ = len(own), _sorted_classes(df, label)
        rows, stats = _class_rows(df, own, label, id_col, self.classes_)
        if self.max_bins is not None:
            self.forest_ = _grow_classes(self, rows, len(own), stats, 1, self.n_features, False, self.random_state or 0)
            whole = self.forest_.whole(df.sparkSession)
            self.tree_, self._fitted = whole and whole[0], True
            return self
        self.tree_ = grow(
            rows, len(own), stats, "gini", 1, self.max_depth, self.min_samples_split, self.min_samples_leaf, self.n_features,
            self.random_state or 0
        )[0]
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        own, tree = self._width(df), self.tree_
        if tree is None:
            from millrace.operators.binned import votes_by_table

            return _most_voted(votes_by_table(df, own, self.forest_, len(self.classes_)), self.classes_)
        if len(tree.nodes) <= CASE_NODES:
            out = df.withColumn("__class", F.when(own.known, tree.column(own.columns, lambda v: F.lit(_share_of_first_largest(v)))))
        else:
            out = score_rows(df, own, lambda x: {"__class": tree.apply(x, _share_of_first_largest)}, "__class int")
        shares = F.array(*[(F.col("__class") == k).cast("double") for k in range(len(self.classes_))])
        out = out.withColumn("probability", F.when(F.col("__class").isNotNull(), shares))
        return out.withColumn("prediction", F.get(F.array(*[F.lit(c) for c in self.classes_]), F.col("__class"))).drop("__class")

    predict = predict_proba = transform


class _Forest(Estimator):
    """Many trees grown together, a level in one job. probability is the share of trees that vote for a class.

    With `max_bins` thresholds lie between so many quantile bins a feature, and a level exchanges histograms; then a forest of many
    nodes stays in a table (see `binned`). A bootstrap sample has as many rows as the table on average, with `exact_samples` exactly.
    """

    random_thresholds = False

    def __init__(
        self, n_estimators: int = 100, max_depth: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1,
        n_features: int | None = None, bootstrap: bool = True, random_state: int | None = None, max_bins: int | None = None, local_rows: int | None = None,
        exact_samples: bool = False
    ) -> None:
        if n_estimators < 1:
            raise ValueError("n_estimators must be at least 1")
        self.exact_samples = exact_samples
        if max_bins is not None and self.random_thresholds:
            raise ValueError("random thresholds are not binned")
        self.max_bins, self.local_rows = max_bins, local_rows
        self.n_estimators, self.max_depth, self.min_samples_split, self.min_samples_leaf = n_estimators, max_depth, min_samples_split, min_samples_leaf
        self.n_features, self.bootstrap, self.random_state = n_features, bootstrap, random_state

    def _features_of_node(self, d: int) -> int | None:
        return self.n_features

    def fit(self, df: DataFrame, features, label: str, id_col: str):
        self.features = features
        own = Features(df, features)
        self.n_features_in_, self.classes_, seed = len(own), _sorted_classes(df, label), self.random_state or 0
        rows, stats = _class_rows(df, own, label, id_col, self.classes_)
        if self.max_bins is not None:
            self.forest_ = _grow_classes(self, rows, len(own), stats, self.n_estimators, self._features_of_node(len(own)), self.bootstrap, seed)
            whole = self.forest_.whole(df.sparkSession)
            self.trees_ = self.estimators_ = whole and [t for t in whole if t.nodes]
            self._fitted = True
            return self
        if self.bootstrap and self.exact_samples:
            rows = bootstrap(rows, "id", self.n_estimators, seed)
        rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(self.n_estimators - 1))))
        if self.bootstrap:  # a row's count in a sample of as many rows with replacement is Poisson(1) in the limit
            weight = F.get("weights", F.col("tree")) if self.exact_samples else poisson_one(uniform(seed, "boot", F.col("tree"), F.col("id")))
            rows = rows.withColumn("w", weight.cast("double")).drop("weights").where("w > 0").withColumns({s: F.col(s) * F.col("w") for s in stats})
        self.trees_ = grow(
            rows, len(own), stats, "gini", self.n_estimators, self.max_depth, self.min_samples_split, self.min_samples_leaf,
            self._features_of_node(len(own)), seed, self.random_thresholds, self.random_thresholds
        )
        self.trees_ = self.estimators_ = [t for t in self.trees_ if t.nodes]
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        trees, k = self.trees_, len(self.classes_)
        if trees is None:
            from millrace.operators.binned import votes_by_table

            return _most_voted(votes_by_table(df, self._width(df), self.forest_, k), self.classes_)

        def score(x: np.ndarray) -> dict[str, np.ndarray]:
            votes = np.zeros((len(x), k))
            for tree in trees:
                votes[np.arange(len(x)), tree.apply(x, _share_of_first_largest)] += 1
            return {"probability": votes / len(trees)}

        out = score_rows(df, self._width(df), score, "probability array<double>")
        return _most_voted(out, self.classes_)

    predict = predict_proba = transform


class RandomForestClassifier(_Forest):
    """Bootstrapped trees with floor(sqrt(d)) features tried at a node by default."""

    def _features_of_node(self, d: int) -> int | None:
        return self.n_features or max(1, math.isqrt(d))


class ExtraTreesClassifier(_Forest):
    """One random threshold for each feature of a node, whatever it gains; all rows and features by default."""

    random_thresholds = True

    def __init__(
        self, n_estimators: int = 100, max_depth: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1,
        n_features: int | None = None, bootstrap: bool = False, random_state: int | None = None, max_bins: int | None = None
    ) -> None:
        super().__init__(n_estimators, max_depth, min_samples_split, min_samples_leaf, n_features, bootstrap, random_state, max_bins)


class AdaBoostClassifier(Estimator):
    """Stumps by weighted error over all (feature, distinct value, polarity); binary labels.

    A stump says +1 where polarity * x < polarity * threshold. Each round counts the weights by (feature, value, side) and
    scans them in order; weights are a function of the earlier stumps, so no state is joined.
    """

    def __init__(self, n_estimators: int = 50, learning_rate: float = 1.0, random_state: int | None = None) -> None:
        self.n_estimators, self.learning_rate, self.random_state = n_estimators, learning_rate, random_state

    def fit(self, df: DataFrame, features, label: str, id_col: str | None = None):
        self.features = features
        own = Features(df, features)
        self.n_features_in_, self.classes_ = len(own), _sorted_classes(df, label)
        if len(self.classes_) != 2:
            raise ValueError("AdaBoost needs two classes")
        rows = df.where(own.known & F.col(label).isNotNull()).select(
            own.vector.alias("x"), F.when(F.col(label) == self.classes_[1], 1).otherwise(-1).alias("y")
        ).persist()
        self.stumps_, self.estimator_errors_ = [], []
        bounds = bucket_bounds(rows, len(own))
        try:
            for _ in range(self.n_estimators):
                log_weight = -self._score([F.get("x", F.lit(i)) for i in range(len(own))]) * F.col("y")
                cells = rows.select("y", F.exp(log_weight).alias("w"), F.posexplode("x").alias("f", "v")).groupBy("f", "v").agg(
                    F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("y") == -1, F.col("w")).otherwise(0.0)).alias("m"))
                scan = running_sums(cells, ["f"], ["p", "m"], bounds)
                scan = scan.select(
                    "f", "v", "p", "m", (F.col("upto_p") - F.col("p")).alias("bp"), (F.col("upto_m") - F.col("m")).alias("bm"),
                    F.col("all_p").alias("tp"), F.col("all_m").alias("tm")
                )
                total = F.col("tp") + F.col("tm")
                # polarity 1: x < t says +1; wrong are the minus below and the plus from t on. polarity -1: x > t says +1
                plus = (F.col("bm") + F.col("tp") - F.col("bp")) / total
                above_p, above_m = F.col("tp") - F.col("bp") - F.col("p"), F.col("tm") - F.col("bm") - F.col("m")
                minus = (above_m + F.col("tp") - above_p) / total
                both = scan.select("f", "v", F.explode(F.array(
                    F.struct(F.round(plus, 12).alias("e"), F.lit(0).alias("o")),
                    F.struct(F.round(minus, 12).alias("e"), F.lit(1).alias("o"))
                )).alias("s"))
                best = both.agg(F.min(F.struct(F.col("s.e").alias("e"), F.col("f"), F.col("v"), F.col("s.o").alias("o"))).alias("b")).first()["b"]
                if best is None:
                    raise ValueError("there are no rows to fit on")
                error = min(max(best["e"], 1e-10), 1 - 1e-10)
                self.estimator_errors_.append(error)
                self.stumps_.append((best["f"], best["v"], 1 if best["o"] == 0 else -1, self.learning_rate * 0.5 * math.log((1 - error) / error)))
        finally:
            rows.unpersist()
        self.estimators_, self.estimator_weights_ = [s[:3] for s in self.stumps_], [s[3] for s in self.stumps_]
        self._fitted = True
        return self

    def _score(self, columns: list[Column]) -> Column:
        total = F.lit(0.0)
        for f, t, polarity, alpha in self.stumps_:
            says = columns[f] < t if polarity == 1 else columns[f] > t
            total = total + F.when(says, alpha).otherwise(-alpha)
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        own = self._width(df)
        out = df.withColumn("rawPrediction", F.when(own.known, self._score(own.columns)))
        return out.withColumn("prediction", by_sign(F.col("rawPrediction"), self.classes_[1], self.classes_[0]))

    predict = decision_function = transform


class _Boosting(Estimator):
    """Regression trees on residuals. The running score is an expression of the trees so far, so rows are never joined with state."""

    def __init__(
        self, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3, min_samples_leaf: int = 1, subsample: float = 1.0,
        random_state: int | None = None, max_bins: int | None = None, local_rows: int | None = None
    ) -> None:
        if not 0 < subsample <= 1:
            raise ValueError("subsample must be in (0, 1]")
        self.max_bins, self.local_rows = max_bins, local_rows
        self.n_estimators, self.learning_rate, self.max_depth, self.min_samples_leaf = n_estimators, learning_rate, max_depth, min_samples_leaf
        self.subsample, self.random_state = subsample, random_state

    def _boost(self, rows: DataFrame, d: int, residual, loss) -> None:
        """`rows` has id, x and y. Scores are cut to the shared folder every few rounds, so expressions stay short."""
        bins = None if self.max_bins is None else find_bins(rows, d, self.max_bins)
        rows = rows if bins is None else encode(rows, bins, ["id", "x", "y"])
        state = stored(rows.withColumn("score", F.lit(float(self.init_))), "boost-rows")
        self.trees_, self.train_loss_ = [], []
        self.estimators_, self.init_score_, self.init_value_ = self.trees_, self.init_, self.init_
        for t in range(self.n_estimators):
            r = residual(F.col("y"), F.col("score"))
            part = state.select(F.lit(0).alias("tree"), "id", "x" if bins is None else "codes", F.lit(1.0).alias("w"), r.alias("r"))
            if self.subsample < 1:  # as many rows as the share says, those of least hashed number
                order = [uniform(self.random_state or 0, "sub", t, F.col("id")), F.col("id")]
                part = ranked(part, order, size="all").where(F.col("rank") < F.greatest(F.floor(F.col("all") * self.subsample), F.lit(1))).drop("rank", "all")
            part = part.withColumns({"s0": F.col("r"), "s1": F.col("r") * F.col("r")}).drop("r")
            if bins is None:
                tree = grow(part, d, ["s0", "s1"], "variance", 1, self.max_depth, 2, self.min_samples_leaf, zero_gain=True)[0]
            else:
                tree = self._binned_tree(part, bins)
            for node in tree.nodes:
                node.value = [node.value[0] / node.size]
            self.trees_.append(tree)
            step = tree.column([F.get("x", F.lit(i)) for i in range(d)], lambda v: F.lit(v[0]))
            state = state.withColumn("score", F.col("score") + F.lit(self.learning_rate) * step)
            if t % 5 == 4:
                state = stored(state, "boost-rows")
            self.train_loss_.append(state.agg(loss(F.col("y"), F.col("score"))).first()[0])

    def _binned_tree(self, part: DataFrame, bins: Bins) -> Tree:
        from millrace.operators.binned import grow_binned

        forest = grow_binned(
            part, bins, ["s0", "s1"], "variance", 1, self.max_depth, 2, self.min_samples_leaf, zero_gain=True, local_rows=self.local_rows)
        whole = forest.whole(part.sparkSession)
        if whole is None:
            raise ValueError("a boosted tree has too many nodes; bound its depth")
        return whole[0]

    def _score(self, df: DataFrame) -> Column:
        self._check_fitted()
        own = self._width(df)
        total = F.lit(float(self.init_))
        for tree in self.trees_:
            total = total + F.lit(self.learning_rate) * tree.column(own.columns, lambda v: F.lit(v[0]))
        return F.when(own.known, total)


class GradientBoostingClassifier(_Boosting):
    """Binary log-loss: starts from the log-odds, fits y - p, leaves are mean residuals."""

    def fit(self, df: DataFrame, features, label: str, id_col: str):
        self.features = features
        own = Features(df, features)
        self.n_features_in_, self.classes_ = len(own), _sorted_classes(df, label)
        if len(self.classes_) != 2:
            raise ValueError("gradient boosting needs two classes")
        rows = df.where(own.known & F.col(label).isNotNull()).select(
            F.col(id_col).alias("id"), own.vector.alias("x"), (F.col(label) == self.classes_[1]).cast("double").alias("y")
        )
        share = min(max(rows.agg(F.avg("y")).first()[0], 1e-15), 1 - 1e-15)
        self.init_ = math.log(share / (1 - share))
        q = lambda s: F.greatest(F.least(sigmoid(s), F.lit(1 - 1e-15)), F.lit(1e-15))
        self._boost(rows, len(own), lambda y, s: y - sigmoid(s), lambda y, s: -F.avg(y * F.log(q(s)) + (1 - y) * F.log(1 - q(s))))
        self._fitted = True
        return self

    def transform(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        out = df.withColumn("rawPrediction", self._score(df)).withColumn("__p", sigmoid(F.col("rawPrediction")))
        out = out.withColumn("probability", F.when(F.col("__p").isNotNull(), F.array(1 - F.col("__p"), F.col("__p"))))
        return out.withColumn("prediction", by_sign(F.col("__p") - threshold, self.classes_[1], self.classes_[0])).drop("__p")

    predict = predict_proba = decision_function = transform


class GradientBoostingRegressor(_Boosting):
    """Squared loss from the mean, or absolute loss from the median with signs as residuals; leaves are means of residuals."""

    def __init__(
        self, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3, min_samples_leaf: int = 1, subsample: float = 1.0,
        loss: str = "mse", random_state: int | None = None, max_bins: int | None = None, local_rows: int | None = None
    ) -> None:
        super().__init__(n_estimators, learning_rate, max_depth, min_samples_leaf, subsample, random_state, max_bins, local_rows)
        if loss not in ("mse", "mae"):
            raise ValueError("loss is 'mse' or 'mae'")
        self.loss = loss

    def fit(self, df: DataFrame, features, label: str, id_col: str):
        self.features = features
        own = Features(df, features)
        self.n_features_in_ = len(own)
        rows = df.where(own.known & F.col(label).isNotNull()).select(F.col(id_col).alias("id"), own.vector.alias("x"), F.col(label).cast("double").alias("y"))
        self.init_ = rows.agg(F.avg("y")).first()[0] if self.loss == "mse" else exact_percentile(rows, F.col("y"), 0.5)
        if self.init_ is None:
            raise ValueError("there are no rows to fit on")
        if self.loss == "mse":
            self._boost(rows, len(own), lambda y, s: y - s, lambda y, s: F.avg((y - s) * (y - s)))
        else:
            self._boost(rows, len(own), lambda y, s: F.signum(y - s), lambda y, s: F.avg(F.abs(y - s)))
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self._score(df))

    predict = transform


def average_path(n: float) -> float:
    """The mean depth of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class IsolationForest(Estimator):
    """Random trees on small samples; rows that are parted early are outliers.

    Each tree takes the max_samples rows of least hashed number. Output: score (-2^(-E h / c)), rawPrediction (score - offset) and
    prediction, -1 for outliers and 1 otherwise; the offset is the `contamination` percentile of the scores.
    """

    def __init__(self, n_estimators: int = 100, max_samples: int | str = "auto", contamination: float = 0.1, random_state: int | None = None) -> None:
        if not 0 < contamination <= 0.5:
            raise ValueError("contamination must be in (0, 0.5]")
        self.n_estimators, self.max_samples, self.contamination, self.random_state = n_estimators, max_samples, contamination, random_state

    def fit(self, df: DataFrame, features, label=None, id_col: str = "id"):
        self.features = features
        own = Features(df, features)
        self.n_features_in_, seed = len(own), self.random_state or 0
        rows = df.where(own.known).select(F.col(id_col).alias("id"), own.vector.alias("x"))
        most = 256 if self.max_samples == "auto" else int(self.max_samples)
        # the samples of all trees: n_estimators * max_samples rows, by a window whose top rows are found before the exchange
        rank = F.row_number().over(Window.partitionBy("tree").orderBy("u", "id"))
        spread = rows.withColumn(
            "tree", F.explode(F.sequence(F.lit(0), F.lit(self.n_estimators - 1)))
        ).withColumn("u", uniform(seed, F.col("tree"), F.col("id")))
        n = rows.count()
        if not n:
            raise ValueError("there are no rows to fit on")
        # the least numbers are almost surely below this; only if a tree should find too few there, all rows compete
        for bound in (min(1.0, 8 * most / n), 1.0):
            drawn = spread.where(F.col("u") < bound).withColumn("r", rank).where(F.col("r") <= most).select("tree", "r", "x").collect()
            if len(drawn) == self.n_estimators * min(most, n):
                break
        samples: dict[int, list] = {}
        for t, r, x in sorted(drawn, key=lambda row: (row[0], row[1])):
            samples.setdefault(t, []).append(x)
        self.sample_size_ = len(samples[0])
        limit = math.ceil(math.log2(max(self.sample_size_, 2)))
        self.trees_ = self.estimators_ = [_isolation_tree(np.array(x), limit, seed, t) for t, x in samples.items()]
        self._fitted, self.offset_ = True, 0.0
        scored = self.score_samples(df.where(own.known))
        self.offset_ = exact_percentile(scored, F.col("score"), self.contamination)
        return self

    def score_samples(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        trees, c = self.trees_, average_path(self.sample_size_)

        def score(x: np.ndarray) -> dict[str, np.ndarray]:
            depth = np.mean([_path_lengths(t, x) for t in trees], axis=0)
            return {"score": -np.power(2.0, -depth / c) if c else -np.ones(len(x))}

        return score_rows(df, self._width(df), score, "score double")

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.score_samples(df).withColumn("rawPrediction", F.col("score") - F.lit(float(self.offset_)))
        return out.withColumn("prediction", by_sign(F.col("rawPrediction"), 1, -1))

    predict = decision_function = transform


def _isolation_tree(x: np.ndarray, limit: int, seed: int, tree: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, path length of a leaf); draws are hashes of seed, tree and the node's path."""
    nodes: list[tuple] = [()]
    todo = [(0, 0, x, 0)]
    while todo:
        at, path, rows, depth = todo.pop()
        f = int(_draw(seed, "feature", tree, path) * x.shape[1])
        low, high = (rows[:, f].min(), rows[:, f].max()) if len(rows) > 1 else (0.0, 0.0)
        if depth >= limit or low == high:  # a constant feature ends the branch
            nodes[at] = (-1, 0.0, -1, -1, depth + average_path(len(rows)))
            continue
        t = low + _draw(seed, "cut", tree, path) * (high - low)
        left = rows[:, f] < t
        nodes += [(), ()]
        nodes[at] = (f, t, len(nodes) - 2, len(nodes) - 1, 0.0)
        todo += [(len(nodes) - 2, 2 * path + 1, rows[left], depth + 1), (len(nodes) - 1, 2 * path + 2, rows[~left], depth + 1)]
    return nodes


def _path_lengths(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    f, t, left, right, depth = (np.array(c) for c in zip(*nodes))
    at = np.zeros(len(x), dtype=int)
    while True:
        go = np.flatnonzero(f[at] >= 0)
        if not len(go):
            return depth[at]
        below = x[go, f[at[go]]] < t[at[go]]
        at[go] = np.where(below, left[at[go]], right[at[go]])
