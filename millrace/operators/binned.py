"""Trees grown by histograms, and forests as tables.

Rows are stored once as bin codes, with a small weight for each tree. At each level every task sums the rows of its open nodes by (node,
feature, bin), so what is exchanged is bounded by nodes x features x bins, whatever the rows. Where all features are tried, only the smaller of two
siblings is summed; the other is their parent less it. Windows over a feature's bins find the best split of each node.

The driver holds the upper nodes only: those of more rows than `local_rows`, which rises with the rows so that a level has at most
SENT_NODES of them in all trees, and their children. What is below a smaller node is grown by one task from its rows' codes, and stays in a Parquet table with a row
for each such node, keyed by (tree, top). A forest of up to SENT_NODES nodes is then read into place; a larger one is scored by
joining rows with the subtrees that they come to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.core import Features, matrix_of
from millrace.operators.trees import LOCAL_ROWS, Node, Tree, _Rules
from millrace.plans.histograms import Bins, Walk, blocks, codes_of, histograms, weights_of
from millrace.storage import cut, ship, write_table

#: Open nodes of a level, and nodes of a forest that is read into place, at most; rows that meet a subtree at once in scoring.
SENT_NODES, PART = 500_000, 20_000

SUBTREE = (
    "tree int, top int, nodes int, feature array<int>, threshold array<double>, left array<int>, right array<int>, size array<double>, value array<double>"
)


@dataclass
class Forest:
    """Trees whose upper nodes are here; the node `tops[t][n]` of a tree goes on in the table of subtrees, which has `below` nodes."""

    trees: list[Tree]
    tops: list[dict[int, int]]
    path: str | None
    below: int

    def subtrees(self, spark) -> DataFrame:
        return spark.read.schema(SUBTREE).parquet(self.path)

    def whole(self, spark) -> list[Tree] | None:
        """All trees with their subtrees in place, if they have at most SENT_NODES nodes together."""
        if self.below + sum(len(t.nodes) for t in self.trees) > SENT_NODES:
            return None
        if self.path:
            for r in self.subtrees(spark).collect():
                nodes, width = self.trees[r.tree].nodes, len(r.value) // r.nodes
                base = len(nodes) - 1  # the first takes the place of the top
                place = lambda k, top=r.top, base=base: top if k == 0 else base + k
                own = [Node(list(r.value[k * width : (k + 1) * width]), r.size[k], 0, r.feature[k], r.threshold[k],
                            place(r.left[k]) if r.feature[k] >= 0 else -1, place(r.right[k]) if r.feature[k] >= 0 else -1) for k in range(r.nodes)]
                nodes[r.top] = own[0]
                nodes += own[1:]
            self.path, self.below, self.tops = None, 0, [{} for _ in self.trees]
        return self.trees


def _walk(trees: list[Tree], slots: list[dict[int, int]], edges: list[list[float]] | None = None) -> Walk:
    """The trees for walking down by code (with the codes' edges), or by value."""
    def columns(name: str) -> list[np.ndarray]:
        return [np.array([getattr(n, name) for n in t.nodes]) for t in trees]

    slot = [np.full(len(t.nodes), -1, dtype=np.int64) for t in trees]
    for own, numbers in zip(slot, slots):
        own[list(numbers)] = list(numbers.values())
    edge = [np.array(e) for e in edges] if edges is not None else columns("threshold")
    return Walk(columns("feature"), edge, columns("left"), columns("right"), slot)


def _splits(sums: DataFrame, stats: list[str], rules: _Rules) -> list:
    """(slot, b): the best split of each slot as (f, bin, next bin, sums on the left, all sums)."""
    upto = Window.partitionBy("slot", "f").orderBy("b")
    running, every = upto.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("slot", "f")
    scan = sums.select(
        "slot", "f", "b", F.lead("b").over(upto).alias("nxt"), F.sum("w").over(running).alias("lw"), F.sum("w").over(every).alias("w"),
        *[F.sum(s).over(running).alias(f"l_{s}") for s in stats], *[F.sum(s).over(every).alias(s) for s in stats]).where("nxt IS NOT NULL")

    def impurity(values, n):
        if rules.criterion == "gini":
            return n - sum((v * v for v in values[1:]), values[0] * values[0]) / F.nullif(n, F.lit(0.0))
        return values[1] - values[0] * values[0] / F.nullif(n, F.lit(0.0))

    parent = impurity([F.col(s) for s in stats], F.col("w"))
    left = impurity([F.col(f"l_{s}") for s in stats], F.col("lw"))
    right = impurity([F.col(s) - F.col(f"l_{s}") for s in stats], F.col("w") - F.col("lw"))
    gain = F.round((parent - left - right) / F.col("w"), 10)
    fits = scan.withColumn("gain", gain).where((F.col("lw") >= rules.min_leaf) & (F.col("w") - F.col("lw") >= rules.min_leaf))
    if not rules.zero_gain:
        fits = fits.where("gain > 0")
    best = F.max_by(
        F.struct("f", "b", "nxt", "lw", "w", *[f"l_{s}" for s in stats], *stats),
        F.struct(F.col("gain"), (-F.col("f")).alias("nf"), (-F.col("b")).alias("nb"))
    ).alias("b")
    return fits.groupBy("slot").agg(best).collect()  # a row for each open node


def _other_siblings(before: DataFrame, own: DataFrame, pairs: list[tuple[int, int, int]], stats: list[str]) -> DataFrame:
    """Sums of all slots of a level: those counted, and their siblings' by subtraction. pairs: slot of parent, counted child, other child."""
    frame = F.broadcast(own.sparkSession.createDataFrame(pairs, "parent long, slot long, other long"))  # a row for each open node
    sums = ["w", *stats]
    counted = own.select("slot", "f", "b", *[F.col(s).alias(f"own_{s}") for s in sums])
    whole = before.withColumnRenamed("slot", "parent").join(frame, "parent").join(counted, ["slot", "f", "b"], "left")
    rest = whole.select(F.col("other").alias("slot"), "f", "b", *[(F.col(s) - F.coalesce(f"own_{s}", F.lit(0.0))).alias(s) for s in sums])
    return own.select("slot", "f", "b", *sums).unionByName(rest.where("w > 0.5"))


def grow_binned(
    coded: DataFrame, bins: Bins, stats: list[str], criterion: str, trees: int = 1, max_depth: int | None = None, min_split: float = 2, min_leaf: float = 1,
    n_features: int | None = None, seed: int = 0, zero_gain: bool = False, weights: str | None = None, local_rows: int | None = None,
) -> Forest:
    """Grow trees on `coded`, a written table with codes, the `stats` columns and `weights`, an array with a whole number for each tree.

    gini: stats are class indicators. variance: stats are (y, y * y). Of equal gains the lowest feature and threshold win. Where features
    have no more values than bins, the trees are those of exact thresholds.
    """
    spark = coded.sparkSession
    ship(spark)
    d, rows = len(bins.high), coded.count()
    local = max(local_rows or LOCAL_ROWS, -(-rows * trees // SENT_NODES))
    rules = _Rules(criterion, max_depth, min_split, min_leaf, n_features, seed, False, zero_gain, bins)
    forest = [Tree() for _ in range(trees)]
    edges: list[list[float]] = [[] for _ in forest]
    for t, sums in _totals(coded, stats, trees, weights).items():
        forest[t].nodes.append(Node(sums[1:].tolist(), float(sums[0])))
        edges[t].append(0.0)
    if not any(t.nodes for t in forest):
        raise ValueError("there are no rows to fit on")
    subtract = n_features is None or n_features >= d
    tops: list[dict[int, int]] = [{} for _ in forest]  # node: depth
    level, edge, before, made = 0, [(t, 0) for t, tree in enumerate(forest) if tree.nodes], None, []
    while max_depth is None or level < max_depth:
        edge = [(t, k) for t, k in edge if not rules.closed(forest[t].nodes[k].value, forest[t].nodes[k].size)]
        for t, k in edge:
            if forest[t].nodes[k].size <= local:  # a row weighs 1 at least
                tops[t][k] = level
        edge = [(t, k) for t, k in edge if k not in tops[t]]
        if not edge:
            break
        slot_of = {e: s for s, e in enumerate(edge)}
        # of two siblings the one with fewer rows is summed; one whose sibling is finished otherwise is summed itself
        pairs, counted = [], dict(slot_of)
        if subtract and before is not None:
            for parent, t, left, right in made:
                few, many = sorted((left, right), key=lambda k: forest[t].nodes[k].size)
                if (t, many) in slot_of:
                    own = slot_of.get((t, few))
                    if own is None:  # its sums are needed all the same
                        own = counted[t, few] = len(edge) + len(pairs)
                    pairs.append((parent, own, slot_of[t, many]))
                    del counted[t, many]
        walk = _walk(forest, [{k: s for (u, k), s in counted.items() if u == t} for t in range(trees)], edges)
        picked = None if subtract else np.array([rules.picked(d, t, forest[t].nodes[k].path) for t, k in edge])
        slots = max(counted.values()) + 1
        sums = histograms(coded, bins, walk, slots, picked, stats, weights)
        if subtract:
            sums = cut(sums, "tree-sums")
            if pairs:
                sums = cut(_other_siblings(before, sums, pairs, stats), "tree-sums")
            before = sums
        found = {r.slot: r.b for r in _splits(sums.where(F.col("slot") < len(edge)), stats, rules)}
        made, children = [], []
        for s, (t, k) in enumerate(edge):
            if s not in found:
                continue
            b, nodes = found[s], forest[t].nodes
            node = nodes[k]
            node.feature, node.threshold, node.left, node.right = b.f, bins.threshold(b.f, b.b, b.nxt), len(nodes), len(nodes) + 1
            edges[t][k] = float(b.b)
            nodes.append(Node([b[f"l_{c}"] for c in stats], b.lw, 2 * node.path + 1))
            nodes.append(Node([b[c] - b[f"l_{c}"] for c in stats], b.w - b.lw, 2 * node.path + 2))
            edges[t] += [0.0, 0.0]
            made.append((s, t, node.left, node.right))
            children += [(t, node.left), (t, node.right)]
        edge, level = children, level + 1
        if not made:
            break
    path, below = _finished(coded, bins, forest, edges, tops, stats, rules, weights) if any(tops) else (None, 0)
    return Forest(forest, tops, path, below)


def _totals(coded: DataFrame, stats: list[str], trees: int, weights: str | None) -> dict[int, np.ndarray]:
    """Of each tree that has rows the sums of weights and of weighted stats."""
    columns = [*stats, *([weights] if weights else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, 1 + len(stats)))
        for batch in batches:
            values = [batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(stats))]
            for t in range(trees):
                w = weights_of(batch, len(stats) if weights else None, t)
                total[t] += [w.sum(), *(float((v * w).sum()) for v in values)]
        yield pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32()), *(pa.array(c) for c in total.T)], names=["tree", "w", *stats])

    parts = coded.select(*columns).mapInArrow(run, "tree int, w double, " + ", ".join(f"{s} double" for s in stats))
    sums = parts.groupBy("tree").agg(*[F.sum(c).alias(c) for c in ("w", *stats)]).where("w > 0").collect()  # a row for each tree
    return {r.tree: np.array(r[1:]) for r in sums}


def _finished(coded, bins, forest, edges, tops, stats, rules, weights) -> tuple[str, int]:
    """Write the subtrees below all tops, each grown by one task from its rows."""
    spark, d, kind = coded.sparkSession, len(bins.high), bins.kind
    numbers = [{k: k for k in own} for own in tops]
    held = spark.sparkContext.broadcast((_walk(forest, numbers, edges), tops, [[n.path for n in t.nodes] for t in forest]))
    columns = ["codes", *stats, *([weights] if weights else [])]
    at_weights = len(columns) - 1 if weights else None
    names = ["tree", "top", "w", "codes", *stats]

    def come(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = held.value[0]
        for batch in blocks(batches):
            codes = codes_of(batch.column(0), kind, d)
            for tree, own in enumerate(walk.slot):
                if not (own >= 0).any():
                    continue
                w = weights_of(batch, at_weights, tree)
                rows = np.flatnonzero(w > 0)
                top = walk.slots(tree, codes[rows])
                rows, top = rows[top >= 0], top[top >= 0]
                picked = pa.array(rows)
                head = [pa.array(np.full(len(rows), tree), pa.int32()), pa.array(top, pa.int32()), pa.array(w[rows]), batch.column(0).take(picked)]
                yield pa.RecordBatch.from_arrays([*head, *(batch.column(1 + k).take(picked).cast(pa.float64()) for k in range(len(stats)))], names=names)

    def finish(group: pa.Table) -> pa.Table:
        tree, top = group.column("tree")[0].as_py(), group.column("top")[0].as_py()
        _, depths, paths = held.value
        w = group.column("w").to_numpy()
        x = codes_of(group.column("codes").combine_chunks(), kind, d).astype(np.int32)
        own = np.column_stack([group.column(s).to_numpy() * w for s in stats])
        nodes = rules.finish(x, w, own, tree, paths[tree][top], depths[tree][top])
        lists = [[n.feature for n in nodes], [n.threshold for n in nodes], [n.left for n in nodes], [n.right for n in nodes], [n.size for n in nodes],
                 [v for n in nodes for v in n.value]]
        row = [tree, top, len(nodes), *lists]
        kinds = [pa.int32()] * 3 + [pa.list_(k) for k in (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in SUBTREE.split(", ")])

    rows = coded.select(*columns).mapInArrow(come, "tree int, top int, w double, codes binary, " + ", ".join(f"{s} double" for s in stats))
    path = write_table(rows.groupBy("tree", "top").applyInArrow(finish, SUBTREE), "subtrees")
    return path, spark.read.schema(SUBTREE).parquet(path).agg(F.coalesce(F.sum("nodes"), F.lit(0))).first()[0]


def votes_by_table(df: DataFrame, own: Features, forest: Forest, classes: int) -> DataFrame:
    """`df` with probability, the share of trees that vote for each class, for a forest whose subtrees stay in their table.

    Rows walk down the upper nodes, then meet the subtrees that they have come to, in parts where many have; null where a feature is null.
    """
    spark, width = df.sparkSession, len(own)
    ship(spark)
    columns = [F.struct(*df.columns).alias("__row"), own.vector.alias("__x"), own.known.alias("__known"), F.monotonically_increasing_id().alias("__n")]
    numbered = cut(df.select(*columns), "scored")
    top_slots = [{k: k for k in tops} for tops in forest.tops]
    leaf = [np.array([int(np.argmax(n.value)) for n in t.nodes], dtype=np.int64) for t in forest.trees]
    held = spark.sparkContext.broadcast((_walk(forest.trees, top_slots), leaf))

    def come(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, leaf = held.value
        for batch in blocks(batches):
            x = matrix_of(batch.column(1), width)
            for tree in range(len(walk.feature)):
                if not len(walk.feature[tree]):  # its sample is empty
                    continue
                end = walk.ends(tree, x)
                top = walk.slot[tree][end]
                vote = pa.array(leaf[tree][end], pa.int32(), mask=top >= 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.full(len(x), tree), pa.int32()), pa.array(top, pa.int32()), vote],
                    names=["n", "x", "tree", "top", "vote"])

    rows = numbered.where("__known").select("__n", "__x")
    come_to = cut(rows.mapInArrow(come, "n long, x array<double>, tree int, top int, vote int"), "tops")
    open_rows = come_to.where("top >= 0")
    counts = open_rows.groupBy("tree", "top").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = open_rows.join(counts, ["tree", "top"]).withColumn("part", F.pmod(F.xxhash64("n"), F.col("parts")).cast("int")).select("tree", "top", "part", "n", "x")
    below = forest.subtrees(spark).join(counts, ["tree", "top"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "size")

    def meet(rows: pa.Table, subtree: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"n": pa.array([], pa.int64()), "vote": pa.array([], pa.int32())})
        r = subtree.to_pylist()[0]
        value = np.array(r["value"]).reshape(r["nodes"], -1).argmax(axis=1)
        walk = Walk(*([np.array(r[c])] for c in ("feature", "threshold", "left", "right")), [np.zeros(0)])
        end = walk.ends(0, matrix_of(rows.column("x").combine_chunks(), width))
        return pa.table({"n": rows.column("n"), "vote": pa.array(value[end], pa.int32())})

    keys = ["tree", "top", "part"]
    met = dealt.groupBy(*keys).cogroup(below.groupBy(*keys)).applyInArrow(meet, "n long, vote int")
    votes = come_to.where("top < 0").select("n", "vote").unionByName(met)
    shares = F.array(*[F.sum((F.col("vote") == k).cast("double")) / F.lit(float(sum(bool(t.nodes) for t in forest.trees))) for k in range(classes)])
    found = votes.groupBy("n").agg(shares.alias("probability"))
    return numbered.join(found, F.col("__n") == F.col("n"), "left").select("__row.*", "probability")
