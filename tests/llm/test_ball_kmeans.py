"""Ball k-means against plain k-means in Python integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from millrace.llm.ball_kmeans import assign_all, assign_balls, ball_kmeans, distance, neighbours


def plain(rows, k, rounds, width, scale=64):
    kept = [(i, [math.floor(scale * v) for v in x]) for i, x in rows if x is not None and len(x) == width and all(v is not None and math.isfinite(v) for v in x)]
    start = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)[:k]
    centroids = [x for _, x in start]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        near = assigned()
        for j in range(len(centroids)):
            own = [x for (_, x), (_, c) in zip(kept, near) if c == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    near = assigned()
    own = lambda j: sum(d for d, c in near if c == j)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, own(c), sum(e for e, _ in near), digest[c]) for (i, _), (d, c) in zip(kept, near)]


@pytest.mark.parametrize("width,k,spread", [(3, 5, 2), (2, 16, 1), (64, 4, 100), (1, 3, 1)])
def test_equals_plain_kmeans(spark, width, k, spread):
    rng = random.Random(width)
    rows = [(i, [rng.randint(-spread, spread) / 64 for _ in range(width)]) for i in range(120)]  # a small grid, so many ties and equal vectors
    rows += [(None, rows[0][1]), (7, rows[1][1]), (7, rows[1][1]), (500, None), (501, [0.5] * (width + 1)), (502, [None] * width),
             (503, [float("nan")] * width), (504, [float("inf")] * width), (505, [-0.001] * width)]
    df = spark.createDataFrame([(i, x, "x", 1.0) for i, x in rows], "vec_id long, embedding array<double>, Cluster string, distance double")
    for rounds in (0, 1, 4):
        found = ball_kmeans(df, k=k, rounds=rounds, width=width).collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, plain(rows, k, rounds, width)))


def test_balls_compare_few_and_find_the_same():
    rng = np.random.default_rng(0)
    centres = rng.integers(-5000, 5000, (16, 8))
    x = np.concatenate([c + rng.integers(-200, 200, (500, 8)) for c in centres])
    cluster, far = assign_all(x, centres)
    moved = centres + rng.integers(-20, 20, centres.shape)
    radii = [int(np.sqrt(distance(x[cluster == j], moved[j]).max())) + 1 for j in range(16)]
    best, d, compared = assign_balls(x, cluster, moved, neighbours(moved, radii))
    wanted, far = assign_all(x, moved)
    assert (best == wanted).all() and (d == far).all() and compared.mean() < 3


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 5.0])], "vec_id long, embedding array<float>")
    found = ball_kmeans(df, width=2, work=True)
    assert sorted(r.cluster for r in found.collect()) == [0, 1] and found.columns[-1] == "compared"
    assert ball_kmeans(df.limit(0), width=2).columns == found.columns[:-1] and ball_kmeans(df, width=3).count() == 0
    with pytest.raises(ValueError):
        ball_kmeans(df, k=0)
    with pytest.raises(Exception, match="too large"):
        ball_kmeans(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), width=1)
