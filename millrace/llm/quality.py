"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k | text) = sigmoid(theta_k - w.x): one weight vector over hashed text features serves all grades, and ordered
thresholds part them. It gives an expected grade and the tail probability of each grade, by which texts are selected.

Features of a whole text: presence of each word (letters and digits, A-Z lower-cased), the share of each punctuation run, of
repeated words and of upper-case letters in powers of two. They are hashed to 2^18 weights, so a text of any length
has a bounded number of them. Fitted by full-batch Adam on all features of at most TRAIN_ROWS rated texts, the first by the hash of
their id; all rows are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import fresh, small
from millrace.llm.textkit import NON_WORD, mix, text_slices, words
from millrace.storage import cut, ship

#: Rated rows that a model is fitted on at most.
TRAIN_ROWS = 16_000
WEIGHT_BITS = 18
ROUNDS, RATE = 200, 0.05
#: Weight of the penalty on the sum of the weights' sizes (smoothed near 0), and the share of rows that a feature must be in.
PENALTY, LEAST_SHARE = 3e-4, 0.001

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[33:127] = True
_PUNCTUATION[48:58] = _PUNCTUATION[65:91] = _PUNCTUATION[97:123] = False
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True


def _distinct(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs and how often each occurs."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))) if len(h) else np.zeros(0, np.int64)
    return h[first], r[first], np.diff(np.append(first, len(h)))


def _level(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A share as a power of two, from 0 (under 1/256) to 8."""
    return np.clip(np.floor(np.log2(np.maximum(part / np.maximum(whole, 1), 1e-9))) + 9, 0, 9).astype(np.uint64)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the texts of a slice as (weight number, text), by text."""
    n = len(offsets) - 1
    hashes, starts, _, bounds = words(raw, offsets, NON_WORD)
    counts = np.diff(bounds)
    h, r, _ = _distinct(hashes, np.repeat(np.arange(n), counts))
    found, rows = [h], [r]
    marks, _, _, mark_bounds = words(raw, offsets, ~_PUNCTUATION)
    mh, mr, often = _distinct(marks, np.repeat(np.arange(n), np.diff(mark_bounds)))
    found.append(mix(mh ^ np.uint64(0xA5A5A5A5) ^ (_level(often, counts[mr]) << np.uint64(56))))
    rows.append(mr)
    every = np.arange(n)
    distinct = np.bincount(r, minlength=n)
    upper = np.add.reduceat(np.append(_UPPER[raw], False).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0)
    for salt, level in ((1, _level(counts - distinct, counts)), (2, _level(upper, np.diff(offsets)))):
        found.append(mix(level + np.uint64(salt << 40)))
        rows.append(every)
    number, row = np.concatenate(found) >> np.uint64(64 - WEIGHT_BITS), np.concatenate(rows)
    both = np.unique((row.astype(np.int64) << WEIGHT_BITS) | number.astype(np.int64))  # features that share a weight count once
    return (both & ((1 << WEIGHT_BITS) - 1)).astype(np.int32), both >> WEIGHT_BITS


@dataclass
class OrdinalModel:
    """Shared weights and ordered thresholds for `grades`, ascending."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, number: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """P(grade >= k-th) for each text and each grade; 1 for the lowest."""
        score = np.bincount(row, self.weights[number], n)
        out = np.ones((n, len(self.grades)))
        out[:, 1:] = _sigmoid(score[:, None] - self.thresholds[None, :])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_ordinal(number: np.ndarray, row: np.ndarray, grade: np.ndarray) -> OrdinalModel:
    """Maximum likelihood with a lasso penalty; `grade` may be any integers, one for each row number."""
    grades = sorted(set(grade.tolist()))
    n, k = len(grade), len(grades)
    if k < 2:
        return OrdinalModel(grades, np.zeros(1 << WEIGHT_BITS), np.zeros(0))
    y = np.searchsorted(grades, grade)
    often = np.bincount(number, minlength=1 << WEIGHT_BITS)
    keep = often[number] > max(2, LEAST_SHARE * n)  # what hardly ever occurs tells nothing
    used, number = np.unique(number[keep], return_inverse=True)
    row, size = row[keep], len(used)
    share = np.array([(y <= j).mean() for j in range(k - 1)])
    # thresholds are the first and the logs of the steps to the others, so they stay in order
    logit = np.log(share / (1 - share))
    params = np.concatenate((np.zeros(size), logit[:1], np.log(np.maximum(np.diff(logit), 1e-2))))
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, ROUNDS + 1):
        theta = np.concatenate((params[size : size + 1], params[size] + np.cumsum(np.exp(params[size + 1 :]))))
        score = np.bincount(row, params[number], n)
        below = np.column_stack([np.zeros(n), _sigmoid(theta[None, :] - score[:, None]), np.ones(n)])
        density = below * (1 - below)
        every = np.arange(n)
        p = np.maximum(below[every, y + 1] - below[every, y], 1e-12)
        up, low = density[every, y + 1] / p, density[every, y] / p
        at_score = (up - low) / n  # of the negative log-likelihood
        at_theta = np.array([-(up[y == j].sum() - low[y == j + 1].sum()) / n for j in range(k - 1)])
        steps = np.exp(params[size + 1 :])
        at_weights = np.bincount(number, at_score[row], size) + PENALTY * np.tanh(50 * params[:size])
        gradient = np.concatenate((at_weights, [at_theta.sum()], steps * np.cumsum(at_theta[::-1])[::-1][1:]))
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        params -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    theta = np.concatenate((params[size : size + 1], params[size] + np.cumsum(np.exp(params[size + 1 :]))))
    weights = np.zeros(1 << WEIGHT_BITS)
    weights[used] = params[:size]
    return OrdinalModel(grades, weights, theta)


def learn_quality(docs: DataFrame, ratings: DataFrame, id_col: str, text_col: str, grade_col: str, train_rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on the texts of `docs` with the first `train_rows` rated ids, by the hash of the id, that `docs` has.

    The ids are chosen before any text is exchanged. Null ids, texts and grades don't count; of rows with equal ids the one
    whose text has the least hash counts, and of several grades of an id the lowest.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for at, raw, offsets in text_slices(batch.column(0)):
                number, row = features(raw, offsets)
                ends = np.searchsorted(row, np.arange(len(offsets)))
                part = [number[s:e].astype("<i4").tobytes() for s, e in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(part)), pa.array(part, pa.binary())], names=["grade", "found"])

    grades = ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("long").alias("grade")).where("id IS NOT NULL AND grade IS NOT NULL")
    grades = grades.groupBy("id").agg(F.min("grade").alias("grade"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = grades.join(texts.where("text IS NOT NULL").select("id"), "id", "left_semi")
    chosen = cut(known.orderBy(F.xxhash64("id"), "id").limit(train_rows), "quality-sample")
    rows = texts.where("text IS NOT NULL").join(F.broadcast(chosen), "id")  # at most train_rows ids
    rows = rows.groupBy("id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "grade")
    found = rows.mapInArrow(run, "grade long, found binary").collect()
    found.sort(key=lambda r: (r[0], bytes(r[1])))  # the same sums whatever the order of the tasks
    lists = [np.frombuffer(bytes(r[1]), dtype="<i4") for r in found]
    number = np.concatenate([*lists, np.zeros(0, np.int32)])
    return fit_ordinal(number, np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([r[0] for r in found], dtype=np.int64))


def score_quality(
    docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", least: float = 0.5, train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """`docs` with expected_grade, tails (P(grade >= k) for each grade from the second on) and kept.

    `ratings` has id and grade, the texts are those of `docs`. kept: the tail probability of the highest grade is at least
    `least`, so a tie is kept. A null or empty text has no words and is scored by what is left. With fewer than two grades to
    learn from tails is empty and all is kept. Repeated rows repeat; an empty table gives no rows. Where `docs` has such names, ours get a
    leading underscore.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(learn_quality(docs, ratings, id_col, text_col, grade_col, train_rows))
    names, at = docs.columns, docs.columns.index(text_col)
    extra = fresh(docs, "expected_grade", "tails", "kept")
    schema = docs.select(*names, F.lit(0.0).alias(extra[0]), F.array().cast("array<double>").alias(extra[1]), F.lit(True).alias(extra[2])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        steps = np.diff(np.array(m.grades, dtype=float))
        for batch in small(batches):
            for start, raw, offsets in text_slices(batch.column(at)):
                n = len(offsets) - 1
                if len(m.grades) > 1:
                    tails = m.tails(*features(raw, offsets), n)[:, 1:]
                else:
                    tails = np.ones((n, 0))
                lowest = float(m.grades[0]) if m.grades else 0.0
                grade = lowest + tails @ steps if len(m.grades) > 1 else np.full(n, lowest)
                kept = tails[:, -1] >= least if tails.shape[1] else np.ones(n, dtype=bool)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * tails.shape[1]), pa.array(tails.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(start, n).columns, pa.array(grade), lists, pa.array(kept)], names=[*names, *extra])

    return docs.mapInArrow(run, schema)


def graded(labels: DataFrame) -> DataFrame:
    """Ratings as grades: 0 toxic, 1 of low quality, 2 good; an id rated more than once gets its lowest grade."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))
