"""Column functions: vectors, distances, kernels, links and hashed random numbers. All stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(columns: Sequence[Column | str]) -> Column:
    return F.array(*[F.col(c) if isinstance(c, str) else c for c in columns])


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def linear_form(columns: Sequence[Column], weights: Sequence[float], constant: float = 0.0) -> Column:
    """sum of columns times literal weights: one arithmetic expression, generated as code."""
    total = F.lit(float(constant))
    for c, w in zip(columns, weights):
        total = total + c * F.lit(float(w))
    return total


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))  # greatest and least pass over nulls


def sigmoid(z: Column) -> Column:
    """1 / (1 + exp(-z)), z held within 500 of 0."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(z, -500, 500)))


def by_sign(score: Column, yes, no) -> Column:
    """`yes` from 0 on, `no` below; null for a null score."""
    return F.when(score >= 0, F.lit(yes)).when(score < 0, F.lit(no))


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(_fold(F.transform(values, lambda v: F.exp(v - top))))


def softmax(values: Column) -> Column:
    total = log_sum_exp(values)
    return F.transform(values, lambda v: F.exp(v - total))


def soft_threshold(x: Column, t: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - F.lit(float(t)), F.lit(0.0))


def gini(counts: Sequence[Column]) -> Column:
    """Gini impurity of class counts; 0 without rows."""
    total = sum(counts[1:], counts[0])
    squares = sum((c * c for c in counts[1:]), counts[0] * counts[0])
    return F.when(total == 0, F.lit(0.0)).otherwise(1 - squares / F.nullif(total * total, F.lit(0.0)))


# kernels

def rbf_kernel(a: Column, b: Column, length_scale: float = 1.0, signal_var: float = 1.0) -> Column:
    return F.lit(signal_var) * F.exp(-squared_distance(a, b) / F.lit(2.0 * length_scale**2))


def matern52_kernel(a: Column, b: Column, length_scale: float = 1.0, signal_var: float = 1.0) -> Column:
    z = euclidean(a, b) * F.lit(math.sqrt(5.0) / length_scale)
    return F.lit(signal_var) * (1 + z + z * z / 3) * F.exp(-z)


def periodic_kernel(a: Column, b: Column, length_scale: float = 1.0, period: float = 1.0, signal_var: float = 1.0) -> Column:
    s = F.sin(euclidean(a, b) * F.lit(math.pi / period))
    return F.lit(signal_var) * F.exp(s * s * F.lit(-2.0 / length_scale**2))


def linear_kernel(a: Column, b: Column, signal_var: float = 1.0, bias: float = 0.0) -> Column:
    return F.lit(signal_var) * dot(a, b) + F.lit(float(bias))


# random numbers that any engine can make again

def uniform(*keys: Column | str | int) -> Column:
    """A number in [0, 1) from the md5 of the keys as text joined by colons."""
    text = F.concat_ws(":", *[F.lit(str(k)) if not isinstance(k, Column) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def normal(*keys: Column | str | int) -> Column:
    """A standard normal number, by Box and Muller."""
    return F.sqrt(-2 * F.log(1 - uniform("a", *keys))) * F.cos(F.lit(2 * math.pi) * uniform("b", *keys))


def poisson_one(u: Column, most: int = 13) -> Column:
    """A Poisson number of mean 1 from a uniform one: the weight of a row in a bootstrap sample.

    Numbers above 12 have a chance under 2^-32, which is what `uniform` resolves.
    """
    total, out, p = 0.0, F.lit(most), math.exp(-1.0)
    steps = []
    for k in range(most):
        total += p
        steps.append(total)
        p /= k + 1
    for k in reversed(range(most)):
        out = F.when(u < steps[k], F.lit(k)).otherwise(out)
    return out
