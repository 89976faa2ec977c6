"""Tail probabilities of the chi-squared and Student distributions, as Arrow functions over the few rows that need them."""

from __future__ import annotations

from math import exp, inf, lgamma, log

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from ..checkpoints import ship


def upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(a * log(x) + b * log(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a
    f = c = 1.0
    d = 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def chi2_p(x: float, dof: float) -> float:
    return 1.0 if dof <= 0 else upper_gamma(dof / 2, x / 2)


def t_two_sided(t: float, dof: float) -> float:
    return 0.0 if t in (inf, -inf) else incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def chi2_tail(x: Column, dof: Column) -> Column:
    ship()

    def run(x: pa.Array, k: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else chi2_p(a, b) for a, b in zip(x.to_pylist(), k.to_pylist())], pa.float64())

    return arrow_udf(run, "double")(x, dof)


def t_tail(t: Column, dof: Column) -> Column:
    ship()

    def run(x: pa.Array, k: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else t_two_sided(a, b) for a, b in zip(x.to_pylist(), k.to_pylist())], pa.float64())

    return arrow_udf(run, "double")(t, dof)
