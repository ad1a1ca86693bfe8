"""Models fitted from moment sums: least squares (M9) and logistic Newton steps (M8).

Least squares needs the sums of the features, of their products and of their
products with the target: one aggregate, a row of (p + 1)(p + 2) / 2 numbers per
task, whatever the number of rows. Values are taken in steps of 10**-digits, so
the sums are whole numbers, equal on every partitioning; the normal equations
over the covariances are solved in fractions, without any rounding.

A Newton step of the logistic model is one aggregate as well: the gradient and
the Hessian at the current coefficients, over standardised features. The number
of steps is fixed; they converge quadratically, so the same coefficients come
out of every engine up to rounding in the last digits.

A feature that is constant or a combination of earlier ones gets coefficient 0.
Rows with a NULL or NaN in a feature or the target take no part; a frame without
rows cannot be fitted (ValueError).
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Linear(NamedTuple):
    features: list[str]
    intercept: float
    coefficients: list[float]

    def score(self) -> Column:
        """intercept + the features times their coefficients, added in order."""
        return reduce(lambda s, fc: s + F.lit(fc[1]) * F.col(f"`{fc[0]}`").cast("double"),
                      zip(self.features, self.coefficients), F.lit(self.intercept))

    def rows(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [("intercept", self.intercept), *zip(self.features, self.coefficients)],
            "term string, coefficient double")


def solve(matrix: list[list], right: list) -> list:
    """Solution of a symmetric system by elimination; a term whose pivot
    vanishes is left out (0). Works on fractions and on floats."""
    n = len(right)
    a = [[*row, b] for row, b in zip(matrix, right)]
    for k in range(n):
        if a[k][k] == 0:
            continue
        for i in range(k + 1, n):
            part = a[i][k] / a[k][k]
            a[i] = [x - part * y for x, y in zip(a[i], a[k])]
    out = [0 * b for b in right]
    for k in reversed(range(n)):
        if a[k][k] != 0:
            out[k] = (a[k][n] - sum(a[k][j] * out[j] for j in range(k + 1, n))) / a[k][k]
    return out


def _complete(df: DataFrame, columns: list[str]) -> DataFrame:
    there = [F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double")) for c in columns]
    return df.where(reduce(lambda a, b: a & b, there))


class Moments(NamedTuple):
    """Exact sums over n rows; columns in the order asked for."""
    n: int
    sums: list[Fraction]
    products: list[list[Fraction]]

    def covariance(self, i: int, j: int) -> Fraction:
        """n times the sum of products of deviations."""
        return self.n * self.products[i][j] - self.sums[i] * self.sums[j]


def moments(df: DataFrame, columns: list[str], digits: int = 6) -> Moments:
    steps = [F.round(F.col(f"`{c}`").cast("double") * float(10 ** digits)).cast("decimal(19,0)")
             for c in columns]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    row = (_complete(df, columns).select(*[s.alias(f"x{i}") for i, s in enumerate(steps)])
           .agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(len(columns))],
                *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs])).first()
    if not row.n:
        raise ValueError("no rows to take moments of")
    unit = 10 ** digits
    products = [[Fraction(0)] * len(columns) for _ in columns]
    for i, j in pairs:
        products[i][j] = products[j][i] = Fraction(int(row[f"s{i}_{j}"]), unit * unit)
    return Moments(row.n, [Fraction(int(row[f"s{i}"]), unit) for i in range(len(columns))], products)


def least_squares(df: DataFrame, features: list[str], target: str, digits: int = 6) -> Linear:
    """M9: the least-squares line through all rows."""
    m = moments(df, [*features, target], digits)
    p = range(len(features))
    slopes = solve([[m.covariance(i, j) for j in p] for i in p],
                   [m.covariance(i, len(features)) for i in p])
    intercept = (m.sums[-1] - sum(b * m.sums[i] for i, b in enumerate(slopes))) / m.n
    return Linear(list(features), float(intercept), [float(b) for b in slopes])


def logistic(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def newton_logistic(df: DataFrame, features: list[str], label: str, steps: int = 8,
                    digits: int = 6) -> Linear:
    """M8: logistic coefficients after ``steps`` Newton steps from zero. ``df``
    is read once a step: pass a written or checkpointed frame."""
    if steps < 1:
        raise ValueError("steps must be 1 at least")
    df = _complete(df, [*features, label])
    m = moments(df, features, digits)
    mean = [float(s / m.n) for s in m.sums]
    spread = [math.sqrt(m.covariance(i, i) / (m.n * m.n)) for i in range(len(features))]
    z = df.select(F.col(f"`{label}`").cast("double").alias("y"), F.lit(1.0).alias("z0"), *[
        ((F.col(f"`{c}`").cast("double") - mean[i]) / (spread[i] or 1.0)).alias(f"z{i + 1}")
        for i, c in enumerate(features)])
    size = len(features) + 1
    beta = [0.0] * size
    for _ in range(steps):
        score = reduce(lambda s, i: s + F.lit(beta[i]) * F.col(f"z{i}"), range(1, size), F.lit(beta[0]))
        at = z.withColumn("p", logistic(score)).select(
            "*", (F.col("y") - F.col("p")).alias("r"), (F.col("p") * (1 - F.col("p"))).alias("w"))
        row = at.agg(*[F.sum(F.col("r") * F.col(f"z{i}")).alias(f"g{i}") for i in range(size)],
                     *[F.sum(F.col("w") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}")
                       for i in range(size) for j in range(i + 1)]).first()
        hessian = [[row[f"h{max(i, j)}_{min(i, j)}"] for j in range(size)] for i in range(size)]
        beta = [b + d for b, d in zip(beta, solve(hessian, [row[f"g{i}"] for i in range(size)]))]
    slopes = [beta[i + 1] / spread[i] if spread[i] else 0.0 for i in range(len(features))]
    return Linear(list(features), beta[0] - sum(b * x for b, x in zip(slopes, mean)), slopes)
