"""Closed-form and Newton fits against the estimators and numpy."""
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from contrail.ml import moments as MM

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(800):
        a, b, c = rng.randint(0, 20), rng.uniform(-3, 3), rng.randint(100, 3000) / 2
        y = 3.5 + 0.25 * a - 2 * b + 0.004 * c + rng.gauss(0, 4)
        p = 1 / (1 + math.exp(-(0.1 * a + b - 0.001 * c)))
        rows.append((a, round(b, 6), c, round(y, 6), int(rng.random() < p)))
    return spark.createDataFrame(rows, "a int, b double, c double, y double, label int")


def test_least_squares_agrees_with_numpy_and_the_estimator(spark, data):
    fit = MM.least_squares(data, X, "y")
    rows = np.array([tuple(r) for r in data.collect()], float)
    want, *_ = np.linalg.lstsq(np.c_[np.ones(len(rows)), rows[:, :3]], rows[:, 3], rcond=None)
    assert np.allclose([fit.intercept, *fit.coefficients], want, rtol=1e-9)
    model = LinearRegression(labelCol="y", regParam=0.0).fit(
        VectorAssembler(inputCols=X, outputCol="features").transform(data))
    assert np.allclose(fit.coefficients, model.coefficients.toArray(), rtol=1e-5)
    got = [r.s for r in data.select(fit.score().alias("s")).collect()]
    assert np.allclose(got, np.c_[np.ones(len(rows)), rows[:, :3]] @ want)


def test_newton_reaches_the_estimators_optimum(spark, data):
    cached = data.checkpoint()
    fit = MM.newton_logistic(cached, X, "label")
    model = LogisticRegression(labelCol="label", regParam=0.0, tol=1e-12, maxIter=500).fit(
        VectorAssembler(inputCols=X, outputCol="features").transform(data))
    assert np.allclose(fit.coefficients, model.coefficients.toArray(), atol=1e-5)
    assert abs(fit.intercept - model.intercept) < 1e-4
    one_less = MM.newton_logistic(cached, X, "label", steps=7)
    assert np.allclose(fit.coefficients, one_less.coefficients, atol=1e-10)     # converged
    p = [r.p for r in data.select(MM.logistic(fit.score()).alias("p")).collect()]
    assert all(0 < x < 1 for x in p)


def test_partitioning_does_not_change_the_sums(spark, data):
    assert MM.moments(data.repartition(1), X) == MM.moments(data.repartition(9, "a"), X)
    assert MM.least_squares(data.repartition(1), X, "y") == MM.least_squares(data.repartition(7), X, "y")


def test_constant_and_dependent_features_are_left_out(spark, data):
    wide = data.selectExpr("*", "5.0D AS k", "a + 2 AS d")
    plain = MM.least_squares(data, X, "y")
    fit = MM.least_squares(wide, ["a", "k", "d", "b", "c"], "y")
    assert fit.coefficients[1] == 0.0 and fit.coefficients[2] == 0.0
    assert np.allclose([fit.coefficients[i] for i in (0, 3, 4)], plain.coefficients)
    newton = MM.newton_logistic(wide.checkpoint(), [*X, "k"], "label")
    assert newton.coefficients[3] == 0.0


def test_gaps_and_empty_frames(spark, data):
    gaps = data.unionByName(spark.createDataFrame(
        [(None, 1.0, 1.0, 1.0, 1), (1, float("nan"), 1.0, 99.0, 0), (1, 1.0, 1.0, None, None)], data.schema))
    assert MM.least_squares(gaps, X, "y") == MM.least_squares(data, X, "y")
    with pytest.raises(ValueError):
        MM.least_squares(data.where("a < 0"), X, "y")
    with pytest.raises(ValueError):
        MM.newton_logistic(data.where("a < 0"), X, "label")
