"""Exact quantiles by narrowing against sorting."""
import math
import random

import pytest

from contrail.operators import clean as C
from contrail.operators.quantiles import RANGES, exact_quantiles, order_statistics


def nearest(values, q):
    v = sorted(values)
    p = q * (len(v) - 1)
    low, high, part = v[math.floor(p)], v[math.ceil(p)], p - math.floor(p)
    return low if low == high or not part else low + (high - low) * part


def columns():
    rng = random.Random(3)
    n = 1201
    return {
        "continuous": [rng.gauss(0, 1) for _ in range(n)],
        "wide": [rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300) for _ in range(n)],
        "hot": [7.25 if rng.random() < 0.4 else rng.random() * 14.5 for _ in range(n)],
        "close": [1.0 + i * 2 ** -52 for i in range(n)],
        "edges": [rng.choice((-math.inf, -1.8e308 / 2, -5e-324, -0.0, 0.0, 5e-324, 1.7e308, math.inf))
                  for _ in range(n)],
        "holes": [None if i % 3 == 0 else math.nan if i % 3 == 1 else rng.random() for i in range(n)],
        "one": [4.5] * n,
        "nothing": [None] * n,
    }


def test_quantiles_equal_sorting(spark):
    cols = columns()
    schema = ", ".join(f"{c} double" for c in cols)
    df = spark.createDataFrame(list(zip(*cols.values())), schema).repartition(5).checkpoint()
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        for ranges in (2, RANGES):
            if ranges == 2 and q != 0.5:
                continue
            got = exact_quantiles(df, list(cols), q, ranges)
            for c, values in cols.items():
                real = [v for v in values if v is not None and not math.isnan(v)]
                want = nearest(real, q) if real else None
                assert got[c] == want or (math.isnan(want) and math.isnan(got[c])), (c, q, ranges)
    with pytest.raises(ValueError):
        exact_quantiles(df, ["one"], 1.5)


def test_order_statistics_name_column_and_rank(spark):
    df = spark.createDataFrame([(float(i % 7),) for i in range(70)], "x double")
    assert order_statistics(df, {"x": [0, 9, 10, 69]}) == {
        ("x", 0): 0.0, ("x", 9): 0.0, ("x", 10): 1.0, ("x", 69): 6.0}
    assert exact_quantiles(df.limit(0), ["x"]) == {"x": None}


def test_fill_leaves_a_column_without_values(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 4.0, None)], "a int, x double, y double")
    got = {r.a: (r.x, r.y) for r in C.fill_median(df, df, ["x", "y"]).collect()}
    assert got == {1: (1.0, None), 2: (2.5, None), 3: (4.0, None)}
