"""Threshold joins against all inner products."""
import numpy as np
from pyspark.sql import functions as F

from contrail.llm.hard_negatives import SuffixIndex, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=10, positives=5, negatives=10, low=30, high=90, scale=256):
    least = {}
    for i, v, l in rows:
        v = tuple(np.floor(np.array(v, np.float32).astype(np.float64) * scale).astype(int).tolist())
        least[i] = min(least.get(i, (l, v)), (l, v))
    out = []
    for a, (label, v) in least.items():
        if a % every:
            continue
        scored = sorted((-int(np.dot(v, w)), i, l) for i, (l, w) in least.items()
                        if i != a and len(w) == len(v))
        for s, p, l in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s]
            out += [(a, p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits[:negatives])]
    return sorted(out)


def found(spark, rows, df=None, **kw):
    df = spark.createDataFrame(rows, SCHEMA) if df is None else df
    return sorted(map(tuple, hard_negatives(spark, df, F.col("vec_id") % 10 == 0, **kw).collect()))


def clustered(n, dim, seed, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    x = centres[rng.integers(8, size=n)] + spread * rng.normal(size=(n, dim))
    x[n // 2:n // 2 + n // 4] = x[3]                 # a quarter is one vector
    x[:, dim // 2:] *= 0.1                           # suffixes that the index leaves out
    label = np.where(rng.random(n) < 0.4, 0, rng.integers(5, size=n))
    return [(i, v, int(l)) for i, v, l in zip(range(n), x.astype(np.float32).tolist(), label)]


def test_equals_all_products(spark):
    rows = clustered(500, 20, 1)
    assert found(spark, rows) == brute(rows)
    for shard_rows in (40, 150):
        assert found(spark, rows, shard_rows=shard_rows) == brute(rows)


def test_windows_far_below_the_positives(spark):
    rows = clustered(300, 12, 2, 0.05)
    for low, high in ((0, 5), (1, 40), (90, 110)):
        want = brute(rows, low=low, high=high)
        assert found(spark, rows, low=low, high=high, shard_rows=100) == want
    few = clustered(25, 9, 5)
    assert found(spark, few) == brute(few)


def test_index_skips_suffixes_and_finds_every_pair_above():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(900, 40)) * 1000 * 0.9 ** np.arange(40)).astype(np.int64)
    index = SuffixIndex(x, np.arange(900), np.zeros(900, int))
    q = x[:50][:, index.order]
    norms = index.suffix_norms(q)
    for share in (0.9, 0.5, 0.2, -1.0):
        t = (norms[:, 0] ** 2 * share).astype(np.int64)
        qi, ri, s = index.above(q, norms, t)
        exact = x[:50] @ x.T
        assert sorted(zip(qi.tolist(), ri.tolist())) == list(map(tuple, np.argwhere(exact >= t[:, None]).tolist()))
        assert (exact[qi, ri] == s).all()
        if share == 0.5:
            assert sum(len(r) for r, _ in index.lists) < 0.8 * 900 * len(index.lists)


def test_odd_rows(spark):
    good = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (3, [1.0, 0.4], 1), (3, [9.0, 9.0], 2), (4, [0.6, 0.3], 2),
            (5, [0.0, 0.0], 2), (6, [0.6, 0.3], 3), (10, [-1.0, -1.0], 2), (20, [1.0, 2.0, 3.0], 1),
            (21, [1.0, 2.0, 3.0], 1), (22, [0.5, 1.0, 1.0], 4), (30, [7.0], 1)]
    bad = [(40, [1.0, 1.0], None), (50, None, 1), (60, [1.0, None], 1), (70, [float("nan"), 1.0], 1),
           (80, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (90, [], 1)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in good + bad],
                               SCHEMA + ", shard int, cell string, windows int")
    assert found(spark, None, df) == brute(good)
    assert found(spark, None, df.limit(0)) == [] == found(spark, bad)
    huge = spark.createDataFrame([(i, [1e30, 1.0], i % 2) for i in range(6)], SCHEMA)
    assert found(spark, None, huge) == []
