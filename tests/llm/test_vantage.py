"""Vantage-point search against all distances."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.llm.queries import QUERIES, RELAXED
from contrail.llm.vantage import VantageTree, distances, nearest
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_query, k):
    out = []
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    for qid, q in rows:
        if is_query(qid):
            d = np.sqrt(((x - np.array(q, np.float64)) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != qid][:k]
            out += [(qid, r + 1, int(ids[j]), d[j]) for r, j in enumerate(order)]
    return sorted(out)


def same(got, want):
    got = sorted(map(tuple, got))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(12, size=n)] + 0.3 * rng.normal(size=(n, dim))
    x[n // 2:n // 2 + 40] = x[7]  # many exact copies
    return [(i, row.tolist()) for i, row in enumerate(x.astype(np.float32))]


def test_factor_one_is_exact(spark):
    rows = clustered(900, 8, 3)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    for shard_rows in (100, 5000):
        got = nearest(spark, df, F.col("vec_id") % 30 == 0, 10, 1.0, shard_rows).collect()
        same(got, brute(rows, lambda i: i % 30 == 0, 10))


def test_relaxed_search_prunes_and_keeps_recall():
    rows = clustered(6000, 16, 5)
    x = np.array([v for _, v in rows], np.float64)
    ids = np.arange(len(x))
    tree = VantageTree(x, ids)
    queries = ids[::100]
    want = brute(rows, lambda i: i % 100 == 0, 10)
    found = {}
    for factor in (1.0, 1.5):
        best, got = tree.search(x[queries], queries, 10, factor)
        found[factor] = {(int(q), int(v)) for q, row in zip(queries, got) for v in row}
        assert (np.diff(best, axis=1) >= 0).all()
    exact = {(q, v) for q, _, v, _ in want}
    assert found[1.0] == exact
    assert len(found[1.5] & exact) >= 0.9 * len(exact)


def low_dimensional_recall(factor, inner):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(8192, inner)) @ rng.normal(size=(inner, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(len(x))
    queries = ids[::100]
    d = distances(x[queries], x)
    d[np.arange(len(queries)), queries] = np.inf
    want = np.argsort(d, axis=1, kind="stable")[:, :10]
    got = VantageTree(x, ids).search(x[queries], queries, 10, factor)[1]
    return np.mean([len(set(g) & set(w)) / 10 for g, w in zip(got.tolist(), want.tolist())])


@pytest.mark.parametrize("inner", [4, 6, 12])
def test_query_factor_keeps_recall_on_low_dimensional_vectors(inner):
    assert low_dimensional_recall(RELAXED, inner) >= 0.95


def test_query_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    got = QUERIES["op2_vantage"](spark, SF_SMALL).collect()
    want = brute(rows, lambda i: i % 100 == 0, 10)
    assert len(got) == len(want)
    hit = {(g.query_id, g.vec_id) for g in got} & {(w[0], w[2]) for w in want}
    assert len(hit) >= 0.9 * len(want)
    x = dict(rows)
    for g in got:
        d = distances(np.array([x[g.query_id]], np.float64), np.array([x[g.vec_id]], np.float64))[0, 0]
        assert abs(d - g.score) < 1e-12


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = nearest(spark, df, F.col("vec_id") >= 0, 2, 1.0).collect()
    root = 2 ** 0.5
    same(got, sorted([(0, 1, 1, 0.0), (0, 2, 2, root), (1, 1, 0, 0.0), (1, 2, 2, root),
                      (2, 1, 0, root), (2, 2, 1, root)]))
    assert nearest(spark, df.limit(0), F.col("vec_id") >= 0).collect() == []
    with pytest.raises(ValueError):
        nearest(spark, df, F.col("vec_id") >= 0, factor=0.5)
