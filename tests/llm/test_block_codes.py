"""Hilbert-blocked vector codes against plain integer k-means."""
import hashlib

import numpy as np

from contrail.llm.block_codes import build_blocks, compressed, encode_vectors, hilbert_keys, shortlists

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, code, error, label_error) and the codebook digest, all distances taken."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(np.array([r[1] for r in rows], np.float32).astype(np.float64) * scale).astype(np.int64)
    width = -(-x.shape[1] // parts)
    x = np.pad(x, ((0, 0), (0, parts * width - x.shape[1])))
    code, error, books = [], np.zeros(len(rows), np.int64), []
    for p in range(parts):
        s = x[:, p * width:(p + 1) * width]
        book = s[:entries].copy()
        for step in range(rounds + 1):
            d = ((s[:, None] - book[None]) ** 2).sum(2)
            near = d.argmin(1)
            if step < rounds:
                for e in set(near.tolist()):
                    mine = s[near == e]
                    book[e] = mine.sum(0) // len(mine)
        code.append(near)
        error += d.min(1)
        books += book.ravel().tolist()
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c[i]:02x}" for c in code), int(error[i]), by_label[r[2]], digest)
                   for i, r in enumerate(rows)), key=str)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(9, dim))[rng.integers(9, size=n)] + 0.05 * rng.normal(size=(n, dim))
    x[n // 3:n // 3 + n // 4] = x[5]  # a quarter is one vector
    labels = [None if i % 11 == 0 else int(i % 3 == 0) for i in range(n)]
    return [(i, row.tolist(), labels[i]) for i, row in enumerate(x.astype(np.float32))]


def same(spark, rows, df=None):
    df = spark.createDataFrame(rows, SCHEMA) if df is None else df
    assert sorted(map(tuple, compressed(spark, df).collect()), key=str) == brute(rows)


def test_equals_plain_k_means(spark):
    same(spark, clustered(700, 24, 1))
    rng = np.random.default_rng(2)
    same(spark, [(i, v, i % 4) for i, v in
                 enumerate(rng.normal(size=(300, 16)).astype(np.float32).tolist())])


def test_partitioning_does_not_matter(spark):
    rows = clustered(400, 16, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 7):
        same(spark, rows, df.repartition(n))


def test_hilbert_keys_visit_every_cell_by_steps_of_one():
    cells = np.stack(np.meshgrid(range(8), range(8), range(8)), -1).reshape(-1, 3).astype(np.uint64)
    keys = hilbert_keys(cells, 3)
    path = cells[np.argsort(keys)].astype(int)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shortlists_keep_every_nearest_entry_and_prune():
    rng = np.random.default_rng(4)
    pieces = (rng.integers(-9, 9, size=(6, 4)) * 1000)[rng.integers(6, size=2000)]
    pieces = pieces + rng.integers(-40, 40, size=pieces.shape)
    blocks, book = build_blocks(pieces), pieces[:16]
    listed = shortlists(blocks.low, blocks.high, book)
    assert listed.mean() < 0.5
    for b in range(len(listed)):
        own = blocks.pieces[b * 32:(b + 1) * 32]
        d = ((own[:, None] - book[None]) ** 2).sum(2)
        assert listed[b][np.unique(np.nonzero(d == d.min(1)[:, None])[1])].all()


def test_odd_rows(spark):
    good = [(5, [0.5, -0.25, 1.0], 1), (5, [0.5, -0.25, 1.0], 1), (7, [0.0, 0.0, 0.0], None),
            (None, [1.0, 2.0, 3.0], None), (9, [0.5, -0.25, 1.0], 2)]
    bad = [(1, None, 1), (2, [1.0, None, 2.0], 1), (3, [float("nan"), 1.0, 1.0], 1),
           (4, [float("inf"), 1.0, 1.0], 1), (0, [], 1), (11, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(i, v, l, "x", 0) for i, v, l in good + bad],
                               SCHEMA + ", code string, part int")
    same(spark, good, df)
    huge = encode_vectors(spark, spark.createDataFrame([(1, [1e30, -1e30], 0), (2, [0.0, 0.0], 0)], SCHEMA))
    assert {r.vec_id: r.error for r in huge.rows.collect()} == {1: 0, 2: 0}
    for empty in (df.limit(0), spark.createDataFrame(bad[:5], SCHEMA)):
        out = compressed(spark, empty)
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert out.count() == 0
