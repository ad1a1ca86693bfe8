"""The Jaccard join against all pairs."""
import random

import numpy as np

from contrail.llm.ngram_join import (CountRTree, count_vector, jaccard_components, shard_keys,
                                     size_levels)
from contrail.llm.words import shingle_set


def brute(rows, k, num, den):
    sets = [(d, frozenset(shingle_set(t.encode(), k).tolist()) if t else frozenset()) for d, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and den * both >= num * (len(a) + len(b) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)]) for i, (d, s) in enumerate(sets))


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(n):
        if rows and rng.random() < 0.6:
            words = (rng.choice(rows[-25:])[1] or "").split()
            for _ in range(rng.randrange(1 + len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                words = words[:-rng.randrange(1, 4)]
        else:
            words = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 5, 8, 12, 30, 80, 200]))
        rows.append((d, " ".join(words)))
    return rows


def test_equals_all_pairs(spark):
    for seed, k, num, den in ((1, 4, 85, 100), (2, 5, 80, 100), (3, 3, 1, 2)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted(map(tuple, jaccard_components(spark, docs, k, num, den).collect()))
        assert got == brute(rows, k, num, den)


def test_linked_sets_share_a_shard():
    rng = np.random.default_rng(4)
    for n in (6, 7, 13, 40, 333):
        for _ in range(30):
            base = np.unique(rng.integers(0, 2**64, n + 60, dtype=np.uint64))
            a = base[:n]
            cut = int(rng.integers(0, max(1, n // 6) + 1))
            b = np.unique(np.concatenate([a[cut // 2:], base[n:n + cut - cut // 2]]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
                assert np.intersect1d(shard_keys(a, 85, 100), shard_keys(b, 85, 100)).size


def test_levels_cover_partner_sizes():
    lows, _ = size_levels(85, 100)
    for n in range(1, 3000):
        level = np.searchsorted(lows, [n, 100 * n // 85], side="right")
        assert level[1] - level[0] <= 1


def test_tree_bound_keeps_every_linked_pair():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**64, int(n), dtype=np.uint64)) for n in rng.integers(5, 90, 120)]
    sets += [s[1:] for s in sets[:60]]
    points = np.stack([count_vector(s) for s in sets])
    q, p = CountRTree(points).candidates(points, 85, 100)
    found = set(zip(q.tolist(), p.tolist()))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                assert (i, j) in found
    assert len(found) < len(sets) ** 2 / 4


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(5, None, 1), (6, "", 1), (7, " \n", 1), (8, "a b c d e", 1), (None, "a b c d e", 1), (8, "A B C D E", 1),
         (3, "a b c d e", 1), (9, "a b", 1), (10, "b a", 1)], "doc_id long, text string, cls int")
    got = sorted(map(tuple, jaccard_components(spark, docs, 4, 85, 100).collect()), key=str)
    assert got == sorted([(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 2, 3), (None, 2, 3), (8, 2, 3), (3, 2, 3),
                          (9, 1, 9), (10, 1, 10)], key=str)
    assert jaccard_components(spark, docs.limit(0), 4, 85, 100).collect() == []


def test_release_after_each_large_table(spark, monkeypatch):
    from contrail.llm.shared import Scratch
    calls = []
    release = Scratch.release
    monkeypatch.setattr(Scratch, "release", lambda self: (calls.append(set(self.saved)), release(self))[1])
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "other " * 9)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_components(spark, docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert calls[0] == {"rows", "shared"} and len(calls) >= 3


def boilerplate(n=24):
    """Texts of one length that share one range of rare words and nothing else, in
    three shards of chance, and some linked pairs."""
    rng = random.Random(9)
    rows = []
    for d in range(n):
        words = [f"own{d}x{i}" for i in range(60)]
        words[20:40] = [f"line{d % 3}x{i}" for i in range(20)]
        rows.append((d, " ".join(words)))
    for d in range(0, n, 5):
        words = rows[d][1].split()
        words[rng.randrange(60)] = "changed"
        rows.append((n + d, " ".join(words)))
    return rows


def test_small_open_shards_are_not_joined_to_clusters(spark, monkeypatch):
    from contrail.llm import ngram_join
    seen = []
    whole = ngram_join._open_round
    monkeypatch.setattr(ngram_join, "_open_round", lambda opened, *rest: (seen.append(opened.count()),
                                                                         whole(opened, *rest))[1])
    small, rows = [], boilerplate()
    round_ = ngram_join._small_round
    monkeypatch.setattr(ngram_join, "_small_round", lambda opened, *rest: (small.append(opened.count()),
                                                                          round_(opened, *rest))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows, 4, 85, 100)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 1)
    assert sorted(map(tuple, jaccard_components(spark, docs, 4, 85, 100).collect())) == expected
    assert seen == [0] and small[0] > 0
    monkeypatch.setattr(ngram_join, "BLOCK", 2)  # larger shards go by clusters
    assert sorted(map(tuple, jaccard_components(spark, docs, 4, 85, 100).collect())) == expected
    assert seen[1] > 0


def test_one_of_the_shards_with_equal_classes_stays(spark):
    from contrail.llm.ngram_join import _one_of_equal
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 11), (3, 10), (3, 12), (4, 11)], "sig long, cls long")
    got = sorted((r.sig, r.cls, r.width) for r in _one_of_equal(members).collect())
    assert got == [(1, 10, 2), (1, 11, 2), (3, 10, 2), (3, 12, 2), (4, 11, 1)]


def near_sets(rng, n, alike):
    """n sets of 60 shingles that share 58 in ``alike`` of three, else 54: too few for a link."""
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    out = []
    for i in range(n):
        keep = 58 if i % 3 < alike else 54
        out.append(np.unique(np.concatenate([base[:keep], rng.integers(0, 2**64, 60 - keep, dtype=np.uint64)])))
    return out


def linked_parts(cls, sets, links=None):
    """The classes by their parts: of all linked pairs, or of ``links``."""
    part = {c: c for c in cls}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    if links is None:
        links = [(x, y) for i, (x, a) in enumerate(zip(cls, sets)) for y, b in zip(cls[:i], sets[:i])
                 if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))]
    for x, y in links:
        part[find(x)] = find(y)
    return sorted(sorted(c for c in cls if find(c) == r) for r in cls if find(r) == r)


def test_tasks_return_no_more_rows_than_they_read():
    import pyarrow as pa

    from contrail.llm.ngram_join import _GROUPS, _group_links, _pack, _shard_groups, _tree_links
    rng = np.random.default_rng(6)
    for alike in (0, 1, 3):
        sets = near_sets(rng, 90, alike)
        cls = list(range(100, 190))
        expected = linked_parts(cls, sets)
        vec = pa.array([_pack(count_vector(s)) for s in sets], pa.binary())
        data = pa.array([s.tobytes() for s in sets], pa.binary())
        ids, sig = pa.array(cls, pa.int64()), pa.array([-7] * 90, pa.int64())
        shard = pa.RecordBatch.from_arrays([sig, ids, ids, vec], names=["sig", "cls", "comp", "vec"])
        groups = pa.Table.from_batches(_shard_groups(85, 100)([shard.slice(0, 50), shard.slice(50)]), _GROUPS)
        assert groups.num_rows <= 90 and len(set(groups.column("cls").to_pylist())) == groups.num_rows
        by_group = dict(zip(groups.column("cls").to_pylist(), groups.column("sig").to_pylist()))
        assert all(len({by_group[c] for c in part}) == 1 for part in expected if len(part) > 1)
        group = pa.RecordBatch.from_arrays([sig, ids, ids, data], names=["sig", "cls", "comp", "shingles"])
        found = [tuple(r.values()) for b in _group_links(85, 100)([group.slice(0, 50), group.slice(50)])
                 for r in b.to_pylist()]
        assert len(found) == 90 - len(expected) and linked_parts(cls, sets, found) == expected
        # a tree of some, searched by all in two batches
        names = ["cluster", "block", "salt", "streamed", "cls", "comp", "shingles"]
        order = [*range(0, 90, 2), *range(90)]
        key = pa.array([1] * len(order), pa.int64())
        rows = pa.RecordBatch.from_arrays(
            [key, key, key, pa.array([0] * 45 + [1] * 90), *[x.take(pa.array(order)) for x in (ids, ids, data)]], names=names)
        found = [tuple(r.values()) for b in _tree_links(85, 100)([rows.slice(0, 30), rows.slice(30, 60), rows.slice(90)])
                 for r in b.to_pylist()]
        held = set(cls[::2])
        pairs = [(x, y) for i, (x, a) in enumerate(zip(cls, sets)) for y, b in zip(cls, sets) if y in held and x != y
                 and 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))]
        assert len(found) < 90 and linked_parts(cls, sets, found) == linked_parts(cls, sets, pairs)


def test_groups_that_share_classes(spark, monkeypatch):
    from contrail.llm import ngram_join
    from contrail.llm.shared import Scratch
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    shards = {1: (1, 2), 2: (2, 3), 10: (10, 11), 20: (20, 21), 21: (21, 22), 22: (20, 22), 23: (20, 21), 24: (21, 22)}
    rows = [(s, c, c, 5) for s, found in shards.items() for c in found]
    scratch = Scratch(spark, "test-groups")
    groups = scratch.save(spark.createDataFrame(rows, "sig long, cls long, comp long, n long"), "groups")
    alone, joined = ngram_join._merged_groups(groups, scratch)
    found = {}
    for r in alone.collect():
        found.setdefault(r.sig, set()).add(r.cls)
    assert sorted(map(sorted, found.values())) == [[1, 2], [2, 3], [10, 11]]
    assert sorted(r.cls for r in joined.collect()) == [20, 21, 22]
    assert len({r.cluster for r in joined.collect()}) == 1
    monkeypatch.setattr(ngram_join, "SHINGLES", 8)  # a group that fits no tree
    assert ngram_join._merged_groups(groups, scratch)[0].count() == 0


def test_equals_all_pairs_in_small_trees(spark, monkeypatch):
    from contrail.llm import ngram_join
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 1)
    rows = corpus(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows, 4, 85, 100)
    for block, shingles in ((3, 10**6), (1024, 150)):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "SHINGLES", shingles)
        assert sorted(map(tuple, jaccard_components(spark, docs, 4, 85, 100).collect())) == expected
