"""Pair search from both ends against a plain search with the same tie rule."""
import random

from contrail.operators import graph as G


def brute(edges, o, d, most):
    """(path, delays) of the smallest shortest path by airports, or None."""
    level = {o: ((o,), ())}
    seen = {o}
    for _ in range(most):
        new = {}
        for u, (path, delays) in level.items():
            for a, b, w in edges:
                if a == u and b not in seen:
                    way = (path + (b,), delays + (w,))
                    if b not in new or way[0] < new[b][0]:
                        new[b] = way
        seen |= set(new)
        if d in new:
            return new[d]
        level = new
    return None


def graph(seed, nodes, out):
    rng = random.Random(seed)
    names = [f"A{i:02d}" for i in range(nodes)]
    return names, sorted({(a, b): (a, b, round(rng.uniform(0, 30), 2)) for a in names
                          for b in rng.sample(names, out) if a != b}.values())


def frames(spark, edges, pairs):
    return (spark.createDataFrame(edges, "src string, dst string, avg_delay double"),
            spark.createDataFrame(pairs, "origin string, dest string"))


def test_paths_and_ties(spark):
    for seed, out in ((1, 2), (2, 3)):
        names, edges = graph(seed, 40, out)
        rng = random.Random(seed + 9)
        pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(30)} | {("A00", "nowhere"), ("A01", "A01")})
        e, p = frames(spark, edges, pairs)
        for most in (2, 10):
            got = {(r.origin, r.dest): (tuple(r.airports), tuple(r.delays)) for r in
                   G.shortest_paths(e, p, most).collect()}
            want = {}
            for o, d in pairs:
                way = ((o,), ()) if o == d else brute(edges, o, d.upper(), most)
                if way is not None:
                    want[o, d.upper()] = way
            assert got == want, (seed, most)


def test_the_search_visits_fewer_nodes_than_a_flood(spark):
    # a tree of three ways at every airport, and one far pair
    edges = [(f"N{i:04d}", f"N{3 * i + k:04d}", 1.0) for i in range(364) for k in (1, 2, 3)]
    e, p = frames(spark, edges, [("N0000", "N1000")])
    found, levels = G.two_frontiers(e, p, 10)
    visited = sum(level.count() for side in levels.values() for level in side)
    flood = G._bfs(e, spark.createDataFrame([("N0000",)], "root string"), 10, True).count()
    assert found.first().path[0] == "N0000" and found.first().path[-1] == "N1000"
    assert visited < flood / 20
    # states stay two names wide, however long the paths
    assert all(level.columns == ["end", "node"] for side in levels.values() for level in side)


def test_no_pairs_and_no_edges(spark):
    e, p = frames(spark, [("A", "B", None)], [("A", "B"), ("B", "A"), ("C", "C")])
    got = {(r.origin, r.dest): (r.hops, r.total_delay) for r in G.shortest_paths(e, p).collect()}
    assert got == {("A", "B"): (1, 0.0), ("C", "C"): (0, 0.0)}
    assert G.shortest_paths(e, p.limit(0)).count() == 0
    assert G.shortest_paths(e.limit(0), p).collect()[0].hops == 0
