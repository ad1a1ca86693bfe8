from pyspark.sql import functions as F

from contrail.operators import graph as G
from tests.conftest import rows

EDGE_SCHEMA = "src string, dst string, total_flights long, avg_delay double"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 10, float(i)) for i, (a, b) in enumerate(pairs)],
                                 EDGE_SCHEMA)


def pairs(spark, ps):
    return spark.createDataFrame(ps, "origin string, dest string")


def test_route_sample_paths(spark):
    # the five-route sample: JFK-LAX both ways, ORD-ATL both ways, DFW-JFK
    e = edges(spark, [("JFK", "LAX"), ("LAX", "JFK"), ("ORD", "ATL"), ("ATL", "ORD"),
                      ("DFW", "JFK")])
    out = G.shortest_paths(e, pairs(spark, [("DFW", "LAX"), ("JFK", "ORD"), ("jfk", "jfk")]))
    got = {(r.origin, r.dest): r for r in out.collect()}
    assert got[("DFW", "LAX")].airports == ["DFW", "JFK", "LAX"]
    assert got[("DFW", "LAX")].hops == 2
    assert got[("DFW", "LAX")].delays == [4.0, 0.0]
    assert got[("DFW", "LAX")].total_delay == 4.0
    assert ("JFK", "ORD") not in got
    assert got[("JFK", "JFK")].hops == 0 and got[("JFK", "JFK")].airports == ["JFK"]


def test_hop_limit_cycle_and_ties(spark):
    chain = [(f"A{i:02d}", f"A{i + 1:02d}") for i in range(11)]        # A00 -> ... -> A11
    diamond = [("S", "M2"), ("S", "M1"), ("M1", "T"), ("M2", "T"), ("T", "S")]  # tie + cycle
    e = edges(spark, chain + diamond)
    out = G.shortest_paths(e, pairs(spark, [("A00", "A10"), ("A00", "A11"), ("S", "T")]))
    got = {(r.origin, r.dest): r for r in out.collect()}
    assert got[("A00", "A10")].hops == 10
    assert ("A00", "A11") not in got                  # 11 hops is beyond the limit
    assert got[("S", "T")].airports == ["S", "M1", "T"]  # smallest of the equal paths


def test_paths_are_connected_and_minimal(spark):
    import itertools
    import random
    rnd = random.Random(3)
    nodes = [f"N{i}" for i in range(12)]
    es = sorted({(a, b) for a, b in itertools.permutations(nodes, 2) if rnd.random() < 0.15})
    e = edges(spark, es)
    out = G.reachable_paths(e).collect()
    adj = {}
    for a, b in es:
        adj.setdefault(a, set()).add(b)

    def bfs(s):
        dist, frontier = {s: 0}, [s]
        while frontier:
            nxt = []
            for u in frontier:
                for v in adj.get(u, ()):
                    if v not in dist:
                        dist[v] = dist[u] + 1
                        nxt.append(v)
            frontier = nxt
        return dist
    expect = {(s, t): d for s in nodes for t, d in bfs(s).items() if t != s and d <= 10
              and s in adj}
    got = {(r.origin, r.dest): r for r in out}
    assert set(got) == set(expect)
    for (s, t), r in got.items():
        assert r.hops == expect[(s, t)]
        assert all(b in adj[a] for a, b in zip(r.airports, r.airports[1:]))


def test_build_graph_dedupes_nodes_and_thresholds(spark):
    import datetime as dt
    recs = []
    for i in range(12):
        recs.append((i, "JFK", "New York", "LAX", "Los Angeles"))
    for i in range(12, 24):
        recs.append((i, "JFK", "Jamaica", "ORD", "Chicago"))
    for i in range(24, 28):
        recs.append((i, "ORD", "Chicago", "ATL", "Atlanta"))  # below 10 flights
    f = spark.createDataFrame(
        [(fid, dt.date(2024, 1, 1), o, oc, d, dc, 5.0, False, False, 100.0)
         for fid, o, oc, d, dc in recs],
        "flight_id long, flightdate date, origin string, origincityname string, dest string, "
        "destcityname string, depdelay double, depdel15 boolean, cancelled boolean, distance double")
    nodes, e = G.build_graph(f, 10)
    assert rows(nodes, "iata", "city") == [("JFK", "Jamaica"), ("LAX", "Los Angeles"),
                                           ("ORD", "Chicago")]
    assert rows(e, "src", "dst") == [("JFK", "LAX"), ("JFK", "ORD")]
    assert G.duplicate_keys(nodes).count() == 0
    deg = {r.iata: (r.out_degree, r.in_degree) for r in G.degrees(e).collect()}
    assert deg["JFK"] == (2, 0) and deg["ORD"] == (0, 1)


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([("A", 1), ("B", 2)], "k string, v int")
    new = spark.createDataFrame([("B", 20), ("C", 30)], "k string, v int")
    assert rows(G.upsert(old, new, ["k"], ["v"])) == [("A", 1), ("B", 20), ("C", 30)]


def test_unknown_airport_has_no_path(spark):
    e = edges(spark, [("JFK", "LAX"), ("LAX", "JFK")])
    out = G.shortest_paths(e, pairs(spark, [("XXX", "JFK"), ("JFK", "YYY"), ("JFK", "LAX")]))
    assert rows(out, "origin", "dest", "hops") == [("JFK", "LAX", 1)]


def test_graph_from_shared_route_stats_equals_mean_threshold(spark):
    # the thin-route query aggregates routes once and passes them in; the
    # graph must equal the one built from flights with the mean threshold
    from contrail.sources.tables import flights
    from tests.conftest import SF_SMALL
    fl = flights(spark, SF_SMALL)
    rs = G.route_stats(fl, 0)
    mean = rs.agg(F.avg("total_flights")).scalar()
    n1, e1 = G.build_graph(fl, stats=rs.where(F.col("total_flights") >= mean))
    n2, e2 = G.build_graph(fl, "mean")
    assert rows(n1) == rows(n2) and rows(e1) == rows(e2)
    assert e1.count() > 0
