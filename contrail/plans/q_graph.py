"""Route graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.operators import graph as G
from contrail.plans.oracle import with_base
from contrail.plans.registry import register
from contrail.sources.tables import flights

_RATE = ("AVG(CASE WHEN depdel15 = TRUE THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100")


def _graph_ctes(threshold: str) -> str:
    return f"""
rs AS (SELECT origin, dest, origincityname, destcityname, COUNT(*) AS total_flights,
         AVG(depdelay) AS avg_delay, AVG(distance) AS avg_distance, {_RATE} AS delay_rate
       FROM flights WHERE cancelled = FALSE
       GROUP BY origin, dest, origincityname, destcityname),
rsf AS (SELECT * FROM rs WHERE total_flights >= {threshold}),
edges0 AS (SELECT origin AS src, dest AS dst, total_flights, COALESCE(avg_delay, 0.0) AS avg_delay,
             COALESCE(avg_distance, 0.0) AS avg_distance, COALESCE(delay_rate, 0.0) AS delay_rate
           FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY origin, dest ORDER BY total_flights DESC,
                   origincityname NULLS LAST, destcityname NULLS LAST) AS rn FROM rsf) WHERE rn = 1),
nodes AS (SELECT iata, city FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY iata ORDER BY side, city NULLS LAST) AS rn
            FROM (SELECT origin AS iata, origincityname AS city, 0 AS side FROM rsf
                  UNION ALL SELECT dest, destcityname, 1 FROM rsf)) WHERE rn = 1),
edges AS (SELECT * FROM edges0 WHERE src IN (SELECT iata FROM nodes)
                                 AND dst IN (SELECT iata FROM nodes))"""


_MEAN = "(SELECT AVG(total_flights) FROM rs)"


def _bfs_sql(roots_sql: str, hops: int = G.MAX_HOPS) -> str:
    """Breadth-first search unrolled into ``hops`` levels of SQL CTEs."""
    parts = [f"l0 AS (SELECT root, root AS node, [root] AS path, CAST([] AS DOUBLE[]) AS delays "
             f"FROM ({roots_sql}))",
             "s0 AS (SELECT root, node FROM l0)"]
    for i in range(1, hops + 1):
        parts.append(f"""c{i} AS (SELECT l.root, e.dst AS node, list_append(l.path, e.dst) AS path,
              list_append(l.delays, e.avg_delay) AS delays
            FROM l{i - 1} l JOIN edges e ON l.node = e.src
            WHERE NOT EXISTS (SELECT 1 FROM s{i - 1} s WHERE s.root = l.root AND s.node = e.dst))""")
        parts.append(f"l{i} AS (SELECT root, node, MIN(path) AS path, ARG_MIN(delays, path) AS delays "
                     f"FROM c{i} GROUP BY root, node)")
        parts.append(f"s{i} AS (SELECT root, node FROM s{i - 1} UNION ALL SELECT root, node FROM l{i})")
    parts.append("found AS (" + " UNION ALL ".join(
        f"SELECT * FROM l{i}" for i in range(1, hops + 1)) + ")")
    return ",\n".join(parts)


_TOTAL = ("CASE WHEN len(delays) = 0 THEN 0.0 ELSE list_reduce(list_transform(delays, "
          "lambda x: COALESCE(x, 0.0)), lambda a, b: a + b) END")


@register("a3_route_stats", with_base(f"""
SELECT origin, dest, origincityname, destcityname, COUNT(*) AS total_flights,
  AVG(depdelay) AS avg_delay, AVG(distance) AS avg_distance, {_RATE} AS delay_rate
FROM flights WHERE cancelled = FALSE GROUP BY origin, dest, origincityname, destcityname
HAVING COUNT(*) >= 10"""))
def a3(spark, sf):
    return G.route_stats(flights(spark, sf), 10)


@register("a4_route_stats_flat", with_base("""
SELECT origin, dest, origincityname, destcityname,
  COALESCE(AVG(distance), 0.0) AS distance_mean, COALESCE(AVG(depdelay), 0.0) AS depdelay_mean,
  COUNT(depdel15) AS depdel15_count,
  CAST(COALESCE(SUM(CAST(depdel15 AS INT)), 0) AS BIGINT) AS depdel15_sum,
  COALESCE(CASE WHEN COUNT(depdel15) > 0 THEN CAST((SUM(CAST(depdel15 AS INT)) * 200 * 100
     + COUNT(depdel15)) // (2 * COUNT(depdel15)) AS DOUBLE) / 100.0 END, 0.0) AS delay_rate
FROM flights GROUP BY origin, dest, origincityname, destcityname"""))
def a4(spark, sf):
    return G.route_stats_flat(flights(spark, sf))


@register("g1_graph_edges", with_base("SELECT * FROM edges", extra=_graph_ctes("10").strip()))
def g1_edges(spark, sf):
    return G.build_graph(flights(spark, sf), 10)[1]


@register("g1_graph_nodes", with_base("SELECT * FROM nodes", extra=_graph_ctes("10").strip()))
def g1_nodes(spark, sf):
    return G.build_graph(flights(spark, sf), 10)[0]


def _all_paths(threshold: str) -> str:
    return with_base(f"""
SELECT root AS origin, node AS dest, path AS airports, delays, CAST(len(path) - 1 AS INTEGER) AS hops,
  {_TOTAL} AS total_delay FROM found""",
        extra=_graph_ctes(threshold).strip() + ",\n" + _bfs_sql("SELECT DISTINCT src AS root FROM edges"))


@register("g2_shortest_paths_all", _all_paths("10"))
def g2_all(spark, sf):
    return G.reachable_paths(G.build_graph(flights(spark, sf), 10)[1])


@register("g2_shortest_paths_busy_routes", _all_paths(_MEAN))
def g2_busy(spark, sf):
    """Only routes of at least mean volume are edges, so paths have hops."""
    return G.reachable_paths(G.build_graph(flights(spark, sf), "mean")[1])


_PAIRS = """
pairs AS (SELECT DISTINCT origin, dest FROM rs WHERE total_flights < (SELECT AVG(total_flights) FROM rs))"""


@register("g2_shortest_paths_for_thin_routes", with_base(f"""
SELECT p.origin, p.dest, f.path AS airports, f.delays, CAST(len(f.path) - 1 AS INTEGER) AS hops,
  {_TOTAL} AS total_delay
FROM pairs p JOIN found f ON f.root = p.origin AND f.node = p.dest
UNION ALL
SELECT origin, dest, [origin], CAST([] AS DOUBLE[]), 0, 0.0 FROM pairs WHERE origin = dest""",
    extra=_graph_ctes(_MEAN).strip() + "," + _PAIRS.strip() + ",\n"
    + _bfs_sql("SELECT DISTINCT origin AS root FROM pairs")))
def g2_pairs(spark, sf):
    """Routes below the mean volume are not graph edges; find how to fly them."""
    fl = flights(spark, sf)
    # every route aggregated once (one row per route); the mean, the thin
    # pairs and the graph edges all read that small result
    rs = G._checkpoint(G.route_stats(fl, 0))
    mean = rs.agg(F.avg("total_flights")).scalar()
    pairs = rs.where(F.col("total_flights") < mean).select("origin", "dest").distinct()
    _, edges = G.build_graph(fl, stats=rs.where(F.col("total_flights") >= mean))
    return G.shortest_paths(edges, pairs)


@register("g3_graph_top_edges", with_base("""
SELECT e.src AS source, a.city AS source_city, e.dst AS target, b.city AS target_city,
  e.total_flights AS flights, e.avg_delay, e.delay_rate
FROM (SELECT * FROM edges ORDER BY total_flights DESC, src, dst LIMIT 100) e
JOIN nodes a ON e.src = a.iata JOIN nodes b ON e.dst = b.iata""",
                                        extra=_graph_ctes("10").strip()))
def g3_edges(spark, sf):
    nodes, edges = G.build_graph(flights(spark, sf), 10)
    return G.top_edges(nodes, edges, 100)[1]


@register("g3_graph_top_nodes", with_base("""
SELECT DISTINCT id, city FROM (
  SELECT e.src AS id, a.city FROM (SELECT * FROM edges ORDER BY total_flights DESC, src, dst LIMIT 100) e
    JOIN nodes a ON e.src = a.iata
  UNION ALL
  SELECT e.dst, b.city FROM (SELECT * FROM edges ORDER BY total_flights DESC, src, dst LIMIT 100) e
    JOIN nodes b ON e.dst = b.iata)""", extra=_graph_ctes("10").strip()))
def g3_nodes(spark, sf):
    nodes, edges = G.build_graph(flights(spark, sf), 10)
    return G.top_edges(nodes, edges, 100)[0]


@register("g4_most_delayed_edges", with_base("""
SELECT src, dst, avg_delay FROM edges ORDER BY avg_delay DESC, src, dst LIMIT 5""",
                                           extra=_graph_ctes("10").strip()))
def g4(spark, sf):
    return G.most_delayed_edges(G.build_graph(flights(spark, sf), 10)[1])


@register("g5_degrees", with_base("""
SELECT COALESCE(o.iata, i.iata) AS iata, COALESCE(o.out_degree, 0) AS out_degree,
  COALESCE(i.in_degree, 0) AS in_degree
FROM (SELECT src AS iata, COUNT(DISTINCT dst) AS out_degree FROM edges GROUP BY src) o
FULL JOIN (SELECT dst AS iata, COUNT(DISTINCT src) AS in_degree FROM edges GROUP BY dst) i
  ON o.iata = i.iata""", extra=_graph_ctes("10").strip()))
def g5(spark, sf):
    return G.degrees(G.build_graph(flights(spark, sf), 10)[1])


@register("g6_duplicate_node_keys", with_base("""
SELECT iata, COUNT(*) AS n FROM nodes GROUP BY iata HAVING COUNT(*) > 1""",
                                            extra=_graph_ctes("10").strip()))
def g6(spark, sf):
    return G.duplicate_keys(G.build_graph(flights(spark, sf), 10)[0])
