"""Airport route graph as two DataFrames and batch shortest paths.

* nodes(iata, city)
* edges(src, dst, total_flights, avg_delay, avg_distance, delay_rate)

Shortest paths are a breadth-first search run for *many* (origin, dest)
pairs at once: one join of the frontier with the edges per hop, an anti-join
against what each source has already reached, and a min-aggregate that keeps
the lexicographically smallest path per (source, node) - so ties resolve the
same way every run. Each hop's frontier is checkpointed (reliably, into the
shared checkpoint folder) so the plan does not grow with the hop count and a
lost executor only recomputes one hop.

Scale: the graph has one node per airport and one edge per route - thousands,
not billions - while every flight contributes to the edge statistics through
one partial-aggregated group-by. The BFS state is at most
(sources x airports) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.operators.filters import not_cancelled_strict
from contrail.operators.topk import within
from contrail.operators.windows import keep_first, latest_per_key
from contrail.session import checkpoint_root

MAX_HOPS = 10


def route_stats(flights: DataFrame, min_flights: int | str = 10) -> DataFrame:
    """A3: per (origin, dest, origin city, dest city) flights, mean delay and
    delay rate %, strict uncancelled, ``HAVING count >= min_flights``.

    ``min_flights="mean"`` keeps routes at or above the mean route volume
    (a threshold that scales with the data)."""
    f = not_cancelled_strict(flights)
    g = f.groupBy("origin", "dest", "origincityname", "destcityname").agg(
        F.count(F.lit(1)).alias("total_flights"),
        F.avg("depdelay").alias("avg_delay"),
        F.avg("distance").alias("avg_distance"),
        (F.avg(F.when(F.col("depdel15") == F.lit(True), 1.0).otherwise(0.0)) * 100)
        .alias("delay_rate"))
    if min_flights == "mean":
        # one row per route, checkpointed: the flights are aggregated once,
        # then the mean and the filter read the small result
        g = _checkpoint(g)
        return g.where(F.col("total_flights") >= g.agg(F.avg("total_flights")).scalar())
    return g.where(F.col("total_flights") >= F.lit(int(min_flights)))


def build_graph(flights: DataFrame, min_flights: int | str = 10,
                stats: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """G1: nodes and edges from flights (or from ``stats``: route_stats rows
    already thresholded, so callers that need them too aggregate once).

    * edges: one per (origin, dest); when several city pairs exist the one
      with most flights wins, then the smaller cities (W4); NULL measures -> 0
      as the loader writes them.
    * nodes: every endpoint; its city is the smallest city seen as an origin,
      else the smallest seen as a destination (J4).
    * J5: edges keep only endpoints present in nodes.
    """
    r = stats if stats is not None else route_stats(flights, min_flights)
    ranked = r.withColumn("_neg", -F.col("total_flights"))
    best = keep_first(ranked, ["origin", "dest"], ["_neg", "origincityname", "destcityname"])
    edges = best.select(
        F.col("origin").alias("src"), F.col("dest").alias("dst"),
        F.col("total_flights").cast("long").alias("total_flights"),
        F.coalesce(F.col("avg_delay"), F.lit(0.0)).alias("avg_delay"),
        F.coalesce(F.col("avg_distance"), F.lit(0.0)).alias("avg_distance"),
        F.coalesce(F.col("delay_rate"), F.lit(0.0)).alias("delay_rate"))
    ends = (r.select(F.col("origin").alias("iata"), F.col("origincityname").alias("city"),
                     F.lit(0).alias("_side"))
            .unionByName(r.select(F.col("dest").alias("iata"), F.col("destcityname").alias("city"),
                                  F.lit(1).alias("_side"))))
    nodes = keep_first(ends, ["iata"], ["_side", "city"]).select("iata", "city")
    edges = (edges.join(nodes.select(F.col("iata").alias("src")), "src", "left_semi")
                  .join(nodes.select(F.col("iata").alias("dst")), "dst", "left_semi")
                  .select("src", "dst", "total_flights", "avg_delay", "avg_distance", "delay_rate"))
    return nodes, edges


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Key upsert (MERGE ... SET): new rows replace old rows with the same
    key; of several new rows of a key the one with the largest ``order``
    columns wins (then the other columns)."""
    newest = latest_per_key(new, keys, order)
    return old.join(newest.select(*keys), keys, "left_anti").unionByName(newest)


def _checkpoint(df: DataFrame) -> DataFrame:
    # reliable checkpoint into spark.checkpoint.dir (never localCheckpoint)
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def _total_delay():
    return F.aggregate("delays", F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def _bfs(edges: DataFrame, roots: DataFrame, max_hops: int, checkpoint: bool) -> DataFrame:
    """(root, node, path, delays) for every node reached from a root in 1..max_hops."""
    if checkpoint:
        checkpoint_root(roots.sparkSession)
    e = edges.select(F.col("src").alias("_u"), F.col("dst").alias("_v"),
                     F.col("avg_delay").alias("_d"))
    if checkpoint:
        # one row per route: computed once instead of once per hop
        e, roots = _checkpoint(e), _checkpoint(roots)
    frontier = roots.select("root", F.col("root").alias("node"),
                            F.array(F.col("root")).alias("path"),
                            F.array().cast("array<double>").alias("delays"))
    start = frontier.select("root", "node")
    steps = []
    for _ in range(max_hops):
        seen = start
        for st in steps:  # each step is checkpointed: the union stays shallow
            seen = seen.unionByName(st.select("root", "node"))
        step = (frontier.join(e, F.col("node") == F.col("_u"))
                .select("root", F.col("_v").alias("node"),
                        F.concat("path", F.array("_v")).alias("path"),
                        F.concat("delays", F.array("_d")).alias("delays")))
        step = step.join(seen, ["root", "node"], "left_anti")
        step = (step.groupBy("root", "node")
                    .agg(F.min(F.struct("path", "delays")).alias("_p"))
                    .select("root", "node", "_p.path", "_p.delays"))
        if checkpoint:
            step = _checkpoint(step)
        if step.isEmpty():
            break
        steps.append(step)
        frontier = step
    found = frontier.limit(0)
    for st in steps:
        found = found.unionByName(st)
    return found


def _next_level(levels: list[DataFrame], open_ends: DataFrame, step: DataFrame) -> DataFrame:
    """Nodes one edge of ``step`` (from, to) beyond the last level of the ends
    that still have an open pair."""
    new = (levels[-1].join(open_ends, "end", "left_semi")
           .join(step, F.col("node") == F.col("from")).select("end", F.col("to").alias("node")).distinct())
    for level in levels:
        new = new.join(level, ["end", "node"], "left_anti")
    return new


def _walk(met: DataFrame, e: DataFrame, ahead: list[DataFrame], back: list[DataFrame]) -> DataFrame:
    """(origin, dest, path, delays): the smallest shortest path of pairs that
    met at nodes of the last levels. Nodes of the first half that lie on a
    shortest path are found backwards from where the pair met; then the walk
    takes the smallest of the possible next airports at every step."""
    pair = ["origin", "dest"]
    halves, on_path = [], met
    for level in reversed(ahead[1:]):
        if halves:
            on_path = (on_path.join(e, F.col("node") == F.col("_v")).select(*pair, F.col("_u").alias("node"))
                       .join(level.select(F.col("end").alias("origin"), "node"), ["origin", "node"], "left_semi")
                       .select(*pair, "node").distinct())
        halves.insert(0, on_path)
    at = met.select(*pair).distinct().select(*pair, F.col("origin").alias("at"), F.array("origin").alias("path"),
                                             F.array().cast("array<double>").alias("delays"))
    sides = [(h, pair) for h in halves] + [(b.withColumnRenamed("end", "dest"), ["dest"])
                                           for b in reversed(back[:-1])]
    for allowed, keys in sides:
        at = (at.join(e, F.col("at") == F.col("_u")).withColumn("node", F.col("_v"))
              .join(allowed, [*keys, "node"], "left_semi")
              .groupBy(*pair).agg(F.min(F.struct("_v", "_d", "path", "delays")).alias("s"))
              .select(*pair, F.col("s._v").alias("at"), F.concat("s.path", F.array("s._v")).alias("path"),
                      F.concat("s.delays", F.array("s._d")).alias("delays")))
    return at.select(*pair, "path", "delays")


def two_frontiers(edges: DataFrame, pairs: DataFrame, max_hops: int, checkpoint: bool = True):
    """(found, levels): shortest paths of (origin, dest) pairs of different
    airports, and the levels of (end, node) that the search has visited.

    One frontier grows from the origins, one from the destinations, the one with
    fewer nodes first; a pair has met when its two last levels share a node,
    which first happens on its shortest paths. States are two names wide, and
    pairs with an end in common share them.
    """
    if checkpoint:
        checkpoint_root(pairs.sparkSession)
    keep = _checkpoint if checkpoint else (lambda df: df)
    e = keep(edges.select(F.col("src").alias("_u"), F.col("dst").alias("_v"), F.col("avg_delay").alias("_d")))
    ways = {"origin": e.select(F.col("_u").alias("from"), F.col("_v").alias("to")),
            "dest": e.select(F.col("_v").alias("from"), F.col("_u").alias("to"))}
    open_pairs = keep(pairs)
    levels = {side: [keep(open_pairs.select(F.col(side).alias("end"), F.col(side).alias("node")).distinct())]
              for side in ways}
    size = {side: levels[side][0].count() for side in ways}
    found = None
    for _ in range(max_hops):
        side = min(ways, key=lambda x: (size[x], x != "origin"))
        ends = open_pairs.select(F.col(side).alias("end")).distinct()
        new = keep(_next_level(levels[side], ends, ways[side]))
        size[side] = new.count()
        if not size[side]:
            break
        levels[side].append(new)
        met = keep(open_pairs.join(levels["origin"][-1].withColumnRenamed("end", "origin"), "origin")
                   .join(levels["dest"][-1].withColumnRenamed("end", "dest"), ["dest", "node"], "left_semi")
                   .select("origin", "dest", "node"))
        if met.isEmpty():
            continue
        paths = keep(_walk(met, e, levels["origin"], levels["dest"]))
        found = paths if found is None else found.unionByName(paths)
        open_pairs = keep(open_pairs.join(met, ["origin", "dest"], "left_anti"))
        if open_pairs.isEmpty():
            break
    return found, levels


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = MAX_HOPS,
                   checkpoint: bool = True) -> DataFrame:
    """Unweighted directed shortest path for every (origin, dest) pair.

    Returns origin, dest, airports (array), delays (per-hop mean delay),
    hops, total_delay (NULL delays count 0). Pairs without a path within
    ``max_hops`` are absent; origin == dest gives hops 0 and one airport.
    Ties between equally short paths go to the smallest airport array.
    """
    wanted = pairs.select(F.upper("origin").alias("origin"), F.upper("dest").alias("dest")).distinct()
    found, _ = two_frontiers(edges, wanted.where(F.col("origin") != F.col("dest")), max_hops, checkpoint)
    out = wanted.where(F.col("origin") == F.col("dest")).select(
        "origin", "dest", F.array("origin").alias("path"),
        F.array().cast("array<double>").alias("delays"))
    if found is not None:
        out = found.unionByName(out)
    return out.select("origin", "dest", F.col("path").alias("airports"), "delays",
                      (F.size("path") - 1).alias("hops"), _total_delay().alias("total_delay"))


def reachable_paths(edges: DataFrame, max_hops: int = MAX_HOPS,
                    checkpoint: bool = True) -> DataFrame:
    """G2 from every airport with an out-edge to every airport it reaches
    (origin != dest). The pairs come out of the search, not a cross join."""
    roots = edges.select(F.col("src").alias("root")).distinct()
    found = _bfs(edges, roots, max_hops, checkpoint)
    return found.select(F.col("root").alias("origin"), F.col("node").alias("dest"),
                        F.col("path").alias("airports"), "delays",
                        (F.size("path") - 1).alias("hops"), _total_delay().alias("total_delay"))


def top_edges(nodes: DataFrame, edges: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The ``limit`` (at most 500, more is refused) busiest edges with
    endpoint cities, and the distinct nodes they touch."""
    limit = within(limit, 500)
    n = nodes.select("iata", "city")
    top = (edges.orderBy(F.desc("total_flights"), "src", "dst").limit(limit)
                .join(n.select(F.col("iata").alias("src"), F.col("city").alias("source_city")), "src")
                .join(n.select(F.col("iata").alias("dst"), F.col("city").alias("target_city")), "dst")
                .select(F.col("src").alias("source"), "source_city", F.col("dst").alias("target"),
                        "target_city", F.col("total_flights").alias("flights"), "avg_delay",
                        "delay_rate"))
    ends = (top.select(F.col("source").alias("id"), F.col("source_city").alias("city"))
               .union(top.select(F.col("target").alias("id"), F.col("target_city").alias("city")))
               .distinct())
    return ends, top


def most_delayed_edges(edges: DataFrame, k: int = 5) -> DataFrame:
    """The k edges with the largest mean delay."""
    return (edges.orderBy(F.desc("avg_delay"), "src", "dst").limit(k)
                 .select("src", "dst", "avg_delay"))


def degrees(edges: DataFrame) -> DataFrame:
    """Out- and in-degree (distinct neighbours) per airport."""
    out_d = edges.groupBy(F.col("src").alias("iata")).agg(F.countDistinct("dst").alias("out_degree"))
    in_d = edges.groupBy(F.col("dst").alias("iata")).agg(F.countDistinct("src").alias("in_degree"))
    return (out_d.join(in_d, "iata", "full")
                 .select("iata", F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
                         F.coalesce("in_degree", F.lit(0)).alias("in_degree")))


def duplicate_keys(nodes: DataFrame, key: str = "iata") -> DataFrame:
    """Keys that occur more than once (must be empty)."""
    return nodes.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def route_stats_flat(flights: DataFrame) -> DataFrame:
    """A4: loader variant - per (origin, dest, cities) mean distance and
    delay, count and sum of the delayed flag (flattened names), rate % r2;
    NULL means -> 0 and a route with no flag values gets rate 0."""
    from contrail.functions.scalars import ratio_half_up
    g = flights.groupBy("origin", "dest", "origincityname", "destcityname").agg(
        F.avg("distance").alias("distance_mean"), F.avg("depdelay").alias("depdelay_mean"),
        F.count("depdel15").alias("depdel15_count"),
        F.sum(F.col("depdel15").cast("int")).cast("long").alias("depdel15_sum"))
    return g.select(
        "origin", "dest", "origincityname", "destcityname",
        F.coalesce("distance_mean", F.lit(0.0)).alias("distance_mean"),
        F.coalesce("depdelay_mean", F.lit(0.0)).alias("depdelay_mean"),
        "depdel15_count", F.coalesce("depdel15_sum", F.lit(0)).cast("long").alias("depdel15_sum"),
        F.coalesce(ratio_half_up(F.col("depdel15_sum") * 100, F.col("depdel15_count"), 2),
                   F.lit(0.0)).alias("delay_rate"))
