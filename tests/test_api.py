"""Every service / dashboard facade runs end to end at the smallest scale."""
from contrail.plans import api as A
from tests.conftest import SF_SMALL


def test_service_facades(spark):
    sf = SF_SMALL
    assert A.dashboard_flights(spark, sf, limit=50).count() == 50
    assert A.airlines(spark, sf).count() > 0
    assert A.origins(spark, sf, "brand#1").count() > 0
    assert A.destinations(spark, sf, origin="nation_1").count() >= 0
    gen, by_day = A.dashboard_stats(spark, sf, airline="brand#2")
    assert gen.count() == 1 and by_day.count() <= 7
    assert A.flights_page(spark, sf, limit=10, offset=5).count() == 10
    assert A.flight_stats(spark, sf).count() <= 200
    assert A.airports(spark, sf).count() == A.airport(spark, sf, "nation_0").count() * 25
    assert A.routes(spark, sf, min_flights=1, max_delay=0).count() >= 0
    nodes, edges = A.route_graph(spark, sf, limit=20, min_flights=1)
    assert edges.count() == 20 and nodes.count() > 0
    e = edges.orderBy("source", "target").first()
    pairs = spark.createDataFrame([(e.source, e.target), ("NATION_3", "NATION_3"), ("NOWHERE", e.target)],
                                  "origin string, dest string")
    got = {(r.origin, r.dest): r.hops for r in A.route_paths(spark, sf, pairs, min_flights=1).collect()}
    # a direct edge is one hop, the same airport zero hops, an unknown airport has no path
    assert got == {(e.source, e.target): 1 if e.source != e.target else 0, ("NATION_3", "NATION_3"): 0}
    assert A.live_positions(spark, sf, limit=7).count() == 7


def test_dashboard_facades(spark):
    sf = SF_SMALL
    for fn in (A.summary, A.monthly_trend, A.airline_delay, A.delay_causes, A.route_matrix,
               A.day_of_week, A.delay_distribution, A.top_routes, A.busiest_airport_matrix,
               A.busiest_routes, A.airport_map):
        assert fn(spark, sf).count() >= 0, fn.__name__
    assert A.summary(spark, sf, airline="BRAND#3", months=(3, 5)).count() == 1
    assert A.gold_summary(spark, sf).count() == 1
    trips = spark.createDataFrame([("BRAND#1", "NATION_1", "NATION_2", "Monday")],
                                  "operating_airline string, origin string, dest string, "
                                  "day_of_week string")
    r = A.trip_risk(spark, sf, trips).first()
    assert r.risk_tier in ("LOW RISK", "MEDIUM RISK", "HIGH RISK")
