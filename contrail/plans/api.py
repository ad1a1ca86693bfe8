"""One function per service endpoint and dashboard figure of the reference
application, each returning lazy DataFrames (nothing is collected here).

A user who called an endpoint calls the function of the same purpose with
the same arguments; the work runs on Spark over all flights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.ml import models as M
from contrail.operators import aggregates as AG
from contrail.operators import filters as FL
from contrail.operators import graph as G
from contrail.operators import sets as ST
from contrail.operators import topk as TK
from contrail.plans.medallion import delay_summary
from contrail.sources import live as L
from contrail.sources.tables import airport_coordinates, flights


# ------------------------------------------------------------ service queries
def dashboard_flights(spark: SparkSession, sf: str, airline=None, origin=None, dest=None,
                      limit: int = 100000) -> DataFrame:
    """Random sample of uncancelled flights (seeded, repeatable)."""
    return TK.sample_flights(flights(spark, sf), n=limit, airline=airline, origin=origin, dest=dest)


def airlines(spark: SparkSession, sf: str) -> DataFrame:
    return ST.distinct_carriers(flights(spark, sf))


def origins(spark: SparkSession, sf: str, airline=None) -> DataFrame:
    return ST.distinct_origins(flights(spark, sf), airline)


def destinations(spark: SparkSession, sf: str, airline=None, origin=None) -> DataFrame:
    return ST.distinct_dests(flights(spark, sf), airline, origin)


def dashboard_stats(spark: SparkSession, sf: str, airline=None, origin=None,
                    dest=None) -> tuple[DataFrame, DataFrame]:
    """(general stats row, delay by day of week with Sunday = 0)."""
    f = FL.by_keys(FL.not_cancelled_strict(flights(spark, sf)), airline, origin, dest)
    return AG.general_stats(f), AG.stats_by_day_of_week(f)


def flights_page(spark: SparkSession, sf: str, airline=None, origin=None, dest=None,
                 date_from=None, date_to=None, delayed_only: bool = False, limit: int = 100,
                 offset: int = 0, after: tuple | None = None) -> DataFrame:
    return TK.flights_page(flights(spark, sf), airline, origin, dest, date_from, date_to,
                           delayed_only, limit, offset, after)


def flight_stats(spark: SparkSession, sf: str, airline=None, origin=None,
                 limit: int = 200) -> DataFrame:
    return TK.gold_top(delay_summary(flights(spark, sf)), airline, origin, limit)


def airports(spark: SparkSession, sf: str) -> DataFrame:
    return TK.airports_sorted(ST.airport_table(flights(spark, sf)))


def airport(spark: SparkSession, sf: str, iata: str) -> DataFrame:
    """Empty result = not found."""
    return TK.airport_by_code(ST.airport_table(flights(spark, sf)), iata)


def routes(spark: SparkSession, sf: str, min_flights: int = 10,
           max_delay: float | None = None, limit: int = 500) -> DataFrame:
    return TK.busy_routes(delay_summary(flights(spark, sf)), min_flights, max_delay, limit)


def route_graph(spark: SparkSession, sf: str, limit: int = 100,
                min_flights: int | str = 10) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the busiest routes."""
    nodes, edges = G.build_graph(flights(spark, sf), min_flights)
    return G.top_edges(nodes, edges, limit)


def route_paths(spark: SparkSession, sf: str, pairs: DataFrame,
                min_flights: int | str = 10) -> DataFrame:
    """Shortest paths for a whole table of (origin, dest) pairs at once."""
    _, edges = G.build_graph(flights(spark, sf), min_flights)
    return G.shortest_paths(edges, pairs)


def live_positions(spark: SparkSession, sf: str, country: str | None = None,
                   limit: int = 50) -> DataFrame:
    return L.latest_positions(L.live_flights(spark, sf), country, limit)


def predict(model, requests: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Score a table of prediction requests (flights[] and weather[] per row)."""
    return M.predict_requests(model, requests, features)


# ------------------------------------------------------------ dashboard data
def _dash(spark, sf, airline=FL.ALL, origin=FL.ALL, months=(1, 12), delayed=False):
    f = flights(spark, sf)
    if delayed:
        f = FL.delayed_only(f)
    return AG.dashboard_frame(f).transform(FL.dashboard_filter(airline, origin, months))


def summary(spark: SparkSession, sf: str, **filters) -> DataFrame:
    return AG.kpis(_dash(spark, sf, **filters))


def monthly_trend(spark: SparkSession, sf: str, **filters) -> DataFrame:
    return AG.monthly_trend(_dash(spark, sf, **filters))


def airline_delay(spark: SparkSession, sf: str, **filters) -> DataFrame:
    return AG.with_carrier_name(AG.carrier_delay_rate(_dash(spark, sf, **filters)), spark)


def delay_causes(spark: SparkSession, sf: str, **filters) -> DataFrame:
    return AG.delay_causes_by_carrier(_dash(spark, sf, **filters))


def route_matrix(spark: SparkSession, sf: str, **filters) -> DataFrame:
    return AG.route_pivot(_dash(spark, sf, **filters))


def day_of_week(spark: SparkSession, sf: str, **filters) -> DataFrame:
    return AG.day_of_week_delay(_dash(spark, sf, **filters), spark)


def delay_distribution(spark: SparkSession, sf: str, **filters) -> DataFrame:
    return AG.delay_histogram(_dash(spark, sf, **filters))


def top_routes(spark: SparkSession, sf: str, **filters) -> DataFrame:
    return AG.top_delayed_routes(_dash(spark, sf, **filters))


def busiest_airport_matrix(spark: SparkSession, sf: str, **filters) -> DataFrame:
    return AG.top_airport_matrix(_dash(spark, sf, **filters), 20)


def busiest_routes(spark: SparkSession, sf: str, **filters) -> DataFrame:
    return AG.route_bubble(_dash(spark, sf, **filters))


def airport_map(spark: SparkSession, sf: str, **filters) -> DataFrame:
    return AG.airport_stats(_dash(spark, sf, **filters), airport_coordinates(spark, sf))


def gold_summary(spark: SparkSession, sf: str) -> DataFrame:
    return AG.summary_from_gold(delay_summary(flights(spark, sf)))


def trip_risk(spark: SparkSession, sf: str, trips: DataFrame, cls=None, reg=None) -> DataFrame:
    """Risk for a table of trips (carrier, origin, dest, day_of_week, and any
    other columns, which stay): one row per trip, repeated trips included."""
    dash = AG.dashboard_frame(flights(spark, sf))
    keys = ["operating_airline", "origin", "dest", "day_of_week"]
    rated = AG.trip_rates(dash, trips.select(*keys).distinct())
    rates = rated.select(*keys, "route_rate", "route_avg_delay", "route_avg_distance")
    return M.trip_risk(trips, rates, cls, reg)


__all__ = [n for n in dir() if not n.startswith("_") and n not in
           {"annotations", "DataFrame", "SparkSession", "F", "M", "AG", "FL", "G", "ST", "TK",
            "L", "delay_summary", "airport_coordinates", "flights"}]
