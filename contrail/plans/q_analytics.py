"""Dashboard analyses (A7-A18, O5, O6, P19) over all strictly uncancelled flights."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.functions.constants import MONTH_ABBR, WEEKDAY_ORDER
from contrail.operators import aggregates as AG
from contrail.plans.medallion import delay_summary
from contrail.plans.oracle import avg_half_up, gold_cte, half_up, with_dash
from contrail.plans.registry import register
from contrail.sources.tables import airport_coordinates, flights


def _dash(spark, sf):
    return AG.dashboard_frame(flights(spark, sf))


_MONTHS = "[" + ", ".join(f"'{m}'" for m in MONTH_ABBR) + "]"


@register("a7_monthly_trend", with_dash(f"""
SELECT month, {avg_half_up('depdelay', 1)} AS avg_delay,
  CAST(SUM(delayed) AS BIGINT) AS delayed_count, {_MONTHS}[month] AS month_name
FROM dash GROUP BY month"""))
def a7(spark, sf):
    return AG.monthly_trend(_dash(spark, sf))


@register("a8_carrier_delay_rate", with_dash(f"""
SELECT operating_airline, pct, total,
  (pct - MIN(pct) OVER ()) / (MAX(pct) OVER () - MIN(pct) OVER () + 0.01) AS score
FROM (SELECT operating_airline, {half_up('SUM(delayed) * 100', 'COUNT(delayed)', 1)} AS pct,
        COUNT(delayed) AS total FROM dash GROUP BY operating_airline)"""))
def a8(spark, sf):
    return AG.carrier_delay_rate(_dash(spark, sf))


_CAUSES = ["carrierdelay", "weatherdelay", "nasdelay", "securitydelay", "lateaircraftdelay"]


@register("a9_delay_causes_by_carrier", with_dash(f"""
SELECT operating_airline, cause, avg_minutes FROM (
  SELECT operating_airline, {', '.join(f"{avg_half_up(c, 1)} AS {c}" for c in _CAUSES)}
  FROM dash GROUP BY operating_airline)
UNPIVOT (avg_minutes FOR cause IN ({', '.join(_CAUSES)}))"""))
def a9(spark, sf):
    return AG.delay_causes_by_carrier(_dash(spark, sf))


_ROUTE_MEAN = f"""
SELECT origin, dest, {avg_half_up('depdelay', 1)} AS avg_delay
FROM dash WHERE depdelay IS NOT NULL GROUP BY origin, dest"""


@register("a10_route_mean_delay", with_dash(_ROUTE_MEAN))
def a10(spark, sf):
    return AG.route_mean_delay(_dash(spark, sf))


# the destinations of the derived flights: one airport per nation
_DESTS = [f"NATION_{i}" for i in range(25)]


@register("a10_route_pivot", with_dash(
    "SELECT origin, " + ", ".join(
        f"COALESCE(MAX(CASE WHEN dest = '{n}' THEN avg_delay END), CAST(0 AS DOUBLE)) AS \"{n}\""
        for n in _DESTS) + " FROM route_mean GROUP BY origin",
    extra="route_mean AS (" + _ROUTE_MEAN + ")"))
def a10_pivot(spark, sf):
    """Wide origin x dest matrix of mean delay, NULL -> 0; the destination
    values become the column names."""
    return AG.route_pivot(_dash(spark, sf))


_TOP20 = """
top_o AS (SELECT origin AS iata FROM dash WHERE origin IS NOT NULL GROUP BY origin
          ORDER BY COUNT(*) DESC, origin LIMIT 20),
top_d AS (SELECT dest AS iata FROM dash WHERE dest IS NOT NULL GROUP BY dest
          ORDER BY COUNT(*) DESC, dest LIMIT 20),
cand AS (SELECT iata FROM top_o UNION SELECT iata FROM top_d),
n_o AS (SELECT origin AS iata, COUNT(*) AS n FROM dash GROUP BY origin),
n_d AS (SELECT dest AS iata, COUNT(*) AS n FROM dash GROUP BY dest),
top20 AS (SELECT c.iata, COALESCE(n_o.n, 0) + COALESCE(n_d.n, 0) AS flights FROM cand c
          LEFT JOIN n_o ON c.iata = n_o.iata LEFT JOIN n_d ON c.iata = n_d.iata
          ORDER BY flights DESC, c.iata LIMIT 20)"""


@register("a11_top_airport_matrix")
def a11_matrix(spark, sf):
    """Wide matrix; which airports become columns depends on the data."""
    return AG.top_airport_matrix(_dash(spark, sf), 20)


@register("a11_named_airport_matrix", with_dash(
    "SELECT origin, " + ", ".join(f"MAX(CASE WHEN dest = '{n}' THEN avg_delay END) AS \"{n}\"" for n in _DESTS)
    + " FROM route_mean GROUP BY origin", extra=_TOP20.strip() + f""",
route_mean AS (SELECT origin, dest, {avg_half_up('depdelay', 1)} AS avg_delay FROM dash
  WHERE depdelay IS NOT NULL AND origin IN (SELECT iata FROM top20) AND dest IN (SELECT iata FROM top20)
  GROUP BY origin, dest)"""))
def a11_named(spark, sf):
    """The same matrix with every airport as a named column."""
    return AG.top_airport_matrix(_dash(spark, sf), 20, _DESTS)


@register("route_level_flag", with_dash("""
SELECT operating_airline, origin, dest, delay_rate_pct,
  CAST(CASE WHEN delay_rate_pct > 15 THEN 1 ELSE 0 END AS INT) AS delayed FROM gold""", extra=gold_cte().strip()))
def route_flag(spark, sf):
    return AG.route_level_flag(delay_summary(flights(spark, sf)))


@register("o6_top20_airports", with_dash("SELECT iata, flights FROM top20", extra=_TOP20.strip()))
def o6(spark, sf):
    return AG.top_airports(_dash(spark, sf), 20)


@register("a11_top20_route_mean_delay", with_dash(f"""
SELECT origin, dest, {avg_half_up('depdelay', 1)} AS avg_delay FROM dash
WHERE depdelay IS NOT NULL AND origin IN (SELECT iata FROM top20) AND dest IN (SELECT iata FROM top20)
GROUP BY origin, dest""", extra=_TOP20.strip()))
def a11(spark, sf):
    return AG.top_airport_routes(_dash(spark, sf), 20)


_DAYS = ", ".join(f"({i + 1}, '{d}')" for i, d in enumerate(WEEKDAY_ORDER))


@register("a12_day_of_week_delay", with_dash(f"""
SELECT cal.day_index, cal.day_of_week, {half_up('g.s', 'g.c', 1)} AS avg_delay,
  COALESCE(g.s / g.c = MAX(g.s / g.c) OVER (), FALSE) AS is_max
FROM (VALUES {_DAYS}) AS cal(day_index, day_of_week)
LEFT JOIN (SELECT day_of_week, SUM(depdelay) AS s, COUNT(depdelay) AS c FROM dash
           GROUP BY day_of_week) g ON cal.day_of_week = g.day_of_week"""))
def a12(spark, sf):
    return AG.day_of_week_delay(_dash(spark, sf), spark)


@register("a13_delay_histogram", with_dash(f"""
SELECT bin * 5 AS bin_start, flights,
  {half_up('SUM(s) OVER ()', 'SUM(flights) OVER ()', 2)} AS mean_delay
FROM (SELECT CAST(LEAST(FLOOR(d / 5), 35) AS INT) AS bin, COUNT(*) AS flights, SUM(d) AS s
      FROM (SELECT LEAST(depdelay, 180.0) AS d FROM dash WHERE depdelay > 0) GROUP BY 1)"""))
def a13(spark, sf):
    return AG.delay_histogram(_dash(spark, sf))


@register("a14_kpis", with_dash(f"""
SELECT COUNT(*) AS total_flights, CAST(COALESCE(SUM(delayed), 0) AS BIGINT) AS delayed_flights,
  {half_up('SUM(delayed) * 100', 'COUNT(*)', 1)} AS delay_rate,
  {half_up('SUM(CASE WHEN depdelay > 0 THEN depdelay END)', 'COUNT(CASE WHEN depdelay > 0 THEN depdelay END)', 1)} AS avg_dep_delay,
  COUNT(DISTINCT operating_airline) AS airlines,
  COUNT(DISTINCT CASE WHEN origin IS NOT NULL AND dest IS NOT NULL THEN origin || '|' || dest END) AS routes
FROM dash"""))
def a14(spark, sf):
    return AG.kpis(_dash(spark, sf))


@register("a15_summary_from_gold", with_dash(f"""
SELECT CAST(COALESCE(SUM(total_flights), 0) AS BIGINT) AS total_flights,
  CAST(COALESCE(SUM(delayed_count), 0) AS BIGINT) AS delayed_flights,
  COALESCE({half_up('SUM(delayed_count) * 100', 'SUM(total_flights)', 1)}, 0.0) AS delay_rate,
  COALESCE({half_up('SUM(COALESCE(ROUND(avg_dep_delay * 100), 0))', 'COUNT(*) * 100', 1)}, 0.0) AS avg_dep_delay,
  {half_up('SUM(ROUND(avg_dep_delay * 100) * total_flights)', 'SUM(CASE WHEN avg_dep_delay IS NOT NULL THEN total_flights END) * 100', 2)} AS weighted_avg_delay,
  COUNT(DISTINCT operating_airline) AS airlines, COUNT(*) AS routes
FROM gold""", extra=gold_cte().strip()))
def a15(spark, sf):
    return AG.summary_from_gold(delay_summary(flights(spark, sf)))


@register("a16_airport_stats", with_dash(f"""
SELECT g.origin, total, avg_delay, delayed, delay_rate, lat, lon,
  CAST(total AS DOUBLE) / MAX(total) OVER () * 40 + 6 AS marker_size
FROM (SELECT origin, COUNT(depdelay) AS total, {avg_half_up('depdelay', 1)} AS avg_delay,
        CAST(SUM(delayed) AS BIGINT) AS delayed,
        {half_up('SUM(delayed) * 100', 'COUNT(depdelay)', 1)} AS delay_rate
      FROM dash GROUP BY origin HAVING COUNT(depdelay) >= 5) g
JOIN coords c ON g.origin = c.iata WHERE lat IS NOT NULL AND lon IS NOT NULL""", coords=True))
def a16(spark, sf):
    return AG.airport_stats(_dash(spark, sf), airport_coordinates(spark, sf))


@register("a17_route_bubble", with_dash(f"""
SELECT origin, dest, {avg_half_up('depdelay', 1)} AS avg_delay, COUNT(depdelay) AS total,
  CAST(SUM(delayed) AS BIGINT) AS delayed,
  {half_up('SUM(delayed) * 100', 'COUNT(depdelay)', 1)} AS delay_rate,
  origin || ' → ' || dest AS route
FROM dash GROUP BY origin, dest HAVING COUNT(depdelay) >= 20
ORDER BY total DESC, origin, dest LIMIT 30"""))
def a17(spark, sf):
    return AG.route_bubble(_dash(spark, sf))


@register("o5_top_delayed_routes", with_dash(f"""
SELECT origin, dest, origin || ' → ' || dest AS route, COUNT(depdelay) AS total,
  {avg_half_up('depdelay', 1)} AS avg_delay
FROM dash GROUP BY origin, dest HAVING COUNT(depdelay) >= 5
ORDER BY SUM(depdelay) / COUNT(depdelay) DESC, origin, dest LIMIT 10"""))
def o5(spark, sf):
    return AG.top_delayed_routes(_dash(spark, sf))


_TRIPS = """
trips AS (SELECT DISTINCT operating_airline, origin, dest, day_of_week FROM dash)"""


@register("a18_trip_rates", with_dash(f"""
SELECT t.operating_airline, t.origin, t.dest, t.day_of_week, r.route_rate, r.route_avg_delay,
  r.route_avg_distance, d.day_rate, a.carrier_rate
FROM trips t
LEFT JOIN (SELECT origin, dest, {half_up('SUM(delayed) * 100', 'COUNT(delayed)', 1)} AS route_rate,
             {avg_half_up('depdelay', 1)} AS route_avg_delay, AVG(distance) AS route_avg_distance
           FROM dash GROUP BY origin, dest) r ON t.origin = r.origin AND t.dest = r.dest
LEFT JOIN (SELECT day_of_week, {half_up('SUM(delayed) * 100', 'COUNT(delayed)', 1)} AS day_rate
           FROM dash GROUP BY day_of_week) d ON t.day_of_week = d.day_of_week
LEFT JOIN (SELECT operating_airline, {half_up('SUM(delayed) * 100', 'COUNT(delayed)', 1)} AS carrier_rate
           FROM dash GROUP BY operating_airline) a ON t.operating_airline = a.operating_airline""",
                                  extra=_TRIPS.strip()))
def a18(spark, sf):
    dash = _dash(spark, sf)
    trips = dash.select("operating_airline", "origin", "dest", "day_of_week").distinct()
    return AG.trip_rates(dash, trips)


@register("p19_carrier_names", with_dash("""
SELECT operating_airline, COUNT(*) AS flights, operating_airline AS airline_name
FROM dash GROUP BY operating_airline"""))
def p19(spark, sf):
    g = _dash(spark, sf).groupBy("operating_airline").agg(F.count(F.lit(1)).alias("flights"))
    return AG.with_carrier_name(g, spark)
