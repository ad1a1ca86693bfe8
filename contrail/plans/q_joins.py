"""Training join, nearest station, station weather, weather dedupe."""

from __future__ import annotations

from contrail.functions.constants import WEATHER_MEASURES
from contrail.operators import joins as J
from contrail.plans.oracle import with_base
from contrail.plans.registry import register
from contrail.sources.tables import airport_coordinates, flights, weather, weather_observations

_W = ", ".join(WEATHER_MEASURES)
_WO = ", ".join(f"wo.{m} AS {m}_o" for m in WEATHER_MEASURES)
_WD = ", ".join(f"wd.{m} AS {m}_d" for m in WEATHER_MEASURES)
_WX = f"""
wxt AS (SELECT location_name, weather_date, {', '.join(m if m != 'snow_mm' else 'COALESCE(snow_mm, 0.0) AS snow_mm' for m in WEATHER_MEASURES)}
        FROM weather)"""


@register("j2_training_join", with_base(f"""
SELECT f.flight_id, f.flightdate, f.operating_airline, f.origin, f.origincityname, f.dest,
  f.destcityname, f.distance, f.distancegroup, f.diverted, f.depdelay, f.depdel15, {_WO}, {_WD}
FROM flights f
JOIN wxt wo ON f.flightdate = wo.weather_date AND f.origincityname = wo.location_name
JOIN wxt wd ON f.flightdate = wd.weather_date AND f.destcityname = wd.location_name""",
                                      weather=True, extra=_WX.strip()))
def j2(spark, sf):
    return J.training_join(flights(spark, sf), weather(spark, sf))


_STATIONS = """
stations AS (
  SELECT 'ST' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS station_id,
    CAST(25.0 AS DOUBLE) + n_nationkey * CAST(0.9 AS DOUBLE)
      + CAST((s_suppkey * 37) % 200 - 100 AS DOUBLE) / CAST(40.0 AS DOUBLE) AS lat,
    CAST(-122.0 AS DOUBLE) + n_regionkey * CAST(12.0 AS DOUBLE) + n_nationkey * CAST(0.5 AS DOUBLE)
      + CAST((s_suppkey * 53) % 200 - 100 AS DOUBLE) / CAST(40.0 AS DOUBLE) AS lon
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
pairs AS (
  SELECT c.iata, s.station_id, c.lat AS c_lat, c.lon AS c_lon, s.lat AS s_lat, s.lon AS s_lon,
    sqrt(pow(cos(radians(c.lat)) * cos(radians(c.lon)) - cos(radians(s.lat)) * cos(radians(s.lon)), 2)
       + pow(cos(radians(c.lat)) * sin(radians(c.lon)) - cos(radians(s.lat)) * sin(radians(s.lon)), 2)
       + pow(sin(radians(c.lat)) - sin(radians(s.lat)), 2)) AS chord
  FROM coords c, stations s),
nearest AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY iata ORDER BY chord, station_id) AS rn
                 FROM pairs) WHERE rn = 1)"""

_HAV = ("2 * 6371.0088 * asin(sqrt(pow(sin((radians(s_lat) - radians(c_lat)) / 2), 2) + "
        "cos(radians(c_lat)) * cos(radians(s_lat)) * pow(sin((radians(s_lon) - radians(c_lon)) / 2), 2)))")


@register("j6_nearest_station", with_base(f"""
SELECT iata, station_id, s_lat AS station_lat, s_lon AS station_lon, ROUND({_HAV}, 3) AS distance_km
FROM nearest""", coords=True, extra=_STATIONS.strip()))
def j6(spark, sf):
    """Brute-force oracle (every city x every station) against the blocked search."""
    return J.nearest_station(airport_coordinates(spark, sf), J.stations(spark, sf))


@register("j7_station_daily_weather", with_base(f"""
SELECT n.iata AS location, n.station_id, w.weather_date, {', '.join('w.' + m for m in WEATHER_MEASURES)}
FROM nearest n
JOIN supplier ON n.station_id = 'ST' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0')
JOIN nation na ON s_nationkey = na.n_nationkey
JOIN weather w ON w.location_name = na.n_name
WHERE w.weather_date BETWEEN DATE '2024-02-01' AND DATE '2024-04-30'""",
                                              weather=True, coords=True, extra=_STATIONS.strip()))
def j7(spark, sf):
    near = J.nearest_station(airport_coordinates(spark, sf), J.stations(spark, sf))
    return J.station_daily_weather(near, weather(spark, sf), J.stations(spark, sf), spark, sf,
                                   "2024-02-01", "2024-04-30")


@register("w3_latest_weather_observation", with_base("""
SELECT location_name, weather_date, o_orderkey, o_custkey, ingested_at FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY location_name, weather_date
                               ORDER BY ingested_at DESC, o_orderkey DESC, o_custkey DESC) AS rn
  FROM wx_obs) WHERE rn = 1""", weather=True))
def w3(spark, sf):
    return J.latest_observation(weather_observations(spark, sf))
