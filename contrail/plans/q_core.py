"""Core queries: bronze reads, silver (J1), gold (A1/A2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.plans.medallion import delay_summary, silver_flights_weather
from contrail.plans.oracle import avg_half_up, half_up, with_base
from contrail.plans.registry import register
from contrail.sources.tables import flights, weather

_DELAYED = "SUM(CASE WHEN depdel15 = TRUE THEN 1 ELSE 0 END)"


@register("a1_delay_summary", with_base(f"""
SELECT operating_airline, origin, dest,
  COUNT(*) AS total_flights,
  {avg_half_up('depdelay')} AS avg_dep_delay,
  {avg_half_up('distance', 0)} AS avg_distance,
  CAST({_DELAYED} AS BIGINT) AS delayed_count,
  {half_up(_DELAYED + ' * 100', 'COUNT(*)')} AS delay_rate_pct,
  {avg_half_up('carrierdelay')} AS avg_carrier_delay,
  {avg_half_up('weatherdelay')} AS avg_weather_delay,
  {avg_half_up('nasdelay')} AS avg_nas_delay
FROM flights WHERE cancelled = FALSE OR cancelled IS NULL
GROUP BY operating_airline, origin, dest"""))
def a1_delay_summary(spark, sf):
    return delay_summary(flights(spark, sf))


@register("j1_silver_flights_weather", with_base("""
SELECT f.flight_id, f.flightdate, f.operating_airline, f.origin, f.origincityname,
  f.dest, f.destcityname, f.distance, f.distancegroup, f.depdelay, f.depdel15,
  f.diverted, f.carrierdelay, f.weatherdelay, f.nasdelay,
  wo.temp AS temp_origin, wo.wind_speed_kmh AS wind_origin,
  wo.precipitation_mm AS precip_origin, wo.cloud_cover AS cloud_origin,
  wd.temp AS temp_dest, wd.wind_speed_kmh AS wind_dest, wd.precipitation_mm AS precip_dest
FROM flights f
LEFT JOIN weather wo ON f.flightdate = wo.weather_date AND f.origincityname = wo.location_name
LEFT JOIN weather wd ON f.flightdate = wd.weather_date AND f.destcityname = wd.location_name""",
                                             weather=True))
def j1_silver(spark, sf):
    return silver_flights_weather(flights(spark, sf), weather(spark, sf))


# ------------------------------------------------------------------ A2
@register("a2_delay_summary_unrounded", with_base(f"""
SELECT operating_airline, origin, dest, COUNT(*) AS total_flights,
  AVG(depdelay) AS avg_dep_delay,
  CAST({_DELAYED} AS BIGINT) AS delayed_count,
  AVG(CASE WHEN depdel15 = TRUE THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100 AS delay_rate_pct,
  AVG(carrierdelay) AS avg_carrier_delay, AVG(weatherdelay) AS avg_weather_delay,
  AVG(nasdelay) AS avg_nas_delay
FROM flights WHERE cancelled = FALSE
GROUP BY operating_airline, origin, dest"""))
def a2_delay_summary_unrounded(spark, sf):
    return delay_summary(flights(spark, sf), rounded=False, lenient=False)


# ------------------------------------------------------------------ API queries
from contrail.operators import aggregates as AG  # noqa: E402
from contrail.operators import filters as FL  # noqa: E402
from contrail.operators import sets as ST  # noqa: E402
from contrail.operators import topk as TK  # noqa: E402
from contrail.plans.oracle import DELAYED, gold_cte  # noqa: E402

_RATE = f"CAST({DELAYED} AS DOUBLE) / COUNT(*) * 100"


@register("a5_dashboard_general_stats", with_base(f"""
SELECT COUNT(*) AS total_flights, COALESCE({_RATE}, 0.0) AS delay_rate,
  COALESCE(AVG(depdelay), 0.0) AS avg_delay_minutes
FROM flights WHERE cancelled = FALSE"""))
def a5_general(spark, sf):
    return AG.general_stats(FL.not_cancelled_strict(flights(spark, sf)))


@register("a5_general_stats_filtered", with_base(f"""
SELECT COUNT(*) AS total_flights, COALESCE({_RATE}, 0.0) AS delay_rate,
  COALESCE(AVG(depdelay), 0.0) AS avg_delay_minutes
FROM flights WHERE cancelled = FALSE AND operating_airline = 'BRAND#13'
  AND origin = 'NATION_3' AND dest = 'NATION_7'"""))
def a5_general_filtered(spark, sf):
    f = FL.by_keys(FL.not_cancelled_strict(flights(spark, sf)), "brand#13", "nation_3", "nation_7")
    return AG.general_stats(f)


@register("a6_stats_by_day_of_week", with_base(f"""
SELECT CAST(EXTRACT(DOW FROM flightdate) AS INT) AS day_of_week, COUNT(*) AS flights,
  {_RATE} AS delay_rate
FROM flights WHERE cancelled = FALSE GROUP BY 1"""))
def a6_by_dow(spark, sf):
    return AG.stats_by_day_of_week(FL.not_cancelled_strict(flights(spark, sf)))


_PAGE_COLS = ("flight_id, flightdate, operating_airline, origin, origincityname, dest, "
              "destcityname, depdelay, depdel15, distance")
_PAGE_ORDER = ("flightdate DESC, flight_id ASC NULLS LAST, operating_airline ASC NULLS LAST, "
               "origin ASC NULLS LAST, dest ASC NULLS LAST, distance ASC NULLS LAST, "
               "depdelay ASC NULLS LAST")


@register("o1_flights_page", with_base(f"""
SELECT {_PAGE_COLS} FROM flights WHERE cancelled = FALSE
ORDER BY {_PAGE_ORDER} LIMIT 100 OFFSET 200"""))
def o1_page(spark, sf):
    return TK.flights_page(flights(spark, sf), limit=100, offset=200)


@register("o1_flights_page_filtered", with_base(f"""
SELECT {_PAGE_COLS} FROM flights WHERE cancelled = FALSE
  AND operating_airline = 'BRAND#13' AND flightdate >= DATE '2024-03-01'
  AND flightdate <= DATE '2024-05-31' AND depdel15 = TRUE
ORDER BY {_PAGE_ORDER} LIMIT 5000"""))
def o1_page_filtered(spark, sf):
    return TK.flights_page(flights(spark, sf), airline="brand#13", date_from="2024-03-01",
                           date_to="2024-05-31", delayed=True, limit=5000)


@register("f_filtered_flights", with_base("""
SELECT flight_id, flightdate, operating_airline, origin, dest, depdelay
FROM flights WHERE cancelled = FALSE AND origin = 'NATION_3' AND dest = 'NATION_7'
  AND MONTH(flightdate) BETWEEN 6 AND 8 AND depdel15 = TRUE"""))
def f_filtered(spark, sf):
    f = FL.not_cancelled_strict(flights(spark, sf)).transform(
        FL.dashboard_filter(origin="nation_3", dest="nation_7", months=(6, 8), delayed=True))
    return f.select("flight_id", "flightdate", "operating_airline", "origin", "dest", "depdelay")


_SAMPLE_RANK = "md5('42:' || CAST(flight_id AS VARCHAR))"


@register("o2_random_sample", with_base(f"""
SELECT flight_id, flightdate, operating_airline AS airline, origin, origincityname, dest,
  destcityname, depdelay AS dep_delay, depdel15 AS dep_del15, distance, carrierdelay,
  weatherdelay, nasdelay, securitydelay, lateaircraftdelay
FROM flights WHERE cancelled = FALSE
ORDER BY {_SAMPLE_RANK}, flight_id, operating_airline, origin, dest, distance LIMIT 5000"""))
def o2_sample(spark, sf):
    return TK.sample_flights(flights(spark, sf), n=5000, seed=42)


_GOLD_TOP_COLS = ("operating_airline, origin, dest, total_flights, avg_dep_delay, delayed_count, "
                  "delay_rate_pct, avg_carrier_delay, avg_weather_delay")


@register("o3_gold_top_delay_rate", with_base(f"""
SELECT {_GOLD_TOP_COLS} FROM gold
ORDER BY delay_rate_pct DESC NULLS FIRST, operating_airline, origin, dest LIMIT 200""",
                                          extra=gold_cte().strip()))
def o3_gold_top(spark, sf):
    return TK.gold_top(delay_summary(flights(spark, sf)))


@register("o3_gold_top_for_carrier", with_base(f"""
SELECT {_GOLD_TOP_COLS} FROM gold WHERE operating_airline = 'BRAND#22'
ORDER BY delay_rate_pct DESC NULLS FIRST, operating_airline, origin, dest LIMIT 200""",
                                           extra=gold_cte().strip()))
def o3_gold_top_carrier(spark, sf):
    return TK.gold_top(delay_summary(flights(spark, sf)), airline="brand#22")


@register("o4_busy_routes", with_base("""
SELECT origin, dest, total_flights, avg_dep_delay, delay_rate_pct, avg_distance, operating_airline
FROM gold WHERE total_flights >= 3 AND avg_dep_delay <= 0
ORDER BY total_flights DESC, origin, dest, operating_airline LIMIT 500""",
                                  extra=gold_cte().strip()))
def o4_routes(spark, sf):
    # max_delay = 0 is a real bound here (the reference's truthiness test ignored it)
    return TK.busy_routes(delay_summary(flights(spark, sf)), min_flights=3, max_delay=0.0)


# ------------------------------------------------------------------ sets
_AIRPORTS_SQL = """
ap_u AS (
  SELECT DISTINCT * FROM (
    SELECT origin AS iata, origincityname AS city, originairportid AS airport_id, 0 AS side FROM flights
    UNION ALL
    SELECT dest, destcityname, destairportid, 1 FROM flights) WHERE iata IS NOT NULL),
airports AS (
  SELECT iata, airport_id, city, 'United States' AS country FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY iata ORDER BY side, city NULLS LAST,
      airport_id NULLS LAST) AS rn FROM ap_u) WHERE rn = 1)"""


@register("u1_airport_table", with_base("SELECT * FROM airports", extra=_AIRPORTS_SQL.strip()))
def u1_airports(spark, sf):
    return ST.airport_table(flights(spark, sf))


@register("o10_airports_sorted", with_base("SELECT * FROM airports ORDER BY iata",
                                           extra=_AIRPORTS_SQL.strip()))
def o10_airports(spark, sf):
    return TK.airports_sorted(ST.airport_table(flights(spark, sf)))


@register("o10_airport_by_code", with_base("SELECT * FROM airports WHERE iata = 'NATION_12'",
                                           extra=_AIRPORTS_SQL.strip()))
def o10_airport(spark, sf):
    return TK.airport_by_code(ST.airport_table(flights(spark, sf)), "nation_12")


@register("u3_distinct_carriers", with_base("""
SELECT DISTINCT operating_airline AS airline FROM flights
WHERE operating_airline IS NOT NULL ORDER BY airline"""))
def u3(spark, sf):
    return ST.distinct_carriers(flights(spark, sf))


@register("u4_distinct_origins_for_carrier", with_base("""
SELECT DISTINCT origin FROM flights WHERE operating_airline = 'BRAND#5'
  AND origin IS NOT NULL ORDER BY origin"""))
def u4(spark, sf):
    return ST.distinct_origins(flights(spark, sf), "brand#5")


@register("u5_distinct_dests", with_base("""
SELECT DISTINCT dest FROM flights WHERE operating_airline = 'BRAND#5' AND origin = 'NATION_9'
  AND dest IS NOT NULL ORDER BY dest"""))
def u5(spark, sf):
    return ST.distinct_dests(flights(spark, sf), "brand#5", "nation_9")


@register("u6_city_sets_compare", with_base("""
SELECT o AS origin_only, d AS dest_only, (o = 0 AND d = 0) AS same_set FROM (
 SELECT (SELECT COUNT(*) FROM (SELECT origincityname FROM flights WHERE origincityname IS NOT NULL
          EXCEPT SELECT destcityname FROM flights WHERE destcityname IS NOT NULL)) AS o,
        (SELECT COUNT(*) FROM (SELECT destcityname FROM flights WHERE destcityname IS NOT NULL
          EXCEPT SELECT origincityname FROM flights WHERE origincityname IS NOT NULL)) AS d)"""))
def u6(spark, sf):
    return ST.city_sets_compare(flights(spark, sf))


@register("u7_distinct_cities", with_base("""
SELECT city FROM (SELECT origincityname AS city FROM flights UNION
                  SELECT destcityname FROM flights) WHERE city IS NOT NULL ORDER BY city"""))
def u7(spark, sf):
    return ST.distinct_cities(flights(spark, sf))


@register("u8_airport_codes", with_base("""
SELECT iata FROM (SELECT origin AS iata FROM flights UNION SELECT dest FROM flights)
WHERE iata IS NOT NULL"""))
def u8(spark, sf):
    return ST.airport_codes(flights(spark, sf))


# ------------------------------------------------------------------ checks
_BRONZE_COLS = ["flight_id", "flightdate", "operating_airline", "tail_number",
                "flight_number_operating_airline", "originairportid", "origin", "origincityname",
                "destairportid", "dest", "destcityname", "depdelay", "depdel15", "arrdelay",
                "arrdel15", "cancelled", "diverted", "distance", "distancegroup", "carrierdelay",
                "weatherdelay", "nasdelay", "securitydelay", "lateaircraftdelay", "ingested_at"]


@register("a19_null_counts", with_base("SELECT " + ", ".join(
    f"CAST(COUNT_IF({c} IS NULL) AS BIGINT) AS null_{c}" for c in _BRONZE_COLS) + " FROM flights"))
def a19(spark, sf):
    return AG.null_counts(flights(spark, sf).select(*_BRONZE_COLS))


@register("a20_duplicate_rows", with_base("""
SELECT COUNT(*) AS rows, (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM flights)) AS distinct_rows,
  COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM flights)) AS duplicate_rows
FROM flights"""))
def a20(spark, sf):
    return AG.duplicate_count(flights(spark, sf).select(*_BRONZE_COLS))


@register("a21_carrier_value_counts", with_base("""
SELECT operating_airline, COUNT(*) AS count,
  CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () AS share
FROM flights WHERE operating_airline IS NOT NULL GROUP BY operating_airline"""))
def a21(spark, sf):
    return AG.value_counts(flights(spark, sf), "operating_airline")


@register("a24_row_counts", with_base("""
SELECT (SELECT COUNT(*) FROM flights) AS flights, (SELECT COUNT(*) FROM weather) AS weather""",
                                     weather=True))
def a24(spark, sf):
    f = flights(spark, sf).agg(F.count(F.lit(1)).alias("flights"))
    w = weather(spark, sf).agg(F.count(F.lit(1)).alias("weather"))
    both = (f.select("flights", F.lit(None).cast("long").alias("weather"))
            .unionByName(w.select(F.lit(None).cast("long").alias("flights"), "weather")))
    return both.agg(F.max("flights").alias("flights"), F.max("weather").alias("weather"))


# ------------------------------------------------------------------ sources
@register("s4_bronze_flights", with_base("SELECT " + ", ".join(_BRONZE_COLS) + " FROM flights"))
def s4(spark, sf):
    """The materialised bronze table read back (written once into the lake)."""
    return flights(spark, sf).select(*_BRONZE_COLS)


@register("s4_bronze_weather", with_base("""
SELECT location_name, weather_date, temp, temp_min_c, temp_max_c, relative_humidity,
  precipitation_mm, snow_mm, wind_speed_kmh, pressure_hpa, cloud_cover, obs, ingested_at
FROM weather""", weather=True))
def s4_weather(spark, sf):
    return weather(spark, sf)


@register("s2_bounded_read", with_base(f"""
SELECT {_PAGE_COLS} FROM flights
ORDER BY flight_id, operating_airline, origin, dest, distance, depdelay NULLS LAST, flightdate
LIMIT 1000"""))
def s2(spark, sf):
    from contrail.sources.raw import bounded
    return bounded(flights(spark, sf).select(*TK.PAGE_COLUMNS), 1000,
                   ["flight_id", "operating_airline", "origin", "dest", "distance",
                    F.asc_nulls_last("depdelay"), "flightdate"])


@register("s15_gold_through_sql_views", with_base(f"""
SELECT operating_airline, origin, dest, total_flights, delay_rate_pct FROM gold
WHERE origin = 'NATION_4' AND total_flights >= 5""", extra=gold_cte().strip()))
def s15(spark, sf):
    """Layers registered as views, queried with Spark SQL; the origin
    predicate is pushed below the aggregate into the bronze scan."""
    from contrail.plans.medallion import register_layers
    register_layers(spark, sf)
    return spark.sql("""SELECT operating_airline, origin, dest, total_flights, delay_rate_pct
                        FROM gold_delay_summary WHERE origin = 'NATION_4' AND total_flights >= 5""")
