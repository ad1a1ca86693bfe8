"""Raw CSV cleaning, fills and small projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.functions import constants as K
from contrail.functions.scalars import clip
from contrail.operators import clean as C
from contrail.operators.topk import SAMPLE_PRIME, sample_key
from contrail.plans.medallion import silver_flights_weather
from contrail.plans.oracle import with_base
from contrail.plans.registry import register
from contrail.sources import raw as R
from contrail.sources.tables import flights, table, weather

_DEP_MIN = "((((flight_id * 7) % 1440) + CAST(FLOOR(depdelay) AS BIGINT)) % 1440 + 1440) % 1440"


@register("s1_clean_raw_csv", with_base(f"""
SELECT flightdate, operating_airline, tail_number, flight_number_operating_airline,
  originairportid, origin, origincityname, destairportid, dest, destcityname,
  depdelay, COALESCE(depdel15, FALSE) AS depdel15, arrdelay, COALESCE(arrdel15, FALSE) AS arrdel15,
  COALESCE(cancelled, FALSE) AS cancelled, COALESCE(diverted, FALSE) AS diverted, distance,
  distancegroup, carrierdelay, weatherdelay, nasdelay, securitydelay, lateaircraftdelay,
  CAST((flight_id * 7) % 1440 AS INT) AS crsdeptime,
  CAST(CASE WHEN depdelay IS NULL OR {_DEP_MIN} = 0 THEN NULL ELSE {_DEP_MIN} END AS INT) AS deptime
FROM flights"""))
def s1(spark, sf):
    return R.clean_raw_flights(R.read_raw_csv(spark, R.land_raw_csv(spark, sf)))


def _clock_sql(minutes: str) -> str:
    """Minutes of the day; midnight is written as 2400 and becomes NULL."""
    m = f"((({minutes}) % 1440 + 1440) % 1440)"
    return f"CAST(CASE WHEN {m} = 0 THEN NULL ELSE {m} END AS INT)"


def _group_sql(delay: str) -> str:
    return f"CASE WHEN {delay} IS NOT NULL THEN CAST(LEAST(GREATEST(FLOOR({delay} / 15), -2), 12) AS INT) END"


_PLANNED = "(CAST(FLOOR(distance / 8) AS BIGINT) + 30)"
_DEP = "((flight_id * 7) % 1440 + CAST(FLOOR(depdelay) AS BIGINT))"
_ARR = f"((flight_id * 7) % 1440 + {_PLANNED} + CAST(FLOOR(arrdelay) AS BIGINT))"
_OUT = "CASE WHEN depdelay IS NOT NULL THEN flight_id % 25 + 5 END"
_IN = "CASE WHEN arrdelay IS NOT NULL THEN flight_id % 12 + 3 END"
_ACTUAL = f"({_PLANNED} + CAST(FLOOR(arrdelay) AS BIGINT) - CAST(FLOOR(depdelay) AS BIGINT))"


@register("s1_clean_raw_csv_all_columns", with_base(f"""
SELECT flightdate, operating_airline, tail_number, flight_number_operating_airline,
  originairportid, origin, origincityname, destairportid, dest, destcityname,
  CAST((flight_id * 7) % 1440 AS INT) AS crsdeptime, {_clock_sql(_DEP)} AS deptime, depdelay,
  COALESCE(depdel15, FALSE) AS depdel15, {_group_sql('depdelay')} AS departuredelaygroups,
  CAST({_OUT} AS INT) AS taxiout, {_clock_sql(f'{_DEP} + {_OUT}')} AS wheelsoff,
  {_clock_sql(f'{_ARR} - {_IN}')} AS wheelson, CAST({_IN} AS INT) AS taxiin,
  CAST(((flight_id * 7) % 1440 + {_PLANNED}) % 1440 AS INT) AS crsarrtime, {_clock_sql(_ARR)} AS arrtime,
  arrdelay, COALESCE(arrdel15, FALSE) AS arrdel15, {_group_sql('arrdelay')} AS arrivaldelaygroups,
  COALESCE(cancelled, FALSE) AS cancelled,
  CASE WHEN cancelled THEN ['A', 'B', 'C', 'D'][flight_id % 4 + 1] END AS cancellationcode,
  COALESCE(diverted, FALSE) AS diverted, CAST({_PLANNED} AS INT) AS crselapsedtime,
  CAST({_ACTUAL} AS INT) AS actualelapsedtime, CAST({_ACTUAL} - {_OUT} - {_IN} AS INT) AS airtime,
  distance, distancegroup, carrierdelay, weatherdelay, nasdelay, securitydelay, lateaircraftdelay
FROM flights"""))
def s1_all(spark, sf):
    """The cleaning script's columns instead of the collector's."""
    return R.clean_raw_flights(R.read_raw_csv(spark, R.land_raw_csv(spark, sf)), keep=K.CLEANING_COLUMNS)


_RAW_NULLS = {  # raw column -> NULL condition on the flights it was exported from
    "FlightDate": "FALSE", "Operating_Airline ": "operating_airline IS NULL",
    "Tail_Number": "tail_number IS NULL",
    "Flight_Number_Operating_Airline": "flight_number_operating_airline IS NULL",
    "OriginAirportID": "originairportid IS NULL", "Origin": "origin IS NULL",
    "OriginCityName": "origincityname IS NULL", "DestAirportID": "destairportid IS NULL",
    "Dest": "dest IS NULL", "DestCityName": "destcityname IS NULL", "CRSDepTime": "FALSE",
    "DepTime": "depdelay IS NULL", "DepDelay": "depdelay IS NULL", "DepDel15": "depdel15 IS NULL",
    "DepartureDelayGroups": "depdelay IS NULL", "TaxiOut": "depdelay IS NULL",
    "WheelsOff": "depdelay IS NULL", "WheelsOn": "arrdelay IS NULL", "TaxiIn": "arrdelay IS NULL",
    "CRSArrTime": "FALSE", "ArrTime": "arrdelay IS NULL", "ArrivalDelayGroups": "arrdelay IS NULL",
    "CancellationCode": "cancelled IS NOT TRUE", "CRSElapsedTime": "distance IS NULL",
    "ActualElapsedTime": "depdelay IS NULL OR arrdelay IS NULL",
    "AirTime": "depdelay IS NULL OR arrdelay IS NULL",
    "ArrDelay": "arrdelay IS NULL", "ArrDel15": "arrdel15 IS NULL",
    "Cancelled": "cancelled IS NULL", "Diverted": "diverted IS NULL",
    "Distance": "distance IS NULL", "DistanceGroup": "distancegroup IS NULL",
    "CarrierDelay": "carrierdelay IS NULL", "WeatherDelay": "weatherdelay IS NULL",
    "NASDelay": "nasdelay IS NULL", "SecurityDelay": "securitydelay IS NULL",
    "LateAircraftDelay": "lateaircraftdelay IS NULL", "Flights": "FALSE",
    "DivAirportLandings": "flight_id % 1000 <> 0",
}


@register("s13_raw_csv_profile", with_base(
    "SELECT COUNT(*) AS rows, " + str(len(R.RAW_COLUMNS)) + " AS columns, "
    + ", ".join(f'CAST(COUNT_IF({cond}) AS BIGINT) AS "null_{c}"' for c, cond in _RAW_NULLS.items())
    + " FROM flights"))
def s13(spark, sf):
    return R.profile_report(R.read_raw_csv(spark, R.land_raw_csv(spark, sf)))


@register("s3_raw_csv_column_subset", with_base("""
SELECT strftime(flightdate, '%Y-%m-%d') AS FlightDate, origin AS Origin, dest AS Dest FROM flights"""))
def s3(spark, sf):
    return R.read_raw_csv(spark, R.land_raw_csv(spark, sf), ["FlightDate", "Origin", "Dest"])


_FRAC_SRC = {"Flight_Number_Operating_Airline": "flight_number_operating_airline",
             "OriginAirportID": "originairportid", "DestAirportID": "destairportid",
             "DepDelay": "depdelay", "ArrDelay": "arrdelay", "DistanceGroup": "distancegroup",
             "CarrierDelay": "carrierdelay", "WeatherDelay": "weatherdelay",
             "NASDelay": "nasdelay", "SecurityDelay": "securitydelay",
             "LateAircraftDelay": "lateaircraftdelay"}


@register("p7_fractional_values_report", with_base("SELECT " + ", ".join(
    f"CAST(COUNT_IF(CAST({src} AS DOUBLE) <> FLOOR(CAST({src} AS DOUBLE))) AS BIGINT) AS {c}"
    for c, src in _FRAC_SRC.items()) + " FROM flights"))
def p7(spark, sf):
    raw = C.strip_column_names(R.read_raw_csv(spark, R.land_raw_csv(spark, sf)))
    return C.fractional_report(raw, list(_FRAC_SRC))


_SEED = ", ".join(f"('{c}', '{n}')" for c, n in K.SEED_AIRLINES)


@register("s8_airlines_insert_if_absent", with_base(f"""
SELECT code, name FROM (VALUES {_SEED}) AS seed(code, name)
UNION ALL
SELECT code, CAST(NULL AS VARCHAR) FROM (SELECT DISTINCT operating_airline AS code FROM flights
  WHERE operating_airline IS NOT NULL)
WHERE code NOT IN (SELECT code FROM (VALUES {_SEED}) AS seed(code, name))"""))
def s8(spark, sf):
    return R.airlines_table(spark, flights(spark, sf))


_SILVER = """
silver AS (
  SELECT f.flight_id, f.operating_airline, f.origin, f.dest, wo.temp AS temp_origin,
    wd.temp AS temp_dest
  FROM flights f
  LEFT JOIN weather wo ON f.flightdate = wo.weather_date AND f.origincityname = wo.location_name
  LEFT JOIN weather wd ON f.flightdate = wd.weather_date AND f.destcityname = wd.location_name)"""


def _u(what: str) -> str:
    return R.uniform_sql(42, what)


@register("s14_synthetic_flights", f"""
WITH ap AS (SELECT list(n_name ORDER BY n_name) AS l FROM nation),
ca AS (SELECT list(b ORDER BY b) AS l FROM (SELECT DISTINCT UPPER(p_brand) AS b FROM part)),
ids AS (SELECT unnest(range((SELECT COUNT(*) FROM lineitem))) AS id),
base AS (SELECT id AS flight_id,
  CAST(DATE '2024-01-01' + CAST(FLOOR({_u('date')} * 366) AS INT) AS DATE) AS flightdate,
  ca.l[CAST(FLOOR({_u('carrier')} * len(ca.l)) AS INT) + 1] AS operating_airline,
  ap.l[CAST(FLOOR({_u('origin')} * len(ap.l)) AS INT) + 1] AS origin,
  ap.l[CAST(FLOOR({_u('dest')} * len(ap.l)) AS INT) + 1] AS dest,
  FLOOR({_u('distance')} * 2800) + 200 AS distance,
  ROUND(-LN(1.0 - {_u('delay')}) * 18 - 5, 1) + 0.0 AS dep,
  SQRT(LN(1.0 - {_u('radius')}) * -2) * COS({_u('angle')} * (2 * PI())) AS noise
  FROM ids, ap, ca)
SELECT flight_id, flightdate, operating_airline, origin, dest, distance,
  LEAST(GREATEST(dep, -30.0), 300.0) AS depdelay,
  ROUND(LEAST(GREATEST(dep + noise * 5, -60.0), 300.0), 6) + 0.0 AS arrdelay, dep > 15 AS depdel15
FROM base""")
def s14(spark, sf):
    """As many generated flights as there are lines, between the nations, by
    the brands."""
    names = [r[0] for r in table(spark, sf, "nation").select("n_name").collect()]        # 25 rows
    brands = table(spark, sf, "part").select(F.upper("p_brand")).distinct().collect()    # 25 brands
    out = R.synthetic_flights(spark, table(spark, sf, "lineitem").count(), 42, sorted(names),
                              sorted(r[0] for r in brands))
    return out.withColumn("arrdelay", F.round("arrdelay", 6))


@register("p15_fill_global_mean", with_base("""
SELECT flight_id, operating_airline, origin, dest,
  COALESCE(temp_origin, (SELECT AVG(temp_origin) FROM silver)) AS temp_origin,
  COALESCE(temp_dest, (SELECT AVG(temp_dest) FROM silver)) AS temp_dest
FROM silver""", weather=True, extra=_SILVER.strip()))
def p15(spark, sf):
    s = silver_flights_weather(flights(spark, sf), weather(spark, sf)).select(
        "flight_id", "operating_airline", "origin", "dest", "temp_origin", "temp_dest")
    return C.fill_mean(s, ["temp_origin", "temp_dest"])


_TRAIN = f"MOD(MOD(flight_id, {SAMPLE_PRIME}) * 7919 + 7, {SAMPLE_PRIME}) < {int(SAMPLE_PRIME * 0.8)}"


@register("p16_fill_train_median", with_base(f"""
SELECT flight_id, operating_airline, origin, dest,
  COALESCE(temp_origin, (SELECT quantile_cont(temp_origin, 0.5) FROM silver WHERE {_TRAIN})) AS temp_origin,
  COALESCE(temp_dest, (SELECT quantile_cont(temp_dest, 0.5) FROM silver WHERE {_TRAIN})) AS temp_dest
FROM silver""", weather=True, extra=_SILVER.strip()))
def p16(spark, sf):
    s = silver_flights_weather(flights(spark, sf), weather(spark, sf)).select(
        "flight_id", "operating_airline", "origin", "dest", "temp_origin", "temp_dest")
    train = s.where(sample_key(7) < int(SAMPLE_PRIME * 0.8))
    return C.fill_median(train, s, ["temp_origin", "temp_dest"])


_BLOCK = "distance / 7.5 + (flight_id % 999983) / 999983.0"


@register("p16_fill_continuous_median", with_base(f"""
SELECT flight_id, COALESCE(minutes, (SELECT quantile_cont(minutes, 0.5) FROM b WHERE {_TRAIN})) AS minutes,
  COALESCE(gain, (SELECT quantile_cont(gain, 0.5) FROM b WHERE {_TRAIN})) AS gain
FROM b""", extra=f"""
b AS (SELECT flight_id, CASE WHEN arrdelay IS NOT NULL THEN {_BLOCK} END AS minutes,
        (arrdelay - depdelay) * ({_BLOCK}) AS gain FROM flights)""".strip()))
def p16_continuous(spark, sf):
    """Measures with about as many distinct values as rows: block minutes, and
    the delay made up on the way weighted by them."""
    block = F.col("distance") / 7.5 + (F.col("flight_id") % 999983) / 999983.0
    f = flights(spark, sf).select(
        "flight_id", F.when(F.col("arrdelay").isNotNull(), block).alias("minutes"),
        ((F.col("arrdelay") - F.col("depdelay")) * block).alias("gain"))
    return C.fill_median(f.where(sample_key(7) < int(SAMPLE_PRIME * 0.8)), f, ["minutes", "gain"])


@register("p13_weather_provider_normalised", with_base("""
SELECT location_name, weather_date, temp, temp_min_c, temp_max_c, relative_humidity,
  precipitation_mm, snow_mm, wind_speed_kmh, pressure_hpa, cloud_cover FROM weather""",
                                                     weather=True))
def p13(spark, sf):
    """Provider-shaped frame (derived from bronze weather, sparse gust and
    sunshine columns empty) normalised back: rename, then drop the sparse ones."""
    w = weather(spark, sf)
    stored = {k: v for k, v in K.WEATHER_RENAMES.items() if v in w.columns}
    provider = (w.select("location_name", *[F.col(v).alias(k) for k, v in stored.items()])
                .withColumn("wpgt", F.lit(None).cast("double"))
                .withColumn("tsun", F.lit(None).cast("double")))
    return C.rename_columns(provider, K.WEATHER_RENAMES).drop(*K.WEATHER_DROPPED)


@register("p22_p26_delay_clip_and_date_parts", with_base("""
SELECT flight_id, LEAST(GREATEST(depdelay, -30.0), 180.0) AS depdelay_clipped,
  CAST(YEAR(flightdate) AS INT) AS year, CAST(MONTH(flightdate) AS INT) AS month,
  CAST(DAY(flightdate) AS INT) AS day
FROM flights"""))
def p22_p26(spark, sf):
    f = flights(spark, sf).select("flight_id", "depdelay",
                                  F.date_format("flightdate", "yyyy-MM-dd").alias("iso"))
    f = C.split_date(f, "iso")
    return f.select("flight_id", clip("depdelay", -30.0, 180.0).alias("depdelay_clipped"),
                    "year", "month", "day")
