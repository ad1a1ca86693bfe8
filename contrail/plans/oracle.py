"""DuckDB oracle text: the bronze mapping as CTEs, mirroring sources.tables.

Every oracle statement is ``WITH <base CTEs> <query>`` over the driver's
pre-registered views. Rounding uses the same exact whole-number form as
``functions.scalars`` so both engines produce equal doubles.
"""

from __future__ import annotations

FLIGHTS_CTE = """
fl_base AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         l_discount, l_returnflag, l_linestatus, l_shipdate, p_brand, s_nationkey,
         sn.n_name AS origin, c_nationkey, cn.n_name AS dest,
         (l_returnflag = 'R' AND l_linestatus = 'F' AND MOD(l_suppkey, 4) = 0) AS voided
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey
       JOIN part ON l_partkey = p_partkey
       JOIN nation sn ON s_nationkey = sn.n_nationkey
       JOIN nation cn ON c_nationkey = cn.n_nationkey),
fl_d AS (
  SELECT *,
    CASE WHEN voided THEN NULL ELSE CAST(CAST(FLOOR(l_quantity * ROUND(l_discount * 100) / 8) AS INT)
         - 10 + CASE WHEN MOD(l_partkey, 50) = 0 THEN 200 ELSE 0 END AS DOUBLE)
         + CASE WHEN MOD(l_partkey, 4) = 1 THEN 0.5 ELSE 0.0 END END AS dep,
    CAST(CAST(FLOOR(l_extendedprice / 40) AS INT) + 100 AS DOUBLE) AS dist
  FROM fl_base),
fl_c AS (
  SELECT *, dep + CAST(MOD(l_orderkey, 21) AS DOUBLE) - 10.0 AS arr,
    FLOOR(dep * 3 / 10) AS c_car,
    CASE WHEN MOD(l_partkey, 3) = 0 THEN FLOOR(dep / 10) ELSE 0 END AS c_wx,
    FLOOR(dep * 2 / 10) AS c_nas,
    CASE WHEN MOD(l_orderkey, 50) = 0 THEN 1 ELSE 0 END AS c_sec
  FROM fl_d),
flights AS (
  SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS flight_id,
    CAST(DATE '2024-01-01' + CAST(MOD(l_orderkey * 7 + l_partkey, 366) AS INT) AS DATE) AS flightdate,
    UPPER(p_brand) AS operating_airline,
    'N' || CAST(l_suppkey AS VARCHAR) AS tail_number,
    CAST(l_linenumber AS INT) AS flight_number_operating_airline,
    CAST(s_nationkey + 10000 AS INT) AS originairportid,
    origin, origin AS origincityname,
    CAST(c_nationkey + 10000 AS INT) AS destairportid,
    dest, dest AS destcityname,
    dep AS depdelay, dep >= 15 AS depdel15, arr AS arrdelay, arr >= 15 AS arrdel15,
    CASE WHEN MOD(l_partkey, 97) = 0 THEN NULL ELSE voided END AS cancelled,
    (l_linestatus = 'F' AND MOD(l_suppkey, 25) = 0) AS diverted,
    dist AS distance,
    CAST(FLOOR(dist / 250) + 1 AS INT) AS distancegroup,
    CASE WHEN dep >= 15 THEN CAST(c_car AS DOUBLE) END AS carrierdelay,
    CASE WHEN dep >= 15 THEN CAST(c_wx AS DOUBLE) END AS weatherdelay,
    CASE WHEN dep >= 15 THEN CAST(c_nas AS DOUBLE) END AS nasdelay,
    CASE WHEN dep >= 15 THEN CAST(c_sec AS DOUBLE) END AS securitydelay,
    CASE WHEN dep >= 15 THEN CAST(dep - c_car - c_wx - c_nas - c_sec AS DOUBLE) END
      AS lateaircraftdelay,
    CAST(l_shipdate AS TIMESTAMP) AS ingested_at
  FROM fl_c)"""

WEATHER_CTE = """
wx_obs AS (
  SELECT n_name AS location_name,
    CAST(DATE '2024-01-01' + CAST(MOD(o_orderkey * 11 + o_custkey, 366) AS INT) AS DATE) AS weather_date,
    o_orderkey, o_custkey, CAST(o_orderdate AS TIMESTAMP) AS ingested_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
wx_g AS (
  SELECT location_name, weather_date, MIN(o_custkey) AS mnc, MAX(o_custkey) AS mxc,
    MIN(o_orderkey) AS mno, MAX(o_orderkey) AS mxo, COUNT(*) AS obs,
    MAX(ingested_at) AS ingested_at
  FROM wx_obs GROUP BY location_name, weather_date),
weather AS (
  SELECT location_name, weather_date,
    CAST(CAST(MOD(mnc, 45) AS INT) - 10 AS DOUBLE) AS temp,
    CAST(CAST(MOD(mnc, 45) AS INT) - 10 - MOD(mno, 7) AS DOUBLE) AS temp_min_c,
    CAST(CAST(MOD(mnc, 45) AS INT) - 10 + MOD(mxo, 9) AS DOUBLE) AS temp_max_c,
    CAST(MOD(mxc, 70) + 30 AS DOUBLE) AS relative_humidity,
    CAST(CASE WHEN MOD(mxo, 4) = 0 THEN MOD(mxo, 30) ELSE 0 END AS DOUBLE) AS precipitation_mm,
    CAST(CASE WHEN MOD(mno, 3) = 0 THEN NULL ELSE MOD(mno, 50) END AS DOUBLE) AS snow_mm,
    CAST(MOD(mxc, 60) AS DOUBLE) AS wind_speed_kmh,
    CAST(MOD(mnc + mxo, 60) + 980 AS DOUBLE) AS pressure_hpa,
    CAST(MOD(mno + mnc, 101) AS DOUBLE) AS cloud_cover,
    obs, ingested_at
  FROM wx_g)"""

COORDS_CTE = """
coords AS (
  SELECT n_name AS iata, CAST(25.0 AS DOUBLE) + n_nationkey * CAST(0.9 AS DOUBLE) AS lat,
         CAST(-122.0 AS DOUBLE) + n_regionkey * CAST(12.0 AS DOUBLE)
           + n_nationkey * CAST(0.5 AS DOUBLE) AS lon
  FROM nation WHERE MOD(n_nationkey, 7) <> 6)"""


def with_base(body: str, *, weather: bool = False, coords: bool = False,
              extra: str | None = None) -> str:
    ctes = [FLIGHTS_CTE]
    if weather:
        ctes.append(WEATHER_CTE)
    if coords:
        ctes.append(COORDS_CTE)
    if extra:
        ctes.append(extra)
    return "WITH " + ",".join(ctes) + "\n" + body


def half_up(num: str, den: str, digits: int = 2) -> str:
    """SQL text for ratio_half_up(num, den, digits): whole numbers, exact."""
    s = 10 ** digits
    n = f"CAST(({num}) AS HUGEINT)"
    d = f"CAST(({den}) AS HUGEINT)"
    mag = f"((ABS({n}) * {2 * s} + {d}) // (2 * {d}))"
    return (f"(CASE WHEN {d} > 0 THEN CAST(CASE WHEN {n} < 0 THEN -{mag} ELSE {mag} END AS DOUBLE)"
            f" / {float(s)} END)")


def avg_half_up(col: str, digits: int = 2) -> str:
    """SQL text for scalars.avg_half_up: sums in steps of 10**-6."""
    return half_up(f"SUM(CAST(ROUND({col} * 1000000) AS BIGINT))", f"COUNT({col}) * 1000000", digits)


DASH_CTE = """
dash AS (
  SELECT flight_id, flightdate, operating_airline, origin, origincityname AS origin_city,
    dest, destcityname AS dest_city, distance, depdelay,
    CAST(COALESCE(depdel15, FALSE) AS INT) AS delayed,
    COALESCE(carrierdelay, 0.0) AS carrierdelay, COALESCE(weatherdelay, 0.0) AS weatherdelay,
    COALESCE(nasdelay, 0.0) AS nasdelay, COALESCE(securitydelay, 0.0) AS securitydelay,
    COALESCE(lateaircraftdelay, 0.0) AS lateaircraftdelay,
    CAST(MONTH(flightdate) AS INT) AS month, DAYNAME(flightdate) AS day_of_week
  FROM flights WHERE cancelled = FALSE)"""

DELAYED = "SUM(CASE WHEN depdel15 = TRUE THEN 1 ELSE 0 END)"


def gold_cte() -> str:
    return f"""
gold AS (
  SELECT operating_airline, origin, dest, COUNT(*) AS total_flights,
    {avg_half_up('depdelay')} AS avg_dep_delay,
    {avg_half_up('distance', 0)} AS avg_distance,
    CAST({DELAYED} AS BIGINT) AS delayed_count,
    {half_up(DELAYED + ' * 100', 'COUNT(*)')} AS delay_rate_pct,
    {avg_half_up('carrierdelay')} AS avg_carrier_delay,
    {avg_half_up('weatherdelay')} AS avg_weather_delay,
    {avg_half_up('nasdelay')} AS avg_nas_delay
  FROM flights WHERE cancelled = FALSE OR cancelled IS NULL
  GROUP BY operating_airline, origin, dest)"""


def with_dash(body: str, **kw) -> str:
    extra = kw.pop("extra", None)
    return with_base(body, extra=DASH_CTE.strip() + ("," + extra if extra else ""), **kw)
