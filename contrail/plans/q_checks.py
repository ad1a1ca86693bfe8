"""Sinks, encoders, and the steps after a model, each with an exact SQL twin.

Fitted numbers depend on the optimiser, so the evaluation, logging and risk
steps run here on a fixed rule in a model's place: a flight is predicted late
when its route's delay rate is ``RULE_PCT`` or more.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from contrail.functions import constants as K
from contrail.functions.scalars import oktas, ratio_half_up
from contrail.ml import features as FT
from contrail.ml import models as M
from contrail.operators import aggregates as AG
from contrail.operators import graph as G
from contrail.operators.joins import union_frames
from contrail.plans import api
from contrail.plans.oracle import avg_half_up, half_up, with_base, with_dash
from contrail.plans.registry import register
from contrail.sources import live as L
from contrail.sources import raw as R
from contrail.sources.live import prediction_log_row
from contrail.session import stored
from contrail.sources.tables import flights, weather
from contrail.streaming.live import new_run_dir

RULE_PCT = 30.0

_RULE = f"""
rr AS (SELECT origin, dest, {half_up('SUM(delayed) * 100', 'COUNT(delayed)', 1)} AS rate
       FROM dash GROUP BY origin, dest),
p AS (SELECT d.flight_id, d.delayed AS label, CASE WHEN rate >= {RULE_PCT} THEN 1 ELSE 0 END AS prediction
      FROM dash d JOIN rr ON d.origin = rr.origin AND d.dest = rr.dest)"""


def _rule_predictions(spark, sf):
    dash = AG.dashboard_frame(flights(spark, sf))
    # the routes' rates are stored: the planner sees that they are few
    rate = stored(dash.groupBy("origin", "dest").agg(
        ratio_half_up(F.sum("delayed") * 100, F.count("delayed"), 1).alias("rate")), "route-rates")
    return dash.join(rate, ["origin", "dest"]).select(
        "flight_id", F.col("delayed").alias(FT.LABEL),
        (F.col("rate") >= RULE_PCT).cast("double").alias("prediction"))


@register("a22_rule_prediction_counts", with_dash(
    "SELECT prediction, COUNT(*) AS count FROM p GROUP BY prediction", extra=_RULE.strip()))
def a22_rule(spark, sf):
    return M.prediction_counts(_rule_predictions(spark, sf))


@register("a23_rule_confusion", with_dash(
    "SELECT label, prediction, COUNT(*) AS count FROM p GROUP BY label, prediction", extra=_RULE.strip()))
def a23_rule(spark, sf):
    return M.confusion(_rule_predictions(spark, sf))


def _class_sql(k: int) -> str:
    hit = f"COUNT_IF(label = {k} AND prediction = {k})"
    said, real = f"COUNT_IF(prediction = {k})", f"COUNT_IF(label = {k})"
    return f"""
SELECT CAST(COUNT_IF(label = prediction) AS DOUBLE) / COUNT(*) AS accuracy, {k} AS class,
  CASE WHEN {said} > 0 THEN CAST({hit} AS DOUBLE) / {said} END AS precision,
  CASE WHEN {real} > 0 THEN CAST({hit} AS DOUBLE) / {real} END AS recall,
  CAST({real} AS BIGINT) AS support FROM p"""


@register("m11_rule_metrics", with_dash(f"""
SELECT accuracy, class, precision, recall,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1, support
FROM ({_class_sql(0)} UNION ALL {_class_sql(1)})""", extra=_RULE.strip()))
def m11_rule(spark, sf):
    return M.evaluate(_rule_predictions(spark, sf))


@register("s12_rule_log_row", with_dash(
    "SELECT COUNT(*) AS rows, CAST(COALESCE(SUM(prediction), 0) AS BIGINT) AS delayed_count FROM p",
    extra=_RULE.strip()))
def s12_rule(spark, sf):
    return prediction_log_row(_rule_predictions(spark, sf)).drop("predicted_at")


_TRIPS = f"""
trips AS (SELECT DISTINCT operating_airline, origin, dest, day_of_week FROM dash
          UNION ALL SELECT DISTINCT operating_airline, origin, 'NOWHERE', 'Monday' FROM dash),
rt AS (SELECT origin, dest, {half_up('SUM(delayed) * 100', 'COUNT(delayed)', 1)} AS route_rate,
         {avg_half_up('depdelay', 1)} AS route_avg_delay, AVG(distance) AS route_avg_distance
       FROM dash GROUP BY origin, dest)"""


@register("m14_trip_risk_by_rates", with_dash(f"""
SELECT operating_airline, t.origin, t.dest, day_of_week,
  COALESCE(route_rate, {K.FALLBACK_RATE_PCT}) / 100.0 AS risk_probability,
  COALESCE(route_avg_delay, {K.FALLBACK_MINUTES}) AS expected_delay_minutes,
  COALESCE(route_avg_distance, {K.FALLBACK_DISTANCE}) AS distance,
  CASE WHEN COALESCE(route_rate, {K.FALLBACK_RATE_PCT}) / 100.0 < {K.RISK_LOW_BELOW} THEN '{K.RISK_LABELS[0]}'
       WHEN COALESCE(route_rate, {K.FALLBACK_RATE_PCT}) / 100.0 < {K.RISK_MEDIUM_BELOW} THEN '{K.RISK_LABELS[1]}'
       ELSE '{K.RISK_LABELS[2]}' END AS risk_tier
FROM trips t LEFT JOIN rt ON t.origin = rt.origin AND t.dest = rt.dest""", extra=_TRIPS.strip()))
def m14_rates(spark, sf):
    """R1 without a model: route rates, and the fallbacks for unknown routes."""
    keys = ["operating_airline", "origin", "dest", "day_of_week"]
    dash = AG.dashboard_frame(flights(spark, sf))
    known = dash.select(*keys).distinct()
    unknown = dash.select("operating_airline", "origin").distinct().select(
        "operating_airline", "origin", F.lit("NOWHERE").alias("dest"), F.lit("Monday").alias("day_of_week"))
    out = api.trip_risk(spark, sf, known.union(unknown))
    return out.select(*keys, "risk_probability", "expected_delay_minutes", "distance", "risk_tier")


# ------------------------------------------------------------ features
@register("m5_label_encoding", with_base("""
SELECT flight_id,
  CAST(DENSE_RANK() OVER (ORDER BY operating_airline) - 1 AS DOUBLE) AS operating_airline_idx,
  CAST(DENSE_RANK() OVER (ORDER BY origin) - 1 AS DOUBLE) AS origin_idx,
  CAST(DENSE_RANK() OVER (ORDER BY dest) - 1 AS DOUBLE) AS dest_idx
FROM flights WHERE cancelled = FALSE AND depdelay IS NOT NULL"""))
def m5(spark, sf):
    data = M.route_training_frame(flights(spark, sf))
    cols = ["operating_airline", "origin", "dest"]
    return Pipeline(stages=FT.label_encoders(cols)).fit(data).transform(data).select(
        "flight_id", *[f"{c}_idx" for c in cols])


@register("m4_one_hot_drop_first", with_base("""
SELECT flight_id, CAST(DENSE_RANK() OVER (ORDER BY origin) - 1 AS INT) AS level
FROM flights WHERE cancelled = FALSE AND depdelay IS NOT NULL"""))
def m4(spark, sf):
    """The encoded level of each row: 0 (all slots empty) for the first one,
    the others from the place of the one (slots run backwards)."""
    data = M.route_training_frame(flights(spark, sf)).select("flight_id", "origin")
    slots = vector_to_array("origin_oh")
    coded = Pipeline(stages=FT.one_hot(["origin"], drop_first=True)).fit(data).transform(data)
    place = F.array_position(slots, 1.0)
    return coded.select("flight_id", F.when(place > 0, F.size(slots) + 1 - place).otherwise(0)
                        .cast("int").alias("level"))


@register("m3_standardised_distance", with_base("""
SELECT flight_id, ROUND((distance - AVG(distance) OVER ()) / STDDEV_SAMP(distance) OVER (), 6) AS scaled
FROM flights WHERE cancelled = FALSE AND depdelay IS NOT NULL"""))
def m3(spark, sf):
    data = M.route_training_frame(flights(spark, sf)).select("flight_id", "distance")
    out = Pipeline(stages=FT.scaled_numeric(["distance"])).fit(data).transform(data)
    return out.select("flight_id", F.round(vector_to_array("num_scaled").getItem(0), 6).alias("scaled"))


@register("oktas_of_cloud_cover", with_base(
    "SELECT location_name, weather_date, cloud_cover / 100.0 * 8 AS oktas FROM weather", weather=True))
def oktas_rows(spark, sf):
    return weather(spark, sf).select("location_name", "weather_date", oktas("cloud_cover").alias("oktas"))


# ------------------------------------------------------------ sinks, written and read back
_SINK_COLS = ["flight_id", "flightdate", "operating_airline", "origin", "dest", "depdelay"]


@register("s6_append_bronze", with_base(f"SELECT {', '.join(_SINK_COLS)} FROM flights"))
def s6(spark, sf):
    path = f"{new_run_dir(spark, 's6')}/bronze"
    f = flights(spark, sf).select(*_SINK_COLS)
    for month in (F.month("flightdate") <= 6, F.month("flightdate") > 6):
        R.append_bronze(f.where(month), path)
    return spark.read.parquet(path).select(*_SINK_COLS)


@register("s7_replace_table", with_base("SELECT DISTINCT operating_airline AS code FROM flights"))
def s7(spark, sf):
    path = f"{new_run_dir(spark, 's7')}/carriers"
    codes = flights(spark, sf).select(F.col("operating_airline").alias("code")).distinct()
    R.replace_table(codes.limit(1), path)
    R.replace_table(codes, path)
    return spark.read.parquet(path)


@register("s9_upsert_routes", with_base("""
SELECT origin, dest, CASE WHEN COUNT(*) >= 30 THEN COUNT(*) + 1000 ELSE COUNT(*) END AS flights
FROM flights GROUP BY origin, dest"""))
def s9(spark, sf):
    """Routes, upserted with the busy ones' new counts (an older and a newer row each)."""
    old = flights(spark, sf).groupBy("origin", "dest").agg(F.count(F.lit(1)).alias("flights"))
    busy = old.where("flights >= 30")
    new = busy.selectExpr("origin", "dest", "flights + 1000 AS flights").union(
        busy.selectExpr("origin", "dest", "flights + 500 AS flights"))
    return G.upsert(old, new, ["origin", "dest"], ["flights"])


_LIVE_COLS = ["icao24", "callsign", "origin_country", "longitude", "latitude", "velocity"]


@register("s11_append_live_store", """
SELECT printf('%06x', user_id) AS icao24, upper(substr(event_type, 1, 3)) || CAST(user_id AS VARCHAR) AS callsign,
  event_type AS origin_country, CAST((event_id * 37) % 3600 AS DOUBLE) / 10.0 - 180.0 AS longitude,
  CAST((event_id * 13) % 1700 AS DOUBLE) / 10.0 - 85.0 AS latitude, value AS velocity
FROM events WHERE event_id % 23 <> 0 AND event_id % 17 <> 0 AND NOT (event_type = 'signup' OR value < 1.0)""")
def s11(spark, sf):
    path = f"{new_run_dir(spark, 's11')}/live"
    live = L.live_flights(spark, sf)
    for half in (F.col("latitude") < 0, F.col("latitude") >= 0):
        L.append_live(live.where(half), path)
    return spark.read.parquet(path).select(*_LIVE_COLS)


@register("u2_union_of_frames", with_base("""
SELECT origin AS iata, COUNT(*) AS departures, CAST(NULL AS BIGINT) AS arrivals FROM flights GROUP BY origin
UNION ALL SELECT dest, NULL, COUNT(*) FROM flights GROUP BY dest"""))
def u2(spark, sf):
    f = flights(spark, sf)
    out = f.groupBy(F.col("origin").alias("iata")).agg(F.count(F.lit(1)).alias("departures"))
    back = f.groupBy(F.col("dest").alias("iata")).agg(F.count(F.lit(1)).alias("arrivals"))
    return union_frames(out, back)
