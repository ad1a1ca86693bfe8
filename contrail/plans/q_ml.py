"""Model training, evaluation, batch scoring and trip risk.

Model outputs depend on optimiser numerics, so these are rows-only checks
except the feature frames, which SQL reproduces exactly.
"""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from contrail.functions.constants import WEATHER_MEASURES
from contrail.ml import features as FT
from contrail.ml import models as M
from contrail.operators import aggregates as AG
from contrail.operators.clean import exact_medians, missing_features
from contrail.operators.filters import not_cancelled_strict
from contrail.operators.joins import training_join
from contrail.plans.oracle import with_base
from contrail.plans.registry import register
from contrail.sources.live import prediction_log_row
from contrail.session import session_key, stored
from contrail.sources.tables import flights, lake, weather
from contrail.streaming.live import new_run_dir

_FIT: dict = {}
_FIT_LOCK = threading.RLock()  # concurrent queries fit each model once


def _materialised(spark, sf, name, df):
    """Training input written once as Parquet into the lake: every estimator
    stage reads only its columns instead of recomputing the joins."""
    path = lake(spark, sf).once(name, lambda p: df.write.mode("overwrite").parquet(p))
    return spark.read.parquet(path)


def _route_models(spark, sf):
    """Route classifier + regressor fitted once per (session, input), saved
    and re-loaded through the model store (M12)."""
    with _FIT_LOCK:
        k = ("route", session_key(spark), lake(spark, sf).root)
        if k not in _FIT:
            data = _materialised(spark, sf, "train_route", M.route_training_frame(flights(spark, sf)))
            train, test = FT.hash_split(data, 0.2)
            cls = M.route_classifier().fit(train)
            reg = M.route_regressor().fit(train.where(F.col("depdelay") > 0))
            root = f"{lake(spark, sf).root}/models"
            M.save(cls, f"{root}/route_cls")
            M.save(reg, f"{root}/route_reg")
            _FIT[k] = (M.load(f"{root}/route_cls"), M.load(f"{root}/route_reg"), test)
        return _FIT[k]


def _weather_frame(spark, sf):
    j = training_join(not_cancelled_strict(flights(spark, sf)), weather(spark, sf))
    return FT.leakage_safe(j)


def _weather_training_data(spark, sf):
    with _FIT_LOCK:
        k = ("weather-data", session_key(spark), lake(spark, sf).root)
        if k not in _FIT:
            _FIT[k] = _materialised(spark, sf, "train_weather", _weather_frame(spark, sf))
        return _FIT[k]


def _weather_model(spark, sf):
    with _FIT_LOCK:
        k = ("weather", session_key(spark), lake(spark, sf).root)
        if k not in _FIT:
            data = _weather_training_data(spark, sf)
            train, test = FT.hash_split(data, 0.2)
            n = train.count()
            medians = exact_medians(train, FT.NUMERIC_FEATURES, written=True)
            _FIT[k] = (M.weather_classifier(n, medians=medians).fit(train), test)
        return _FIT[k]


_J2_COLS = ["flight_id", "flightdate", "origin", "origincityname", "dest",
            "destcityname", "distance", "distancegroup"]
_M1_COLS = _J2_COLS + ["diverted"] + [f"{m}_o" for m in WEATHER_MEASURES] + \
    [f"{m}_d" for m in WEATHER_MEASURES] + ["label"]
_WX = f"""
wxt AS (SELECT location_name, weather_date, {', '.join(m if m != 'snow_mm' else 'COALESCE(snow_mm, 0.0) AS snow_mm' for m in WEATHER_MEASURES)}
        FROM weather)"""


_M1_SQL = f"""
SELECT * FROM (
  SELECT {', '.join('f.' + c for c in _J2_COLS)}, CAST(f.diverted AS INT) AS diverted,
    {', '.join(f'wo.{m} AS {m}_o' for m in WEATHER_MEASURES)},
    {', '.join(f'wd.{m} AS {m}_d' for m in WEATHER_MEASURES)},
    CAST(f.depdel15 AS INT) AS label
  FROM flights f
  JOIN wxt wo ON f.flightdate = wo.weather_date AND f.origincityname = wo.location_name
  JOIN wxt wd ON f.flightdate = wd.weather_date AND f.destcityname = wd.location_name
  WHERE f.cancelled = FALSE)
WHERE {' AND '.join(c + ' IS NOT NULL' for c in _M1_COLS)}"""


@register("m1_leakage_safe_training_frame", with_base(_M1_SQL, weather=True, extra=_WX.strip()))
def m1(spark, sf):
    return _weather_frame(spark, sf)


@register("m8_route_classifier_predictions")
def m8_route(spark, sf):
    cls, _, test = _route_models(spark, sf)
    return M.with_probability(cls.transform(test)).select(
        "flight_id", "operating_airline", "origin", "dest", "label", "prediction",
        "delay_probability")


@register("m9_delay_regression_predictions")
def m9(spark, sf):
    _, reg, test = _route_models(spark, sf)
    return reg.transform(test.where(F.col("depdelay") > 0)).select(
        "flight_id", "depdelay", F.col("prediction").alias("predicted_delay"))


@register("m11_route_classifier_metrics")
def m11(spark, sf):
    cls, _, test = _route_models(spark, sf)
    return M.evaluate(cls.transform(test))


@register("a23_confusion_matrix")
def a23(spark, sf):
    cls, _, test = _route_models(spark, sf)
    return M.confusion(cls.transform(test))


@register("a22_prediction_counts")
def a22(spark, sf):
    cls, _, test = _route_models(spark, sf)
    return M.prediction_counts(cls.transform(test))


@register("m3_m4_m8_weather_classifier_metrics")
def m8_weather(spark, sf):
    model, test = _weather_model(spark, sf)
    return M.evaluate(model.transform(test))


@register("m7_oversampled_class_counts", with_base(f"""
SELECT label, (SELECT MAX(n) FROM c) AS rows FROM c""", weather=True, extra=_WX.strip() + f""",
m1 AS ({_M1_SQL.strip()}),
c AS (SELECT label, COUNT(*) AS n FROM m1 WHERE {FT.split_key_sql()} >= 0.2 GROUP BY label)"""))
def m7(spark, sf):
    train, _ = FT.hash_split(_weather_training_data(spark, sf), 0.2)
    return FT.oversample(train).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


@register("m10_forest_metrics")
def m10(spark, sf):
    train, test = FT.hash_split(_weather_training_data(spark, sf), 0.2)
    medians = exact_medians(train, FT.NUMERIC_FEATURES, written=True)
    return M.evaluate(M.forest_classifier(medians=medians).fit(train).transform(test))


def _balanced(spark, sf):
    """M7: the weather model's training rows, both classes equally many."""
    train, test = FT.hash_split(_weather_training_data(spark, sf), 0.2)
    path = lake(spark, sf).once("train_balanced", lambda p: FT.oversample(train)
                                .write.mode("overwrite").parquet(p))
    return spark.read.parquet(path), test


@register("m7_m8_oversampled_classifier_metrics")
def m7_m8(spark, sf):
    train, test = _balanced(spark, sf)
    medians = exact_medians(train, FT.NUMERIC_FEATURES, written=True)
    return M.evaluate(M.weather_classifier(train.count(), medians=medians).fit(train).transform(test))


@register("m7_m10_oversampled_forest_metrics")
def m7_m10(spark, sf):
    train, test = _balanced(spark, sf)
    medians = exact_medians(train, FT.NUMERIC_FEATURES, written=True)
    return M.evaluate(M.forest_classifier(medians=medians).fit(train).transform(test))


def _of_known_levels(train, test):
    """The test rows whose categories training has seen. The levels are stored,
    so the planner sees that they are few and shuffles no test row for them."""
    known = test
    for c in FT.CATEGORICAL_FEATURES:
        known = known.join(stored(train.select(c).distinct(), f"levels-{c}"), c, "left_semi")
    return known


@register("m4_m8_drop_first_classifier_metrics")
def m4_m8(spark, sf):
    """The encoding that leaves out the first level of each category; rows of
    levels that training has not seen cannot be scored: ``unseen_rows`` says how
    many of the test rows."""
    train, test = FT.hash_split(_weather_training_data(spark, sf), 0.2)
    known = _of_known_levels(train, test)
    model = M.weather_classifier(train.count(), drop_first=True,
                                 categoricals=FT.varied(train, FT.CATEGORICAL_FEATURES),
                                 medians=exact_medians(train, FT.NUMERIC_FEATURES, written=True)).fit(train)
    return M.evaluate(model.transform(known)).withColumn(
        "unseen_rows", F.lit(test.count() - known.count()))


def _requests(spark, sf):
    """One prediction request per uncancelled flight: the flight and the
    day's weather at both of its cities (as the API receives them)."""
    f = not_cancelled_strict(flights(spark, sf))
    w = weather(spark, sf)
    wcols = ["location_name", "weather_date", *WEATHER_MEASURES]
    wo = w.select(*[F.col(c).alias(f"o_{c}") for c in wcols])
    wd = w.select(*[F.col(c).alias(f"d_{c}") for c in wcols])
    j = (f.join(wo, (F.col("flightdate") == F.col("o_weather_date"))
                & (F.col("origincityname") == F.col("o_location_name")))
          .join(wd, (F.col("flightdate") == F.col("d_weather_date"))
                & (F.col("destcityname") == F.col("d_location_name"))))

    def wstruct(p):
        return F.struct(F.date_format(f"{p}weather_date", "yyyy-MM-dd").alias("weather_date"),
                        F.col(f"{p}location_name").alias("location_name"),
                        *[F.col(f"{p}{m}").alias(m) for m in WEATHER_MEASURES])
    return j.select(
        F.col("flight_id").alias("request_id"),
        F.array(F.struct(F.date_format("flightdate", "yyyy-MM-dd").alias("flightdate"),
                         "origin", "origincityname", "dest", "destcityname", "distance",
                         "distancegroup", F.col("diverted").cast("int").alias("diverted"))
                ).alias("flights"),
        F.array(wstruct("o_"), wstruct("d_")).alias("weather"))


@register("s16_explode_request_flights", with_base("""
SELECT f.flight_id AS request_id, strftime(f.flightdate, '%Y-%m-%d') AS flightdate, f.origin,
  f.origincityname, f.dest, f.destcityname, f.distance, f.distancegroup,
  CAST(f.diverted AS INT) AS diverted
FROM flights f
JOIN weather wo ON f.flightdate = wo.weather_date AND f.origincityname = wo.location_name
JOIN weather wd ON f.flightdate = wd.weather_date AND f.destcityname = wd.location_name
WHERE f.cancelled = FALSE""", weather=True))
def s16(spark, sf):
    return FT.explode_request(_requests(spark, sf))[0]


_REQUEST_WEATHER = ", ".join(m if m != "snow_mm" else "COALESCE(snow_mm, 0.0) AS snow_mm" for m in WEATHER_MEASURES)


@register("s16_explode_request_weather", with_base(f"""
SELECT request_id, strftime(weather_date, '%Y-%m-%d') AS weather_date, location_name, {_REQUEST_WEATHER}
FROM (SELECT f.flight_id AS request_id, UNNEST([f.origincityname, f.destcityname]) AS city, f.flightdate
  FROM flights f
  JOIN weather wo ON f.flightdate = wo.weather_date AND f.origincityname = wo.location_name
  JOIN weather wd ON f.flightdate = wd.weather_date AND f.destcityname = wd.location_name
  WHERE f.cancelled = FALSE) r
JOIN weather w ON w.weather_date = r.flightdate AND w.location_name = r.city""", weather=True))
def s16_weather(spark, sf):
    return FT.explode_request(_requests(spark, sf))[1]


@register("p25_missing_features_of_requests", with_base(f"""
SELECT feature, (SELECT COUNT(*) FROM flights f
  JOIN weather wo ON f.flightdate = wo.weather_date AND f.origincityname = wo.location_name
  JOIN weather wd ON f.flightdate = wd.weather_date AND f.destcityname = wd.location_name
  WHERE f.cancelled = FALSE) AS request_rows
FROM (VALUES {', '.join(f"('{m}_{side}')" for side in 'od' for m in WEATHER_MEASURES)}) AS t(feature)""", weather=True))
def p25(spark, sf):
    """What the requests' flights lack for the model before they meet their
    weather, and on how many rows."""
    rows = FT.explode_request(_requests(spark, sf))[0]
    missing = spark.createDataFrame([(f,) for f in missing_features(rows, FT.MODEL_FEATURES)], "feature string")
    return missing.select("feature", rows.agg(F.count(F.lit(1))).scalar().alias("request_rows"))


@register("m12_saved_model_predictions", with_base(f"""
SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS differing FROM flights
WHERE cancelled = FALSE AND depdelay IS NOT NULL AND {FT.split_key_sql()} < 0.2"""))
def m12(spark, sf):
    """Predictions of the weather-free classifier before it is saved against
    those after loading, flight by flight."""
    data = _materialised(spark, sf, "train_route", M.route_training_frame(flights(spark, sf)))
    train, test = FT.hash_split(data, 0.2)
    model = M.route_classifier(max_iter=20).fit(train)
    path = f"{new_run_dir(spark, 'm12')}/model"
    M.save(model, path)
    before, after = [M.with_probability(m.transform(test)).select(
        "flight_id", "prediction", "delay_probability", F.lit(side).alias("side"))
        for m, side in ((model, 1), (M.load(path), -1))]
    # flight ids repeat: the two bags of predictions are compared
    bags = (before.union(after).groupBy("flight_id", "prediction", "delay_probability")
            .agg(F.count_if(F.col("side") == 1).alias("n"), F.abs(F.sum("side")).alias("apart")))
    return bags.agg(F.sum("n").alias("rows"), F.sum("apart").alias("differing"))


def _batch_predictions(spark, sf):
    model, _ = _weather_model(spark, sf)
    return M.predict_requests(model, _requests(spark, sf), FT.MODEL_FEATURES)


@register("m13_batch_prediction")
def m13(spark, sf):
    return _batch_predictions(spark, sf).select(
        "request_id", "flightdate", "origin", "dest", "prediction", "delay_probability")


@register("s12_prediction_log_row")
def s12(spark, sf):
    return prediction_log_row(_batch_predictions(spark, sf)).drop("predicted_at")


@register("m14_trip_risk")
def m14(spark, sf):
    cls, reg, _ = _route_models(spark, sf)
    dash = AG.dashboard_frame(flights(spark, sf))
    trips = dash.select("operating_airline", "origin", "dest", "day_of_week").distinct()
    rated = AG.trip_rates(dash, trips)
    rates = rated.select("operating_airline", "origin", "dest", "day_of_week", "route_rate",
                         "route_avg_delay", "route_avg_distance", "day_rate", "carrier_rate")
    return M.trip_risk(trips, rates, cls, reg)
