"""Delay models: train, evaluate, save/load, batch scoring, trip risk.

Training runs as Spark ML estimators: executors compute gradient and
summary statistics over their partitions, the driver only iterates the
optimiser on the aggregated vectors. Scoring is ``PipelineModel.transform``
- a per-row projection inside the executors.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions import constants as K
from contrail.functions.scalars import risk_tier
from contrail.ml import features as FT
from contrail.operators.clean import require_features
from contrail.session import stored


# flights x weather rows up to which a request is matched row by row
IN_PLACE = 4096


def route_classifier(max_iter: int = 1000) -> Pipeline:
    """M8 (dashboard model): delayed yes/no from encoded carrier, origin,
    dest and distance."""
    return Pipeline(stages=FT.route_feature_stages() + [
        LogisticRegression(featuresCol="features", labelCol=FT.LABEL, maxIter=max_iter, tol=1e-4)])


def route_regressor() -> Pipeline:
    """M9: expected delay minutes (fit on positive delays only)."""
    return Pipeline(stages=FT.route_feature_stages() + [
        LinearRegression(featuresCol="features", labelCol="depdelay", regParam=0.0)])


def weather_classifier(n_train: int | None = None, max_iter: int = 400,
                       drop_first: bool = False, categoricals: list[str] | None = None,
                       medians: dict[str, float] | None = None) -> Pipeline:
    """M3 + M4 + M8 (notebook model): imputed, scaled weather numerics and
    one-hot categoricals. A C=1 L2 penalty on the summed loss equals
    ``regParam = 1 / n`` on Spark's mean loss; tol 1e-4 as scikit-learn's.

    By default every level is kept and unseen levels get their own slot, so
    scoring never fails on an airport the training split did not contain
    (the same fitted space as dropping the first level, up to the penalty).
    ``drop_first=True`` reproduces the reference's encoding exactly,
    including its error on unseen levels; ``categoricals`` are then the columns
    that vary. ``medians`` fill missing numerics (see ``scaled_numeric``)."""
    reg = 1.0 / n_train if n_train else 0.0
    return Pipeline(stages=FT.weather_feature_stages(drop_first, categoricals, medians) + [
        LogisticRegression(featuresCol="features", labelCol=FT.LABEL, maxIter=max_iter,
                           regParam=reg, elasticNetParam=0.0, standardization=False, tol=1e-4)])


def forest_classifier(num_trees: int = 100, max_depth: int = 12, seed: int = 42,
                      medians: dict[str, float] | None = None) -> Pipeline:
    """Random forest on the weather features: 100 trees, the library
    default of the model this mirrors. That one grows its trees out; here
    ``max_depth`` states the depth (Spark allows 30 at most). ``medians`` as in
    ``weather_classifier``.

    Each row's node in every tree is kept from level to level (4 bytes a tree
    and row, on disk where memory is full), so no level walks the trees from
    their roots; the lineage is as long as the trees are deep, so it is not cut."""
    return Pipeline(stages=FT.weather_feature_stages(False, medians=medians) + [
        RandomForestClassifier(featuresCol="features", labelCol=FT.LABEL, numTrees=num_trees,
                               maxDepth=max_depth, seed=seed, cacheNodeIds=True, checkpointInterval=-1)])


def route_training_frame(flights: DataFrame) -> DataFrame:
    """Training rows for the route models: uncancelled, delay known."""
    return (flights.where(F.col("cancelled") == F.lit(False)).where(F.col("depdelay").isNotNull())
                   .select("flight_id", "operating_airline", "origin", "dest", "distance", "depdelay",
                           F.coalesce(F.col("depdel15"), F.lit(False)).cast("int").alias(FT.LABEL)))


def with_probability(pred: DataFrame) -> DataFrame:
    """P(delayed) as a plain column."""
    return pred.withColumn("delay_probability", vector_to_array("probability").getItem(1))


def confusion(pred: DataFrame, label: str = FT.LABEL, prediction: str = "prediction") -> DataFrame:
    """Counts per (label, prediction)."""
    return (pred.groupBy(F.col(label).cast("int").alias("label"),
                         F.col(prediction).cast("int").alias("prediction"))
                .agg(F.count(F.lit(1)).alias("count")))


def evaluate(pred: DataFrame, label: str = FT.LABEL, prediction: str = "prediction") -> DataFrame:
    """Accuracy and per-class precision / recall / F1 / support, from one
    aggregation of the confusion counts (no driver loop)."""
    y = F.col(label).cast("int")
    p = F.col(prediction).cast("int")
    c = pred.agg(F.count(F.lit(1)).alias("n"),
                 F.count_if((y == 1) & (p == 1)).alias("tp"),
                 F.count_if((y == 0) & (p == 1)).alias("fp"),
                 F.count_if((y == 1) & (p == 0)).alias("fn"),
                 F.count_if((y == 0) & (p == 0)).alias("tn"))

    def cls(k, tp, fp, fn):
        prec = F.try_divide(F.col(tp).cast("double"), F.col(tp) + F.col(fp))
        rec = F.try_divide(F.col(tp).cast("double"), F.col(tp) + F.col(fn))
        return F.struct(F.lit(k).alias("class"), prec.alias("precision"), rec.alias("recall"),
                        F.try_divide(2 * prec * rec, prec + rec).alias("f1"),
                        (F.col(tp) + F.col(fn)).alias("support"))
    rows = c.select(((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"),
                    F.explode(F.array(cls(0, "tn", "fn", "fp"), cls(1, "tp", "fp", "fn"))).alias("m"))
    return rows.select("accuracy", "m.*")


def prediction_counts(pred: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Rows per predicted class."""
    return pred.groupBy(F.col(prediction).cast("int").alias("prediction")).agg(
        F.count(F.lit(1)).alias("count"))


def save(model: PipelineModel, path: str) -> None:
    """M12."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """M12."""
    return PipelineModel.load(path)


def join_request_weather(flights: DataFrame, weather: DataFrame, key: str = "request_id") -> DataFrame:
    """J2 across two exploded request tables: a flight meets the weather rows
    of its own request at its origin and destination city on its date
    (inner; identical weather rows count once). The keys hold the city and
    the day, so one large request spreads over many tasks."""
    ms = K.WEATHER_MEASURES
    # one row per (request, city, day): a self-route request lists its city twice
    w = weather.select(key, "location_name", "weather_date", *ms).dropDuplicates(
        [key, "location_name", "weather_date"])
    wo = w.select(F.col(key).alias("_ko"), F.col("location_name").alias("_lo"),
                  F.col("weather_date").alias("_do"), *[F.col(m).alias(f"{m}_o") for m in ms])
    wd = w.select(F.col(key).alias("_kd"), F.col("location_name").alias("_ld"),
                  F.col("weather_date").alias("_dd"), *[F.col(m).alias(f"{m}_d") for m in ms])
    j = (flights.join(wo, (F.col(key) == F.col("_ko")) & (F.col("flightdate") == F.col("_do"))
                      & (F.col("origincityname") == F.col("_lo")))
                .join(wd, (F.col(key) == F.col("_kd")) & (F.col("flightdate") == F.col("_dd"))
                      & (F.col("destcityname") == F.col("_ld"))))
    return j.drop("_ko", "_lo", "_do", "_kd", "_ld", "_dd")


def match_in_requests(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """A row per flight of a request: the flight, the weather of its own request
    row at both ends (as ``join_request_weather`` names it, the first of equal
    keys) and ``found``: both are there. Nothing is shuffled. Rows whose arrays
    make more than ``IN_PLACE`` pairs are left to the join: nothing is found."""
    ms = K.WEATHER_MEASURES
    small = F.size("flights").cast("long") * F.size("weather") <= IN_PLACE
    rows = requests.where(F.col(key).isNotNull()).select(
        key, F.when(small, F.col("weather")).alias("_wx"), F.inline("flights"))

    def at(city):
        return F.get(F.filter("_wx", lambda w: (w["weather_date"] == F.col("flightdate"))
                              & (w["location_name"] == F.col(city))), F.lit(0))
    rows = rows.withColumns({"_wo": at("origincityname"), "_wd": at("destcityname")})
    sides = [(p, m) for p in "od" for m in ms]
    return rows.select(
        *[c for c in rows.columns if c not in ("_wx", "_wo", "_wd")],
        *[F.col(f"_w{p}").getField(m).alias(f"{m}_{p}") for p, m in sides],
        (F.col("_wo").isNotNull() & F.col("_wd").isNotNull()).alias("found"),
    ).fillna(0.0, subset=["snow_mm_o", "snow_mm_d"])


def predict_requests(model: PipelineModel, requests: DataFrame,
                     features: list[str] | None = None) -> DataFrame:
    """Match each request's flights to its weather (S16 and the keyed
    join), check features (P25), class and probability per flight. Raises when
    nothing matches.

    A request row mostly brings its flights' weather along, so it is matched
    where it is and the rows are stored once. Only flights that lack weather
    there are joined with the weather of all rows of their request."""
    rows = stored(match_in_requests(requests), "matched")
    measures = [f"{m}_{p}" for p in "od" for m in K.WEATHER_MEASURES]
    j = rows.where("found").drop("found")
    rest = rows.where("NOT found").drop("found", *measures)
    if not rest.isEmpty():
        weather = FT.explode_request(requests)[1].join(
            stored(rest.select("request_id").distinct(), "unmatched"), "request_id", "left_semi")
        j = j.unionByName(stored(join_request_weather(rest, weather), "joined"))
    j = FT.bools_to_int(j)
    if features:
        require_features(j, features)
    if j.isEmpty():
        raise ValueError("No matching flight+weather data after merge")
    return with_probability(model.transform(j))


def trip_risk(trips: DataFrame, rates: DataFrame, cls: PipelineModel | None,
              reg: PipelineModel | None) -> DataFrame:
    """M14 + R1 for a table of trips (carrier, origin, dest, ...).

    ``rates`` carries route_rate, route_avg_delay, route_avg_distance (A18).
    Probability from the classifier, else route rate (or 30 %) / 100;
    expected minutes = max(0, regression), else route mean (or 20); distance
    falls back to 1000. Unknown codes get the encoders' extra index.
    """
    keys = [c for c in ("operating_airline", "origin", "dest", "day_of_week")
            if c in trips.columns and c in rates.columns]
    # one rate row per key, so repeated trips keep their own rows and no more
    t = trips.join(rates.dropDuplicates(keys), keys, "left")
    t = t.withColumn("distance", F.coalesce(F.col("route_avg_distance"),
                                            F.lit(K.FALLBACK_DISTANCE)))
    fallback_p = F.coalesce(F.col("route_rate"), F.lit(K.FALLBACK_RATE_PCT)) / 100.0
    fallback_m = F.coalesce(F.col("route_avg_delay"), F.lit(K.FALLBACK_MINUTES))
    if cls is not None:
        t = with_probability(cls.transform(t)).drop("features", "rawPrediction", "probability",
                                                    "prediction",
                                                    *[f"{c}_idx" for c in FT.ROUTE_FEATURES])
    else:
        t = t.withColumn("delay_probability", F.lit(None).cast("double"))
    if reg is not None:
        t = reg.transform(t).withColumnRenamed("prediction", "_reg").drop(
            "features", *[f"{c}_idx" for c in FT.ROUTE_FEATURES])
    else:
        t = t.withColumn("_reg", F.lit(None).cast("double"))
    prob = F.coalesce(F.col("delay_probability"), fallback_p)
    # greatest() skips NULLs, so guard it or the fallback would never apply
    reg_minutes = F.when(F.col("_reg").isNotNull(), F.greatest(F.lit(0.0), F.col("_reg")))
    minutes = F.coalesce(reg_minutes, fallback_m)
    return (t.withColumn("risk_probability", prob)
             .withColumn("expected_delay_minutes", minutes)
             .withColumn("risk_tier", risk_tier(prob))
             .drop("_reg", "delay_probability"))
