import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from contrail.functions.constants import WEATHER_MEASURES
from contrail.ml import features as FT
from contrail.ml import models as M
from contrail.sources import raw as R


def test_route_models_train_predict_and_risk(spark):
    f = R.synthetic_flights(spark, 3000, seed=1).withColumn("cancelled", F.lit(False))
    data = M.route_training_frame(f)
    train, test = FT.hash_split(data, 0.2)
    assert train.count() + test.count() == data.count()
    assert train.join(test, "flight_id").count() == 0
    cls = M.route_classifier(max_iter=50).fit(train)
    reg = M.route_regressor().fit(train.where("depdelay > 0"))
    pred = M.with_probability(cls.transform(test))
    assert pred.where("delay_probability < 0 OR delay_probability > 1").count() == 0
    ev = {r["class"]: r for r in M.evaluate(pred).collect()}
    assert 0.0 <= ev[1].accuracy <= 1.0 and ev[0].support + ev[1].support == test.count()
    assert sum(r["count"] for r in M.prediction_counts(pred).collect()) == test.count()
    trips = spark.createDataFrame([("AA", "JFK", "LAX"), ("ZZ", "QQQ", "LAX")],
                                  "operating_airline string, origin string, dest string")
    rates = spark.createDataFrame([("JFK", "LAX", 40.0, 12.0, 2000.0)],
                                  "origin string, dest string, route_rate double, "
                                  "route_avg_delay double, route_avg_distance double")
    risk = {r.origin: r for r in M.trip_risk(trips, rates, cls, reg).collect()}
    assert risk["QQQ"].distance == 1000.0          # unknown route -> fallback distance
    assert risk["JFK"].risk_tier in ("LOW RISK", "MEDIUM RISK", "HIGH RISK")
    assert risk["JFK"].expected_delay_minutes >= 0
    fb = {r.origin: r for r in M.trip_risk(trips, rates, None, None).collect()}
    assert fb["JFK"].risk_probability == 0.4 and fb["QQQ"].risk_probability == 0.3
    assert fb["QQQ"].expected_delay_minutes == 20.0


def test_model_save_load_roundtrip(spark, tmp_path):
    f = R.synthetic_flights(spark, 800, seed=2).withColumn("cancelled", F.lit(False))
    data = M.route_training_frame(f)
    cls = M.route_classifier(max_iter=20).fit(data)
    M.save(cls, str(tmp_path / "m"))
    again = M.load(str(tmp_path / "m"))
    a = cls.transform(data).select("flight_id", "prediction").orderBy("flight_id").collect()
    b = again.transform(data).select("flight_id", "prediction").orderBy("flight_id").collect()
    assert a == b


def test_leakage_safe_and_oversample(spark):
    df = spark.createDataFrame([(i, i % 5 == 0, float(i), False, 1.0) for i in range(100)],
                               "flight_id long, depdel15 boolean, depdelay double, "
                               "cancelled boolean, distance double")
    safe = FT.leakage_safe(df)
    assert "depdelay" not in safe.columns and "depdel15" not in safe.columns
    assert safe.where("label = 1").count() == 20
    over = FT.oversample(safe)
    bal = {r.label: r["count"] for r in over.groupBy("label").count().collect()}
    assert bal == {0: 80, 1: 80}  # minority brought exactly to the majority's size
    copies = {r.flight_id: r["count"] for r in over.groupBy("flight_id").count().collect()}
    # originals kept once each; 60 extra copies drawn from the 20 minority rows
    assert all(copies[i] >= 1 if i % 5 == 0 else copies[i] == 1 for i in range(100))
    assert sum(copies[i] for i in range(0, 100, 5)) == 80
    w = FT.class_weights(safe)
    tot = {r.label: r.s for r in w.groupBy("label").agg(F.sum("weight").alias("s")).collect()}
    assert abs(tot[0] - tot[1]) < 1e-9


def test_explode_request(spark):
    req = spark.createDataFrame(
        [(1, [("2024-01-01", "JFK", "New York", "LAX", "Los Angeles", 2475.0, 10, 0)],
          [("2024-01-01", "New York") + (1.0,) * 5 + (None,) + (1.0,) * 3,
           ("2024-01-01", "Los Angeles") + (2.0,) * 9])],
        "request_id long, flights array<struct<flightdate:string, origin:string, "
        "origincityname:string, dest:string, destcityname:string, distance:double, "
        "distancegroup:int, diverted:int>>, weather array<struct<weather_date:string, "
        "location_name:string, temp:double, temp_min_c:double, temp_max_c:double, "
        "relative_humidity:double, precipitation_mm:double, snow_mm:double, "
        "wind_speed_kmh:double, pressure_hpa:double, cloud_cover:double>>")
    fl, wx = FT.explode_request(req)
    assert fl.count() == 1 and wx.count() == 2
    assert wx.where("snow_mm IS NULL").count() == 0
    j = M.join_request_weather(fl, wx)
    r = j.first()
    assert r.temp_o == 1.0 and r.temp_d == 2.0 and r.snow_mm_o == 0.0
    assert j.count() == 1 and r.origin == "JFK" and r.request_id == 1


def test_oversample_exact_uneven_multi_class(spark):
    # three classes of 700 / 207 / 93 rows over 7 partitions; 493 and 607
    # extra copies do not divide evenly
    df = spark.range(1000).select(
        F.col("id").alias("flight_id"),
        F.when(F.col("id") % 10 < 7, 0).when(F.col("id") % 10 < 9, 1).otherwise(2).alias("label"))
    df = df.where(~((F.col("label") == 1) & (F.col("id") % 100 < 20))
                  & ~((F.col("label") == 2) & (F.col("id") % 100 < 7))).repartition(7, "flight_id")
    sizes = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    over = FT.oversample(df)
    assert {r.label: r["count"] for r in over.groupBy("label").count().collect()} == \
        {c: max(sizes.values()) for c in sizes}
    per_row = over.groupBy("label", "flight_id").count()
    for c, n in sizes.items():
        kept = per_row.where(F.col("label") == c).agg(F.count("*"), F.min("count"), F.sum("count")).first()
        assert kept[0] == n and kept[1] >= 1 and kept[2] == max(sizes.values()), (c, kept)


def test_oversampling_draws_with_replacement_on_any_partitioning(spark):
    df = spark.range(3000).selectExpr("id", "int(id % 10 = 0) AS label", "if(id % 3 = 0, null, id % 7) AS x")
    counts = []
    for n in (1, 8):
        over = FT.oversample(df.repartition(n)).groupBy("id").count().collect()
        counts.append({r.id: r["count"] for r in over})
    assert counts[0] == counts[1] and sum(counts[0].values()) == 5400
    drawn = [counts[0][i] - 1 for i in range(0, 3000, 10)]       # 2400 draws from 300 rows
    assert sum(drawn) == 2400
    chi = sum((d - 8) ** 2 / 8 for d in drawn)                   # 299 degrees: mean 299, deviation 24.5
    assert 299 - 5 * 24.5 < chi < 299 + 5 * 24.5
    other = {r.id: r["count"] for r in FT.oversample(df, seed=1).groupBy("id").count().collect()}
    assert other != counts[0]


def test_forest_keeps_rows_nodes_and_grows_the_same_trees(spark):
    df = spark.range(600).selectExpr(
        "id AS flight_id", "int(id % 3 = 0 OR id % 7 = 1) AS label", "int(id % 2) AS diverted",
        "concat('A', id % 4) AS origin", "concat('B', id % 5) AS dest",
        *[f"double((id * {i + 3}) % {11 + i}) AS {c}" for i, c in enumerate(FT.NUMERIC_FEATURES)])
    medians = {c: 1.0 for c in FT.NUMERIC_FEATURES}
    pipeline = M.forest_classifier(num_trees=5, max_depth=6, medians=medians)
    forest = pipeline.getStages()[-1]
    assert forest.getCacheNodeIds()
    kept = pipeline.fit(df).stages[-1].toDebugString.split("\n", 1)[1]
    plain = M.forest_classifier(num_trees=5, max_depth=6, medians=medians)
    plain.getStages()[-1].setCacheNodeIds(False)
    assert plain.fit(df).stages[-1].toDebugString.split("\n", 1)[1] == kept


def test_oversampled_models_fill_by_exact_medians(spark, monkeypatch):
    """No estimator of the weather queries sorts the columns for approximate medians."""
    from pyspark.ml.feature import Imputer

    from contrail.plans import q_ml
    seen = []
    monkeypatch.setattr(q_ml, "_weather_training_data", lambda s, d: spark.range(10).selectExpr("id AS flight_id"))
    monkeypatch.setattr(q_ml, "_balanced", lambda s, d: (spark.range(8), spark.range(2)))
    monkeypatch.setattr(q_ml, "_of_known_levels", lambda train, test: test)
    monkeypatch.setattr(q_ml, "exact_medians", lambda df, cols, written=False: {c: 0.5 for c in cols})
    monkeypatch.setattr(q_ml.FT, "varied", lambda df, cols: cols)

    class Stop(Exception):
        pass

    def fit(self, df):
        seen.append([type(x) for x in self.getStages()])
        raise Stop

    monkeypatch.setattr("pyspark.ml.Pipeline.fit", fit)
    for query in (q_ml.m10, q_ml.m7_m10, q_ml.m7_m8, q_ml.m4_m8):
        try:
            query(spark, "unused")
        except Stop:
            pass
    assert len(seen) == 4 and not any(Imputer in stages for stages in seen)


def _requests(spark, rows):
    """(request_id, flights as (day, from, to), weather as (city, day, measure))."""
    measures = ", ".join(f"{m}: double" for m in WEATHER_MEASURES)
    return spark.createDataFrame(
        [(i, fl and [(d, o, o, to, to, 100.0, 1, 0) for d, o, to in fl],
          wx and [(c, d, *[x if m != "snow_mm" else None for m in WEATHER_MEASURES]) for c, d, x in wx])
         for i, fl, wx in rows],
        "request_id long, flights array<struct<flightdate: string, origin: string, origincityname: string, "
        "dest: string, destcityname: string, distance: double, distancegroup: int, diverted: int>>, "
        f"weather array<struct<location_name: string, weather_date: string, {measures}>>")


class _Constant:
    def transform(self, df):
        return df.withColumn("probability", array_to_vector(F.array(F.lit(0.25), F.lit(0.75))))


def test_requests_are_matched_without_a_shuffle(spark, monkeypatch):
    """As the join of all rows does it, also where a row lacks its weather."""
    day, own = "2024-01-01", [("X", "2024-01-01", 1.0), ("Y", "2024-01-01", 2.0)]
    rows = [(1, [(day, "X", "Y"), (day, "Y", "X"), (day, "X", "X")], own),
            (2, [(day, "X", "Y")], own[:1]), (2, [(day, "Z", "Y")], own[1:]),  # Y comes with the other row
            (2, None, own), (3, [(day, "X", "Y")], None), (3, [(None, "X", None)], own),
            (4, [(day, "X", "Y")] * 2, own * 2), (None, [(day, "X", "Y")], own), (5, [("2024-01-02", "X", "Y")], own)]
    requests = _requests(spark, rows)
    cols = ["request_id", "origin", "dest", "temp_o", "temp_d", "snow_mm_o", "snow_mm_d"]
    want = M.join_request_weather(*FT.explode_request(requests)).select(cols)
    def bag(df):
        return sorted(map(tuple, df.select(cols).collect()))

    assert len(bag(want)) == 7 and all(r[-1] == 0.0 for r in bag(want))
    assert bag(M.predict_requests(_Constant(), requests)) == bag(want)
    assert "Exchange" not in M.match_in_requests(requests)._jdf.queryExecution().toString()
    monkeypatch.setattr(M, "IN_PLACE", 4)  # the larger requests go to the join
    assert bag(M.predict_requests(_Constant(), requests)) == bag(want)
    with pytest.raises(ValueError, match="No matching"):
        M.predict_requests(_Constant(), requests.where("request_id = 5"))
