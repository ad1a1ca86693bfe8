import datetime as dt

from pyspark.sql import functions as F

from contrail.operators import aggregates as AG
from contrail.plans.medallion import delay_summary, silver_flights_weather
from tests.conftest import rows

FLIGHT_SCHEMA = ("flight_id long, flightdate date, operating_airline string, origin string, "
                 "origincityname string, dest string, destcityname string, depdelay double, "
                 "depdel15 boolean, cancelled boolean, distance double, distancegroup int, "
                 "diverted boolean, carrierdelay double, weatherdelay double, nasdelay double, "
                 "securitydelay double, lateaircraftdelay double")


def flights_df(spark, recs):
    full = []
    for r in recs:
        fid, day, car, o, d, delay, canc = r
        full.append((fid, dt.date(2024, 1, day), car, o, o, d, d, delay,
                     None if delay is None else delay >= 15, canc, 1000.0, 5, False,
                     None if delay is None or delay < 15 else 1.0, None, None, None, None))
    return spark.createDataFrame(full, FLIGHT_SCHEMA)


def test_delay_summary_nulls_and_rounding(spark):
    f = flights_df(spark, [
        (1, 1, "AA", "JFK", "LAX", 10.0, False), (2, 1, "AA", "JFK", "LAX", 20.0, None),
        (3, 1, "AA", "JFK", "LAX", None, False), (4, 2, "AA", "JFK", "LAX", 0.0, True),
        (5, 2, "DL", "ATL", "ORD", 15.0, False)])
    g = {(r.operating_airline, r.origin): r for r in delay_summary(f).collect()}
    aa = g[("AA", "JFK")]
    assert aa.total_flights == 3            # cancelled row out, NULL-cancelled kept
    assert aa.avg_dep_delay == 15.0          # NULL delay ignored
    assert aa.delayed_count == 1
    assert aa.delay_rate_pct == 33.33
    assert g[("DL", "ATL")].delay_rate_pct == 100.0
    strict = delay_summary(f, rounded=False, lenient=False)
    assert strict.agg(F.sum("total_flights")).first()[0] == 3


def test_group_counts_sum_to_filtered_count(spark):
    f = flights_df(spark, [(i, 1 + i % 5, "C%d" % (i % 3), "O%d" % (i % 4), "D%d" % (i % 2),
                            float(i % 40 - 10), None if i % 7 == 0 else i % 11 == 0)
                           for i in range(200)])
    g = delay_summary(f)
    assert g.agg(F.sum("total_flights")).first()[0] == f.where("NOT coalesce(cancelled, false)").count()
    assert g.where("delay_rate_pct < 0 OR delay_rate_pct > 100").count() == 0


def test_empty_input(spark):
    f = flights_df(spark, [])
    assert delay_summary(f).count() == 0
    r = AG.general_stats(f).first()
    assert (r.total_flights, r.delay_rate, r.avg_delay_minutes) == (0, 0.0, 0.0)


def test_dashboard_frame_and_day_of_week_calendar(spark):
    f = flights_df(spark, [(1, 1, "AA", "JFK", "LAX", 10.0, False),   # Monday
                           (2, 2, "AA", "JFK", "LAX", 30.0, False),   # Tuesday
                           (3, 3, "AA", "JFK", "LAX", None, True)])
    d = AG.dashboard_frame(f)
    assert d.count() == 2
    out = AG.day_of_week_delay(d, spark).orderBy("day_index").collect()
    assert [r.day_of_week for r in out][:2] == ["Monday", "Tuesday"]
    assert len(out) == 7 and out[6].avg_delay is None
    assert [r.is_max for r in out][:3] == [False, True, False]


def test_histogram_clip_joins_last_bin(spark):
    f = flights_df(spark, [(1, 1, "A", "X", "Y", 0.0, False), (2, 1, "A", "X", "Y", 15.0, False),
                           (3, 1, "A", "X", "Y", 180.0, False), (4, 1, "A", "X", "Y", 300.0, False)])
    h = rows(AG.delay_histogram(AG.dashboard_frame(f)), "bin_start", "flights")
    assert h == [(15, 1), (175, 2)]


def test_route_bubble_and_top_routes_tiebreak(spark):
    recs = [(i, 1, "A", "X", "Y", 10.0, False) for i in range(5)] + \
           [(10 + i, 1, "A", "X", "Z", 10.0, False) for i in range(5)] + \
           [(20 + i, 1, "A", "W", "Y", 50.0, False) for i in range(4)]
    top = AG.top_delayed_routes(AG.dashboard_frame(flights_df(spark, recs)), min_flights=5, top=1)
    assert rows(top, "route") == [("X → Y",)]  # equal means: smaller route wins; 4-flight route out


def test_silver_dedupes_reloaded_weather(spark):
    f = flights_df(spark, [(1, 1, "AA", "JFK", "LAX", 10.0, False)])
    w = spark.createDataFrame(
        [("JFK", dt.date(2024, 1, 1), 1.0, 5.0, 0.0, 10.0, dt.datetime(2024, 1, 1, 1)),
         ("JFK", dt.date(2024, 1, 1), 2.0, 6.0, 0.0, 20.0, dt.datetime(2024, 1, 1, 2))],
        "location_name string, weather_date date, temp double, wind_speed_kmh double, "
        "precipitation_mm double, cloud_cover double, ingested_at timestamp")
    s = silver_flights_weather(f, w).collect()
    assert len(s) == 1 and s[0].temp_origin == 2.0 and s[0].temp_dest is None


def test_silver_null_city_matches_nothing(spark):
    f = flights_df(spark, [(1, 1, "AA", "JFK", "LAX", 10.0, False)]).withColumn(
        "origincityname", F.lit(None).cast("string"))
    w = spark.createDataFrame(
        [(None, dt.date(2024, 1, 1), 9.0, 5.0, 0.0, 10.0, dt.datetime(2024, 1, 1, 1)),
         ("LAX", dt.date(2024, 1, 1), 20.0, 6.0, 0.0, 10.0, dt.datetime(2024, 1, 1, 1))],
        "location_name string, weather_date date, temp double, wind_speed_kmh double, "
        "precipitation_mm double, cloud_cover double, ingested_at timestamp")
    s = silver_flights_weather(f, w).collect()
    assert len(s) == 1 and s[0].temp_origin is None and s[0].temp_dest == 20.0


def test_duplicates_by_digest(spark):
    rows = [("a", None, 0.0), ("a", None, -0.0), ("a", "", 0.0), ("", "a", 0.0), (None, "a", 0.0), ("a", "b", None),
            ("a", "b", None), ("a", "b", None), ("c", "d", float("nan")), ("c", "d", float("nan"))]
    df = spark.createDataFrame(rows, "x string, `a.b` string, _n double")
    for bits in (64, 2, 1):                 # few bits: rows of one digest that are no copies
        assert [tuple(r) for r in AG.duplicate_count(df, bits).collect()] == [(10, 6, 4)]
    assert [tuple(r) for r in AG.duplicate_count(df.limit(0)).collect()] == [(0, 0, 0)]
    many = spark.range(3000).selectExpr("id % 1000 AS k", "cast(id % 500 as string) AS s")
    assert [tuple(r) for r in AG.duplicate_count(many).collect()] == [(3000, 1000, 2000)]
    plan = AG.duplicate_count(many)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_d0" in plan
