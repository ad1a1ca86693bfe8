from pyspark.sql import functions as F

from contrail.operators import filters as FL
from contrail.operators.windows import keep_first, latest_per_key
from tests.conftest import rows


def test_strict_and_lenient_cancel(spark):
    df = spark.createDataFrame([(1, False), (2, True), (3, None)], "id int, cancelled boolean")
    assert rows(FL.not_cancelled_strict(df), "id") == [(1,)]
    assert rows(FL.not_cancelled_lenient(df), "id") == [(1,), (3,)]


def test_keys_upper_and_all_sentinel(spark):
    df = spark.createDataFrame([("AA", "JFK", "LAX"), ("DL", "JFK", "ATL")],
                               "operating_airline string, origin string, dest string")
    assert rows(FL.by_keys(df, "aa"), "dest") == [("LAX",)]
    assert FL.by_keys(df, FL.ALL, "ALL", None).count() == 2


def test_threshold_zero_is_a_bound(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, -1.0)], "id int, v double")
    assert rows(FL.at_most(df, "v", 0), "id") == [(1,), (3,)]
    assert FL.at_most(df, "v", None).count() == 3


def test_date_range_inclusive(spark):
    df = spark.sql("SELECT explode(sequence(DATE'2024-01-30', DATE'2024-02-02')) AS flightdate")
    assert FL.date_range(df, "2024-01-31", "2024-02-01").count() == 2


def test_keep_first_and_latest_with_ties_and_nulls(spark):
    df = spark.createDataFrame(
        [("JFK", 0, "New York", 1), ("JFK", 1, "Jamaica", 2), ("JFK", 0, None, 3),
         ("LAX", 1, "LA", 4)], "iata string, side int, city string, airport_id int")
    first = keep_first(df, ["iata"], ["side", "city"])
    assert rows(first, "iata", "city") == [("JFK", "New York"), ("LAX", "LA")]
    newest = latest_per_key(df, ["iata"], ["airport_id"])
    assert rows(newest, "iata", "airport_id") == [("JFK", 3), ("LAX", 4)]


def test_airborne(spark):
    df = spark.createDataFrame([(False, 1.0, 2.0, "A"), (True, 1.0, 2.0, "B"), (False, None, 2.0, "C"),
                                (False, 1.0, 2.0, None)],
                               "on_ground boolean, latitude double, longitude double, callsign string")
    assert rows(FL.airborne(df), "callsign") == [("A",)]


def test_sample_thinning_is_exact(spark):
    import datetime as dt

    from contrail.operators.topk import sample_flights
    recs = [(i * 7 + 3, dt.date(2024, 1, 1 + i % 28), "AA", "JFK", "JFK", "LAX", "LAX",
             float(i % 30), i % 30 >= 15, False, 500.0, None, None, None, None, None)
            for i in range(3000)]
    f = spark.createDataFrame(recs, "flight_id long, flightdate date, operating_airline string, "
                              "origin string, origincityname string, dest string, "
                              "destcityname string, depdelay double, depdel15 boolean, "
                              "cancelled boolean, distance double, carrierdelay double, "
                              "weatherdelay double, nasdelay double, securitydelay double, "
                              "lateaircraftdelay double")
    thin = [r.flight_id for r in sample_flights(f, n=100, seed=9, exact=True).collect()]
    full = [r.flight_id for r in sample_flights(f, n=100, seed=9, exact=False).collect()]
    assert len(thin) == 100 and sorted(thin) == sorted(full)
