import math
import random

from pyspark.sql import functions as F

from contrail.operators import clean as C
from contrail.operators import joins as J
from contrail.sources import raw as R
from tests.conftest import rows


def _hav(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (a[0], a[1], b[0], b[1]))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def test_nearest_station_matches_brute_force(spark):
    rnd = random.Random(11)
    cities = [(f"C{i}", rnd.uniform(-80, 80), rnd.uniform(-180, 180)) for i in range(15)]
    # stations clustered in two areas so most cities need wider rings
    st = [(f"S{i:03d}", rnd.uniform(30, 50), rnd.uniform(-100, -70)) for i in range(60)] + \
         [(f"T{i:03d}", rnd.uniform(-10, 10), rnd.uniform(100, 120)) for i in range(20)]
    c_df = spark.createDataFrame(cities, "iata string, lat double, lon double")
    s_df = spark.createDataFrame(st, "station_id string, lat double, lon double")
    got = {r.iata: r.station_id for r in J.nearest_station(c_df, s_df).collect()}
    for name, la, lo in cities:
        best = min(st, key=lambda s: (_hav((la, lo), (s[1], s[2])), s[0]))
        assert got[name] == best[0], name


def test_training_join_is_inner_on_both_ends(spark):
    import datetime as dt
    d = dt.date(2024, 1, 1)
    f = spark.createDataFrame([(1, d, "AA", "A", "A", "B", "B", 100.0, 1, False, 20.0, True),
                               (2, d, "AA", "A", "A", "C", "C", 100.0, 1, False, 5.0, False)],
                              "flight_id long, flightdate date, operating_airline string, origin string,"
                              " origincityname string, dest string, destcityname string, distance double,"
                              " distancegroup int, diverted boolean, depdelay double, depdel15 boolean")
    cols = "location_name string, weather_date date, " + ", ".join(
        f"{m} double" for m in J.WEATHER_MEASURES)
    w = spark.createDataFrame([("A", d) + (1.0,) * 5 + (None,) + (1.0,) * 3,
                               ("B", d) + (2.0,) * 9], cols)
    out = J.training_join(f, w).collect()
    assert [r.flight_id for r in out] == [1]
    assert out[0].snow_mm_o == 0.0 and out[0].temp_d == 2.0


def test_cleaning_chain_on_raw_rows(spark):
    raw = spark.createDataFrame(
        [("2024-01-05", "AA ", " JFK", "New York ", "LAX", "905", "2400", "12.0", "1.00", "", "1.00", None),
         ("bad-date", "DL", "ATL", "Atlanta", "ORD", "5", "10", "3.0", "0.00", "0.00", "1.00", None),
         ("2024-01-06", "UA", None, "x", "SFO", "12345", "", "", "", "1.00", "1.00", "7")],
        "FlightDate string, `Operating_Airline ` string, Origin string, OriginCityName string, "
        "Dest string, CRSDepTime string, DepTime string, DepDelay string, DepDel15 string, "
        "Cancelled string, Flights string, DivAirportLandings string")
    out = R.clean_raw_flights(raw).collect()
    assert len(out) == 1                       # bad date and missing origin dropped
    r = out[0]
    assert (r.operating_airline, r.origin, r.origincityname) == ("AA", "JFK", "New York")
    assert r.crsdeptime == 545 and r.deptime is None
    assert r.depdelay == 12.0 and r.depdel15 is True and r.cancelled is False
    assert "flights" not in out[0].asDict() and "divairportlandings" not in out[0].asDict()


def test_sparse_constant_and_fills(spark):
    df = spark.createDataFrame([(1, None, "k", 1.0), (2, None, "k", None), (3, 5, "k", 3.0)],
                               "a int, b int, c string, x double")
    assert C.sparse_columns(df, 2) == ["b"]
    assert C.constant_columns(df) == ["c"]
    assert rows(C.fill_mean(df, ["x"]), "a", "x") == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert rows(C.fill_median(df, df, ["x"]), "a", "x") == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert C.missing_features(df, ["a", "zz"]) == ["zz"]


def test_insert_if_absent_keeps_existing(spark):
    old = spark.createDataFrame([("AA", "American")], "code string, name string")
    new = spark.createDataFrame([("AA", "Other"), ("ZZ", None)], "code string, name string")
    assert rows(R.insert_if_absent(old, new, ["code"])) == [("AA", "American"), ("ZZ", None)]


def test_generator_is_seeded(spark):
    a = R.synthetic_flights(spark, 500, seed=5)
    b = R.synthetic_flights(spark, 500, seed=5)
    assert rows(a) == rows(b)
    assert a.where("depdelay < -30 OR depdelay > 300").count() == 0
    assert a.where("depdel15 <> (depdelay > 15)").count() == 0


def test_sinks_roundtrip(spark, tmp_path):
    import datetime as dt
    df = spark.createDataFrame([(1, dt.date(2024, 3, 5), "AA"), (2, dt.date(2024, 4, 1), "DL")],
                               "flight_id long, flightdate date, operating_airline string")
    R.append_bronze(df, str(tmp_path / "bronze"))
    R.append_bronze(df, str(tmp_path / "bronze"))
    back = spark.read.parquet(str(tmp_path / "bronze"))
    assert back.count() == 4 and "ingested_at" in back.columns
    assert back.where("flight_month = 202403").count() == 2
    R.replace_table(df, str(tmp_path / "ref"))
    R.replace_table(df.limit(1), str(tmp_path / "ref"))
    assert spark.read.parquet(str(tmp_path / "ref")).count() == 1
    R.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    rep = R.profile_report(df, str(tmp_path / "profile")).first()
    assert rep.rows == 2 and rep.columns == 3
    assert J.union_frames(df, df.select("flight_id")).count() == 4


def test_generated_numbers_are_uniform_and_counter_based(spark):
    u = spark.range(20000).select(R.uniform(3, "x").alias("u"), R.uniform(4, "x").alias("v"))
    s = u.selectExpr("min(u)", "max(u)", "avg(u)", "corr(u, v)").first()
    assert 0 <= s[0] and s[1] < 1 and abs(s[2] - 0.5) < 0.01 and abs(s[3]) < 0.03
    one = R.synthetic_flights(spark, 3000, seed=5)
    wide = one.where("flight_id < 100").orderBy("flight_id").collect()
    assert wide == R.synthetic_flights(spark, 100, seed=5).coalesce(1).orderBy("flight_id").collect()
    noise = one.where("depdelay between -4 and 200").selectExpr("avg(arrdelay - depdelay)", "stddev(arrdelay - depdelay)").first()
    assert abs(noise[0]) < 0.4 and abs(noise[1] - 5) < 0.3
