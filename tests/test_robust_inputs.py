"""Inputs the derived tables never show: fractions, NULL keys, reloads,
repeated trips, malformed states, one-day files, changed inputs."""
import datetime as dt
import json
import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from contrail.functions import constants as K
from contrail.functions import scalars as S
from contrail.operators import aggregates as AG
from contrail.operators import clean as C
from contrail.operators import joins as J
from contrail.operators import topk as TK
from contrail.plans import api
from contrail.sources import live as L
from contrail.sources import raw as R
from contrail.sources import tables as T
from contrail.streaming import live as ST
from tests.conftest import SF_SMALL, rows

CLEAN = [c.lower() for c in K.COLLECTOR_COLUMNS] + ["crsdeptime", "deptime"]


def _raw(spark, n, **fixed):
    base = {"FlightDate": "2024-01-05", "Operating_Airline ": "AA", "Tail_Number": "N1", "Origin": "JFK",
            "OriginCityName": "New York", "Dest": "LAX", "DestCityName": "Los Angeles", "DepDelay": "12.5",
            "DepDel15": "0.00", "ArrDelay": "-3.0", "Cancelled": "0.00", "Diverted": "0.00",
            "Distance": "100.0", "Flights": "1.00"}
    out = []
    for i in range(n):
        r = {**base, **{k: (v(i) if callable(v) else v) for k, v in fixed.items()}}
        out.append(tuple(r.get(c) for c in R.RAW_COLUMNS))
    return spark.createDataFrame(out, R.RAW_SCHEMA)


@pytest.mark.parametrize("fixed", [
    {},                                                                   # one day, one carrier, one route
    {"CarrierDelay": lambda i: "5.5" if i == 0 else None},                # 95 % NULL
    {"FlightDate": lambda i: f"2024-01-{i % 20 + 1:02d}", "Tail_Number": None}])
def test_cleaned_columns_do_not_depend_on_the_data(spark, fixed):
    out = R.clean_raw_flights(_raw(spark, 20, **fixed))
    assert out.columns == CLEAN
    got = out.collect()
    assert len(got) == 20 and all(r.depdelay == 12.5 and r.operating_airline == "AA" for r in got)
    assert sum(r.carrierdelay is not None for r in got) == ("CarrierDelay" in fixed)


@pytest.mark.parametrize("values,digits,want", [
    ([0.6, 0.6, 0.6], 2, 0.6), ([0.5], 0, 1.0), ([-0.5], 0, -1.0), ([12.5, 12.25], 1, 12.4),
    ([12.25, 12.25], 1, 12.3), ([-12.25, -12.25], 1, -12.3), ([None, 2.0], 2, 2.0), ([None], 2, None),
    ([2.0**53, 2.0**53 + 2, 3.0], 0, 6004799503160663.0)])
def test_rounded_means_are_exact(spark, values, digits, want):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.agg(S.avg_half_up("v", digits).alias("m")).first()["m"] == want


def test_rounded_ratio_beyond_double_precision(spark):
    df = spark.createDataFrame([(45035996273704961, 1000)], "n long, d long")
    assert df.select(S.ratio_half_up("n", "d", 2).alias("o")).first()["o"] == 45035996273704.96


def _dash(spark, recs):
    return spark.createDataFrame(recs, "operating_airline string, origin string, dest string, depdelay double, "
                                 "delayed int, distance double, day_of_week string")


def test_null_keys_form_no_group(spark):
    d = _dash(spark, [("AA", "A", "B", 1.5, 0, 1.0, "Monday"), ("AA", "A", None, 9.0, 1, 1.0, "Monday"),
                      (None, None, "B", 9.0, 1, 1.0, "Monday")])
    assert rows(AG.route_mean_delay(d)) == [("A", "B", 1.5)]
    assert AG.route_pivot(d).columns == ["origin", "B"]
    assert rows(AG.carrier_delay_rate(d), "operating_airline") == [("AA",)]
    assert AG.route_bubble(d, 1).count() == AG.top_delayed_routes(d, 1).count() == 1


def test_reloaded_weather_does_not_multiply_flights(spark):
    day = dt.date(2024, 1, 5)
    f = spark.createDataFrame([(1, day, "AA", "A", "CityA", "B", "CityB", 1.0, 1, False, 3.0, False)],
                              "flight_id long, flightdate date, operating_airline string, origin string, "
                              "origincityname string, dest string, destcityname string, distance double, "
                              "distancegroup int, diverted boolean, depdelay double, depdel15 boolean")
    schema = ", ".join(["location_name string", "weather_date date", "ingested_at timestamp",
                        *[f"{m} double" for m in K.WEATHER_MEASURES]])
    w = spark.createDataFrame(
        [(c, day, dt.datetime(2024, 1, n), *[float(n)] * len(K.WEATHER_MEASURES))
         for c in ("CityA", "CityB") for n in (1, 2)], schema)
    got = J.training_join(f, w).collect()
    assert len(got) == 1 and got[0].temp_o == 2.0


def test_repeated_trips_keep_their_rows(spark):
    flight = T.flights(spark, SF_SMALL).where("cancelled = false").first()
    trips = spark.createDataFrame([(i, flight.operating_airline, flight.origin, flight.dest, "Monday")
                                   for i in (1, 2, 2)],
                                  "trip_id int, operating_airline string, origin string, dest string, day_of_week string")
    got = api.trip_risk(spark, SF_SMALL, trips).collect()
    assert sorted(r.trip_id for r in got) == [1, 2, 2]
    assert len({(r.risk_probability, r.expected_delay_minutes) for r in got}) == 1


GOOD = ["abc123", "DLH1 ", "Germany", 1700000000, 1700000001, 8.5, 50.0, 1.0, False, 1.0, 1.0, 0.0, None, 1.0,
        "1000", False, 0]


def test_malformed_states_are_counted_and_do_not_fail(spark):
    folder = tempfile.mkdtemp(prefix="contrail-landing-")
    bad = [*GOOD]
    bad[5] = "north"
    with open(os.path.join(folder, "p.json"), "w") as f:
        f.write(json.dumps({"time": 1700000000, "states": [GOOD, bad, GOOD[:3], [*GOOD[:1], *GOOD[1:]]]}) + "\n")
    raw = L.read_landed(spark, folder)
    assert L.clean_states(L.parse_snapshots(raw)).count() == 2
    assert rows(L.rejected_states(raw), "states", "short_states", "bad_positions") == [(4, 1, 1)]


def test_limits_are_refused_not_cut(spark):
    f = T.flights(spark, SF_SMALL)
    for call in (lambda: TK.flights_page(f, limit=5001), lambda: TK.sample_flights(f, n=200001),
                 lambda: TK.flights_page(f, limit=0),
                 lambda: L.latest_positions(L.live_flights(spark, SF_SMALL), limit=201),
                 lambda: api.route_graph(spark, SF_SMALL, limit=501)):
        with pytest.raises(ValueError):
            call()


def test_page_behind_a_row_equals_the_offset_page(spark):
    f = T.flights(spark, SF_SMALL)
    first = TK.flights_page(f, limit=50).collect()
    last = first[-1]
    behind = TK.flights_page(f, limit=50, after=(last.flightdate, last.flight_id)).collect()
    assert behind == TK.flights_page(f, limit=50, offset=50).collect()


def test_sample_is_the_same_with_and_without_thinning(spark):
    f = T.flights(spark, SF_SMALL)
    a = TK.sample_flights(f, n=300, seed=3).collect()
    assert a == TK.sample_flights(f, n=300, seed=3, exact=False).collect() and len(a) == 300
    assert a != TK.sample_flights(f, n=300, seed=4).collect()


def test_lake_follows_its_input(spark):
    folder = tempfile.mkdtemp(prefix="contrail-input-")
    for t in ("lineitem", "orders", "customer", "supplier", "part", "nation"):
        shutil.copyfile(f"{SF_SMALL}/{t}.parquet", f"{folder}/{t}.parquet")
    first = T.flights(spark, folder).count()
    half = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").where("l_orderkey % 2 = 0")
    half.toPandas().to_parquet(f"{folder}/lineitem.parquet", coerce_timestamps="us",
                               allow_truncated_timestamps=True)
    second = T.flights(spark, folder).count()
    assert 0 < second < first
    # a second builder that lost the race leaves the published table alone
    lake = T.lake(spark, folder)
    private = f"{lake.root}/.flights-late"
    spark.range(1).write.parquet(private)
    from contrail.session import path_exists, publish
    publish(spark, private, f"{lake.root}/flights")
    assert not path_exists(spark, private)
    assert T.flights(spark, folder).count() == second


def test_latest_positions_survive_a_lost_checkpoint(spark, monkeypatch):
    monkeypatch.setattr(ST, "COMPACT_AFTER", 2)
    landing = L.land_snapshots(spark, SF_SMALL)
    run = ST.new_run_dir(spark, "test-lost")
    for turn in range(2):  # the second run starts without the first one's checkpoint
        q = ST.track_latest(ST.live_stream(spark, landing, max_files_per_trigger=1), f"{run}/table",
                            f"{run}/ckpt{turn}")
        ST.run_to_completion(q)
    cols = ["icao24", "collected_at", "time_position", "callsign"]
    assert rows(ST.latest_version(spark, f"{run}/table"), *cols) \
        == rows(L.latest_per_aircraft(L.live_flights(spark, SF_SMALL)), *cols)
    assert len(ST._folders(spark, f"{run}/table")) <= 4


def test_deduplication_over_many_batches_loses_nothing(spark):
    landing = L.land_snapshots(spark, SF_SMALL)
    run = ST.new_run_dir(spark, "test-t2-many")
    q = ST.ingest(ST.dedupe(ST.live_stream(spark, landing, max_files_per_trigger=1)), f"{run}/sink", f"{run}/ckpt")
    ST.run_to_completion(q)
    assert ST.late_reports(q) == 0
    assert spark.read.parquet(f"{run}/sink").count() == L.live_flights(spark, SF_SMALL).select(
        "icao24", "collected_at").distinct().count()


# ------------------------------------------------------------ final plans
def _final_plan(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_flights_are_scanned_once_for_rates_and_fills(spark):
    f = T.flights(spark, SF_SMALL)
    dash = AG.dashboard_frame(f)
    trips = spark.createDataFrame([("X", "A", "B", "Monday")],
                                  "operating_airline string, origin string, dest string, day_of_week string")
    assert _final_plan(AG.trip_rates(dash, trips)).count("FileScan parquet") == 0  # reads the checkpoint
    filled = C.fill_mean(f.select("flight_id", "depdelay", "distance", "arrdelay"),
                         ["depdelay", "distance", "arrdelay"])
    filled.collect()
    text = filled._jdf.queryExecution().executedPlan().toString()
    assert "ReusedSubquery" in text or text.count("Subquery subquery#") == 1  # one pass for all means
    assert "struct<depdelay:double,arrdelay:double,distance:double>" in text


def test_month_filter_prunes_partitions(spark):
    df = api._dash(spark, SF_SMALL, months=(6, 8)).groupBy("origin").count()
    explain = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(explain)
    assert "PartitionFilters: []" not in text and "flight_month" in text
