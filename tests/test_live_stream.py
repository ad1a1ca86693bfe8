import json
import os
import tempfile
import uuid

from pyspark.sql import functions as F

from contrail.sources import live as L
from contrail.streaming import live as S
from tests.conftest import SF_SMALL, rows

SAMPLE = [
    {"time": 1700000000, "states": [
        ["abc123", "DLH123  ", "Germany", 1700000000, 1700000001, 8.56, 50.03, 10600, False, 240.0,
         90.0, 0.0, None, 10650, "1000", False, 0],
        ["def456", "UAL456  ", "United States", 1700000000, 1700000002, -73.78, 40.63, 11200, False,
         260.0, 180.0, 0.0, None, 11250, "2000", False, 0],
        ["ground1", "GRD1    ", "France", 1700000000, 1700000000, 2.0, 48.0, 0, True, 0.0,
         0.0, 0.0, None, 0, "3000", False, 0],
        ["nopos", "NOP1    ", "France", 1700000000, 1700000000, None, None, 0, False, 0.0,
         0.0, 0.0, None, 0, "3000", False, 0]]}]


def _land(objs):
    d = tempfile.mkdtemp(prefix="contrail-landing-")
    with open(os.path.join(d, "poll-0.json"), "w") as fh:
        for o in objs:
            fh.write(json.dumps(o) + "\n")
    return d


def test_parse_and_clean_sample(spark):
    raw = L.read_landed(spark, _land(SAMPLE))
    out = L.clean_states(L.parse_snapshots(raw)).collect()
    assert sorted(r.callsign for r in out) == ["DLH123", "UAL456"]
    r = [x for x in out if x.icao24 == "abc123"][0]
    assert r.latitude == 50.03 and r.baro_altitude == 10600.0 and r.on_ground is False
    assert L.parse_snapshots(raw, limit=1).count() == 1


def test_stream_equals_batch(spark):
    landing = L.land_snapshots(spark, SF_SMALL)
    run = S.new_run_dir(spark, "test-t1")
    S.run_to_completion(S.ingest(S.live_stream(spark, landing), f"{run}/sink", f"{run}/ckpt"))
    streamed = spark.read.parquet(f"{run}/sink").select(*L.LIVE_COLUMNS)
    batch = L.live_flights(spark, SF_SMALL).select(*L.LIVE_COLUMNS)
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0


def test_stream_latest_equals_batch(spark):
    landing = L.land_snapshots(spark, SF_SMALL)
    run = S.new_run_dir(spark, "test-t3")
    q = S.track_latest(S.live_stream(spark, landing, max_files_per_trigger=2),
                       f"{run}/table", f"{run}/ckpt")
    S.run_to_completion(q)
    got = S.latest_version(spark, f"{run}/table")
    want = L.latest_per_aircraft(L.live_flights(spark, SF_SMALL))
    cols = ["icao24", "collected_at", "time_position", "callsign", "velocity"]
    assert rows(got, *cols) == rows(want, *cols)


def test_dedupe_keeps_one_per_key(spark):
    landing = L.land_snapshots(spark, SF_SMALL)
    run = S.new_run_dir(spark, "test-t2")
    S.run_to_completion(S.ingest(S.dedupe(S.live_stream(spark, landing)), f"{run}/sink",
                                 f"{run}/ckpt"))
    out = spark.read.parquet(f"{run}/sink")
    assert out.count() == out.select("icao24", "collected_at").distinct().count()
    assert out.count() == L.live_flights(spark, SF_SMALL).select(
        "icao24", "collected_at").distinct().count()


def test_latest_positions_limit_and_country(spark):
    live = L.live_flights(spark, SF_SMALL)
    assert L.latest_positions(live, limit=200).count() == 200
    assert L.latest_positions(live, country="view", limit=5).where(
        F.col("origin_country") != "view").count() == 0
