"""Live positions, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.plans.registry import register
from contrail.sources import live as L
from contrail.sources.store import BatchTable
from contrail.streaming import live as S

# DuckDB twin of sources.live.event_states + parse + clean_states.
_STATES = """
WITH st AS (
  SELECT printf('%06x', user_id) AS icao24,
    CASE WHEN event_id % 23 <> 0 THEN rpad(upper(substr(event_type, 1, 3)) || CAST(user_id AS VARCHAR), 8, ' ') END AS callsign,
    event_type AS origin_country,
    CAST(epoch_us(ts) // 1000000 AS BIGINT) AS time_position,
    CAST(epoch_us(ts) // 1000000 AS BIGINT) + event_id % 5 AS last_contact,
    CASE WHEN event_id % 17 <> 0 THEN CAST((event_id * 37) % 3600 AS DOUBLE) / 10.0 - 180.0 END AS longitude,
    CASE WHEN event_id % 17 <> 0 THEN CAST((event_id * 13) % 1700 AS DOUBLE) / 10.0 - 85.0 END AS latitude,
    value * 500 AS baro_altitude,
    (event_type = 'signup' OR value < 1.0) AS on_ground,
    value AS velocity,
    CAST((event_id * 7) % 360 AS DOUBLE) AS true_track,
    CAST(event_id % 21 - 10 AS DOUBLE) AS vertical_rate,
    value * 510 AS geo_altitude,
    lpad(CAST(event_id % 7777 AS VARCHAR), 4, '0') AS squawk,
    (event_id % 101 = 0) AS spi,
    CAST(event_id % 3 AS INT) AS position_source,
    CAST(date_trunc('minute', ts) AS TIMESTAMP) AS collected_at
  FROM events),
live AS (
  SELECT icao24, trim(callsign) AS callsign, origin_country, time_position, last_contact,
    longitude, latitude, baro_altitude, on_ground, velocity, true_track, vertical_rate,
    geo_altitude, squawk, spi, position_source, collected_at
  FROM st WHERE on_ground = FALSE AND latitude IS NOT NULL AND longitude IS NOT NULL
    AND callsign IS NOT NULL)
"""


@register("s10_live_states", _STATES + "SELECT * FROM live")
def s10(spark, sf):
    return L.live_flights(spark, sf)


@register("o9_latest_live_positions", _STATES + """
SELECT * FROM live ORDER BY collected_at DESC, time_position DESC, icao24, last_contact DESC
LIMIT 200""")
def o9(spark, sf):
    return L.latest_positions(L.live_flights(spark, sf), limit=200)


@register("f13_latest_positions_for_country", _STATES + """
SELECT * FROM live WHERE origin_country = 'purchase'
ORDER BY collected_at DESC, time_position DESC, icao24, last_contact DESC LIMIT 50""")
def f13(spark, sf):
    return L.latest_positions(L.live_flights(spark, sf), country="purchase", limit=50)


_LATEST = _STATES + """
SELECT icao24, collected_at, time_position, last_contact, callsign, origin_country, longitude,
  latitude, baro_altitude, on_ground, velocity, true_track, vertical_rate, geo_altitude, squawk,
  spi, position_source
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY icao24 ORDER BY collected_at DESC,
        time_position DESC, last_contact DESC, callsign DESC, origin_country DESC,
        longitude DESC, latitude DESC, baro_altitude DESC) AS rn FROM live) WHERE rn = 1"""


@register("t3_latest_position_per_aircraft", _LATEST)
def t3(spark, sf):
    return L.latest_per_aircraft(L.live_flights(spark, sf))


@register("t4_airborne_by_country_window", _STATES + """
SELECT time_bucket(INTERVAL 5 MINUTE, collected_at) AS window_start,
  time_bucket(INTERVAL 5 MINUTE, collected_at) + INTERVAL 5 MINUTE AS window_end,
  origin_country, COUNT(*) AS aircraft_reports, COUNT(DISTINCT icao24) AS aircraft
FROM live GROUP BY 1, 2, 3""")
def t4(spark, sf):
    return L.airborne_by_country_window(L.live_flights(spark, sf), 5)


@register("t1_stream_ingest", _STATES + "SELECT * FROM live")
def t1(spark, sf):
    """Streaming ingest drained with availableNow; equals the batch read."""
    landing = L.land_snapshots(spark, sf)
    run = S.new_run_dir(spark, "t1")
    S.run_to_completion(S.ingest(S.live_stream(spark, landing, max_files_per_trigger=4),
                                 f"{run}/sink", f"{run}/ckpt"))
    return spark.read.parquet(f"{run}/sink").select(*L.LIVE_COLUMNS)


def _checked_run(spark, sf):
    run = S.new_run_dir(spark, "t1-checked")
    stream = S.checked_stream(spark, L.land_damaged_snapshots(spark, sf), max_files_per_trigger=4)
    S.run_to_completion(S.ingest_checked(stream, f"{run}/good", f"{run}/rejects", f"{run}/ckpt"))
    return BatchTable(spark, f"{run}/good").read(), BatchTable(spark, f"{run}/rejects").read()


@register("t1_stream_ingest_of_damaged_polls", _STATES.replace(
    "FROM events),", "FROM events WHERE event_id % 19 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0),")
    + "SELECT * FROM live")
def t1_good(spark, sf):
    """The states that are left of damaged polls, streamed in several epochs."""
    return _checked_run(spark, sf)[0]


@register("t1_stream_dead_letters", f"""
SELECT CASE WHEN event_id % 19 = 0 THEN '{L.REASONS[0]}' WHEN event_id % 11 = 0 THEN '{L.REASONS[3]}'
    ELSE '{L.REASONS[4]}' END AS reason,
  CASE WHEN event_id % 19 <> 0 THEN CAST(date_trunc('minute', ts) AS TIMESTAMP) END AS collected_at,
  CASE WHEN event_id % 19 <> 0 THEN printf('%06x', user_id) END AS icao24, TRUE AS has_report, TRUE AS has_source
FROM events WHERE event_id % 19 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0""")
def t1_rejects(spark, sf):
    """The dead letters of the same run."""
    return _checked_run(spark, sf)[1].select(
        "reason", "collected_at", "icao24", (F.length("report") > 5).alias("has_report"),
        F.col("source").startswith("part-").alias("has_source"))


@register("t2_stream_dedupe_keys", _STATES + "SELECT DISTINCT icao24, collected_at FROM live")
def t2(spark, sf):
    landing = L.land_snapshots(spark, sf)
    run = S.new_run_dir(spark, "t2")
    q = S.ingest(S.dedupe(S.live_stream(spark, landing, max_files_per_trigger=4)), f"{run}/sink",
                 f"{run}/ckpt")
    S.run_to_completion(q)
    return spark.read.parquet(f"{run}/sink").select("icao24", "collected_at")


@register("t3_stream_latest_position", _LATEST)
def t3_stream(spark, sf):
    landing = L.land_snapshots(spark, sf)
    run = S.new_run_dir(spark, "t3")
    S.run_to_completion(S.track_latest(S.live_stream(spark, landing, max_files_per_trigger=4),
                                       f"{run}/table", f"{run}/ckpt"))
    out = S.latest_version(spark, f"{run}/table")
    return out.select("icao24", "collected_at", "time_position", "last_contact",
                      *[c for c in out.columns if c not in
                        ("icao24", "collected_at", "time_position", "last_contact")])


@register("t4_stream_window_counts", _STATES + """
SELECT time_bucket(INTERVAL 5 MINUTE, collected_at) AS window_start,
  time_bucket(INTERVAL 5 MINUTE, collected_at) + INTERVAL 5 MINUTE AS window_end,
  origin_country, COUNT(*) AS aircraft_reports
FROM live GROUP BY 1, 2, 3
HAVING time_bucket(INTERVAL 5 MINUTE, collected_at) + INTERVAL 5 MINUTE
       <= (SELECT MAX(collected_at) FROM live) - INTERVAL 10 MINUTE""")
def t4_stream(spark, sf):
    """Append mode: exactly the windows the final watermark (latest report
    minus 10 minutes) has closed; later windows are still open in state."""
    landing = L.land_snapshots(spark, sf)
    run = S.new_run_dir(spark, "t4")
    q = S.ingest(S.window_counts(S.live_stream(spark, landing, max_files_per_trigger=4)),
                 f"{run}/sink", f"{run}/ckpt")
    S.run_to_completion(q)
    return spark.read.parquet(f"{run}/sink")
