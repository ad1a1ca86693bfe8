"""Live aircraft state vectors (S10-S12, F12, F13, O9, T3 batch form).

The reference polls an HTTP API for ``{"time": t, "states": [[17 fields], ...]}``
and stores the airborne rows. Here the polls are *landed files* (JSON lines)
that a job reads; for tests and benchmarks the landed files are derived from
the driver's ``events`` table:

* one event is one state report: user -> aircraft (``icao24``), event type ->
  ``origin_country``, ``ts`` -> report time, ``value`` -> velocity;
* one landed line = one poll holding one report; the poll time is the
  report's minute (so reports of one aircraft within a minute share
  ``collected_at``, as reports of one real poll do).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.functions.constants import STATE_FIELDS
from contrail.operators.filters import airborne
from contrail.operators.filters import country as of_country
from contrail.operators.topk import within
from contrail.sources.tables import table
from contrail.session import path_exists
from contrail.sources.store import BatchTable

SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("time", T.LongType()),
    T.StructField("states", T.ArrayType(T.ArrayType(T.StringType()))),
])

# Spark type of each positional field of a state vector.
STATE_TYPES = {
    "icao24": "string", "callsign": "string", "origin_country": "string",
    "time_position": "long", "last_contact": "long", "longitude": "double",
    "latitude": "double", "baro_altitude": "double", "on_ground": "boolean",
    "velocity": "double", "true_track": "double", "vertical_rate": "double",
    "sensors": "string", "geo_altitude": "double", "squawk": "string",
    "spi": "boolean", "position_source": "int",
}

LIVE_COLUMNS = ["icao24", "callsign", "origin_country", "time_position", "last_contact",
                "longitude", "latitude", "baro_altitude", "on_ground", "velocity",
                "true_track", "vertical_rate", "geo_altitude", "squawk", "spi",
                "position_source", "collected_at"]


def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed state reports derived from ``events`` (before landing as JSON)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    eid = F.col("event_id")
    has_pos = eid % 17 != 0
    return ev.select(
        F.format_string("%06x", F.col("user_id")).alias("icao24"),
        # padded like the feed (8 chars); NULL for some reports
        F.when(eid % 23 != 0, F.rpad(F.concat(F.upper(F.substring("event_type", 1, 3)),
                                              F.col("user_id").cast("string")), 8, " "))
         .alias("callsign"),
        F.col("event_type").alias("origin_country"),
        F.unix_timestamp("ts").alias("time_position"),
        (F.unix_timestamp("ts") + eid % 5).alias("last_contact"),
        F.when(has_pos, ((eid * 37) % 3600).cast("double") / 10.0 - 180.0).alias("longitude"),
        F.when(has_pos, ((eid * 13) % 1700).cast("double") / 10.0 - 85.0).alias("latitude"),
        (F.col("value") * 500).alias("baro_altitude"),
        ((F.col("event_type") == "signup") | (F.col("value") < 1.0)).alias("on_ground"),
        F.col("value").alias("velocity"),
        ((eid * 7) % 360).cast("double").alias("true_track"),
        ((eid % 21) - 10).cast("double").alias("vertical_rate"),
        (F.col("value") * 510).alias("geo_altitude"),
        F.lpad((eid % 7777).cast("string"), 4, "0").alias("squawk"),
        (eid % 101 == 0).alias("spi"),
        (eid % 3).cast("int").alias("position_source"),
        F.col("ts").alias("_ts"), eid.alias("_eid"),
    )


def _json_value(col: str, typ: str):
    c = F.col(col)
    if typ == "string":
        return F.coalesce(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2),
                          F.lit("null"))
    if typ == "boolean":
        return F.coalesce(F.when(c, "true").otherwise("false"), F.lit("null"))
    return F.coalesce(c.cast("string"), F.lit("null"))


def land_snapshots(spark: SparkSession, sf_dir: str, out_dir: str | None = None) -> str:
    """Write the derived polls as JSON lines (one file set per input dir) and
    return the folder. Written once; later calls reuse it."""
    from contrail.sources.tables import BUILD_LOCK, lake
    if out_dir is None:
        return lake(spark, sf_dir).once("live_landing", lambda p: _write_polls(spark, sf_dir, p))
    with BUILD_LOCK:  # concurrent callers land the files once
        if not path_exists(spark, f"{out_dir}/_SUCCESS"):
            _write_polls(spark, sf_dir, out_dir)
    return out_dir


def land_damaged_snapshots(spark: SparkSession, sf_dir: str) -> str:
    """The same polls with faults that depend on the event id: every 19th line
    is cut off, of the others every 11th state is short and every 13th has a
    position that is no number."""
    from contrail.sources.tables import lake
    return lake(spark, sf_dir).once("damaged_landing",
                                    lambda p: _write_polls(spark, sf_dir, p, damaged=True))


def _write_polls(spark: SparkSession, sf_dir: str, out_dir: str, damaged: bool = False) -> None:
    s = event_states(spark, sf_dir)

    def vector(fields, **given):
        return F.concat(F.lit("["), F.concat_ws(",", *[
            F.lit(given[f]) if f in given else F.lit("null") if f == "sensors"
            else _json_value(f, STATE_TYPES[f]) for f in fields]), F.lit("]"))
    vec = vector(STATE_FIELDS)
    if damaged:
        vec = F.when(F.col("_eid") % 11 == 0, vector(STATE_FIELDS[:5])).when(
            F.col("_eid") % 13 == 0, vector(STATE_FIELDS, longitude='"east"')).otherwise(vec)
    poll = F.unix_timestamp(F.date_trunc("minute", "_ts"))
    # one poll line per report: no grouping, so no line (and no task) can
    # hold a hot aircraft's whole history
    lines = s.select("_ts", "_eid", F.concat(F.lit('{"time":'), poll.cast("string"),
                                             F.lit(',"states":['), vec, F.lit("]}")).alias("value"))
    if damaged:
        lines = lines.withColumn("value", F.when(F.col("_eid") % 19 == 0, F.substring("value", 1, 40))
                                 .otherwise(F.col("value")))
    # files in time order, as a collector lands them: a stream that takes a
    # few files at a time then sees no report behind its watermark
    (lines.repartitionByRange("_ts").sortWithinPartitions("_ts").select("value")
          .write.mode("overwrite").text(out_dir))
    _stamp_in_order(spark, out_dir)


def _stamp_in_order(spark: SparkSession, folder: str) -> None:
    """Modification times that follow the part numbers (streams read by time)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((s.getPath().getName(), s.getPath()) for s in fs.listStatus(p)
                   if s.getPath().getName().startswith("part-"))
    for i, (_, path) in enumerate(parts):
        fs.setTimes(path, 1_700_000_000_000 + 1000 * i, -1)


def parse_snapshots(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Snapshot rows -> one typed row per state (first ``limit`` states of
    each snapshot), ``collected_at`` = poll time. Works on batch or stream."""
    states = F.col("states") if limit is None else F.slice("states", 1, int(limit))
    x = raw.select(F.col("time"), F.posexplode(states).alias("_pos", "_s"))
    # a short state or a value of another type gives NULL, never a failed job
    cols = [F.try_element_at("_s", F.lit(i + 1)).try_cast(STATE_TYPES[f]).alias(f)
            for i, f in enumerate(STATE_FIELDS) if f != "sensors"]
    return x.select(*cols, F.timestamp_seconds("time").alias("collected_at"), "_pos")


# A poll that may be damaged: the line itself is kept when it is not JSON.
CHECKED_SCHEMA = T.StructType([*SNAPSHOT_SCHEMA.fields, T.StructField("_line", T.StringType())])
REASONS = ("unreadable line", "no poll time", "no states", "short state", "position is not a number")


def checked_states(raw: DataFrame) -> DataFrame:
    """One row per state of polls read with ``CHECKED_SCHEMA`` (a line that is
    no poll is one row): the parsed columns, ``reason`` for what is malformed
    (NULL: nothing is), the ``report`` as it came and its ``source`` file. Works
    on batch or stream."""
    broken = F.col("_line").isNotNull()
    x = raw.select("time", "_line", "source", F.explode_outer("states").alias("_s"))
    bad_position = F.lit(False)
    for f in ("longitude", "latitude"):
        v = F.try_element_at("_s", F.lit(STATE_FIELDS.index(f) + 1))
        bad_position = bad_position | (v.isNotNull() & v.try_cast("double").isNull())
    reason = (F.when(broken, REASONS[0]).when(F.col("time").isNull(), REASONS[1])
              .when(F.col("_s").isNull(), REASONS[2])
              .when(F.size("_s") < len(STATE_FIELDS), REASONS[3]).when(bad_position, REASONS[4]))
    cols = [F.try_element_at("_s", F.lit(i + 1)).try_cast(STATE_TYPES[f]).alias(f)
            for i, f in enumerate(STATE_FIELDS) if f != "sensors"]
    return x.select(*cols, F.timestamp_seconds("time").alias("collected_at"), reason.alias("reason"),
                    F.coalesce("_line", F.to_json("_s")).alias("report"), "source")


def rejected_states(raw: DataFrame) -> DataFrame:
    """One row per poll time: states, short ones, and ones with a position
    that is not a number."""
    x = raw.select("time", F.explode("states").alias("_s"))
    bad = F.lit(False)
    for f in ("longitude", "latitude"):
        v = F.try_element_at("_s", F.lit(STATE_FIELDS.index(f) + 1))
        bad = bad | (v.isNotNull() & v.try_cast("double").isNull())
    return x.groupBy("time").agg(
        F.count(F.lit(1)).alias("states"),
        F.count_if(F.size("_s") < len(STATE_FIELDS)).alias("short_states"),
        F.count_if(bad).alias("bad_positions"))


def clean_states(states: DataFrame) -> DataFrame:
    """F12 + P10: airborne reports with a position and callsign, callsign trimmed."""
    return airborne(states).withColumn("callsign", F.trim("callsign"))


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT_SCHEMA).json(path)


def live_flights(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """The live store: every airborne state from every landed poll."""
    raw = read_landed(spark, land_snapshots(spark, sf_dir))
    return clean_states(parse_snapshots(raw, limit)).drop("_pos")


def latest_positions(live: DataFrame, country: str | None = None, limit: int = 50) -> DataFrame:
    """O9 + F13: newest reports, optionally for one origin country; a limit
    over 200 is refused."""
    limit = within(limit, 200)
    return of_country(live, country).orderBy(F.desc("collected_at"), F.desc("time_position"), "icao24",
                        F.desc("last_contact")).limit(limit)


def latest_per_aircraft(live: DataFrame) -> DataFrame:
    """T3 batch form: the newest report per aircraft (max over a struct keyed by
    report time - combines map-side, one row per aircraft per task)."""
    rest = [c for c in live.columns if c not in ("icao24", "collected_at", "time_position",
                                                 "last_contact")]
    s = F.struct("collected_at", "time_position", "last_contact", *rest)
    return (live.groupBy("icao24").agg(F.max(s).alias("_s"))
                .select("icao24", *[F.col(f"_s.{c}").alias(c) for c in
                                    ["collected_at", "time_position", "last_contact", *rest]]))


def airborne_by_country_window(live: DataFrame, minutes: int = 5) -> DataFrame:
    """T4 batch form: airborne reports per country per tumbling window."""
    w = F.window("collected_at", f"{minutes} minutes")
    return (live.groupBy(w.alias("w"), "origin_country")
                .agg(F.count(F.lit(1)).alias("aircraft_reports"),
                     F.countDistinct("icao24").alias("aircraft"))
                .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                        "origin_country", "aircraft_reports", "aircraft"))


def append_live(df: DataFrame, path: str) -> None:
    """Append documents to the live store with an insert timestamp."""
    df.withColumn("inserted_at", F.current_timestamp()).write.mode("append").parquet(path)


def append_live_batch(df: DataFrame, path: str, batch_id: str) -> BatchTable:
    """S11, once however often it is retried."""
    table = BatchTable(df.sparkSession, path)
    table.append(df.withColumn("inserted_at", F.current_timestamp()), batch_id)
    return table


def prediction_log_row(predictions: DataFrame, label_col: str = "prediction") -> DataFrame:
    """One row (predicted_at, rows, delayed_count) for the prediction log."""
    return predictions.agg(
        F.current_timestamp().alias("predicted_at"),
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col(label_col) == 1, 1).otherwise(0)), F.lit(0))
        .cast("long").alias("delayed_count"))
