"""Raw flight CSV in, bronze tables out (S1-S8, S13, S14) and the cleaning chain.

The raw file looks like the public on-time performance export: TitleCase
headers (one with a trailing blank), hhmm clocks of 1-4 digits, flags as
``1.00``/``0.00``, numbers as ``12.0``, empty cells for missing values, a
constant ``Flights`` column and a nearly empty diversion column. For tests
the file is derived from the bronze flights (so cleaning it must give them
back); in production it is whatever landed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.functions import constants as K
from contrail.operators import clean as C
from contrail.session import compiled_methods
from contrail.sources.store import BatchTable

RAW_COLUMNS = [
    "FlightDate", "Operating_Airline ", "Tail_Number", "Flight_Number_Operating_Airline",
    "OriginAirportID", "Origin", "OriginCityName", "DestAirportID", "Dest", "DestCityName",
    "CRSDepTime", "DepTime", "DepDelay", "DepDel15", "DepartureDelayGroups", "TaxiOut",
    "WheelsOff", "WheelsOn", "TaxiIn", "CRSArrTime", "ArrTime", "ArrDelay", "ArrDel15",
    "ArrivalDelayGroups", "Cancelled", "CancellationCode", "Diverted", "CRSElapsedTime",
    "ActualElapsedTime", "AirTime", "Distance", "DistanceGroup", "CarrierDelay", "WeatherDelay", "NASDelay",
    "SecurityDelay", "LateAircraftDelay", "Flights", "DivAirportLandings",
]
# Every raw column is read as text; typing is the cleaning chain's job.
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

INT_COLUMNS = ["Flight_Number_Operating_Airline", "OriginAirportID", "DestAirportID",
               "DistanceGroup", "DepartureDelayGroups", "ArrivalDelayGroups", "TaxiOut", "TaxiIn",
               "CRSElapsedTime", "ActualElapsedTime", "AirTime"]
DOUBLE_COLUMNS = ["DepDelay", "ArrDelay", "Distance", "CarrierDelay", "WeatherDelay",
                  "NASDelay", "SecurityDelay", "LateAircraftDelay"]
BOOL_COLUMNS = ["DepDel15", "ArrDel15", "Cancelled", "Diverted"]
STRING_COLUMNS = ["Operating_Airline", "Tail_Number", "Origin", "OriginCityName", "Dest",
                  "DestCityName", "CancellationCode"]


RAW_FILE_ROWS = 500_000  # of a landed file: one task reads it


def _hhmm(minutes):
    return (F.floor(minutes / 60) * 100 + minutes % 60).cast("int")


def export_raw(flights: DataFrame) -> DataFrame:
    """The raw-CSV view of bronze flights (all text, raw spellings)."""
    crs = (F.col("flight_id") * 7) % 1440
    dep = F.pmod(crs + F.floor("depdelay"), F.lit(1440))
    # what bronze lacks follows from the flight's number, delays and distance
    planned = F.floor(F.col("distance") / 8) + 30
    crs_arr = F.pmod(crs + planned, F.lit(1440))
    arr = F.pmod(crs_arr + F.floor("arrdelay"), F.lit(1440))
    out_taxi = F.when(F.col("depdelay").isNotNull(), F.col("flight_id") % 25 + 5)
    in_taxi = F.when(F.col("arrdelay").isNotNull(), F.col("flight_id") % 12 + 3)
    actual = planned + F.floor("arrdelay") - F.floor("depdelay")
    code = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.col("flight_id") % 4 + 1).cast("int"))

    def clock(minutes):
        return F.when(minutes == 0, F.lit("2400")).otherwise(_hhmm(minutes).cast("string"))

    def group(delay):
        # greatest() and least() skip NULLs
        return F.when(F.col(delay).isNotNull(),
                      F.least(F.greatest(F.floor(F.col(delay) / 15), F.lit(-2)), F.lit(12)))

    def flag(c):
        return F.when(F.col(c), F.lit("1.00")).when(~F.col(c), F.lit("0.00"))

    def num(c):
        return F.col(c).cast("double").cast("string")

    return flights.select(
        F.date_format("flightdate", "yyyy-MM-dd").alias("FlightDate"),
        F.col("operating_airline").alias("Operating_Airline "),
        F.col("tail_number").alias("Tail_Number"),
        F.col("flight_number_operating_airline").cast("string").alias("Flight_Number_Operating_Airline"),
        F.col("originairportid").cast("string").alias("OriginAirportID"),
        F.col("origin").alias("Origin"),
        F.concat(F.col("origincityname"), F.lit(" ")).alias("OriginCityName"),
        F.col("destairportid").cast("string").alias("DestAirportID"),
        F.col("dest").alias("Dest"),
        F.col("destcityname").alias("DestCityName"),
        _hhmm(crs).cast("string").alias("CRSDepTime"),
        clock(dep).alias("DepTime"),
        num("depdelay").alias("DepDelay"), flag("depdel15").alias("DepDel15"),
        group("depdelay").cast("double").cast("string").alias("DepartureDelayGroups"),
        out_taxi.cast("double").cast("string").alias("TaxiOut"),
        clock(F.pmod(dep + out_taxi, F.lit(1440))).alias("WheelsOff"),
        clock(F.pmod(arr - in_taxi, F.lit(1440))).alias("WheelsOn"),
        in_taxi.cast("double").cast("string").alias("TaxiIn"),
        _hhmm(crs_arr).cast("string").alias("CRSArrTime"), clock(arr).alias("ArrTime"),
        num("arrdelay").alias("ArrDelay"), flag("arrdel15").alias("ArrDel15"),
        group("arrdelay").cast("double").cast("string").alias("ArrivalDelayGroups"),
        flag("cancelled").alias("Cancelled"), F.when(F.col("cancelled"), code).alias("CancellationCode"),
        flag("diverted").alias("Diverted"), planned.cast("double").cast("string").alias("CRSElapsedTime"),
        actual.cast("double").cast("string").alias("ActualElapsedTime"),
        (actual - out_taxi - in_taxi).cast("double").cast("string").alias("AirTime"),
        num("distance").alias("Distance"),
        F.col("distancegroup").cast("string").alias("DistanceGroup"),
        *[num(c).alias(n) for c, n in zip(K.DELAY_CAUSES, ["CarrierDelay", "WeatherDelay",
                                                            "NASDelay", "SecurityDelay",
                                                            "LateAircraftDelay"])],
        F.lit("1.00").alias("Flights"),
        F.when(F.col("flight_id") % 1000 == 0, F.lit("1")).alias("DivAirportLandings"),
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none",
              file_rows: int = 0) -> None:
    """CSV with a header (Parquet is the better sink; CSV for exchange). A
    compressed file is read by one task: ``file_rows`` bounds its rows."""
    (df.write.mode(mode).option("header", True).option("compression", compression)
     .option("maxRecordsPerFile", file_rows).csv(path))


def read_raw_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """S1 (+S3): explicit all-text schema, header row, PERMISSIVE; with
    ``columns`` only those are kept (the CSV parser prunes the rest)."""
    df = (spark.read.schema(RAW_SCHEMA).option("header", True).option("mode", "PERMISSIVE")
          .csv(path))
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def bounded(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows in a stated order (repeatable)."""
    return df.orderBy(*order).limit(n)


def land_raw_csv(spark: SparkSession, sf_dir: str) -> str:
    """Write the raw CSV export of the bronze flights once (gzip: a seventh of
    the text's size); return its folder."""
    from contrail.sources.tables import flights, lake
    return lake(spark, sf_dir).once("raw_csv", lambda path: write_csv(
        export_raw(flights(spark, sf_dir)), path, compression="gzip", file_rows=RAW_FILE_ROWS))


def clean_raw_flights(raw: DataFrame, bool_default: bool = False,
                      keep: list[str] | None = None) -> DataFrame:
    """The cleaning chain, raw text -> typed bronze rows:

    P3 strip names, P5 case-insensitive keep list (the constant ``Flights``
    column and the diversion column are not on it), P9 dates, P6 clocks, P7
    integers, delays and distance as doubles, P8 flags (missing ->
    ``bool_default``), P10 trim, P12 drop rows without date/origin/dest, P4
    lower-case names.

    ``keep`` is the keep list: the collector's columns and the two departure
    clocks, unless given (``CLEANING_COLUMNS``: the cleaning script's).

    The output columns are the keep list's whatever the data hold: a column of
    one value or mostly NULLs stays. P1 and P11 (``drop_sparse_columns``,
    ``drop_constant_columns``) are for frames without a keep list.
    """
    compiled_methods(raw.sparkSession)  # some forty conversions make one long method
    df = C.strip_column_names(raw)
    df = C.keep_columns(df, keep or K.COLLECTOR_COLUMNS + ["CRSDepTime", "DepTime"])
    df = C.parse_dates(df, ["FlightDate"])
    df = C.parse_clock_columns(df, K.CLOCK_COLUMNS)
    df = C.to_int_columns(df, INT_COLUMNS)
    df = C.to_double_columns(df, DOUBLE_COLUMNS)
    df = C.to_bool_columns(df, BOOL_COLUMNS, bool_default)
    df = C.trim_strings(df, STRING_COLUMNS)
    df = C.drop_incomplete(df, ["FlightDate", "Origin", "Dest"])
    return C.lower_column_names(df)


# ------------------------------------------------------------------ sinks
def append_bronze(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("flight_month",)) -> None:
    """Append to a bronze table, partitioned by flight month, stamped with
    ``ingested_at``. No chunking: every task writes its own files."""
    out = df
    if "flight_month" in partition_by and "flight_month" not in df.columns:
        out = out.withColumn("flight_month",
                             F.date_format("flightdate", "yyyyMM").cast("int"))
    if "ingested_at" not in out.columns:
        out = out.withColumn("ingested_at", F.current_timestamp())
    out.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_bronze_batch(df: DataFrame, path: str, batch_id: str) -> BatchTable:
    """S6, once however often it is retried: like ``append_bronze``, into the
    ledger table at ``path``; a batch written again replaces its first try."""
    out = df
    if "flight_month" not in df.columns:
        out = out.withColumn("flight_month", F.date_format("flightdate", "yyyyMM").cast("int"))
    if "ingested_at" not in out.columns:
        out = out.withColumn("ingested_at", F.current_timestamp())
    table = BatchTable(df.sparkSession, path, ("flight_month",))
    table.append(out, batch_id)
    return table


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a reference table."""
    df.write.mode("overwrite").parquet(path)


def insert_if_absent(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``INSERT ... ON CONFLICT DO NOTHING`` - new keys only, first row per
    key among the new ones."""
    fresh = new.join(existing.select(*key), key, "left_anti").dropDuplicates(key)
    return existing.unionByName(fresh)


def seed_airlines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.SEED_AIRLINES, "code string, name string")


def airlines_table(spark: SparkSession, flights: DataFrame) -> DataFrame:
    """The airlines reference table: the 8 seed rows, then every carrier code
    seen in flights that is not seeded (name from the 21-name dictionary)."""
    from contrail.operators.aggregates import carrier_names
    codes = flights.select(F.col("operating_airline").alias("code")).where(
        F.col("code").isNotNull()).distinct()
    named = codes.join(F.broadcast(carrier_names(spark)), "code", "left")
    return insert_if_absent(seed_airlines(spark), named, ["code"])


def profile_report(df: DataFrame, path: str | None = None) -> DataFrame:
    """Rows, columns, NULL counts as one JSON document."""
    rep = C.audit(df)
    if path:
        rep.coalesce(1).write.mode("overwrite").json(path)
    return rep


# ------------------------------------------------------------------ S14
def uniform(seed: int, what: str, row: str = "id"):
    """A number in [0, 1) from (seed, what, row id): the first 52 bits of their
    MD5. It depends on nothing else, and any engine computes the same."""
    text = F.concat(F.lit(f"{seed}:{what}:"), F.col(row).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def uniform_sql(seed: int, what: str, row: str = "id") -> str:
    """The same number as SQL text."""
    return (f"(CAST(CAST('0x' || substr(md5('{seed}:{what}:' || CAST({row} AS VARCHAR)), 1, 13) AS BIGINT)"
            f" AS DOUBLE) / {float(1 << 52)})")


def synthetic_flights(spark: SparkSession, n: int, seed: int = 42, airports: list[str] | None = None,
                      carriers: list[str] | None = None) -> DataFrame:
    """S14 fixture generator (never a silent fallback): exponential delays
    shifted by -5 and clipped to [-30, 300], delayed = delay > 15, uniform
    airports/carriers/dates, normal noise on arrival. Numbers are counter-based
    (``uniform``): the rows do not depend on the partitioning."""
    airports = airports or ["ATL", "DEN", "DFW", "JFK", "LAX", "ORD", "SEA", "SFO"]
    carriers = carriers or sorted(K.CARRIER_NAMES)

    def one_of(names: list[str], what: str):
        place = F.floor(uniform(seed, what) * len(names)).cast("int")
        return F.element_at(F.array(*[F.lit(x) for x in names]), place + 1)
    # inverse of the exponential distribution; Box-Muller for the normal one
    dep = F.round(-F.log(F.lit(1.0) - uniform(seed, "delay")) * 18 - 5, 1)
    noise = (F.sqrt(F.log(F.lit(1.0) - uniform(seed, "radius")) * -2)
             * F.cos(uniform(seed, "angle") * (2 * math.pi)))
    base = spark.range(n).select(
        F.col("id").alias("flight_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.floor(uniform(seed, "date") * 366).cast("int"))
        .alias("flightdate"),
        one_of(carriers, "carrier").alias("operating_airline"),
        one_of(airports, "origin").alias("origin"), one_of(airports, "dest").alias("dest"),
        (F.floor(uniform(seed, "distance") * 2800) + 200).cast("double").alias("distance"),
        dep.alias("_dep"), noise.alias("_noise"))
    return base.select(
        "flight_id", "flightdate", "operating_airline", "origin", "dest", "distance",
        F.least(F.greatest(F.col("_dep"), F.lit(-30.0)), F.lit(300.0)).alias("depdelay"),
        F.least(F.greatest(F.col("_dep") + F.col("_noise") * 5, F.lit(-60.0)), F.lit(300.0))
        .alias("arrdelay"),
        (F.col("_dep") > 15).alias("depdel15"))
