"""Silver and gold layers as lazy DataFrames (the reference's SQL views).

* silver (J1): flights LEFT JOIN weather at origin, LEFT JOIN weather at dest.
* gold (A1/A2): delay summary per (carrier, origin, dest).

Scale: weather has one row per (location, day) - a few hundred thousand
rows even for decades of data over thousands of airports - yet it still
grows with the input, so it is *not* hinted: AQE broadcasts it when its
measured size is under the threshold and falls back to a shuffle join
otherwise. The gold group-by aggregates map-side first (partial
aggregation), so only one row per key per task crosses the shuffle even
when one route holds a third of all flights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions.scalars import avg_half_up, pct_half_up
from contrail.operators.filters import not_cancelled_lenient, not_cancelled_strict
from contrail.operators.windows import latest_per_key

# Columns of the silver view: the DDL view's list plus the loader variant's
# extra columns (cloud at origin, precipitation at destination).
SILVER_COLUMNS = [
    "flight_id", "flightdate", "operating_airline", "origin", "origincityname",
    "dest", "destcityname", "distance", "distancegroup", "depdelay", "depdel15",
    "diverted", "carrierdelay", "weatherdelay", "nasdelay",
    "temp_origin", "wind_origin", "precip_origin", "cloud_origin",
    "temp_dest", "wind_dest", "precip_dest",
]


def dedupe_weather(weather: DataFrame) -> DataFrame:
    """Newest row per (location, date) so reloads cannot fan out joins."""
    return latest_per_key(weather, ["location_name", "weather_date"], ["ingested_at"])


def silver_flights_weather(flights: DataFrame, weather: DataFrame,
                           dedupe: bool = True) -> DataFrame:
    """J1 silver view. SQL null semantics: a NULL city matches nothing."""
    w = dedupe_weather(weather) if dedupe else weather
    wo = w.select(F.col("location_name").alias("wo_loc"), F.col("weather_date").alias("wo_date"),
                  F.col("temp").alias("temp_origin"), F.col("wind_speed_kmh").alias("wind_origin"),
                  F.col("precipitation_mm").alias("precip_origin"),
                  F.col("cloud_cover").alias("cloud_origin"))
    wd = w.select(F.col("location_name").alias("wd_loc"), F.col("weather_date").alias("wd_date"),
                  F.col("temp").alias("temp_dest"), F.col("wind_speed_kmh").alias("wind_dest"),
                  F.col("precipitation_mm").alias("precip_dest"))
    f = flights.select("flight_id", "flightdate", "operating_airline", "origin", "origincityname",
                       "dest", "destcityname", "distance", "distancegroup", "depdelay",
                       "depdel15", "diverted", "carrierdelay", "weatherdelay", "nasdelay")
    j = (f.join(wo, (F.col("flightdate") == F.col("wo_date"))
                & (F.col("origincityname") == F.col("wo_loc")), "left")
          .join(wd, (F.col("flightdate") == F.col("wd_date"))
                & (F.col("destcityname") == F.col("wd_loc")), "left"))
    return j.select(*SILVER_COLUMNS)


def delay_summary(flights: DataFrame, rounded: bool = True, lenient: bool = True) -> DataFrame:
    """Gold A1 (``rounded``/``lenient``) or A2 (unrounded, strict filter).

    avg_* use half-up rounding of the exact mean (PostgreSQL numeric).
    """
    src = not_cancelled_lenient(flights) if lenient else not_cancelled_strict(flights)
    delayed = F.sum(F.when(F.col("depdel15"), 1).otherwise(0))
    keys = ["operating_airline", "origin", "dest"]
    if rounded:
        return src.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("total_flights"),
            avg_half_up("depdelay", 2).alias("avg_dep_delay"),
            avg_half_up("distance", 0).alias("avg_distance"),
            delayed.cast("long").alias("delayed_count"),
            pct_half_up(delayed, F.count(F.lit(1)), 2).alias("delay_rate_pct"),
            avg_half_up("carrierdelay", 2).alias("avg_carrier_delay"),
            avg_half_up("weatherdelay", 2).alias("avg_weather_delay"),
            avg_half_up("nasdelay", 2).alias("avg_nas_delay"),
        )
    return src.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_flights"),
        F.avg("depdelay").alias("avg_dep_delay"),
        delayed.cast("long").alias("delayed_count"),
        (F.avg(F.when(F.col("depdel15"), 1.0).otherwise(0.0)) * 100).alias("delay_rate_pct"),
        F.avg("carrierdelay").alias("avg_carrier_delay"),
        F.avg("weatherdelay").alias("avg_weather_delay"),
        F.avg("nasdelay").alias("avg_nas_delay"),
    )


def register_layers(spark, sf_dir: str) -> None:
    """Temp views ``bronze_flights``, ``bronze_weather``, ``silver_flights_weather``,
    ``gold_delay_summary`` for SQL users."""
    from contrail.sources.tables import flights, weather
    fl, wx = flights(spark, sf_dir), weather(spark, sf_dir)
    fl.createOrReplaceTempView("bronze_flights")
    wx.createOrReplaceTempView("bronze_weather")
    silver_flights_weather(fl, wx).createOrReplaceTempView("silver_flights_weather")
    delay_summary(fl).createOrReplaceTempView("gold_delay_summary")
