"""Set operators over airports and codes.

Distinct lists are a group-by on one small key (partial distinct per task),
so they stay cheap however many flights there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions.constants import DEFAULT_COUNTRY
from contrail.operators.filters import by_keys
from contrail.operators.windows import keep_first


def airport_table(flights: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """U1 + W1: airports = origin triples then dest triples, first per code
    (origin side wins, then smallest city, then smallest id), constant country."""
    o = flights.select(F.col("origin").alias("iata"), F.col("origincityname").alias("city"),
                       F.col("originairportid").alias("airport_id"), F.lit(0).alias("_side"))
    d = flights.select(F.col("dest").alias("iata"), F.col("destcityname").alias("city"),
                       F.col("destairportid").alias("airport_id"), F.lit(1).alias("_side"))
    u = o.unionByName(d).where(F.col("iata").isNotNull()).distinct()
    first = keep_first(u, ["iata"], ["_side", "city", "airport_id"])
    return first.select("iata", "airport_id", "city", F.lit(country).alias("country"))


def distinct_carriers(flights: DataFrame) -> DataFrame:
    """Carriers, sorted."""
    return (flights.where(F.col("operating_airline").isNotNull())
                   .select(F.col("operating_airline").alias("airline")).distinct().orderBy("airline"))


def distinct_origins(flights: DataFrame, airline: str | None = None) -> DataFrame:
    """U4: origins, optionally for one carrier, sorted."""
    return (by_keys(flights, airline).where(F.col("origin").isNotNull())
            .select("origin").distinct().orderBy("origin"))


def distinct_dests(flights: DataFrame, airline: str | None = None,
                   origin: str | None = None) -> DataFrame:
    """Destinations, optionally for a carrier and/or origin, sorted."""
    return (by_keys(flights, airline, origin).where(F.col("dest").isNotNull())
            .select("dest").distinct().orderBy("dest"))


def city_sets_compare(flights: DataFrame) -> DataFrame:
    """Do origin cities and destination cities form the same set?"""
    # distinct first (partial aggregation per task): the anti joins inside
    # subtract then see one row per city, never a hot city's flights
    o = flights.select(F.col("origincityname").alias("city")).where(F.col("city").isNotNull()).distinct()
    d = flights.select(F.col("destcityname").alias("city")).where(F.col("city").isNotNull()).distinct()
    only_o = o.subtract(d).agg(F.count(F.lit(1)).alias("origin_only"))
    only_d = d.subtract(o).agg(F.count(F.lit(1)).alias("dest_only"))
    # both sides are single-row aggregates; union + max folds them into one row
    both = (only_o.select("origin_only", F.lit(None).cast("long").alias("dest_only"))
            .unionByName(only_d.select(F.lit(None).cast("long").alias("origin_only"), "dest_only")))
    return both.agg(F.max("origin_only").alias("origin_only"),
                    F.max("dest_only").alias("dest_only")).withColumn(
        "same_set", (F.col("origin_only") == 0) & (F.col("dest_only") == 0))


def distinct_cities(flights: DataFrame) -> DataFrame:
    """Every city (origin or destination), sorted."""
    return (flights.select(F.col("origincityname").alias("city"))
            .union(flights.select(F.col("destcityname").alias("city")))
            .where(F.col("city").isNotNull()).distinct().orderBy("city"))


def airport_codes(df: DataFrame, a: str = "origin", b: str = "dest") -> DataFrame:
    """U8: airport set = origins union destinations."""
    return (df.select(F.col(a).alias("iata")).union(df.select(F.col(b).alias("iata")))
              .where(F.col("iata").isNotNull()).distinct())
