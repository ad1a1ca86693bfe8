"""Ordered pages, top-k and deterministic sampling.

``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: every task
keeps its own top k and only those reach the final merge, so the sort never
gathers the table. Every ordering ends in a full tie-break so pages are
repeatable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.operators.filters import (at_most, by_keys, date_range, delayed_only,
                                        not_cancelled_strict)

PAGE_COLUMNS = ["flight_id", "flightdate", "operating_airline", "origin", "origincityname",
                "dest", "destcityname", "depdelay", "depdel15", "distance"]
MAX_PAGE, MAX_SAMPLE = 5000, 200000
_TIE = ["flight_id", "operating_airline", "origin", "dest", "distance", "depdelay"]


def flights_page(flights: DataFrame, airline=None, origin=None, dest=None, date_from=None,
                 date_to=None, delayed: bool = False, limit: int = 100,
                 offset: int = 0, after: tuple | None = None) -> DataFrame:
    """O1 (``GET /flights``): strict uncancelled, optional filters, newest
    first, LIMIT/OFFSET; a limit over 5000 is refused, as the service does.

    ``after=(flightdate, flight_id)`` starts behind that row instead of
    counting an offset: a deep page then costs no more than the first one,
    and months after the date are not read.
    """
    limit = within(limit, MAX_PAGE)
    df = by_keys(not_cancelled_strict(flights), airline, origin, dest)
    df = date_range(df, date_from, date_to)
    if delayed:
        df = delayed_only(df)
    if after is not None:
        day, last = F.lit(str(after[0])[:10]).cast("date"), F.lit(after[1])
        df = date_range(df, None, after[0]).where(
            (F.col("flightdate") < day) | (F.col("flight_id") > last))
    order = [F.desc("flightdate")] + [F.asc_nulls_last(c) for c in _TIE]
    out = df.select(*PAGE_COLUMNS).orderBy(*order)
    if offset:
        out = out.offset(int(offset))
    return out.limit(limit)


SAMPLE_PRIME = 1000003
SAMPLE_MULT = 7919


def sample_key(seed: int, col: str = "flight_id"):
    """Deterministic pseudo-random rank in [0, SAMPLE_PRIME) from a key."""
    return ((F.col(col) % SAMPLE_PRIME) * SAMPLE_MULT + seed) % SAMPLE_PRIME


def within(value: int, most: int, what: str = "limit") -> int:
    """``value`` as an int in [1, most]; anything else is refused."""
    value = int(value)
    if not 1 <= value <= most:
        raise ValueError(f"{what} must be between 1 and {most}, not {value}")
    return value


def sample_rank(seed: int, col: str = "flight_id"):
    """Pseudo-random rank of a key: the MD5 of seed and key, as text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(col).cast("string")))


def sample_flights(flights: DataFrame, n: int = 100000, seed: int = 42, airline=None,
                   origin=None, dest=None, exact: bool = True) -> DataFrame:
    """O2 (``GET /api/flights``): n rows (at most 200000) in a seeded random
    order, repeatable across runs and engines.

    ``exact`` first counts the ranks' leading four digits (65,536 counts over
    two pruned columns), so only rows up to the digit at which n is reached
    are sorted; the result is the same without it.
    """
    n = within(n, MAX_SAMPLE, "n")
    df = by_keys(not_cancelled_strict(flights), airline, origin, dest).select(
        "flight_id", "flightdate", F.col("operating_airline").alias("airline"),
        "origin", "origincityname", "dest", "destcityname",
        F.col("depdelay").alias("dep_delay"), F.col("depdel15").alias("dep_del15"),
        "distance", "carrierdelay", "weatherdelay", "nasdelay", "securitydelay",
        "lateaircraftdelay").withColumn("_r", sample_rank(seed))
    order = ["_r", "flight_id", "airline", "origin", "dest", "distance"]
    if exact:
        lead = F.substring("_r", 1, 4)
        seen = 0
        for digits, rows in sorted(tuple(r) for r in df.groupBy(lead.alias("d")).count()
                                   .where("d IS NOT NULL").collect()):
            seen += rows
            if seen >= n:
                df = df.where(lead <= F.lit(digits))
                break
    return df.orderBy(*[F.asc_nulls_last(c) for c in order]).limit(n).drop("_r")


def gold_top(gold: DataFrame, airline=None, origin=None, limit: int = 200) -> DataFrame:
    """O3 (``GET /flights/stats``): gold rows by delay rate, highest first
    (NULLs first as in PostgreSQL DESC), route as tie-break."""
    g = by_keys(gold, airline, origin)
    return (g.select("operating_airline", "origin", "dest", "total_flights", "avg_dep_delay",
                     "delayed_count", "delay_rate_pct", "avg_carrier_delay", "avg_weather_delay")
             .orderBy(F.desc_nulls_first("delay_rate_pct"), "operating_airline", "origin", "dest")
             .limit(limit))


def busy_routes(gold: DataFrame, min_flights: int = 10, max_delay: float | None = None,
                limit: int = 500) -> DataFrame:
    """O4 (``GET /routes``): gold rows with >= min_flights (and mean delay <=
    max_delay, 0 included), most flights first."""
    g = gold.where(F.col("total_flights") >= min_flights)
    g = at_most(g, "avg_dep_delay", max_delay)
    return (g.select("origin", "dest", "total_flights", "avg_dep_delay", "delay_rate_pct",
                     "avg_distance", "operating_airline")
             .orderBy(F.desc("total_flights"), "origin", "dest", "operating_airline")
             .limit(limit))


def airports_sorted(airports: DataFrame) -> DataFrame:
    """Every airport ordered by code."""
    return airports.orderBy("iata")


def airport_by_code(airports: DataFrame, code: str) -> DataFrame:
    """One airport (empty frame = not found); code upper-cased."""
    return airports.where(F.col("iata") == F.lit(code.upper()))
