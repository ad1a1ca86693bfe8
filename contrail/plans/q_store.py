"""Sinks that survive retries (S6, S8, S9, S11), written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.plans.oracle import with_base
from contrail.plans.q_checks import _LIVE_COLS, _SINK_COLS
from contrail.plans.registry import ORACLE, register
from contrail.sources import live as L
from contrail.sources import raw as R
from contrail.sources.store import BatchTable, KeyedTable
from contrail.sources.tables import flights
from contrail.streaming.live import new_run_dir


@register("s6_append_exactly_once", with_base(f"SELECT {', '.join(_SINK_COLS)} FROM flights"))
def s6_once(spark, sf):
    """Half-years as batches: the first is appended twice, the second by a
    writer that dies before publishing (its rows are wrong) and by another."""
    path = f"{new_run_dir(spark, 's6-once')}/bronze"
    f = flights(spark, sf).select(*_SINK_COLS)
    first, second = f.where(F.month("flightdate") <= 6), f.where(F.month("flightdate") > 6)
    R.append_bronze_batch(first, path, "2024-first")
    R.append_bronze_batch(first, path, "2024-first")
    BatchTable(spark, path, ("flight_month",)).stage(
        first.withColumn("flight_month", F.lit(0)).withColumn("ingested_at", F.current_timestamp()))
    return R.append_bronze_batch(second, path, "2024-second").read().select(*_SINK_COLS)


@register("s11_append_live_exactly_once", ORACLE["s11_append_live_store"])
def s11_once(spark, sf):
    path = f"{new_run_dir(spark, 's11-once')}/live"
    live = L.live_flights(spark, sf)
    south, north = live.where("latitude < 0"), live.where("latitude >= 0")
    L.append_live_batch(north, path, "poll-1")
    L.append_live_batch(south, path, "poll-2")
    return L.append_live_batch(south, path, "poll-2").read().select(*_LIVE_COLS)


@register("s9_keyed_table_upserts", with_base("""
SELECT origin, dest, CASE WHEN COUNT(*) >= 60 THEN COUNT(*) + 5000 WHEN COUNT(*) >= 30 THEN COUNT(*) + 1000
  ELSE COUNT(*) END AS flights
FROM flights GROUP BY origin, dest"""))
def s9_table(spark, sf):
    """The route table: created, then two upserts of the busy and the busiest
    routes (an older and a newer row of each), read back from disk."""
    counts = flights(spark, sf).groupBy("origin", "dest").agg(F.count(F.lit(1)).alias("flights"))
    table = KeyedTable(spark, f"{new_run_dir(spark, 's9')}/routes", ["origin", "dest"])
    table.upsert(counts, ["flights"])
    for least, more in ((30, 1000), (60, 5000)):
        busy = counts.where(F.col("flights") >= least)
        table.upsert(busy.selectExpr("origin", "dest", f"flights + {more} AS flights").union(
            busy.selectExpr("origin", "dest", f"flights + {more - 500} AS flights")), ["flights"])
    return table.read()


@register("s8_keyed_table_inserts", ORACLE["s8_airlines_insert_if_absent"])
def s8_table(spark, sf):
    """The airline table: seeded, then the carriers of the flights that it
    lacks, twice."""
    table = KeyedTable(spark, f"{new_run_dir(spark, 's8')}/airlines", ["code"])
    table.insert_if_absent(R.seed_airlines(spark), ["name"])
    for _ in range(2):
        table.insert_if_absent(R.airlines_table(spark, flights(spark, sf)), ["name"])
    return table.read()
