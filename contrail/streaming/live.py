"""Structured Streaming over landed live-state polls.

* T1 ingest: ``readStream.json(landing)`` -> parse -> airborne filter -> Parquet
  sink with a checkpoint; ``trigger(availableNow=True)`` drains what has landed
  and stops, so a scheduled job and a long-running one share one plan.
* T2 duplicate suppression by (icao24, collected_at) with a watermark, so
  the dedupe state is bounded in time.
* T3 latest position per aircraft: streaming max-by aggregation in update
  mode; each micro-batch writes its changed aircraft only, and the change
  sets are merged from time to time, never through the driver.
* T4 airborne reports per country per tumbling window, watermark-bounded,
  append mode (a window is written once it can no longer change).

Every query restarts from its checkpoint after a failure (exactly-once file
sink / idempotent change sets). Late reports beyond the watermark are dropped:
``late_reports`` tells how many.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contrail.session import checkpoint_root, path_exists
from contrail.sources.live import (CHECKED_SCHEMA, LIVE_COLUMNS, SNAPSHOT_SCHEMA, checked_states,
                                   clean_states, latest_per_aircraft, parse_snapshots)
from contrail.sources.store import BatchTable


def live_stream(spark: SparkSession, landing: str, limit: int | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of cleaned airborne states from landed polls."""
    r = spark.readStream.schema(SNAPSHOT_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return clean_states(parse_snapshots(r.json(landing), limit)).drop("_pos")


def new_run_dir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/contrail-streams/{name}-{uuid.uuid4().hex[:12]}"


def ingest(stream: DataFrame, sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append cleaned states to a Parquet table."""
    w = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return w.start(sink)


def checked_stream(spark: SparkSession, landing: str,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``checked_states`` of landed polls, malformed lines included."""
    r = (spark.readStream.schema(CHECKED_SCHEMA).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", "_line"))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return checked_states(r.json(landing).select("*", F.col("_metadata.file_name").alias("source")))


def write_both(good_dir: str, reject_dir: str):
    """foreachBatch writer: an epoch's good states and its dead letters, each
    as one batch of a ledger table. An epoch that runs again (after a crash
    between the two writes, or behind them) replaces its own rows."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # parsed once for both tables
        try:
            good = clean_states(batch.where("reason IS NULL")).select(*LIVE_COLUMNS)
            bad = batch.where("reason IS NOT NULL").select(
                "reason", "collected_at", "icao24", "report", "source")
            BatchTable(spark, good_dir).append(good, f"epoch-{epoch}")
            BatchTable(spark, reject_dir).append(bad, f"epoch-{epoch}")
        finally:
            batch.unpersist()
    return write


def ingest_checked(stream: DataFrame, good_dir: str, reject_dir: str, checkpoint: str,
                   once: bool = True) -> StreamingQuery:
    """T1 with rejects: airborne states to one table, malformed reports with
    reason and source file to another. The query's progress carries the metric
    ``states`` (all and rejected). A lost checkpoint needs new tables."""
    seen = stream.observe("states", F.count(F.lit(1)).alias("all"),
                          F.count("reason").alias("rejected"))
    w = (seen.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(write_both(good_dir, reject_dir)))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return w.start()


def dedupe(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeated (icao24, collected_at) reports within the watermark."""
    return (stream.withWatermark("collected_at", delay)
                  .dropDuplicatesWithinWatermark(["icao24", "collected_at"]))


def late_reports(q: StreamingQuery) -> int:
    """Rows the query's stateful operators dropped behind the watermark."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in q.recentProgress
               for op in p["stateOperators"])


def latest_state(stream: DataFrame) -> DataFrame:
    """T3 aggregation: newest report per aircraft (struct max, update mode)."""
    rest = [c for c in stream.columns if c not in ("icao24", "collected_at", "time_position",
                                                   "last_contact")]
    s = F.struct("collected_at", "time_position", "last_contact", *rest)
    return (stream.groupBy("icao24").agg(F.max(s).alias("_s"))
                  .select("icao24", *[F.col(f"_s.{c}").alias(c) for c in
                                      ["collected_at", "time_position", "last_contact", *rest]]))


# Change sets kept beside one another before they are merged into one.
COMPACT_AFTER = 16


def _folders(spark: SparkSession, table_dir: str) -> list[str]:
    """Names of the finished change sets (a folder listing, no data)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(table_dir)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n for n in names if n.startswith(("e=", "base="))
                  and path_exists(spark, f"{table_dir}/{n}/_SUCCESS"))


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_changes(table_dir: str):
    """foreachBatch writer: each epoch writes only the aircraft it changed, in
    a folder of its own (running an epoch again rewrites it). Once
    ``COMPACT_AFTER`` change sets lie there they are merged into one base and
    removed. A row never replaces a newer one, so neither a lost checkpoint
    (epochs start at 0 again) nor a merge that ran twice changes the result.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{table_dir}/e={epoch:012d}")
        done = _folders(spark, table_dir)
        if len(done) > COMPACT_AFTER:
            base = f"{table_dir}/base={epoch:012d}-{uuid.uuid4().hex[:8]}"
            _newest(spark, table_dir, done).write.parquet(base)
            for name in done:
                _remove(spark, f"{table_dir}/{name}")
    return write


def _newest(spark: SparkSession, table_dir: str, names: list[str]) -> DataFrame:
    rows = spark.read.parquet(*[f"{table_dir}/{n}" for n in names])
    return latest_per_aircraft(rows)


def latest_version(spark: SparkSession, table_dir: str) -> DataFrame:
    """The newest report per aircraft over all change sets."""
    names = _folders(spark, table_dir)
    if not names:
        raise FileNotFoundError(table_dir)
    return _newest(spark, table_dir, names)


def track_latest(stream: DataFrame, table_dir: str, checkpoint: str,
                 once: bool = True) -> StreamingQuery:
    """Maintain the latest-position table. State and table hold one row
    per aircraft ever seen."""
    w = (latest_state(stream).writeStream.outputMode("update")
         .option("checkpointLocation", checkpoint)
         .foreachBatch(write_changes(table_dir)))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return w.start()


def window_counts(stream: DataFrame, minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """T4: airborne reports per origin country per tumbling window."""
    w = F.window("collected_at", f"{minutes} minutes")
    return (stream.withWatermark("collected_at", delay)
                  .groupBy(w.alias("w"), "origin_country")
                  .agg(F.count(F.lit(1)).alias("aircraft_reports"))
                  .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          "origin_country", "aircraft_reports"))


def run_to_completion(q: StreamingQuery) -> None:
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover - surfaced to caller
        raise RuntimeError(str(q.exception()))
