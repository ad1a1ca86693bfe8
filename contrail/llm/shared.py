"""Scratch tables in the shared folder, bounded Arrow batches, small helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.session import checkpoint_root, ship_package

# Rows per Arrow batch between the JVM and Python: whole texts travel in
# these batches, so this bounds a worker's memory.
BATCH_ROWS = 256

# Spark's switch that deletes a query's shuffle files when the query has ended.
_END_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate Parquet tables of one operator run.

    They live under ``spark.checkpoint.dir`` (shared by all executors), so a
    lost executor never loses them. ``drop`` removes one as soon as its
    successor is written; the ones a returned lazy DataFrame reads stay.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/contrail-llm/{tag}-{uuid.uuid4().hex[:12]}"
        self.saved: set[str] = set()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        ship_package(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        # the job that writes a table runs once, so its shuffle files go with it
        before = self.spark.conf.get(_END_CLEANUP, None)
        self.spark.conf.set(_END_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            if before is None:
                self.spark.conf.unset(_END_CLEANUP)
            else:
                self.spark.conf.set(_END_CLEANUP, before)
        self.saved.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(n))
            p.getFileSystem(conf).delete(p, True)
            self.saved.discard(n)

    def release(self) -> None:
        """After a large table is written its job's shuffle files are needed no
        more. Spark's cleaner deletes them when the driver's JVM has collected
        the job's frames, which a driver with memory to spare does late."""
        self.spark._jvm.System.gc()

    def keep(self, *names: str) -> None:
        """Drop every table but these."""
        self.drop(*sorted(self.saved - set(names)))


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns (backtick-safe), whatever else the table has."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def binary_values(column: pa.Array) -> list:
    """Python bytes (or None) of a string column, without decoding to str."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tidy(task):
    """The task, after which the worker gives freed memory back: workers live
    on, and would keep the largest task's memory beside the JVM's."""
    def run(batches):
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
            if trim is not None:
                trim(0)
    return run


def concat_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema,
                   rows: int = 65536) -> Iterator[pa.RecordBatch]:
    """Merge small batches before they go back to the JVM."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held, schema).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held, schema).combine_chunks().to_batches()[0]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of consecutive rows with equal integer keys, across batches.

    The input must be sorted by ``keys`` within the partition; one group at a
    time is held.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if b.num_rows == 0:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        cuts = np.flatnonzero(change).tolist()
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for cut in cuts:
            held.append(b.slice(start, cut - start))
            yield pa.Table.from_batches(held)
            held, start = [], cut
        held.append(b.slice(start))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)
