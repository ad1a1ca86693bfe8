"""Table sinks that survive retries and dying writers.

Both tables write data into folders of their own and publish them with one
small file, renamed into place; a reader follows only published files. A writer
that dies before the rename leaves the table as it was, and its folder is
rubbish that ``vacuum`` removes.

``BatchTable`` appends batches by id. Its ledger has one entry per batch, so a
batch that is written again replaces the rows of its first try instead of adding
to them.

``KeyedTable`` holds one row per key in buckets by key hash. A merge reads and
rewrites only the buckets that the changes touch; a new manifest names the new
folders for these and the old ones for the rest. Older manifests stay readable.
Writers that meet merge again on top of the one that came first.

The driver holds one line per batch or bucket. Paths are relative to the table,
so it can be moved as a whole.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contrail.operators.windows import latest_per_key
from contrail.session import path_exists

BUCKETS = 64
_TRIES = 10


class _Folder:
    """Files of one table, through the session's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _handle(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.at(name))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self, name: str) -> list[str]:
        fs, p = self._handle(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def publish(self, name: str, content: dict) -> bool:
        """Write a file under a private name and rename it; False if it exists."""
        fs, target = self._handle(name)
        if fs.exists(target):
            return False
        fs.mkdirs(target.getParent())
        _, private = self._handle(f"{name.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
        out = fs.create(private, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        done = bool(fs.rename(private, target))
        if not done:
            fs.delete(private, False)
        return done

    def read(self, name: str) -> dict:
        fs, p = self._handle(name)
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        fs, p = self._handle(name)
        fs.delete(p, True)


def _load(folder: _Folder, schema: StructType, folders: list[str]) -> DataFrame:
    spark = folder.spark
    if not folders:
        return spark.createDataFrame([], schema)
    # below one base path, so batches may be partitioned inside
    return (spark.read.option("basePath", folder.at("data")).schema(schema)
            .parquet(*[folder.at(f) for f in folders]).select(*[F.col(f"`{n}`") for n in schema.names]))


class BatchTable:
    """Append-only table of batches, each present once however often it is written."""

    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = ()):
        self._folder, self._partition_by = _Folder(spark, path), partition_by

    def _entries(self) -> dict[str, tuple[int, dict]]:
        """Per batch key its newest entry: files are ``<key>.<try>.json``."""
        newest: dict[str, int] = {}
        for name in self._folder.names("ledger"):
            if not name.startswith(".") and name.endswith(".json"):
                key, attempt, _ = name.split(".")
                newest[key] = max(newest.get(key, 0), int(attempt))
        return {k: (n, self._folder.read(f"ledger/{k}.{n}.json")) for k, n in newest.items()}

    def stage(self, df: DataFrame) -> dict:
        """Write the rows without publishing them."""
        name = f"data/_batch={uuid.uuid4().hex}"
        df.write.partitionBy(*self._partition_by).parquet(self._folder.at(name))
        # a partitioned frame without rows leaves no partition folder to read
        holds = not self._partition_by or any("=" in n for n in self._folder.names(name))
        return {"folder": name, "holds_rows": holds, "schema": df.schema.jsonValue()}

    def commit(self, batch_id: str, staged: dict) -> None:
        """Publish staged rows as the batch, in place of any earlier try."""
        key = hashlib.sha256(batch_id.encode()).hexdigest()[:32]
        for _ in range(_TRIES):
            attempt = self._entries().get(key, (0, None))[0] + 1
            if self._folder.publish(f"ledger/{key}.{attempt}.json", {"batch": batch_id, **staged}):
                return
        raise RuntimeError(f"batch {batch_id!r}: other writers kept publishing it")

    def append(self, df: DataFrame, batch_id: str) -> None:
        self.commit(batch_id, self.stage(df))

    def batches(self) -> list[str]:
        return sorted(e["batch"] for _, e in self._entries().values())

    def read(self) -> DataFrame:
        """Rows of every published batch; all batches have one schema."""
        entries = [e for _, e in self._entries().values()]
        if not entries:
            raise ValueError(f"no batch is published in {self._folder.path}")
        schema = StructType.fromJson(entries[0]["schema"])
        columns = {(f.name, f.dataType.simpleString()) for f in schema}
        if any({(f.name, f.dataType.simpleString()) for f in StructType.fromJson(e["schema"])} != columns
               for e in entries):
            raise ValueError("batches have different columns")
        return _load(self._folder, schema, sorted(e["folder"] for e in entries if e["holds_rows"]))

    def vacuum(self) -> None:
        """Remove replaced and unpublished rows; no writer may be at work."""
        entries = self._entries()
        kept = {e["folder"] for _, e in entries.values()}
        for name in self._folder.names("data"):
            if f"data/{name}" not in kept:
                self._folder.remove(f"data/{name}")
        for name in self._folder.names("ledger"):
            parts = name.split(".")
            if name.startswith(".") or int(parts[1]) < entries[parts[0]][0]:
                self._folder.remove(f"ledger/{name}")


class KeyedTable:
    """One row per key, merged bucket by bucket."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        if not keys or buckets < 1:
            raise ValueError("keys must be named and buckets be 1 at least")
        self.spark, self.keys, self.buckets = spark, list(keys), buckets
        self._folder = _Folder(spark, path)

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self._folder.names("manifests") if not n.startswith("."))

    def _manifest(self, version: int | None = None) -> dict | None:
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        m = self._folder.read(f"manifests/{version:012d}.json")
        if m["keys"] != self.keys:
            raise ValueError(f"the table's keys are {m['keys']}")
        return m

    def read(self, version: int | None = None) -> DataFrame:
        m = self._manifest(version)
        if m is None:
            raise ValueError(f"nothing is published in {self._folder.path}")
        return _load(self._folder, StructType.fromJson(m["schema"]), sorted(m["folders"].values()))

    def _in_buckets(self, df: DataFrame, buckets: int) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(buckets))
        return df.withColumn("_bucket", bucket.cast("int"))

    def _same_key(self, left: str, right: str):
        return reduce(lambda a, b: a & b, [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
                                           for k in self.keys])

    def upsert(self, changes: DataFrame, order: list[str]) -> int:
        """Rows replace those of the same key; of several the one greatest by
        ``order`` (then by the other columns). Returns the new version."""
        return self._merge(latest_per_key(changes, self.keys, order), replace=True)

    def insert_if_absent(self, rows: DataFrame, order: list[str]) -> int:
        """Rows of keys that the table lacks; of several the greatest by ``order``."""
        return self._merge(latest_per_key(rows, self.keys, order), replace=False)

    def _merge(self, changes: DataFrame, replace: bool) -> int:
        staged = f"staged/{uuid.uuid4().hex}"
        schema = changes.schema
        try:
            for _ in range(_TRIES):
                m = self._manifest()
                buckets = m["buckets"] if m else self.buckets
                if m:
                    schema = StructType.fromJson(m["schema"])
                    changes = changes.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema])
                if not path_exists(self.spark, self._folder.at(staged)):
                    # read back from disk: the touched buckets and the merge see the same rows
                    changes.write.parquet(self._folder.at(staged))
                new = self._in_buckets(self.spark.read.schema(schema).parquet(self._folder.at(staged)), buckets)
                touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())
                folders = dict(m["folders"]) if m else {}
                old = _load(self._folder, schema, [folders[str(b)] for b in touched if str(b) in folders])
                target = f"data/_merge={uuid.uuid4().hex}"
                if touched:
                    old = self._in_buckets(old, buckets)
                    a, b = old.alias("old"), new.alias("new")
                    if replace:
                        merged = a.join(b, self._same_key("old", "new"), "left_anti").unionByName(new)
                    else:
                        merged = old.unionByName(b.join(a, self._same_key("new", "old"), "left_anti"))
                    (merged.hint("rebalance", "_bucket").write.partitionBy("_bucket")
                     .parquet(self._folder.at(target)))
                    folders.update({str(b): f"{target}/_bucket={b}" for b in touched})
                version = (m["version"] if m else 0) + 1
                if self._folder.publish(f"manifests/{version:012d}.json", {
                        "version": version, "keys": self.keys, "buckets": buckets,
                        "schema": schema.jsonValue(), "folders": folders}):
                    return version
                self._folder.remove(target)
            raise RuntimeError("other writers kept publishing; nothing was merged")
        finally:
            self._folder.remove(staged)

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the newest ``keep`` versions; no writer may be at work."""
        kept = self.versions()[-max(1, keep):]
        used = {f.split("/")[1] for v in kept for f in self._manifest(v)["folders"].values()}
        for name in self._folder.names("data"):
            if name not in used:
                self._folder.remove(f"data/{name}")
        for v in self.versions():
            if v not in kept:
                self._folder.remove(f"manifests/{v:012d}.json")
        self._folder.remove("staged")
