"""SparkSession construction and the shared checkpoint folder.

On a cluster the operator names a shared folder in ``spark.checkpoint.dir``;
we read it from the session and only fall back to a fresh local folder when
it is unset (unit tests, laptops).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every contrail job wants, whatever the cluster size.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Settings for a large cluster (hundreds of executors, tens of TB per job).
# AQE starts from many shuffle partitions and coalesces them to ~256 MB,
# splits skewed join partitions and rebalanced write partitions, and reads
# Parquet in 256 MB splits. The submitter's own --conf values win.
CLUSTER_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    # streaming state (dedupe keys, latest position, open windows) off the
    # JVM heap, with incremental changelog commits per micro-batch
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "contrail", extra: dict | None = None,
              cluster: bool = False) -> SparkSession:
    """Build (or reuse) a session with contrail's defaults.

    ``master``/``shuffle_partitions`` are only for local runs; on a cluster the
    submitter decides them (``cluster=True`` adds ``CLUSTER_DEFAULTS`` for
    keys the submitter did not set).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if cluster:
        from pyspark import SparkConf
        given = dict(SparkConf().getAll())
        for k, v in CLUSTER_DEFAULTS.items():
            if k not in given:
                b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised layers.

    Read from ``spark.checkpoint.dir``; set a private temp folder only when
    the session has none and runs in local mode (tests / laptops). A cluster
    session without the setting is an error, never a machine-local folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext handle
        sc = None
    d = sc.getConf().get("spark.checkpoint.dir", None) if sc is not None else None
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # pragma: no cover - conf absent
            d = None
    if not d:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "local")
        if not str(master).startswith("local"):
            # a machine-local folder is invisible to other executors and lost
            # with the driver: on a cluster the shared folder must be named
            raise RuntimeError("spark.checkpoint.dir is unset: name a shared folder "
                               "(e.g. on the cluster's distributed file system)")
        d = tempfile.mkdtemp(prefix="contrail-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` exists on whatever filesystem it names.

    Uses the Hadoop FileSystem of the session; sessions without a JVM handle
    fall back to a metadata-only read of the path.
    """
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        return bool(fs.exists(p))
    try:
        spark.read.format("binaryFile").load(path).schema  # noqa: B018 - resolves the path
        return True
    except Exception:  # noqa: BLE001 - missing path
        return False


def compiled_methods(spark: SparkSession) -> None:
    """A stage whose generated method is too long for the JVM's compiler (8000
    bytes of code) runs as separate, compiled projections instead of one
    interpreted method. A limit that the submitter has set is kept."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key, "65535") == "65535":
        spark.conf.set(key, "8000")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back: it is
    computed once however often it is used, and the planner knows its size (a
    join with it is a broadcast only when it is small)."""
    path = f"{checkpoint_root(df.sparkSession)}/contrail-stored/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Names, sizes and modification times of the files under ``paths``, from
    the store's own listing; only the paths where there is no JVM handle."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return "|".join(paths)
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            continue
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath().toUri().getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return "|".join(sorted(found))


def publish(spark: SparkSession, private: str, path: str) -> None:
    """Rename a finished folder into place; if another application was first,
    its result stays and this one is removed."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(private), jvm.org.apache.hadoop.fs.Path(path)
    fs = dst.getFileSystem(conf)
    if not fs.exists(dst):
        fs.mkdirs(dst.getParent())
        try:
            if fs.rename(src, dst) and not fs.exists(jvm.org.apache.hadoop.fs.Path(dst, src.getName())):
                return
        except Exception:  # noqa: BLE001 - lost the race: the other folder is complete
            if not path_exists(spark, path):
                raise
        # some stores move a folder into an existing one: take it out again
        fs.delete(jvm.org.apache.hadoop.fs.Path(dst, src.getName()), True)
    fs.delete(src, True)


def session_key(spark: SparkSession) -> str:
    """Unique per running application (ids of dead sessions can be reused)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - sessions without a SparkContext handle
        return spark.conf.get("spark.app.id", str(id(spark)))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (as ``--py-files`` would), once per
    application: the tasks import it."""
    key = session_key(spark)
    if key in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="contrail-ship-"), "contrail.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("contrail", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(key)


def abspath(p: str) -> str:
    return p if "://" in p else os.path.abspath(p)
