"""Session settings and the shared folder for checkpoints and staged tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Similarity work is heavy per row: small stages still use all cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Text cells are long; small Arrow batches keep Python workers within memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  driver_memory: str | None = None, app: str = "clauseloom") -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


#: What one Arrow batch holds at most while ``small_batches`` is in force.
SMALL_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans run inside send texts to Python in batches that fit an executor's memory, whatever session they are given.

    A batch is held several times, by the JVM that fills it and by the worker. Smaller limits of the session stay.
    """
    before = {key: spark.conf.get(key, None) for key in SMALL_BATCH}
    for key, most in SMALL_BATCH.items():
        own = before[key]
        if not (own and own.isdigit() and 0 < int(own) < most):
            spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, own in before.items():
            spark.conf.unset(key) if own is None else spark.conf.set(key, own)


_own_dirs: dict[str, str] = {}
_stored: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Where neither is set, a local session gets a temporary folder; on a cluster that is an error, as executors would not see
    each other's files.
    """
    context = spark.sparkContext
    app = context.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        base = _own_dirs[app]
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _stored.setdefault(app, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the tables that operators have stored for this application so far; results that read them must be done with."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = _stored.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder.

    Operators that scan a result of a scan again do this in between: both
    branches of the next scan then read a table instead of repeating the plan,
    and a lost executor costs a re-read.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables that ``materialize`` has returned and no later step reads.

    Spark drops the shuffle files of finished steps when their plans are collected as garbage, which is asked for as well: long chains
    of steps would keep them on disk until the driver's heap is full.
    """
    for table in stored:
        spark, path = table.sparkSession, table._stored_at
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        _stored.get(spark.sparkContext.applicationId, [path]).remove(path)
    gc.collect()
    if stored:
        stored[0].sparkSession._jvm.java.lang.System.gc()
