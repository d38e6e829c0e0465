"""Spark session and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the engine relies on; every one is a public Spark configuration.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Streaming state (visitor/session get-or-create aggregates have no time key) lives in
    # RocksDB off the JVM heap; changelog checkpointing commits only each batch's changes.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Runtime bloom filters prune the big side of a shuffle join by the keys of a selective
    # side (e.g. all sessions by the period's page views in the top-pages join). Spark skips
    # them when the selective side is estimated over 10 MB, which a day of a large site is;
    # the filter itself stays capped by its bit budget, so allow a larger side to build it.
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
    # Call-site capture for error messages costs several driver round trips per Column call;
    # plans built from many expressions are assembled much faster without it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_spark(master: str | None = None, app_name: str = "webtraffic",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    On a cluster the master and sizing come from ``spark-submit``; pass ``master`` only for
    local runs and tests.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and materialised tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only a local-mode
    session without one gets a fresh temporary folder; a cluster without one is an error,
    because a machine-local folder is not visible to other executors.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="webtraffic-ckpt-")
    sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A unique path under the checkpoint root, scoped to this application."""
    root = checkpoint_root(spark)
    app = spark.sparkContext.applicationId
    return "/".join([root, "webtraffic", app, *parts, uuid.uuid4().hex[:12]])


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove scratch output that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


__all__ = ["get_spark", "checkpoint_root", "scratch_path", "drop_scratch", "is_local", "DEFAULT_CONF"]
