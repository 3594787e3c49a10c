"""SparkSession factory.

The library never creates a session behind the caller's back: every operator
takes a DataFrame (or a session handed in by the caller).  This module only
provides a sensible local/test session and helpers that read cluster settings.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of ours should carry.  AQE re-plans joins and
# coalesces shuffle partitions at runtime; UTC keeps timestamps comparable
# with other engines; the UI stays off (no servers in batch jobs).
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "boreframe", extra: dict | None = None) -> SparkSession:
    """Return the active session or build one.

    Under spark-submit (or with ``SPARK_MASTER`` set by a launcher) the master
    and the shuffle partitions are the launcher's; only a session of our own
    making is local.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    conf = dict(_BASE_CONF)
    own = master or os.environ.get("BOREFRAME_MASTER")
    launched = "PYSPARK_GATEWAY_PORT" in os.environ or "SPARK_MASTER" in os.environ
    if own or not launched:
        own = own or "local[*]"
        builder = builder.master(own)
        if own.startswith("local"):
            conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
            conf["spark.driver.memory"] = "8g"
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, setting a local one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is; without it a cluster session is refused.  Only local/test sessions
    without the setting get a scratch folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all "
                         "executors share; a machine-local folder would lose rows")
    local = tempfile.mkdtemp(prefix="boreframe-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint dir for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def stored(df, name: str):  # noqa: ANN001, ANN201
    """``df`` written to the shared folder, where compressed columns take a small
    part of what a checkpoint's rows do, and read back."""
    at = shared_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a finished step once the JVM has found
    that nobody refers to them, which on a roomy heap may be never."""
    spark.sparkContext._jvm.System.gc()


def spread_local(df, cols):  # noqa: ANN001, ANN201
    """Deal a scan of few files to all cores of a local session by ``cols``.

    A local test table is one file and would be one task.  On a cluster the
    scan is returned as it is, whatever its size.
    """
    spark = df.sparkSession
    if not spark.sparkContext.master.startswith("local"):
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, *cols) if len(df.inputFiles()) < cores else df
