"""Session helpers: a tuned builder for local runs and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


LOCAL_CONF = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"}


def is_local(master: str | None) -> bool:
    """One process on one machine (``local[8]``), not a cluster of any kind."""
    return bool(master) and re.fullmatch(r"local(\[.*\])?", master) is not None


def get_spark(master: str | None = None, app: str = "curio", shuffle_partitions: int | None = None,
              driver_memory: str | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session. On a cluster pass ``master=None`` and let spark-submit decide:
    shuffle partitions and driver memory have defaults of their own only for a local master."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = DEFAULT_CONF | (LOCAL_CONF if is_local(master) else {})
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory is not None:
        conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (a shared filesystem or object store); a machine-local temp
    folder would be lost with the executor. Only a local-mode session (tests) gets its own folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server's setting is authoritative
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        return d.rstrip("/")
    d = sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = sc.master
        if not is_local(master):  # local-cluster has executors of its own
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="curio-ckpt-", dir=os.environ.get("CURIO_TMP", "/tmp"))
    sc.setCheckpointDir(d)
    got = sc.getCheckpointDir()
    return (got or d).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for a written table."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
