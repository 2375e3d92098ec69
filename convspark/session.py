"""SparkSession construction and the few session-level settings we rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job benefits from; the driver's own session may not have
# them, so no operator depends on them for correctness.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# Only for the local JVM we start ourselves (tests, bench, checks).
LOCAL_CONF = {
    "spark.driver.memory": "12g",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "convspark", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with our defaults.

    ``shuffle_partitions`` should be sized from the data: at cluster scale
    aim for ~128-256 MB of shuffle data per partition; AQE then coalesces.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf.update(LOCAL_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator to a shared file system; we only
    fall back to a scratch folder when it is unset and the master is local
    (tests); on a cluster an unset folder is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="convspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for data a job lands
    and reads back (never a machine-local temp folder on a cluster)."""
    import uuid

    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/convspark/{name}/{uuid.uuid4().hex}"


def materialize(df, name: str = "stage"):
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back: the lineage is cut, and a lost executor costs a re-read of this
    table instead of a recompute of everything before it.  (Never
    ``localCheckpoint``: its blocks die with the executor.)"""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
