"""Session construction and lineage cuts.

On a cluster the session comes from the platform; ``get_session`` only fills
in settings that are unset.  ``checkpoint_dir`` reads ``spark.checkpoint.dir``
from the session, never overriding what the cluster names.  Where it is unset a
local master (tests) gets a scratch folder, and any other master an error: a
folder of the driver's machine is not seen by executors.
"""

from __future__ import annotations

import itertools
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "trafficlens",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Return the running session (settings untouched except unset defaults) or build one."""
    wanted = dict(_DEFAULTS)
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    wanted.update(extra or {})
    active = SparkSession.getActiveSession()
    if active is not None:
        for k, v in _DEFAULTS.items():
            if active.conf.get(k, None) is None:
                try:
                    active.conf.set(k, v)
                except Exception:  # noqa: BLE001 - static confs cannot change on a live session
                    pass
        checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in wanted.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, taken from the session."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="trafficlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables; it stays until ``release_scratch``."""
    return os.path.join(_scratch_root(spark), f"{name}-{next(_counter)}-{os.urandom(4).hex()}")


def _scratch_root(spark: SparkSession) -> str:
    return os.path.join(checkpoint_dir(spark), "tables", spark.sparkContext.applicationId)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the shared file system has ``path``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def release_scratch(spark: SparkSession) -> bool:
    """Delete every table that this application wrote by ``scratch_path``; results that still read them are void.

    For the end of a job.  Checkpoints go with their tables where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    return path.getFileSystem(conf).delete(path, True)


_counter = itertools.count(1)


def session() -> SparkSession:
    """The running session, in threads too."""
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared folder as a compressed table and read back: a lineage cut for rows that are many."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
