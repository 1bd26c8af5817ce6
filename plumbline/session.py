"""Session helpers shared by tests, the benchmark and the entry points."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # plans here have thousands of expressions; recording a Python call site for each is slow
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("plumbline")
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def _local_folder(spark: SparkSession, prefix: str) -> str:
    """A temporary folder, in a local session only: other machines would not see it."""
    master = spark.conf.get("spark.master", "local")
    if master.split("[")[0] != "local":
        raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder.

    Only a session that names no folder (local tests) gets a temporary one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(configured or _local_folder(spark, "plumbline-ckpt-"))
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder beside the checkpoints: shared on a cluster, temporary in local tests."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        return _local_folder(spark, "plumbline-")
    return f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"
