"""Session settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}   # temporary folders of local sessions

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str = "souba", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SOUBA_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")      # small tables keep their parallelism
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")               # else each Column asks for its call site
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and tables handed from one job to the next.

    The cluster names it in ``spark.checkpoint.dir``; a path without a scheme belongs to the cluster's default file
    system, as everywhere in Spark. Where it is unset, a local session (tests, the bench) gets a temporary folder and any
    other is refused: a folder of its own choice may be one machine's.
    """
    context = spark.sparkContext
    local = context.master.startswith("local[") or context.master == "local"
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named and local:
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="souba-")
        named = _LOCAL[context.applicationId]
    if not named:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(named)
    return named.rstrip("/")
