"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Session defaults every operator relies on: UTC wall clock (hour/weekday
# parity with DuckDB), AQE for runtime re-planning (coalescing, skew splits,
# runtime broadcast conversion driven by measured shuffle sizes).
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "vigil",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Local session for tests and bench; on a cluster use the provided one."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = (SparkSession.builder
               .master(master or f"local[{cpus}]")
               .appName(app)
               .config("spark.driver.memory", os.environ.get("VIGIL_DRIVER_MEM", "8g"))
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
               # checkpoints of the phased jobs are removed once their frames are gone
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    for k, v in {**_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in _DEFAULTS.items():
        if k != "spark.ui.enabled":
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and lineage-cutting tables.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as
    is. Only on a local master (tests) an unset one becomes a scratch folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        current = tempfile.mkdtemp(prefix="vigil-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder, computed once: the rows are
    persisted while the checkpoint job counts and writes them, then released.
    A lost executor later re-reads the checkpoint files, not the lineage."""
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out
