"""Session helpers: a local session for tests and lineage cutting that
respects the cluster's ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "proofsheet", cpus: int | str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session used by tests and the bench.  On a cluster the caller
    builds its own session; nothing in the library depends on this one."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PROOFSHEET_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # CP1256 and other legacy code pages need this in Spark 4.
        .config("spark.sql.legacy.javaCharsets", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder reliable checkpoints go to: the one already set on the
    context, else the one the cluster names in ``spark.checkpoint.dir``.  Only
    a ``local[*]`` session without either gets a scratch folder; a cluster
    without a shared folder is an error, never a machine-local path."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="proofsheet-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read
    back: compressed, survives lost executors, and is computed once."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.  Survives the
    loss of any executor (unlike a local checkpoint or a cache)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
