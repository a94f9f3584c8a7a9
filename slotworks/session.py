"""Session defaults and the shared scratch folder."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Estimated bytes (of compressed columns, for a scan) of a piece of `spread`.
PIECE_BYTES = 16 << 20
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even where that adds a shuffle behind the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: str | int = "*", app: str = "slotworks", **conf) -> SparkSession:
    """A local session for tests and benchmarks; a cluster passes its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    small = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
             "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "12g"),
             "spark.ui.showConsoleProgress": "false"}
    for key, value in {**DEFAULTS, **small, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A temporary one is made in local mode only, where
    driver and tasks share the machine; a cluster without one is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="slotworks-"))
    return named or sc.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that outlives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a small input by its keys, so that a few files (or one big
    row group) do not leave cores idle under CPU-heavy work.

    Decided from the optimizer's size estimate: from one default split per core
    on, the scan is parallel enough and nothing is shuffled. Below that a piece is
    `PIECE_BYTES` of the estimate at the most, however few the cores, so what a task
    sorts or groups does not grow with the input.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-size // PIECE_BYTES)), *keys) if size < cores * 128 * 1024 * 1024 else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for staging writes."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once below the shared folder and read it again: what is behind it runs once, its size is known, and it outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
