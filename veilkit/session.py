"""Session settings shared by tests, the benchmark and the registered queries."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 16 << 20


def build_session(app: str = "veilkit", cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("VEILKIT_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only where none is set (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        known = tempfile.mkdtemp(prefix="veilkit-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known


def spread(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Use every core for CPU-heavy projections: an input of fewer splits than cores (a small file of one
    row group) is spread out first. Large tables have more splits than that and stay where they are.

    Splits grow with the file and a row group is read by one of them, so where slim rows cost much CPU a caller
    names the rows a task may get: the number of tasks then grows with the table and none gets longer.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if task_rows is not None:
        tasks = -(-df.count() // task_rows)  # the footers tell
        if tasks > cores:
            return df.repartition(tasks)
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder so lost executors do not cost a rescan."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_batches(spark: SparkSession) -> None:
    """Python gets Arrow batches of limited bytes: by rows alone, a batch of large bodies has no bound. A smaller limit
    that is set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(name, None)
    if size is None or not size.isdigit() or not 0 < int(size) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
