"""Scan results kept between runs: a table by content hash and configuration; only texts not in it are scanned."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilkit.functions.arrays import pinned
from veilkit.operators.scan import FINDINGS_TYPE, ScanConfig, findings_sql

STORED = f"sha string, findings {FINDINGS_TYPE}, prefix string"


def fingerprint(config: ScanConfig) -> str:
    """Any change of a recognizer, a term, an exemption or a limit changes the compiled scan, and this with it."""
    return hashlib.sha256(findings_sql("t", config).encode()).hexdigest()[:16]


def _folder(path: str, config: ScanConfig) -> str:
    return f"{path}/config={fingerprint(config)}"


def stored(spark: SparkSession, path: str, config: ScanConfig) -> DataFrame:
    """(sha, findings, prefix) of the texts scanned so far with this configuration."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_folder(path, config))
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(_folder(path, config))


def keyed(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("_sha", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def unseen(df: DataFrame, path: str, config: ScanConfig = ScanConfig(), *, text: str = "text") -> DataFrame:
    """(sha, text) of the distinct texts that the store does not have; the anti-join sees hashes, and copies are combined
    before texts move."""
    known = stored(df.sparkSession, path, config).select(F.col("sha").alias("_sha"))
    return (keyed(df, text).groupBy("_sha").agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("text")).join(known, "_sha", "left_anti")
            .withColumnRenamed("_sha", "sha"))


def scan_stored(df: DataFrame, path: str, config: ScanConfig = ScanConfig(), *, text: str = "text") -> DataFrame:
    """Adds `findings`. Texts that the store lacks are scanned and added to it, by hash prefix; the others are looked up.
    Runs at the same time may add a text twice, which changes nothing."""
    spark = df.sparkSession
    fresh = unseen(df, path, config, text=text).withColumn("findings", F.expr(pinned(findings_sql("text", config))))
    (fresh.select("sha", "findings", F.substring("sha", 1, 2).alias("prefix")).repartition("prefix")
     .write.mode("append").partitionBy("prefix").parquet(_folder(path, config)))
    found = stored(spark, path, config).filter(F.size("findings") > 0).groupBy("sha").agg(F.first("findings").alias("findings"))
    none = F.expr(f"cast(array() AS {FINDINGS_TYPE})")
    return (keyed(df, text).join(found.withColumnRenamed("sha", "_sha"), "_sha", "left")
            .withColumn("findings", F.coalesce("findings", none)).drop("_sha"))
