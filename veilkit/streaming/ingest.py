"""Audit events from a queue or folder into the audit table; browser and network events join on the way."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilkit.operators import policy as P
from veilkit.operators import shadow
from veilkit.plans import requests
from veilkit.sources.audit import parse_events, rejected, to_audit

WATERMARK = "10 minutes"


def kafka_lines(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
            .option("startingOffsets", "earliest").load().select("value"))


def folder_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def audit_stream(lines: DataFrame) -> DataFrame:
    """The same transform as the batch path: parse, default, local time, month."""
    return to_audit(parse_events(lines))


def append(rows: DataFrame, path: str, checkpoint: str, *, partition: Sequence[str] = (), once: bool = True) -> StreamingQuery:
    """Append to a Parquet table. The checkpoint makes a restart exactly-once; `once` drains what is
    there and stops, otherwise the query keeps running."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if partition:
        writer = writer.partitionBy(*partition)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_audit(lines: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    return append(audit_stream(lines), path, checkpoint, partition=["month"], once=once)


def ingest_rejects(lines: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """The twin of `ingest_audit`: every line that it leaves out, with the reason. Run both on the same source."""
    return append(rejected(lines), path, checkpoint, partition=["problem"], once=once)


def _browser_events(lines: DataFrame, column: str) -> DataFrame:
    schema = "event_id string, event_time timestamp_ntz, " + shadow.EVENT_SCHEMA
    parsed = lines.select(F.col(column).cast("string").alias("_line"), F.from_json(F.col(column), schema).alias("e"))
    return shadow.validate(parsed.select("_line", "e.*"))


def browser_stream(lines: DataFrame, column: str = "value") -> DataFrame:
    """Browser events to audit rows; invalid ones are left to `browser_rejects`."""
    return shadow.to_audit(_browser_events(lines, column).filter("problem IS NULL").drop("_line"))


def browser_rejects(lines: DataFrame, column: str = "value") -> DataFrame:
    """(value, problem) of the lines that `browser_stream` leaves out: the first field that is out of bounds."""
    return _browser_events(lines, column).filter("problem IS NOT NULL").select(F.col("_line").alias("value"), "problem")


def network_stream(rows: DataFrame, policy: P.Policy, config) -> DataFrame:
    """Proxy requests (host, path, method, text, ...) to audit rows: known sites only, decided, recorded."""
    external = rows.withColumn("destination", F.lit("external")).withColumn("model", F.col("host"))
    seen = P.match_site(external).filter("site_name IS NOT NULL")
    scanned = requests.with_injection(requests.with_findings(seen, config))
    scanned = scanned.withColumn("entities", F.expr("array_sort(array_distinct(transform(findings, f -> f.entity)))"))
    decided = P.network_decision(P.evaluate(scanned, policy)).filter("recorded")
    return decided.select("event_id", "event_time", "user", "team", "teams", "model", "destination", F.lit("icap").alias("api_format"),
                          F.col("network_action").alias("action"), F.col("network_rules").alias("rules"), "entities", "injection_score",
                          F.sha2("text", 256).alias("prompt_sha256"), F.length("text").cast("bigint").alias("prompt_chars"))


def each_batch(rows: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], *, once: bool = True) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
