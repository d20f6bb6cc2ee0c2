"""Audit events: schema, readers, month-partitioned storage, retention, emission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from veilkit import fixed

EVENT_SCHEMA = ", ".join(f"`{name}` {kind}" for name, kind in fixed.AUDIT_EVENT_FIELDS)
_NULLABLE = {"est_cost_usd"}
BLOOM_ROWS = 200_000


def _default(kind: str) -> str:
    if kind.startswith("array"):
        return f"cast(array() AS {kind})"
    return "''" if kind == "string" else f"cast(0 AS {kind})"


def typed(events: DataFrame) -> DataFrame:
    """Missing fields become empty or zero; only the cost keeps NULL, which means unknown."""
    return events.selectExpr(*[
        f"`{n}`" if n in _NULLABLE else f"coalesce(`{n}`, {_default(k)}) AS `{n}`" for n, k in fixed.AUDIT_EVENT_FIELDS])


def read_audit_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a fixed schema: no inference pass, unknown fields dropped."""
    return typed(spark.read.schema(EVENT_SCHEMA).json(path))


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Audit events from a text or Kafka value column; rows that are no JSON object are left to `rejected`."""
    parsed = lines.select(F.from_json(F.col(column).cast("string"), EVENT_SCHEMA).alias("e")).filter("e IS NOT NULL")
    return typed(parsed.select("e.*"))


def rejected(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines that never reach the audit table, as (value, problem): `json` or `event_id`. Batch or stream."""
    line = F.col(column).cast("string")
    event_id = F.coalesce(F.get_json_object(line, "$.event_id"), F.lit(""))
    problem = (F.when(F.get_json_object(line, "$").isNull() | ~F.ltrim(line).startswith("{"), "json")
               .when(~event_id.rlike(fixed.EVENT_ID_PATTERN), "event_id"))
    return lines.select(line.alias("value"), problem.alias("problem")).filter("value IS NULL OR problem IS NOT NULL")


def to_audit(events: DataFrame) -> DataFrame:
    """Queue rows to table rows: `ts` milliseconds become wall-clock time of the organisation's zone, and
    the month they are partitioned by. Rows without a valid event id are left to `rejected`."""
    moment = F.expr("timestampadd(MILLISECOND, ts, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return (
        events.filter(F.col("event_id").rlike(fixed.EVENT_ID_PATTERN))
        .withColumn("event_time", F.convert_timezone(F.lit("UTC"), F.lit(fixed.TIME_ZONE), moment))
        .withColumn("month", F.date_format("event_time", "yyyyMM").cast("int"))
    )


def _bloom(writer: DataFrameWriter, column: str, distinct: int) -> DataFrameWriter:
    """A Bloom filter per row group, for `distinct` values of a column: a look-up reads the row groups that may have it."""
    return (writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(distinct)))


def write_audit(audit: DataFrame, path: str, *, mode: str = "append", files_per_month: int = 1, rows_expected: int = BLOOM_ROWS) -> None:
    """Parquet by month, sorted by (team, action, event_time) so row-group statistics prune, with Bloom filters on
    event_id, which the order says nothing about. Rows are spread over `files_per_month` writers per month, and a
    writer that got more than a partition's advisory size is split: a busy month must not land in one task."""
    salt = F.pmod(F.xxhash64("event_id"), F.lit(files_per_month))
    dealt = audit.withColumn("_writer", salt).hint("rebalance", "month", "_writer").drop("_writer")
    # the month leads, so that the writer finds its partitions in order and does not sort again
    (_bloom(dealt.sortWithinPartitions("month", "team", "action", "event_time").write.mode(mode), "event_id", rows_expected)
     .partitionBy("month").parquet(path))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def retained(audit: DataFrame, as_of: str, years: int = fixed.RETENTION_YEARS) -> DataFrame:
    """Rows younger than the retention period; whole older months are pruned by partition."""
    limit = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(years)} YEARS")
    rows = audit.filter(F.col("event_time") >= limit)
    return rows.filter(F.col("month") >= F.date_format(limit, "yyyyMM").cast("int")) if "month" in audit.columns else rows


def expired_months(audit: DataFrame, as_of: str, years: int = fixed.RETENTION_YEARS) -> DataFrame:
    """Month partitions that lie wholly outside the retention period and can be dropped."""
    limit = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(years)} YEARS")
    return (audit.groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.max("event_time").alias("last"))
            .filter(F.col("last") < limit))


def event_json(events: DataFrame) -> DataFrame:
    """(key, value) rows for a topic: the event as JSON, keyed by team."""
    names = [n for n, _ in fixed.AUDIT_EVENT_FIELDS if n in events.columns]
    return events.select(F.col("team").alias("key"), F.to_json(F.struct(*names)).alias("value"))


def emit_kafka(events: DataFrame, servers: str, topic: str) -> None:
    (event_json(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save())


def emit_json(events: DataFrame, path: str) -> None:
    """The fallback without a broker: one JSON line per event."""
    event_json(events).select("value").write.mode("append").text(path)


def subject_index(audit: DataFrame) -> DataFrame:
    """(hash, event_id, event_time, month): the side table a subject search reads instead of every row's array."""
    month = F.col("month") if "month" in audit.columns else F.date_format("event_time", "yyyyMM").cast("int")
    return audit.select(F.explode("subject_hashes").alias("hash"), "event_id", "event_time", month.alias("month"))


def write_subject_index(index: DataFrame, path: str, *, mode: str = "append", files_per_month: int = 1, hashes_expected: int = BLOOM_ROWS) -> None:
    """Parquet by month, sorted by hash and with Bloom filters on it, so that a search reads the row groups of its
    hashes only. Hashes are dealt over `files_per_month` writers."""
    salt = F.pmod(F.xxhash64("hash"), F.lit(files_per_month))
    rows = index.repartition("month", salt).sortWithinPartitions("hash", "event_time")
    _bloom(rows.write.mode(mode), "hash", hashes_expected).partitionBy("month").parquet(path)


def find_events(audit: DataFrame, event_ids: Sequence) -> DataFrame:
    """Rows of a few events: the ids go to the scan, which skips row groups without them."""
    return audit.filter(F.col("event_id").isin(list(event_ids)))


def find_hashes(index: DataFrame, hashes: Sequence[str]) -> DataFrame:
    """Index rows of a few hashes, read likewise."""
    return index.filter(F.col("hash").isin(list(hashes)))
