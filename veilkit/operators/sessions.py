"""Request and answer phases that arrive separately, matched by session within a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS = 600
_KEYS = ["source", "session_id"]


def _bucket(ttl_seconds: int):
    """Time cut into pieces of one time to live."""
    return F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(event_time AS timestamp_ntz))") / ttl_seconds)


def _seconds(n: int):
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n).cast("decimal(18,6)"))


def join_sessions(requests: DataFrame, responses: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Every response with the latest request of its session that is at most `ttl_seconds` older; responses
    without one stay, with NULLs. No pairs are formed: time is cut into buckets of one time to live, the
    latest request comes from the response's own bucket, else from the last request of the bucket before.
    """
    bucket = _bucket(ttl_seconds)
    asked = (requests.select(*_KEYS, F.struct(F.col("event_time").alias("request_time"), F.col("event_id").alias("request_id")).alias("_r"),
                             "event_time").withColumn("_bucket", bucket))
    answered = responses.withColumn("_bucket", bucket).withColumn("_answer", F.lit(True))
    both = answered.unionByName(asked, allowMissingColumns=True)
    seen = Window.partitionBy(*_KEYS, "_bucket").orderBy("event_time", F.coalesce("_answer", F.lit(False)), "event_id")
    rows = both.withColumn("_r", F.last("_r", ignorenulls=True).over(seen)).filter("_answer")
    before = asked.groupBy(*_KEYS, (F.col("_bucket") + 1).alias("_bucket")).agg(F.max("_r").alias("_b"))
    rows = rows.join(before, [*_KEYS, "_bucket"], "left").withColumn("_r", F.coalesce("_r", "_b"))
    fresh = F.col("_r.request_time") >= F.col("event_time") - _seconds(ttl_seconds)
    return (rows.withColumn("request_time", F.when(fresh, F.col("_r.request_time")))
            .withColumn("request_id", F.when(fresh, F.col("_r.request_id"))).drop("_r", "_b", "_bucket", "_answer"))


def report_once(leaks: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Leaks of a session are reported once while it lives: again only after more than the time to live without
    one. A leak's predecessor is in its own bucket or the last one of the bucket before."""
    rows = leaks.withColumn("_bucket", _bucket(ttl_seconds))
    inside = Window.partitionBy(*_KEYS, "_bucket").orderBy("event_time", "event_id")
    before = rows.groupBy(*_KEYS, (F.col("_bucket") + 1).alias("_bucket")).agg(F.max("event_time").alias("_b"))
    rows = rows.withColumn("_last", F.lag("event_time").over(inside)).join(before, [*_KEYS, "_bucket"], "left")
    last = F.coalesce("_last", "_b")
    return rows.filter(last.isNull() | (F.col("event_time") > last + _seconds(ttl_seconds))).select(*leaks.columns)
