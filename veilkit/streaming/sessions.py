"""Request and answer phases joined on streams within their time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilkit.operators.sessions import TTL_SECONDS
from veilkit.streaming.ingest import WATERMARK


def _timed(rows: DataFrame, name: str, watermark: str) -> DataFrame:
    return rows.withColumn(name, F.col(name).cast("timestamp")).withWatermark(name, watermark)


def join_stream(requests: DataFrame, responses: DataFrame, *, ttl_seconds: int = TTL_SECONDS, watermark: str = WATERMARK) -> DataFrame:
    """Each response with the latest request of its session at most the time to live older, as the batch form.
    The bounds on both sides let Spark drop state behind the watermark; a response comes out, with NULLs if it
    has no request, once the watermark has passed it."""
    asked = _timed(requests.select(F.col("source").alias("r_source"), F.col("session_id").alias("r_session"),
                                   F.col("event_time").alias("request_time"), F.col("event_id").alias("request_id")), "request_time", watermark)
    answered = _timed(responses, "event_time", watermark)
    within = F.expr(f"source = r_source AND session_id = r_session AND request_time <= event_time "
                    f"AND request_time >= event_time - INTERVAL {int(ttl_seconds)} SECONDS")
    latest = F.max(F.struct("request_time", "request_id")).alias("_r")
    rows = answered.join(asked, within, "leftOuter").groupBy(*responses.columns).agg(latest)
    return rows.select(*responses.columns, F.col("_r.request_time").alias("request_time"), F.col("_r.request_id").alias("request_id"))


def report_once_stream(leaks: DataFrame, ttl_seconds: int = TTL_SECONDS, watermark: str = WATERMARK) -> DataFrame:
    """The stream form of `report_once`: state per session is the time of its last leak, forgotten after the time
    to live. A leak that arrives after a later one of its session counts as a repeat."""
    columns = leaks.columns

    def hold(key, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(groups)).sort_values(["_at", "event_id"])
        report = []
        for at in rows["_at"].tolist():
            report.append(last is None or at - last > ttl_seconds * 1_000_000)
            last = at if last is None else max(last, at)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + ttl_seconds * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[report, columns]

    timed = _timed(leaks, "event_time", watermark).withColumn("_at", F.unix_micros("event_time"))
    out = ", ".join(f"{f.name} {'timestamp' if f.name == 'event_time' else f.dataType.simpleString()}" for f in leaks.schema)
    return timed.groupBy("source", "session_id").applyInPandasWithState(hold, out, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
