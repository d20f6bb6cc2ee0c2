"""Live quota counters: the decisions of the replay, made as requests arrive, on keyed state.

Each team has its own state: a counter per minute, and tokens and cost per month. A request that a limit rejects adds
nothing to its month, so a month stays where it first crossed a limit. Event-time timers remove a minute's counter and a
month's sums once the watermark has passed them; what is kept of a team does not grow with its requests.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilkit.operators.quota import LIMITS, check_quotas
from veilkit.streaming.ingest import WATERMARK

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECISION = ("event_id string, minute_count bigint, retry_after int, quota_kind string, quota_limit double, quota_used double")
_EPOCH = datetime(1970, 1, 1)


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """State variables and timers need this store; it also keeps state on disk instead of in the executors' heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def limits_of(quotas: Mapping, team: str | None) -> dict[str, float]:
    own = (quotas.get("teams") or {}).get(team) or {}
    return {name: float(value) for name, value in {**(quotas.get("default") or {}), **own}.items()}


class TeamQuotas(StatefulProcessor):
    """State of a team: minutes (start -> requests counted), months (start -> tokens, cost in millionths). What lies more
    than the watermark's delay before a batch's last request is passed already and not kept at all."""

    def __init__(self, quotas: Mapping, delay_ms: int):
        self.quotas, self.delay_ms = quotas, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getMapState("minutes", "start bigint", "n bigint")
        self.months = handle.getMapState("months", "start bigint", "tokens bigint, micro bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        limits = limits_of(self.quotas, key[0])
        rpm, most_tokens, most_cost = (limits.get(name) for name in LIMITS)
        minutes: dict[int, int] = {}
        months: dict[int, tuple[int, int]] = {}
        out, newest = [], 0
        for r in pd.concat(list(rows)).sort_values(["at_us", "order_id"]).itertuples():
            minute, month, newest = r.at_us // 60_000_000, _month(r.at_us), r.at_us // 1000
            if minute not in minutes:
                minutes[minute] = self._get(self.minutes, minute, (0,))[0]
            if month not in months:
                months[month] = self._get(self.months, month, (0, 0))
            minutes[minute] += 1
            tokens, micro = months[month]
            second = r.at_us // 1_000_000 % 60
            kind = limit = used = None
            if rpm is not None and minutes[minute] > rpm:
                kind, limit, used = LIMITS[0], rpm, float(minutes[minute])
            elif most_tokens is not None and tokens >= most_tokens:
                kind, limit, used = LIMITS[1], most_tokens, float(tokens)
            elif most_cost is not None and micro / 1_000_000 >= most_cost:
                kind, limit, used = LIMITS[2], most_cost, round(micro / 1_000_000, 4)
            else:
                months[month] = tokens + int(r.tokens), micro + int(r.micro)
            out.append((r.event_id, minutes[minute], max(1, 60 - int(second)), kind, limit, used))
        for state, values, end in ((self.minutes, {m: (n,) for m, n in minutes.items()}, _minute_end), (self.months, months, _month_end)):
            for start, value in values.items():
                if end(start) > newest - self.delay_ms:
                    state.updateValue((start,), value)
                    self.handle.registerTimer(end(start))
                else:
                    self._remove(state, start)
        yield pd.DataFrame(out, columns=["event_id", "minute_count", "retry_after", "quota_kind", "quota_limit", "quota_used"])

    @staticmethod
    def _get(state, key: int, otherwise: tuple) -> tuple:
        return tuple(state.getValue((key,))) if state.containsKey((key,)) else otherwise

    @staticmethod
    def _remove(state, start: int) -> None:
        if state.containsKey((start,)):
            state.removeKey((start,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A timer stands at the end of a minute, of a month, or of both."""
        passed = expiredTimerInfo.getExpiryTimeInMs()
        self._remove(self.minutes, passed // 60_000 - 1)
        month = _month((passed - 1) * 1000)
        if _month_end(month) == passed:
            self._remove(self.months, month)
        return iter([])

    def close(self) -> None:
        pass


def _minute_end(minute: int) -> int:
    return (minute + 1) * 60_000


def _month(at_us: int) -> int:
    """A month's number since year 0."""
    at = _EPOCH + timedelta(microseconds=int(at_us))
    return at.year * 12 + at.month - 1


def _month_end(month: int) -> int:
    month += 1
    return int(datetime(month // 12, month % 12 + 1, 1, tzinfo=timezone.utc).timestamp() * 1000)


def quota_stream(requests: DataFrame, quotas: Mapping, watermark: str = WATERMARK) -> DataFrame:
    """Decisions (event_id, minute_count, retry_after, quota_kind, quota_limit, quota_used) on requests that reached the
    quota check. Requests of a micro-batch are judged by event time and id, later batches after earlier ones; a request
    later than the watermark is dropped. Call keep_state_in_rocksdb first."""
    check_quotas(quotas)
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(event_time AS timestamp_ntz))")
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    micro = F.bround(F.coalesce("est_cost_usd", F.lit(0.0)) * 1_000_000, 0).cast("bigint")
    slim = (requests.withColumn("at_us", micros).withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", watermark)
            .select("team", "at", "at_us", F.col("event_id").alias("order_id"), F.col("event_id").cast("string").alias("event_id"),
                    tokens.cast("bigint").alias("tokens"), micro.alias("micro")))
    return slim.groupBy("team").transformWithStateInPandas(TeamQuotas(dict(quotas), int(pd.Timedelta(watermark).total_seconds() * 1000)), DECISION, "append", "eventTime")
