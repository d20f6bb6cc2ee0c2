"""Anomaly counters and message suppression on streams, with the same outcome as their batch twins."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilkit.operators.anomaly import check_config, event_signals, slot
from veilkit.operators.notify import match_channels
from veilkit.functions import predicates as P
from veilkit.streaming.ingest import WATERMARK

KEEP_DAYS = 30
STATE_PARTS = 256  # parts of the users that share a window's state


def _timed(rows: DataFrame, watermark: str) -> DataFrame:
    """Event time as microseconds and as a watermarked timestamp, both read as UTC whatever the session's
    zone is, so that state timeouts compare like with like."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(event_time AS timestamp_ntz))")
    return (rows.withColumn("at_us", micros).withColumn("at", F.timestamp_micros("at_us"))
            .withColumn("event_id", F.col("event_id").cast("string")).withWatermark("at", watermark))


def anomaly_stream(events: DataFrame, config: Mapping, watermark: str = WATERMARK, parts: int = STATE_PARTS) -> DataFrame:
    """One alert per (user, signal, window) when its count or its distinct subjects reach the threshold.

    State is keyed by the window, so it times out with it, and by a part of the users: most users have a handful of
    events a window, and a Python call for each of them costs far more than the counting. A checkpoint goes on with
    the `parts` it began with. Events later than the watermark are dropped here and counted by the batch twin.
    """
    check_config(config)
    minutes, thresholds = config.get("window_minutes", 60), dict(config["thresholds"])
    rows = event_signals(events.filter(P.KNOWN_USER).filter("api_format <> 'anomaly'"))
    rows = rows.filter(F.col("signal").isin(list(thresholds))).withColumn("slot", slot(minutes))
    timed = (_timed(rows, watermark).withColumn("part", F.pmod(F.xxhash64("user"), F.lit(parts)))
             .select("event_id", "at", "at_us", "user", "signal", F.date_format("slot", "yyyy-MM-dd HH:mm:ss").alias("slot"), "hashes", "part"))

    def count(key, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window = key[0]
        if state.hasTimedOut:
            state.remove()
            return
        held = {(u, s): [n, f, set(k)] for u, s, n, f, k in zip(*state.get)} if state.exists else {}
        events, out = pd.concat(list(groups)).sort_values(["at_us", "event_id"]), []
        for event_id, user, signal, hashes in zip(events["event_id"], events["user"], events["signal"], events["hashes"]):
            one = held.setdefault((user, signal), [0, False, set()])
            if one[1]:
                continue
            if signal == "subjects":
                one[2].update(hashes)
                one[0] = len(one[2])
            else:
                one[0] += 1
            if one[0] >= thresholds[signal]:
                one[1], one[2] = True, set()
                out.append((event_id, user, signal, window, one[0]))
        state.update(([u for u, _ in held], [s for _, s in held], [n for n, _, _ in held.values()], [f for _, f, _ in held.values()],
                      [sorted(k) for _, _, k in held.values()]))
        end = pd.Timestamp(window, tz="UTC") + pd.Timedelta(minutes=minutes)
        state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["event_id", "user", "signal", "slot", "count"])

    return timed.groupBy("slot", "part").applyInPandasWithState(
        count, "event_id string, user string, signal string, slot string, count bigint",
        "users array<string>, signals array<string>, seen array<bigint>, fired array<boolean>, known array<array<string>>",
        "append", GroupStateTimeout.EventTimeTimeout)


def cooldown_stream(events: DataFrame, channels, watermark: str = WATERMARK, keep_days: int = KEEP_DAYS) -> DataFrame:
    """Channel matches with sent and suppressed. State per key is the end of the cooldown and a count; a key is
    forgotten once its cooldown has passed, or `keep_days` later if suppressed messages wait to be mentioned."""
    rows = (_timed(match_channels(events, channels), watermark)
            .select("event_id", "at", "at_us", "channel", "team", "repeat_key", "cooldown"))

    def hold(key, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until, waiting = state.get if state.exists else (0.0, 0)
        out = []
        for event in pd.concat(list(groups)).sort_values(["at_us", "event_id"]).itertuples():
            now = event.at_us / 1e6
            if event.cooldown and now < until:
                waiting += 1
                out.append((event.event_id, key[0], False, 0))
            else:
                out.append((event.event_id, key[0], True, waiting))
                until, waiting = now + event.cooldown, 0
        state.update((until, waiting))
        end = int(until * 1000) + 1 + (keep_days * 86_400_000 if waiting else 0)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "channel", "sent", "suppressed"])

    return rows.groupBy("channel", "team", "repeat_key").applyInPandasWithState(
        hold, "event_id string, channel string, sent boolean, suppressed bigint", "until double, waiting bigint", "append",
        GroupStateTimeout.EventTimeTimeout)
