"""User anomalies: a signal that reaches its threshold within a fixed window alerts once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions import predicates as P
from veilkit.functions.arrays import pinned
from veilkit.functions.globs import literal
from veilkit.operators.policy import effective_action

COUNTED = ("blocked", "overrides", "secrets", "injection")


def check_config(config: Mapping) -> None:
    minutes, thresholds = config.get("window_minutes", 60), config.get("thresholds") or {}
    if isinstance(minutes, bool) or not isinstance(minutes, int) or not 1 <= minutes <= 1440:
        raise ValueError("window_minutes is a whole number from 1 to 1440")
    if not thresholds or set(thresholds) - set(fixed.ANOMALY_SIGNALS):
        raise ValueError(f"thresholds of {sorted(fixed.ANOMALY_SIGNALS)}")
    if any(isinstance(v, bool) or not isinstance(v, int) or v < 1 for v in thresholds.values()):
        raise ValueError("thresholds are positive whole numbers")


def signals_sql() -> str:
    """The counted signals an event raises, as an array of names."""
    leaked = "exists(concat(entities, output_leaked), e -> startswith(e, 'SECRET_'))"
    return (f"filter(array(if({effective_action()} = 'block', 'blocked', NULL), if({P.OVERRIDE}, 'overrides', NULL), "
            f"if({leaked}, 'secrets', NULL), if({P.INJECTION}, 'injection', NULL)), s -> s IS NOT NULL)")


def _known(events: DataFrame) -> DataFrame:
    return events.filter(P.KNOWN_USER).filter("api_format <> 'anomaly'")


def slot(minutes: int) -> Column:
    """Start of the event's fixed window."""
    seconds = minutes * 60
    since = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(event_time AS timestamp_ntz))")
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (F.floor(since / seconds) * seconds).cast("decimal(18,6)"))


def event_signals(events: DataFrame) -> DataFrame:
    """One row per (event, signal); subjects carry their hashes."""
    subjects = "if(size(subject_hashes) > 0 AND destination = 'external' AND action <> 'block', subject_hashes, NULL)"
    rows = events.withColumn("_signals", F.expr(pinned(
        f"concat(transform({signals_sql()}, s -> named_struct('signal', s, 'hashes', cast(NULL AS array<string>))), "
        f"if({subjects} IS NULL, array(), array(named_struct('signal', 'subjects', 'hashes', {subjects}))))")))
    return rows.select("event_id", "event_time", "user", "team", F.inline("_signals"))


def count_alerts(events: DataFrame, config: Mapping) -> DataFrame:
    """Alerts of the counted signals: the event at which a user's count in a window first reaches the
    threshold. The `<=` filter lets Spark keep only a window's first rows before the shuffle."""
    check_config(config)
    minutes = config.get("window_minutes", 60)
    thresholds = {s: t for s, t in config["thresholds"].items() if s in COUNTED}
    if not thresholds:
        thresholds = {"": 1}
    wanted = F.expr("CASE signal" + "".join(f" WHEN {literal(s)} THEN {t}" for s, t in thresholds.items()) + " END")
    rows = (_known(events).withColumn("slot", slot(minutes))
            .select("event_id", "event_time", "user", "team", "model", "destination", "slot", F.explode(F.expr(signals_sql())).alias("signal"))
            .withColumn("threshold", wanted).filter("threshold IS NOT NULL"))
    order = Window.partitionBy("user", "signal", "slot").orderBy("event_time", "event_id")
    first = rows.withColumn("count", F.row_number().over(order)).filter(F.col("count") <= max(thresholds.values()))
    return first.filter("`count` = threshold")


def subject_alerts(events: DataFrame, config: Mapping) -> DataFrame:
    """Alerts on distinct people: the event at which a user's distinct hashes in a window reach the
    threshold, with the exact count after that event."""
    check_config(config)
    threshold = config["thresholds"].get("subjects")
    minutes = config.get("window_minutes", 60)
    rows = (_known(events).filter("destination = 'external' AND action <> 'block'").withColumn("slot", slot(minutes))
            .select("event_id", "event_time", "user", "team", "model", "destination", "slot", F.explode("subject_hashes").alias("hash")))
    firsts = (rows.groupBy("user", "slot", "hash")
              .agg(F.min(F.struct("event_time", "event_id", "team", "model", "destination")).alias("first")))
    order = Window.partitionBy("user", "slot").orderBy("first", "hash")
    if threshold is None:
        firsts, threshold = firsts.filter("false"), 1
    hit = (firsts.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= threshold)
           .filter(F.col("_n") == threshold).select("user", "slot", F.col("first").alias("at")))
    counted = (firsts.join(hit, ["user", "slot"]).filter("first <= at").groupBy("user", "slot", "at")
               .agg(F.count(F.lit(1)).alias("count")))
    return counted.select("at.*", "user", "slot", F.lit("subjects").alias("signal"), F.lit(threshold).alias("threshold"), "count")


def approximate_subjects(events: DataFrame, config: Mapping, error: float = 0.01) -> DataFrame:
    """Windows whose distinct-subject sketch reaches the threshold: one sketch per (user, window)."""
    minutes = config.get("window_minutes", 60)
    rows = (_known(events).filter("destination = 'external' AND action <> 'block'").withColumn("slot", slot(minutes))
            .select("user", "slot", F.explode("subject_hashes").alias("hash")))
    return (rows.groupBy("user", "slot").agg(F.approx_count_distinct("hash", error).alias("subjects"))
            .filter(F.col("subjects") >= config["thresholds"]["subjects"]))


def alert_events(alerts: DataFrame, config: Mapping) -> DataFrame:
    """Notification events of alerts; they are not written to the audit table."""
    what = F.expr("CASE signal" + "".join(f" WHEN {literal(s)} THEN {literal(t)}" for s, t in fixed.ANOMALY_SIGNALS.items()) + " END")
    minutes = config.get("window_minutes", 60)
    none = F.expr("cast(array() AS array<string>)")
    reason = F.concat(F.lit(f"Anomali: son {minutes} dakikada "), F.col("count").cast("string"), F.lit(" kez "), what,
                      F.lit(" (eşik "), F.col("threshold").cast("string"), F.lit(")"))
    return alerts.select(
        "event_id", "event_time", "user", "team", F.array("team").alias("teams"), "model", "destination", F.lit("alert").alias("action"),
        F.array(F.concat(F.lit(fixed.ANOMALY_RULE), "signal")).alias("rules"), reason.alias("reason"), none.alias("entities"),
        none.alias("output_leaked"), F.lit("").alias("output_action"), none.alias("output_rules"), F.lit(0.0).alias("injection_score"),
        F.lit("anomaly").alias("api_format"), F.lit("").alias("quota"))


def alerts(events: DataFrame, config: Mapping) -> DataFrame:
    columns = ["event_id", "event_time", "user", "team", "model", "destination", "slot", "signal", "threshold", "count"]
    return (count_alerts(events, config).withColumn("count", F.col("count").cast("bigint")).select(*columns)
            .unionByName(subject_alerts(events, config).select(*columns)))
