"""User risk: signals per user, then a bounded score with its reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions import predicates as P
from veilkit.plans.usage import audit_window, ntz


def signals(audit: DataFrame, as_of: str, days: int, team: str = "") -> DataFrame:
    """Eight signals per known user. Distinct subjects are counted on exploded hashes, so one very
    active user's hashes are spread over the cluster instead of gathered into one array."""
    rows = audit_window(audit, as_of, days, team).filter(P.KNOWN_USER)
    recent = F.col("event_time") >= ntz(as_of) - F.expr("INTERVAL 1 DAY")
    risky = F.expr(P.RISKY)
    off_hours = F.expr("hour(event_time) NOT BETWEEN 8 AND 18 OR weekday(event_time) >= 5")
    counted = rows.groupBy("user").agg(
        F.min("team").alias("team"), F.count(F.lit(1)).alias("requests"),
        F.count_if(F.expr(P.INJECTION)).alias("injection"), F.count_if(F.expr(P.HAS_SECRET)).alias("secrets"),
        F.count_if(F.expr(P.OUTPUT_LEAK)).alias("output_leaks"), F.count_if(F.expr(P.OVERRIDE)).alias("overrides"),
        F.count_if(F.col("action") == "block").alias("blocked"),
        F.count_if(F.expr(P.EXTERNAL_UNMASKED_PII)).alias("unmasked_pii_external"),
        F.count_if(risky & off_hours).alias("after_hours"), F.count_if(risky & recent).alias("risky_24h"),
        F.count_if(risky & ~recent).alias("risky_before"), F.max("event_time").alias("last_seen"),
    )
    subjects = (
        rows.filter("destination = 'external' AND action <> 'block'")
        .select("user", F.explode("subject_hashes").alias("hash"))
        .groupBy("user").agg(F.countDistinct("hash").alias("subjects"))
    )
    return (
        counted.filter("risky_24h + risky_before > 0").join(subjects, "user", "left")
        .withColumn("subjects", F.coalesce("subjects", F.lit(0).cast("bigint")))
    )


def score(rows: DataFrame, days: int) -> DataFrame:
    """Contribution of each signal, spike flag and a 0-100 score; halves round to even."""
    points = "array(" + ", ".join(
        f"named_struct('points', bround({w}D * {name}, 1), 'position', {-i}, 'signal', '{name}', 'count', {name})"
        for i, (name, w) in enumerate(fixed.RISK_WEIGHTS.items())) + ")"
    baseline = F.col("risky_before") / F.lit(max(days - 1, 1))
    spike = (F.col("risky_24h") >= fixed.SPIKE_MIN) & (
        F.col("risky_24h") >= fixed.SPIKE_FACTOR * F.greatest(baseline, F.lit(1.0)))
    return (
        rows.withColumn("_points", F.expr(f"sort_array(filter({points}, p -> p.count > 0), false)"))
        .withColumn("spike", spike)
        .withColumn("daily_avg", F.bround(baseline, 1))
        .withColumn("total", F.expr("aggregate(_points, 0D, (s, p) -> s + p.points)")
                    + F.when(F.col("spike"), F.lit(fixed.SPIKE_BONUS)).otherwise(0.0))
        .withColumn("score", F.bround(100 * (1 - F.exp(-F.col("total") / fixed.RISK_SCALE)), 0).cast("int"))
        .withColumn("reasons", F.expr("transform(_points, p -> named_struct('signal', p.signal, 'count', p.count, "
                                      "'points', p.points))"))
        .drop("_points")
    )


def report(audit: DataFrame, as_of: str, days: int, team: str = "", limit: int | None = None) -> DataFrame:
    """All users, scored and ranked; a limit cuts the ranked list, so a spike can bring a user in."""
    rows = score(signals(audit, as_of, days, team), days).orderBy(F.desc("score"), F.desc("total"), "user")
    return rows if limit is None else rows.limit(limit)
