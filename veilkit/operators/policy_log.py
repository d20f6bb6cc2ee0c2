"""Policy versions and their append-only event log: status, active version, reviews and rule differences."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilkit.operators.ordered import range_buckets
from veilkit.operators.policy import Context, decision_sql
from veilkit.plans.compliance import declared_sql

ACTIVATING = ["approved", "applied", "emergency"]
EMERGENCY_REASON_CHARS = 10


def version_status(versions: DataFrame, events: DataFrame) -> DataFrame:
    """Each version with its events folded to pending, approved or rejected: the last deciding event
    counts. One max_by per version, combined before the shuffle."""
    decided = events.filter(F.col("event").isin("rejected", *ACTIVATING))
    last = decided.groupBy("version").agg(
        F.max_by("event", F.struct("ts", "event_id")).alias("_last"), F.max("ts").alias("decided_at"))
    counted = events.groupBy("version").agg(F.count(F.lit(1)).alias("events"))
    return (versions.join(last, "version", "left").join(counted, "version", "left")
            .withColumn("status", F.expr("CASE WHEN _last IS NULL THEN 'pending' WHEN _last = 'rejected' THEN 'rejected' ELSE 'approved' END"))
            .withColumn("events", F.coalesce("events", F.lit(0))).drop("_last"))


def active_version(versions: DataFrame, events: DataFrame) -> DataFrame:
    """The version of the latest activating event; no row when nothing was ever activated."""
    latest = (events.filter(F.col("event").isin(*ACTIVATING))
              .agg(F.max_by("version", F.struct("ts", "event_id")).alias("version")).filter("version IS NOT NULL"))
    return versions.join(F.broadcast(latest), "version")


def four_eyes(versions: DataFrame, events: DataFrame) -> DataFrame:
    """Approvals by the author: an emergency release needs a reason, a plain approval another person."""
    same = F.lower(F.trim("actor")) == F.lower(F.trim("author"))
    reviewed = events.filter(F.col("event").isin("approved", "emergency"))
    return (reviewed.join(versions.select("version", "author"), "version").filter(same)
            .withColumn("finding", F.when(F.col("event") == "approved", "self_approved")
                        .when(F.length(F.trim("comment")) < EMERGENCY_REASON_CHARS, "emergency_without_reason")
                        .otherwise("emergency_release")))


def rules_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rules by (kind, name) as added, removed, changed or same. Both sides have (kind, name, body) with
    body holding action, mode and conditions in one comparable column."""
    joined = old.withColumnRenamed("body", "before").join(new.withColumnRenamed("body", "after"), ["kind", "name"], "full_outer")
    status = F.expr("CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' "
                    "WHEN before = after THEN 'same' ELSE 'changed' END")
    return joined.withColumn("status", status)


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "changed", "removed")])


def version_at(rows: DataFrame, events: DataFrame, *, time: str = "event_time", into: str = "policy_version") -> DataFrame:
    """Adds the version in force at each row's time: that of the latest activating event at or before it, NULL before the
    first one. Rows and events stand in one order, cut into ranges of about as many rows each; the last event of a range
    is carried on to the ranges after it, one row a range, so neither a long log nor a hot day is one task."""
    log = (events.filter(F.col("event").isin(*ACTIVATING))
           .select(F.col("ts").alias("_at"), F.lit(0).alias("_kind"), F.col("event_id").cast("string").alias("_tie"), F.struct("version").alias("_set")))
    own = rows.withColumns({"_at": F.col(time), "_kind": F.lit(1), "_tie": F.lit("")})
    placed = range_buckets(own.unionByName(log, allowMissingColumns=True), ["_at", "_kind", "_tie"], "_place")
    inside = Window.partitionBy("_place").orderBy("_at", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    last = placed.filter("_kind = 0").groupBy("_place").agg(F.max_by("_set", F.struct("_at", "_tie")).alias("_own"))
    every = placed.select("_place").distinct().join(last, "_place", "left")  # a row per range
    before = Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("_place", F.last("_own", ignorenulls=True).over(before).alias("_carried"))
    found = placed.withColumn("_set", F.last("_set", ignorenulls=True).over(inside)).filter("_kind = 1").join(carried, "_place")
    return found.withColumn(into, F.coalesce("_set", "_carried")["version"]).select(*rows.columns, into)


def evaluate_at(rows: DataFrame, policies: Mapping, *, version: str = "policy_version", into: str = "decision") -> DataFrame:
    """Each row judged by the rules of its own version, all in one projection; NULL where no version was in force or
    the version is not among `policies`."""
    out, names = rows, []
    for number, (key, policy) in enumerate(sorted(policies.items())):
        names.append((key, f"_decision_{number}"))
        out = out.withColumn(names[-1][1], F.when(F.col(version) == key, F.expr(decision_sql(policy.rules, policy.mode, policy.default_action, Context(declared=declared_sql(policy.systems))))))
    return out.withColumn(into, F.coalesce(*[F.col(n) for _, n in names])).drop(*[n for _, n in names])
