"""Team quotas replayed over recorded requests: per minute, and monthly tokens and cost."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions.globs import literal
from veilkit.operators.ordered import row_numbers, running_totals
from veilkit.session import materialize

LIMITS = ("requests_per_minute", "monthly_tokens", "monthly_cost_usd")
_REPLAYED = ("event_id", "event_time", "team", "prompt_tokens", "completion_tokens", "est_cost_usd")


def check_quotas(quotas: Mapping) -> None:
    unknown = set(quotas) - {"default", "teams", "on_backend_error"}
    if unknown:
        raise ValueError(f"unknown quota settings {sorted(unknown)}")
    for limits in [quotas.get("default") or {}, *(quotas.get("teams") or {}).values()]:
        for name, value in (limits or {}).items():
            if name not in LIMITS or isinstance(value, bool) or not isinstance(value, (int, float)) or value < 0:
                raise ValueError(f"quota limit {name}={value!r}")


def team_limits(quotas: Mapping, team: str = "team") -> dict[str, Column]:
    """Each limit as a Column: the team's own value, else the default, else NULL (no limit)."""
    check_quotas(quotas)
    default, teams = quotas.get("default") or {}, quotas.get("teams") or {}
    out = {}
    for name in LIMITS:
        value = F.lit(float(default[name])) if name in default else F.lit(None).cast("double")
        for t, limits in teams.items():
            if name in (limits or {}):
                value = F.when(F.col(team) == t, F.lit(float(limits[name]))).otherwise(value)
        out[name] = value
    return out


def per_minute(requests: DataFrame, limit: Column) -> DataFrame:
    """Adds minute_count, the request's number within (team, minute) counting rejected ones too, and
    retry_after. Buckets of a second keep a team's burst from being one window."""
    rows = requests.withColumn("_minute", F.date_trunc("minute", "event_time"))
    rows = row_numbers(rows, ["team", "_minute"], ["event_time", "event_id"], F.date_trunc("second", "event_time"), "minute_count")
    over = F.col("minute_count") > limit
    return (rows.withColumn("over_minute", F.coalesce(over, F.lit(False)))
            .withColumn("retry_after", F.greatest(F.lit(1), 60 - F.second("event_time"))).drop("_minute"))


def replay(requests: DataFrame, quotas: Mapping) -> DataFrame:
    """Adds quota_kind, quota_limit and quota_used to requests that reached the quota check (callers drop
    policy-blocked rows first); NULL kind for accepted ones.

    A monthly limit rejects when the usage before a request has reached it. Usage only grows and nothing
    is accepted after a crossing, so running sums over the requests that passed the minute check decide;
    the reported usage is the one at the first crossing, because rejected requests add none.

    All windows run on slim rows, written down between the two passes; the requests are read for those and once
    more to receive the result by event_id, which names one request.
    """
    limits = team_limits(quotas)
    slim = materialize(requests.select(*_REPLAYED))
    rows = materialize(per_minute(slim.withColumns({f"_l_{n}": c for n, c in limits.items()}), F.col("_l_requests_per_minute")))
    rows = rows.withColumn("_month", F.date_trunc("month", "event_time"))
    counted = ~F.col("over_minute")
    tokens = F.when(counted, F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).otherwise(0)
    micro = F.when(counted, F.bround(F.coalesce("est_cost_usd", F.lit(0.0)) * 1_000_000, 0).cast("bigint")).otherwise(0)
    rows = running_totals(rows, ["team", "_month"], ["event_time", "event_id"], F.date_trunc("hour", "event_time"),
                          {"_tokens": tokens, "_micro": micro}, inclusive=False)
    rows = rows.withColumn("_cost", F.col("_micro") / 1_000_000)
    full = counted & (F.coalesce(F.col("_tokens") >= F.col("_l_monthly_tokens"), F.lit(False))
                      | F.coalesce(F.col("_cost") >= F.col("_l_monthly_cost_usd"), F.lit(False)))
    rows = materialize(rows.withColumn("_full", full))
    frozen = rows.filter("_full").groupBy("team", "_month").agg(F.min("_tokens").alias("_ft"), F.min("_cost").alias("_fc"))
    rows = rows.join(frozen, ["team", "_month"], "left")
    kind = (F.when(F.col("over_minute"), "requests_per_minute")
            .when(F.col("_full") & F.coalesce(F.col("_ft") >= F.col("_l_monthly_tokens"), F.lit(False)), "monthly_tokens")
            .when(F.col("_full"), "monthly_cost_usd"))
    out = rows.withColumn("quota_kind", kind)
    limit = F.coalesce(*[F.when(F.col("quota_kind") == n, F.col(f"_l_{n}")) for n in LIMITS])
    used = (F.when(F.col("quota_kind") == "requests_per_minute", F.col("minute_count").cast("double"))
            .when(F.col("quota_kind") == "monthly_tokens", F.col("_ft").cast("double"))
            .when(F.col("quota_kind") == "monthly_cost_usd", F.round("_fc", 4)))
    result = out.withColumn("quota_limit", limit).withColumn("quota_used", used).select("event_id", "minute_count", "retry_after", "quota_kind", "quota_limit", "quota_used")
    return requests.join(result, "event_id")


def apply_rejections(rows: DataFrame) -> DataFrame:
    """A rejected request becomes a block with its own rule and reason, and costs nothing."""
    hit = F.col("quota_kind").isNotNull()
    what = F.expr("CASE quota_kind" + "".join(f" WHEN {literal(k)} THEN {literal(v)}" for k, v in fixed.QUOTA_LABELS.items()) + " END")
    number = lambda c: F.regexp_replace(F.format_string("%.6f", F.col(c)), r"\.?0+$", "")
    reason = F.concat(F.lit("Ekip "), what, F.lit(" kotası aşıldı ("), number("quota_used"), F.lit(" / "), number("quota_limit"), F.lit(")."))
    return (
        rows.withColumn("action", F.when(hit, "block").otherwise(F.col("action")))
        .withColumn("rules", F.when(hit, F.array_append("rules", F.concat(F.lit(fixed.QUOTA_RULE), "quota_kind"))).otherwise(F.col("rules")))
        .withColumn("reason", F.when(hit, reason).otherwise(F.col("reason")))
        .withColumn("quota", F.coalesce("quota_kind", F.lit("")))
        .withColumn("prompt_tokens", F.when(hit, 0).otherwise(F.col("prompt_tokens")))
        .withColumn("completion_tokens", F.when(hit, 0).otherwise(F.col("completion_tokens")))
        .withColumn("est_cost_usd", F.when(hit, 0.0).otherwise(F.col("est_cost_usd")))
    )


def with_quotas(audit: DataFrame, quotas: Mapping) -> DataFrame:
    """Replay quotas over a decided audit table: policy-blocked rows pass through and consume nothing."""
    blocked = audit.filter("action = 'block'")
    done = apply_rejections(replay(audit.filter("action <> 'block'"), quotas))
    return done.unionByName(blocked.withColumn("quota", F.lit("")), allowMissingColumns=True)
