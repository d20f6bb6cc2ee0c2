"""Usage reports over the audit table: one function per report, all map-side-combining aggregates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions import predicates as P
from veilkit.functions.lookups import entity_label, provider_of


def ntz(value: str):
    return F.lit(value).cast("timestamp_ntz")


def audit_window(audit: DataFrame, as_of: str, days: int, team: str = "") -> DataFrame:
    """Rows of the last `days` days before `as_of`; prunes month partitions where the table has them."""
    start = ntz(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    rows = audit.filter(F.col("event_time") >= start)
    if "month" in audit.columns:
        rows = rows.filter(F.col("month") >= F.date_format(start, "yyyyMM").cast("int"))
    return rows.filter(F.col("team") == team) if team else rows


def _count(condition: str, name: str):
    return F.count_if(F.expr(condition)).alias(name)


def _cost():
    return F.round(F.sum("est_cost_usd"), 6).alias("est_cost_usd")


def _unknown_cost():
    return _count("est_cost_usd IS NULL", "cost_unknown_requests")


def _tokens():
    return F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens")


def _latency():
    return F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms")


def summary(audit: DataFrame, as_of: str, days: int, team: str = "") -> DataFrame:
    return audit_window(audit, as_of, days, team).agg(
        F.count(F.lit(1)).alias("requests"), F.countDistinct("user").alias("users"),
        F.countDistinct("team").alias("teams"),
        _count("destination = 'external'", "external_requests"),
        _count("action = 'mask'", "masked"), _count("action = 'block'", "blocked"),
        _count(P.INJECTION, "injection_attempts"), _count(P.HAS_SECRET, "secret_requests"),
        _count(P.EXTERNAL_UNMASKED_PII, "external_unmasked_pii"), _count(P.MONITOR_DIFF, "monitor_diffs"),
        _count(P.WOULD_BLOCK, "would_block"), _count(P.OUTPUT_LEAK, "output_leaks"),
        _count("output_action IN ('mask', 'block')", "output_protected"), _count(P.QUOTA_HIT, "quota_blocks"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        _cost(), _unknown_cost(), _latency(),
    )


def daily(audit: DataFrame, as_of: str, days: int, team: str = "") -> DataFrame:
    return (
        audit_window(audit, as_of, days, team)
        .groupBy(F.date_format("event_time", "yyyy-MM-dd").alias("day"))
        .agg(F.count(F.lit(1)).alias("requests"),
             *[_count(f"action = '{a}'", a) for a in fixed.SEVERITY],
             _count("destination = 'external'", "external"), _cost())
        .orderBy("day")
    )


def by_team(audit: DataFrame, as_of: str, days: int, team: str = "", limit: int | None = None) -> DataFrame:
    rows = (
        audit_window(audit, as_of, days, team).groupBy("team")
        .agg(F.count(F.lit(1)).alias("requests"), _count("destination = 'external'", "external"),
             _count("action = 'mask'", "masked"), _count("action = 'block'", "blocked"),
             _count(P.INJECTION, "injection_attempts"), _count(P.EXTERNAL_UNMASKED_PII, "external_unmasked_pii"),
             _tokens(), _cost(), _unknown_cost())
        .orderBy(F.desc("requests"), "team")
    )
    return rows if limit is None else rows.limit(limit)


def by_model(audit: DataFrame, as_of: str, days: int, team: str = "", limit: int | None = None) -> DataFrame:
    rows = (
        audit_window(audit, as_of, days, team).groupBy("model")
        .agg(F.min("destination").alias("destination"), F.count(F.lit(1)).alias("requests"), _tokens(), _cost(),
             _unknown_cost(), _latency())
        .orderBy(F.desc("requests"), "model")
    )
    return rows if limit is None else rows.limit(limit)


def entities(audit: DataFrame, as_of: str, days: int, team: str = "") -> DataFrame:
    return (
        audit_window(audit, as_of, days, team)
        .select("destination", "action", "masked_entities", F.explode("entities").alias("entity"))
        .groupBy("entity")
        .agg(F.count(F.lit(1)).alias("requests"), _count("destination = 'external'", "external"),
             _count("action = 'block'", "blocked"),
             _count("action <> 'block' AND array_contains(masked_entities, entity)", "masked"),
             _count("destination = 'external' AND action <> 'block' AND NOT array_contains(masked_entities, entity)",
                    "external_unmasked"))
        .orderBy(F.desc("requests"), "entity")
    )


def rules(audit: DataFrame, as_of: str, days: int, team: str = "") -> DataFrame:
    """Enforced and monitored rule hits; both arrays are tagged and exploded in a single scan."""
    tagged = F.expr("concat(transform(rules, r -> named_struct('rule', r, 'mode', 'enforce')), "
                    "transform(monitored_rules, r -> named_struct('rule', r, 'mode', 'monitor')))")
    return (
        audit_window(audit, as_of, days, team).select(F.inline(tagged))
        .groupBy("rule", "mode").agg(F.count(F.lit(1)).alias("hits"))
        .orderBy(F.desc("hits"), "rule", "mode")
    )


def by_format(audit: DataFrame, as_of: str, days: int, team: str = "") -> DataFrame:
    return (
        audit_window(audit, as_of, days, team).groupBy(F.expr(P.API_FORMAT).alias("api_format"))
        .agg(F.count(F.lit(1)).alias("requests"), _cost()).orderBy(F.desc("requests"), "api_format")
    )


def top_users(audit: DataFrame, as_of: str, days: int, team: str = "", limit: int = 10) -> DataFrame:
    risk = F.col("blocked") + F.col("injection_attempts")
    return (
        audit_window(audit, as_of, days, team).groupBy("user")
        .agg(F.min("team").alias("team"), F.count(F.lit(1)).alias("requests"), _count("action = 'block'", "blocked"),
             _count(P.INJECTION, "injection_attempts"),
             _count("destination = 'external' AND size(entities) > 0", "external_with_pii"))
        .filter(risk + F.col("external_with_pii") > 0)
        .orderBy(risk.desc(), F.desc("external_with_pii"), "user").limit(limit)
    )


def inventory_usage(audit: DataFrame, as_of: str, days: int) -> DataFrame:
    """Team x model usage. Entity sets are collected as distinct arrays: the entity namespace is a
    fixed list plus the configured dictionary, so the buffers stay small whatever the row count."""
    return (
        audit_window(audit, as_of, days).groupBy("team", "model")
        .agg(F.min("destination").alias("destination"), F.count(F.lit(1)).alias("requests"),
             F.countDistinct("user").alias("users"), F.min("event_time").alias("first_seen"),
             F.max("event_time").alias("last_seen"),
             F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_sort("entities"))))).alias("entities"),
             _count("destination = 'external' AND action <> 'block' AND size(entities) > 0", "external_with_pii"))
    )


def register_usage(audit: DataFrame, as_of: str, days: int, providers=()) -> DataFrame:
    return (
        audit_window(audit, as_of, days).filter("action <> 'block'")
        .select("destination", "model", "team", F.explode("entities").alias("entity"))
        .groupBy("entity", "destination", "model", "team").agg(F.count(F.lit(1)).alias("requests"))
        .withColumn("provider", provider_of(F.col("model"), providers))
    )


def transfer(audit: DataFrame, month: str, providers=(), labels: Mapping[str, str] | None = None) -> DataFrame:
    """Cross-border transfers of personal data in one calendar month ('2024-01')."""
    start = F.to_timestamp_ntz(F.lit(f"{month}-01"), F.lit("yyyy-MM-dd"))
    rows = audit.filter((F.col("event_time") >= start) & (F.col("event_time") < start + F.expr("INTERVAL 1 MONTH")))
    if "month" in audit.columns:
        rows = rows.filter(F.col("month") == int(month.replace("-", "")))
    return (
        rows.filter("destination = 'external'")
        .select("team", "model", "user", "action", "masked_entities", F.explode("entities").alias("entity"))
        .filter("NOT startswith(entity, 'SECRET_') AND NOT startswith(entity, 'KURUM_')")
        .groupBy("team", "model", "entity")
        .agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("user").alias("users"),
             _count("action = 'block'", "blocked"),
             _count("action <> 'block' AND array_contains(masked_entities, entity)", "masked_sent"),
             _count("action <> 'block' AND NOT array_contains(masked_entities, entity)", "unmasked_sent"))
        .withColumn("provider", provider_of(F.col("model"), providers))
        .withColumn("entity_label", entity_label(F.col("entity"), labels))
        .orderBy(F.desc("unmasked_sent"), F.desc("requests"), "team", "model", "entity")
    )


EXPLORER_COLUMNS = ["event_id", "event_time", "user", "team", "teams", "model", "destination", "api_format", "action",
                    "rules", "reason", "monitored_rules", "would_action", "entities", "masked_entities",
                    "injection_score", "output_leaked", "output_action", "output_rules", "quota", "prompt_tokens",
                    "completion_tokens", "est_cost_usd", "latency_ms", "prompt_chars"]


def events_page(audit: DataFrame, as_of: str, days: int = 30, *, filters: Mapping[str, str] | None = None,
                flag: str = "", before: tuple[str, object] | None = None, limit: int = 50) -> DataFrame:
    """One keyset page, newest first. `day` replaces the window; `before` is the (event_time, event_id)
    of the last row seen. `more` says whether another page follows (limit + 1 rows are read)."""
    chosen = {k: v for k, v in (filters or {}).items() if v}
    unknown = set(chosen) - {"team", "user", "model", "action", "destination", "api_format", "entity", "rule", "day"}
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    if "day" in chosen:
        rows = audit.filter(F.to_date("event_time") == F.lit(chosen["day"]).cast("date"))
    else:
        rows = audit_window(audit, as_of, days)
    rows = rows.withColumn("api_format", F.expr(P.API_FORMAT))
    for name in ("team", "user", "model", "action", "destination", "api_format"):
        if name in chosen:
            rows = rows.filter(F.col(name) == chosen[name])
    if "entity" in chosen:
        rows = rows.filter(F.array_contains("entities", chosen["entity"]))
    if "rule" in chosen:
        rule = chosen["rule"]
        rows = rows.filter(F.array_contains("rules", rule) | F.array_contains("monitored_rules", rule)
                           | F.array_contains("output_rules", rule))
    if flag:
        rows = rows.filter(P.EVENT_FLAGS[flag])
    if before:
        last_id = F.lit(before[1]).cast(audit.schema["event_id"].dataType)
        rows = rows.filter(F.struct("event_time", "event_id") < F.struct(ntz(before[0]).alias("event_time"),
                                                                         last_id.alias("event_id")))
    page = rows.select(*EXPLORER_COLUMNS).orderBy(F.desc("event_time"), F.desc("event_id")).limit(limit + 1)
    numbered = page.withColumn("position", F.expr("row_number() OVER (ORDER BY event_time DESC, event_id DESC)"))
    return (numbered.withColumn("more", F.expr("count(*) OVER ()") > limit)
            .filter(F.col("position") <= limit))


def event_detail(audit: DataFrame, event_id, as_of: str) -> DataFrame:
    """The event and how often, by how many users and since when the same prompt came in 90 days."""
    one = audit.filter(F.col("event_id") == event_id).limit(1)
    same = (
        audit_window(audit, as_of, 90)
        .join(F.broadcast(one.select("prompt_sha256")), "prompt_sha256", "left_semi")
        .groupBy("prompt_sha256")
        .agg(F.count(F.lit(1)).alias("same_requests"), F.countDistinct("user").alias("same_users"),
             F.min("event_time").alias("same_first_seen"))
    )
    return one.join(F.broadcast(same), "prompt_sha256", "left")


def same_prompts(audit: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Repeat statistics of every prompt hash: the set form of the detail view's lookup."""
    return (
        audit_window(audit, as_of, days).groupBy("prompt_sha256")
        .agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("user").alias("users"),
             F.min("event_time").alias("first_seen"))
    )


def team_transfer(audit: DataFrame, as_of: str, days: int) -> DataFrame:
    return (
        audit_window(audit, as_of, days).filter("destination = 'external'")
        .select("team", "action", F.explode("entities").alias("entity")).groupBy("team", "entity")
        .agg(_count("action = 'mask'", "masked"), _count("action = 'block'", "blocked"))
        .orderBy(F.desc("blocked"), F.desc("masked"), "team", "entity")
    )
