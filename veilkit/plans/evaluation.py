"""Evaluation report: what was protected, what a monitored rule would have protected, what was exposed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions import predicates as P
from veilkit.functions.lookups import country_of, entity_label, mapped, provider_of
from veilkit.plans.usage import audit_window

_RISK = {name: f"({when})" for name, (when, _, _) in P.RISK_CONDITIONS.items()}
_PROTECTED = {name: f"(({when}) AND ({ok}))" for name, (when, ok, _) in P.RISK_CONDITIONS.items()}
_WOULD = {name: f"(({when}) AND NOT ({ok}) AND ({would}))" for name, (when, ok, would) in P.RISK_CONDITIONS.items()}
_EXPOSED = {name: f"(({when}) AND NOT ({ok}) AND NOT ({would}))" for name, (when, ok, would) in P.RISK_CONDITIONS.items()}
_ANY_RISK = "(" + " OR ".join(_RISK.values()) + ")"
_ANY_EXPOSED = "(" + " OR ".join(_EXPOSED.values()) + ")"
_ANY_WOULD = f"(NOT {_ANY_EXPOSED} AND (" + " OR ".join(_WOULD.values()) + "))"
_ROW_PROTECTED = "(action = 'block' OR array_contains(masked_entities, entity))"


def _gateway(audit: DataFrame, as_of: str, days: int) -> DataFrame:
    return audit_window(audit, as_of, days).filter(f"NOT {P.SHADOW}")


def _browser(audit: DataFrame, as_of: str, days: int) -> DataFrame:
    return audit_window(audit, as_of, days).filter(P.SHADOW)


def _count(condition: str, name: str) -> Column:
    return F.count_if(F.expr(condition)).alias(name)


def summary(audit: DataFrame, as_of: str, days: int) -> DataFrame:
    per_risk = []
    for name in P.RISK_CONDITIONS:
        per_risk += [_count(_RISK[name], f"{name}_total"), _count(_PROTECTED[name], f"{name}_protected"),
                     _count(_WOULD[name], f"{name}_would")]
    return _gateway(audit, as_of, days).agg(
        F.count(F.lit(1)).alias("requests"), F.countDistinct("user").alias("users"),
        F.countDistinct("team").alias("teams"), _count("destination = 'external'", "external_requests"),
        _count("size(monitored_rules) > 0", "monitored_requests"),
        F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"),
        F.round(F.sum("est_cost_usd"), 6).alias("est_cost_usd"), _count("est_cost_usd IS NULL", "cost_unknown_requests"),
        _count(_ANY_RISK, "risky_total"), _count(_ANY_EXPOSED, "risky_exposed"), _count(_ANY_WOULD, "risky_would"),
        *per_risk,
    )


def outcomes(summary_row: DataFrame) -> DataFrame:
    """One row per risk kind (and 'risky' for any): total, protected, would, exposed; never negative."""
    rows = ["named_struct('risk', 'risky', 'label', '', 'total', risky_total, "
            "'protected', greatest(risky_total - risky_exposed - risky_would, 0L), "
            "'would', risky_would, 'exposed', risky_exposed)"]
    for name, label in fixed.EVALUATION_RISKS.items():
        rows.append(f"named_struct('risk', '{name}', 'label', '{label}', 'total', {name}_total, "
                    f"'protected', {name}_protected, 'would', {name}_would, "
                    f"'exposed', greatest({name}_total - {name}_protected - {name}_would, 0L))")
    return summary_row.select(F.inline(F.expr(f"array({', '.join(rows)})")))


def entities(audit: DataFrame, as_of: str, days: int) -> DataFrame:
    return (
        _gateway(audit, as_of, days)
        .select("model", "destination", "action", "would_action", "masked_entities", F.explode("entities").alias("entity"))
        .groupBy("entity", "model", "destination")
        .agg(F.count(F.lit(1)).alias("requests"), _count(_ROW_PROTECTED, "protected"),
             _count(f"NOT {_ROW_PROTECTED} AND would_action IN ('mask', 'block')", "would"))
    )


def _with_outcome(rows: DataFrame) -> DataFrame:
    return rows.withColumn("exposed", F.expr("greatest(requests - protected - would, 0L)"))


def _total(rows: DataFrame, *keys: str) -> DataFrame:
    return (rows.groupBy(*keys)
            .agg(F.sum("requests").alias("total"), F.sum("protected").alias("protected"),
                 F.sum("would").alias("would"), F.sum("exposed").alias("exposed"))
            .orderBy(F.desc("exposed"), F.desc("would"), F.desc("total"), *keys))


def cross_border(entity_rows: DataFrame, providers=(), countries: Mapping[str, str] | None = None,
                 labels: Mapping[str, str] | None = None) -> DataFrame:
    """Personal data sent abroad by entity, provider and country."""
    rows = (_with_outcome(entity_rows)
            .filter(F.expr(P.entity_kind("entity")) == "pii").filter("destination = 'external'")
            .withColumn("provider", provider_of(F.col("model"), providers)))
    return (_total(rows, "entity", "provider")
            .withColumn("country", country_of(F.col("provider"), countries))
            .withColumn("label", entity_label(F.col("entity"), labels)))


def entity_totals(entity_rows: DataFrame, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Per entity; personal and corporate data count only when sent abroad, secrets everywhere."""
    rows = (_with_outcome(entity_rows).withColumn("kind", F.expr(P.entity_kind("entity")))
            .filter("kind = 'secret' OR destination = 'external'"))
    return _total(rows, "entity", "kind").withColumn("label", entity_label(F.col("entity"), labels))


def teams(audit: DataFrame, as_of: str, days: int, limit: int = 10) -> DataFrame:
    return (
        _gateway(audit, as_of, days).groupBy("team")
        .agg(F.count(F.lit(1)).alias("requests"), _count(_ANY_RISK, "risky"),
             _count(_RISK["pii_external"], "pii_external"), _count(_RISK["secrets"], "secrets"),
             _count(_RISK["injection"], "injections"), _count(_ANY_EXPOSED, "exposed"), _count(_ANY_WOULD, "would"))
        .orderBy(F.expr("exposed + would").desc(), F.desc("risky"), F.desc("requests"), "team").limit(limit)
    )


def shadow_sites(audit: DataFrame, as_of: str, days: int, limit: int | None = None) -> DataFrame:
    """All sites, so that totals over them are totals; a limit is the caller's choice."""
    kinds = {"visits": "visit", "masked": "masked", "cancelled": "cancelled", "blocked": "blocked",
             "overridden": "allowed_override", "redirected": "redirected"}
    counts = {name: _count(f"array_contains(rules, '{fixed.SHADOW_RULE}{kind}')", name) for name, kind in kinds.items()}
    rows = (
        _browser(audit, as_of, days).groupBy(F.col("model").alias("site"))
        .agg(F.countDistinct("user").alias("users"), counts.pop("visits"), _count("size(entities) > 0", "with_data"),
             *counts.values())
        .orderBy(F.desc("with_data"), F.desc("visits"), "site")
    )
    return rows if limit is None else rows.limit(limit)


def shadow_entities(audit: DataFrame, as_of: str, days: int, labels: Mapping[str, str] | None = None) -> DataFrame:
    return (
        _browser(audit, as_of, days).select("rules", F.explode("entities").alias("entity")).groupBy("entity")
        .agg(F.count(F.lit(1)).alias("events"), _count(P.OVERRIDE, "overridden"),
             _count(f"array_contains(rules, '{fixed.JUSTIFICATION_RULE}false_positive')", "false_positives"))
        .withColumn("label", entity_label(F.col("entity"), labels))
        .orderBy(F.desc("events"), "entity")
    )


def shadow_justifications(audit: DataFrame, as_of: str, days: int) -> DataFrame:
    return (
        _browser(audit, as_of, days).select(F.explode("rules").alias("rule"))
        .filter(F.col("rule").startswith(fixed.JUSTIFICATION_RULE))
        .groupBy(F.substring("rule", len(fixed.JUSTIFICATION_RULE) + 1, 100).alias("justification"))
        .agg(F.count(F.lit(1)).alias("events"))
        .withColumn("label", mapped(F.col("justification"), fixed.JUSTIFICATIONS))
        .orderBy(F.desc("events"), "justification")
    )


def examples(audit: DataFrame, as_of: str, days: int, per_outcome: int = 3, limit: int = 8) -> DataFrame:
    """One event per (team, outcome), at most three per outcome, eight in all, exposed first. The
    `<= k` filters let Spark drop rows beyond the limit before the shuffle (window group limit)."""
    outcome = f"CASE WHEN {_ANY_EXPOSED} THEN 'exposed' WHEN {_ANY_WOULD} THEN 'would' ELSE 'protected' END"
    ranked = "ORDER BY size(entities) DESC, injection_score DESC, event_time DESC, event_id"
    rows = _gateway(audit, as_of, days).filter(_ANY_RISK).withColumn("outcome", F.expr(outcome))
    first = (rows.withColumn("_n", F.expr(f"row_number() OVER (PARTITION BY team, outcome {ranked})"))
             .filter("_n <= 1"))
    few = (first.withColumn("_n", F.expr(f"row_number() OVER (PARTITION BY outcome {ranked})"))
           .filter(F.col("_n") <= per_outcome))
    order = F.expr("CASE outcome WHEN 'exposed' THEN 0 WHEN 'would' THEN 1 ELSE 2 END")
    return (few.orderBy(order, F.size("entities").desc(), F.desc("injection_score"), F.desc("event_time"), "event_id")
            .limit(limit)
            .select("event_id", "event_time", "team", "model", "destination", "api_format", "action", "would_action",
                    "entities", "masked_entities", "rules", "monitored_rules", "injection_score", "output_leaked",
                    "output_action", "outcome"))


def shadow_totals(site_rows: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("visits", "with_data", "masked", "cancelled", "blocked", "overridden", "redirected")]
    return site_rows.agg(*sums, F.coalesce(F.max("users"), F.lit(0)).alias("users"))


def top_undeclared(undeclared: DataFrame, limit: int = 5) -> DataFrame:
    return undeclared.select("team", "model", "requests").orderBy(F.desc("requests"), "team", "model").limit(limit)
