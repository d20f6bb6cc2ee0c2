"""From request rows to audit rows: scan, injection, destination, rules, routing, masking, audit columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions.arrays import let, pinned
from veilkit.functions.values import subject_hash
from veilkit.operators import mask as M
from veilkit.operators import policy as P
from veilkit.operators.injection import with_injection
from veilkit.operators.parts import analyze_parts, injection_parts
from veilkit.operators.scan import ScanConfig, with_findings

_STRINGS = "cast(array() AS array<string>)"


def analyze(requests: DataFrame, policy: P.Policy, config: ScanConfig = ScanConfig(), *,
            injection_roles=tuple(fixed.INJECTION_ROLES)) -> DataFrame:
    """Expects team, teams, model, api_format and `parts`; adds all_text, entity columns, injection columns,
    provider columns, destination, declared and decision (routing applied). One narrow projection chain:
    a request never leaves its row."""
    rows = requests.withColumn("all_text", F.array_join(F.expr("transform(parts, p -> coalesce(p.text, ''))"), "\n"))
    rows = injection_parts(analyze_parts(rows, config), roles=injection_roles)
    rows = rows.withColumn("entities", F.expr("array_sort(array_distinct(transform(findings, f -> f.entity)))"))
    rows = P.resolve_provider(rows, policy)
    return decide(rows, policy)


def analyze_texts(requests: DataFrame, policy: P.Policy, config: ScanConfig = ScanConfig()) -> DataFrame:
    """The same for requests of a single text."""
    rows = with_injection(with_findings(requests, config))
    rows = rows.withColumn("entities", F.expr("array_sort(array_distinct(transform(findings, f -> f.entity)))"))
    return decide(P.resolve_provider(rows, policy), policy)


def decide(rows: DataFrame, policy: P.Policy) -> DataFrame:
    return P.route(P.evaluate(rows, policy), policy)


def mask_parts(analyzed: DataFrame) -> DataFrame:
    """Adds masked_parts and vault. Only requests decided as 'mask' change, and only the decision's
    entities; numbering follows part order inside the row."""
    texts = "transform(parts, p -> coalesce(p.text, ''))"
    masked = M.mask_row("ts", "part_findings", "array_contains(decision.mask_entities, f.entity)")
    applies = "decision.action = 'mask' AND size(decision.mask_entities) > 0"
    return (analyzed.withColumn("_m", F.expr(pinned(f"if({applies}, {let('ts', texts, masked)}, NULL)")))
            .withColumn("masked_parts", F.expr(f"if(_m IS NULL, {texts}, _m.masked)"))
            .withColumn("vault", F.col("_m.vault")).drop("_m"))


def audit_rows(analyzed: DataFrame, policy: P.Policy, *, subject_key: bytes | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Audit columns from a decided request, and the columns to `keep`. A blocked request costs nothing; an unknown
    price is NULL."""
    blocked = F.col("decision.action") == "block"
    known = F.col("prompt_tokens").isNotNull() if "prompt_tokens" in analyzed.columns else F.lit(False)
    prompt = F.coalesce("prompt_tokens", F.lit(0)) if "prompt_tokens" in analyzed.columns else F.lit(0)
    completion = F.coalesce("completion_tokens", F.lit(0)) if "completion_tokens" in analyzed.columns else F.lit(0)
    text = "all_text" if "all_text" in analyzed.columns else "text"
    hashes = F.expr(_STRINGS)
    if subject_key is not None:
        value = f"substr(`{text}`, f.start + 1, f.end - f.start)"
        types = ", ".join(f"'{e}'" for e in fixed.SUBJECT_ENTITIES)
        hashes = F.expr(f"array_sort(array_distinct(transform(filter(findings, f -> f.entity IN ({types})), "
                        f"f -> {subject_hash(subject_key, 'f.entity', value)})))")
    cost = P.estimate_cost(F.col("model"), prompt, completion, policy)
    return analyzed.select(
        *[c for c in ("event_id", "event_time", "user", "team", "teams", "model", "destination", "api_format") if c in analyzed.columns],
        F.col("decision.action").alias("action"), F.col("decision.rules").alias("rules"),
        F.coalesce("decision.reason", F.lit("")).alias("reason"), F.col("decision.monitored_rules").alias("monitored_rules"),
        F.col("decision.would_action").alias("would_action"), F.col("decision.mask_entities").alias("masked_entities"),
        "entities", "injection_score", F.sha2(text, 256).alias("prompt_sha256"), F.length(text).cast("bigint").alias("prompt_chars"),
        F.when(blocked, 0).otherwise(prompt).cast("bigint").alias("prompt_tokens"),
        F.when(blocked, 0).otherwise(completion).cast("bigint").alias("completion_tokens"),
        F.when(blocked, 0.0).when(known, cost).alias("est_cost_usd"),
        F.expr(_STRINGS).alias("output_leaked"), F.lit("").alias("output_action"), F.expr(_STRINGS).alias("output_rules"),
        F.lit("").alias("quota"), hashes.alias("subject_hashes"), *keep)
