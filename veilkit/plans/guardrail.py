"""The guardrail service's two phases for gateways that ask before and after the model: decisions, texts, audit rows.

The asking gateway calls the model itself, so tokens and cost of its calls are unknown, not zero. A request and its
answer belong together by (source, session_id) within a time to live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions.arrays import let, pinned
from veilkit.operators import mask as M
from veilkit.operators import policy as P
from veilkit.operators.parts import analyze_parts, injection_parts
from veilkit.operators.scan import ScanConfig, findings_sql
from veilkit.operators.sessions import TTL_SECONDS, join_sessions, report_once
from veilkit.plans.requests import audit_rows, mask_parts
from veilkit.session import materialize

PHASE_RULE, ANSWER_RULE = "guardrail:", "guardrail:cevap"
_VAULT = "array<struct<entity:string,n:int,canon:string,original:string,placeholder:string>>"
_STRINGS = "cast(array() AS array<string>)"


def _destination(stated: str, model: str, own: str, trust: bool) -> str:
    """What a caller states may only be stricter than the model's own destination, unless it is trusted. Without a
    model nothing is known to stay inside."""
    inside = f"WHEN {stated} = 'internal' THEN 'internal' " if trust else ""
    return f"CASE WHEN {stated} = 'external' THEN 'external' {inside}WHEN coalesce({model}, '') = '' THEN 'external' ELSE {own} END"


def requests(calls: DataFrame, policy: P.Policy, config: ScanConfig = ScanConfig(), *, trust_destination: bool = False) -> DataFrame:
    """Calls (event_id, event_time, source, session_id, user, team, teams, model, stated_destination, parts) with what the
    scan found, the decision, the texts that go on (`masked_parts`), `vault`, `known` (values found) and `verdict`:
    block, mask if a value was replaced, else pass. Nothing is shuffled."""
    rows = calls.withColumns({"api_format": F.lit("guardrail"), "all_text": F.array_join(F.expr("transform(parts, p -> coalesce(p.text, ''))"), "\n")})
    rows = injection_parts(analyze_parts(rows, config))
    rows = rows.withColumn("entities", F.expr("array_sort(array_distinct(transform(findings, f -> f.entity)))"))
    rows = P.resolve_provider(rows, policy)
    rows = rows.withColumn("destination", F.expr(_destination("stated_destination", "model", "destination", trust_destination)))
    rows = mask_parts(P.evaluate(rows, policy))
    known = "array_sort(array_distinct(transform(findings, f -> substr(all_text, f.start + 1, f.end - f.start))))"
    return (rows.withColumn("known", F.expr(known)).withColumn("vault", F.coalesce("vault", F.expr(f"cast(array() AS {_VAULT})")))
            .withColumn("verdict", F.expr("CASE WHEN decision.action = 'block' THEN 'block' WHEN size(vault) > 0 THEN 'mask' ELSE 'pass' END")))


def _guardrail_columns(masked: Column) -> dict[str, Column]:
    return {"auth_source": F.lit("guardrail"), "api_format": F.lit("guardrail"), "prompt_tokens": F.lit(0).cast("bigint"),
            "completion_tokens": F.lit(0).cast("bigint"), "usage_known": F.lit(0), "est_cost_usd": F.lit(None).cast("double"),
            "masked_count": masked.cast("bigint"), "upstream_status": F.lit(0)}


def request_audit(judged: DataFrame, policy: P.Policy, *, subject_key: bytes | None = None) -> DataFrame:
    """Audit rows of the request phase, one a call."""
    out = audit_rows(judged, policy, subject_key=subject_key, keep=["source", "vault"])
    out = out.withColumn("rules", F.array_append("rules", F.concat(F.lit(PHASE_RULE), "source")))
    return out.withColumns(_guardrail_columns(F.size("vault"))).withColumn("output_entities", F.expr(_STRINGS)).drop("source", "vault")


def answers(calls: DataFrame, judged: DataFrame, policy: P.Policy, config: ScanConfig = ScanConfig(), *, ttl_seconds: int = TTL_SECONDS,
            trust_destination: bool = False) -> DataFrame:
    """Answers (event_id, event_time, source, session_id, user, teams, model, stated_destination, texts) judged with the
    session of their request (`judged`, the result of `requests`): what it sent and its placeholders are no leaks. A
    blocked request has no session. Without a session the answer's own columns count, and nothing is known.

    Adds output_entities, output_leaked, output (the decision), verdict and out_texts: leaks hidden where the rules say
    so, placeholders opened."""
    sent = materialize(judged.filter("verdict <> 'block' AND session_id IS NOT NULL").select(  # what a session keeps, never its texts
        "source", "session_id", "event_time", "event_id", "user", "teams", "model", "destination", "known", "vault"))
    keys = sent.select("source", "session_id", "event_time", "event_id")
    matched = join_sessions(keys, calls, ttl_seconds).drop("request_time")
    session = sent.select(F.col("event_id").alias("request_id"), F.struct("user", "teams", "model", "destination", "known", "vault").alias("_s"))
    rows = matched.join(session, "request_id", "left")
    own = _destination("stated_destination", "model", "'external'", trust_destination)
    kept = "if(_s.{0} IS NOT NULL, _s.{0}, {1})"
    rows = rows.withColumns({
        "user": F.expr("coalesce(nullif(if(_s IS NOT NULL, _s.user, user), ''), 'unknown')"),
        "teams": F.expr("if(size(coalesce(if(_s IS NOT NULL, _s.teams, teams), array())) > 0, if(_s IS NOT NULL, _s.teams, teams), array('default'))"),
        "model": F.expr("coalesce(if(_s IS NOT NULL, _s.model, model), '')"), "destination": F.expr(kept.format("destination", own)),
        "_known": F.expr(f"coalesce(_s.known, {_STRINGS})"), "_vault": F.expr(f"coalesce(_s.vault, cast(array() AS {_VAULT}))")})
    rows = rows.withColumns({"team": F.col("teams")[0], "api_format": F.lit("guardrail"), "injection_score": F.lit(0.0)})
    value = "substr(x, f.start + 1, f.end - f.start)"
    new = f"NOT array_contains(_known, {value}) AND NOT exists(_vault, v -> v.original = {value} OR v.placeholder = {value})"
    scanned = f"transform(texts, x -> named_struct('x', coalesce(x, ''), 'found', {findings_sql('x', config)}))"
    rows = rows.withColumn("_scanned", F.expr(pinned(scanned)))
    rows = rows.withColumn("_leaks", F.expr(f"transform(_scanned, s -> {let('x', 's.x', f'filter(s.found, f -> {new})')})"))
    rows = rows.withColumn("output_entities", F.expr("array_sort(array_distinct(flatten(transform(_scanned, s -> transform(s.found, f -> f.entity)))))"))
    rows = rows.withColumn("output_leaked", F.expr("array_sort(array_distinct(transform(flatten(_leaks), f -> f.entity)))"))
    rows = P.evaluate_output(rows, policy)
    before, after = fixed.REDACTED_FORMAT.split("{}")
    hidden = (f"transform(filter(_leaks[i], f -> output.action = 'mask' AND array_contains(output.mask_entities, f.entity)), f -> named_struct("
              f"'start', f.start, 'end', f.end, 'replacement', concat('{before}', f.entity, '{after}')))")
    opened = ("array_join(transform(" + M.token_pieces("red") + ", (p, j) -> if(j % 2 = 1, coalesce(get(filter(_vault, v -> v.placeholder = p), 0).original, p), p)), '')")
    texts = f"transform(_scanned, (s, i) -> {let('x', 's.x', let('red', M.apply_spans('x', hidden), opened))})"
    rows = rows.withColumn("out_texts", F.expr(f"if(output.action = 'block', NULL, {texts})"))
    verdict = "CASE WHEN output.action = 'block' THEN 'block' WHEN out_texts <> transform(texts, x -> coalesce(x, '')) THEN 'mask' ELSE 'pass' END"
    return rows.withColumn("verdict", F.expr(verdict)).drop("_s", "_known", "_vault", "_scanned", "_leaks", "request_id")


def answer_audit(judged: DataFrame, *, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Audit rows of the answer phase: answers that leak, once a session while it lives; answers without a session id
    are each reported."""
    leaking = judged.filter(F.size("output_leaked") > 0)
    once = report_once(leaking.filter("session_id IS NOT NULL").select("source", "session_id", "event_time", "event_id"), ttl_seconds)
    rows = leaking.filter("session_id IS NOT NULL").join(once.select("event_id"), "event_id", "left_semi").unionByName(leaking.filter("session_id IS NULL"))
    blocked = F.col("output.action") == "block"
    out = rows.select(
        "event_id", "event_time", "user", "team", "teams", "model", "destination", F.when(blocked, "block").otherwise("allow").alias("action"),
        F.array(F.concat(F.lit(PHASE_RULE), "source"), F.lit(ANSWER_RULE)).alias("rules"), F.coalesce("output.reason", F.lit("")).alias("reason"),
        F.col("output.monitored_rules").alias("monitored_rules"), F.when(blocked, "block").otherwise("allow").alias("would_action"),
        F.expr(_STRINGS).alias("masked_entities"), F.expr(_STRINGS).alias("entities"), F.lit(0.0).alias("injection_score"),
        F.sha2(F.lit(""), 256).alias("prompt_sha256"), F.lit(0).cast("bigint").alias("prompt_chars"), "output_entities", "output_leaked",
        F.col("output.action").alias("output_action"), F.col("output.rules").alias("output_rules"), F.lit("").alias("quota"),
        F.expr(_STRINGS).alias("subject_hashes"))
    return out.withColumns(_guardrail_columns(F.lit(0)))
