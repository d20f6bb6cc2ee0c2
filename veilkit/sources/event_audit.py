"""An audit table derived from the generic `events` table (event_id, ts, user_id, event_type, value, props).

Every column is an integer-arithmetic function of the event, so any SQL engine gives the same rows.
`event_time` is a wall-clock timestamp without zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TEAM = "element_at(array('analitik', 'yazilim', 'finans', 'stajyer', 'pazarlama'), cast(user_id % 5 AS int) + 1)"
_SITE = "element_at(array('chatgpt.com', 'claude.ai', 'gemini.google.com'), cast(event_id % 3 AS int) + 1)"
_MODEL = ("element_at(array('gpt-4o', 'gpt-4o-mini', 'claude-opus-5', 'gemini-2.5-pro', 'vllm/qwen3', "
          "'mistral-large'), cast(k % 6 AS int) + 1)")
_FORMAT = ("CASE event_id % 11 WHEN 0 THEN 'browser' WHEN 1 THEN 'icap' WHEN 2 THEN 'messages' WHEN 3 THEN '' "
           "ELSE 'chat' END")
_SHADOW_KIND = ("element_at(array('visit', 'masked', 'cancelled', 'blocked', 'allowed_override', 'redirected'), "
                "cast(k % 6 AS int) + 1)")
_REASON = "element_at(array('consent', 'test_data', 'false_positive', 'other'), cast(event_id % 4 AS int) + 1)"
_ENTITIES = ("filter(array(if(k % 7 = 0, 'IBAN_TR', NULL), if(k % 17 = 0, 'KURUM_PROJE', NULL), "
             "if(k % 5 = 0, 'PHONE_TR', NULL), if(k % 13 = 0, 'SECRET_AWS_KEY', NULL), if(k % 4 = 0, 'TCKN', NULL)), "
             "e -> e IS NOT NULL)")
_ACTION = ("CASE WHEN injection_score >= 0.85D THEN 'block' "
           "WHEN destination = 'external' AND (k % 4 = 0 OR k % 7 = 0) AND event_id % 3 <> 0 THEN 'mask' "
           "WHEN injection_score >= 0.5D THEN 'alert' ELSE 'allow' END")
_COST = ("CASE WHEN model = 'mistral-large' OR api_format IN ('browser', 'icap') THEN NULL "
         "WHEN action = 'block' OR destination = 'internal' THEN 0.0D "
         "ELSE cast(2 * prompt_tokens + 10 * completion_tokens AS double) / 1000000D END")
_RULES = ("concat(CASE action WHEN 'block' THEN array('prompt-injection-block') "
          "WHEN 'alert' THEN array('prompt-injection-alert') WHEN 'mask' THEN array('kvkk-yurtdisi-maskele') "
          "ELSE cast(array() AS array<string>) END, "
          f"CASE WHEN api_format IN ('browser', 'icap') THEN array(concat('golge-ai:', {_SHADOW_KIND})) "
          "ELSE cast(array() AS array<string>) END, "
          f"CASE WHEN api_format IN ('browser', 'icap') AND k % 6 = 4 THEN array(concat('golge-ai:gerekce:', {_REASON})) "
          "ELSE cast(array() AS array<string>) END)")
_SUBJECTS = ("array_sort(transform(filter(entities, e -> e IN ('IBAN_TR', 'PHONE_TR', 'TCKN')), "
             "e -> substr(sha2(concat(e, ':', cast(user_id % 40 AS string)), 256), 1, 32)))")


def audit_from_events(events: DataFrame) -> DataFrame:
    no_strings = "cast(array() AS array<string>)"
    staged = (
        events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
        .withColumn("api_format", F.expr(_FORMAT))
        .withColumn("model", F.expr(f"if(api_format IN ('browser', 'icap'), {_SITE}, {_MODEL})"))
        .withColumn("destination", F.expr("if(startswith(model, 'vllm/'), 'internal', 'external')"))
        .withColumn("entities", F.expr(_ENTITIES))
        .withColumn("injection_score", F.expr("CASE WHEN k % 19 = 0 THEN 0.9D WHEN k % 23 = 0 THEN 0.6D ELSE 0D END"))
        .withColumn("action", F.expr(_ACTION))
        .withColumn("prompt_tokens", F.expr("if(action = 'block', 0L, 50L + 3L * k)"))
        .withColumn("completion_tokens", F.expr("if(action = 'block', 0L, cast(floor(value) AS bigint))"))
        .withColumn("would_action", F.expr("if(action = 'allow' AND destination = 'external' AND k % 5 = 0, 'mask', action)"))
        .withColumn("leaks", F.expr("event_type = 'purchase' AND k % 3 = 0"))
    )
    return staged.selectExpr(
        "event_id", "ts AS event_time", "value AS latency_ms",
        "if(user_id % 25 = 0, 'anonymous', concat('u', cast(user_id AS string))) AS `user`",
        f"{_TEAM} AS team", f"array({_TEAM}) AS teams", "api_format", "model", "destination", "entities",
        "injection_score", "action",
        f"if(action = 'mask', array_intersect(entities, array('IBAN_TR', 'TCKN')), {no_strings}) AS masked_entities",
        "would_action", f"if(leaks, array('CREDIT_CARD'), {no_strings}) AS output_leaked",
        "CASE WHEN NOT leaks THEN '' WHEN event_id % 2 = 0 THEN 'mask' ELSE 'allow' END AS output_action",
        f"{no_strings} AS output_rules",
        "prompt_tokens", "completion_tokens", f"{_COST} AS est_cost_usd",
        "if(k % 97 = 0, 'requests_per_minute', '') AS quota",
        f"{_RULES} AS rules",
        f"if(would_action <> action, array('telefon-gozlem'), {no_strings}) AS monitored_rules",
        f"{_SUBJECTS} AS subject_hashes",
        "sha2(concat('prompt-', cast(k AS string)), 256) AS prompt_sha256",
        "cast(prompt_tokens * 4 AS bigint) AS prompt_chars",
        "'' AS reason", "event_type", "k", "user_id",
    )
