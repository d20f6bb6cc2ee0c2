"""E1-E13, E31: usage reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (AS_OF, DAYS, EXT_UNMASKED, HAS_SECRET, MS, WINDOW, audit, flat, label_sql, provider_sql, scratch, sql, table)
from veilkit.plans import daily_states as DS
from veilkit.plans import usage as U
from veilkit.session import spread
from veilkit.sources.event_audit import audit_from_events

FILE_ROWS = 200_000
OPEN_SINCE = "2024-01-27 00:00:00"
_STORED: dict[tuple, str] = {}


def states(s, d):
    """The window's states: the days before OPEN_SINCE stored in two runs, each with the users that were new then, the
    rest from the audit. Stored once a session and folder, as are the events in files of like size: they are read for every
    state, and a table in few row groups would be read by as few tasks each time."""
    key = (s.sparkContext.applicationId, d)
    if key not in _STORED:
        folder, users = scratch(s), None
        spread(table(s, d, "events"), FILE_ROWS).write.parquet(f"{folder}/events")
        rows = audit_from_events(s.read.parquet(f"{folder}/events"))
        for lo, hi in (("2024-01-01 00:00:00", "2024-01-11 00:00:00"), ("2024-01-11 00:00:00", OPEN_SINCE)):
            part = rows.filter((F.col("event_time") >= U.ntz(lo)) & (F.col("event_time") < U.ntz(hi)))
            DS.number_users(part, users).write.mode("append").parquet(f"{folder}/numbers")
            users = s.read.parquet(f"{folder}/numbers")
            DS.write_days(part, users, f"{folder}/states")
        DS.number_users(rows, users).write.mode("append").parquet(f"{folder}/numbers")
        _STORED[key] = folder
    folder = _STORED[key]
    rows = audit_from_events(s.read.parquet(f"{folder}/events"))
    return DS.States(s, f"{folder}/states", rows, s.read.parquet(f"{folder}/numbers"), AS_OF, DAYS)

QUERIES = {
    "e1_usage_summary": lambda s, d: U.summary(audit(s, d), AS_OF, DAYS),
    "e2_usage_daily": lambda s, d: U.daily(audit(s, d), AS_OF, DAYS),
    "e3_usage_by_team": lambda s, d: U.by_team(audit(s, d), AS_OF, DAYS),
    "e4_usage_by_model": lambda s, d: U.by_model(audit(s, d), AS_OF, DAYS),
    "e5_usage_entities": lambda s, d: U.entities(audit(s, d), AS_OF, DAYS),
    "e6_usage_rules": lambda s, d: U.rules(audit(s, d), AS_OF, DAYS),
    "e7_usage_by_format": lambda s, d: U.by_format(audit(s, d), AS_OF, DAYS),
    "e8_usage_top_users": lambda s, d: U.top_users(audit(s, d), AS_OF, DAYS),
    "e9_inventory_usage": lambda s, d: flat(U.inventory_usage(audit(s, d), AS_OF, DAYS)),
    "e10_register_usage": lambda s, d: U.register_usage(audit(s, d), AS_OF, DAYS),
    "e11_transfer_month": lambda s, d: U.transfer(audit(s, d), "2024-01"),
    "e12_events_page": lambda s, d: flat(
        U.events_page(audit(s, d), AS_OF, DAYS, filters={"destination": "external", "team": "finans"},
                      flag="external_unmasked_pii", before=("2024-01-28 00:00:00", 0), limit=50)
        .select("event_id", "event_time", "user", "model", "api_format", "action", "rules", "entities",
                "masked_entities", "est_cost_usd", "position", "more")),
    "e12_events_day_rule": lambda s, d: flat(
        U.events_page(audit(s, d), AS_OF, filters={"day": "2024-01-15", "rule": "kvkk-yurtdisi-maskele"}, limit=200)
        .select("event_id", "event_time", "user", "team", "model", "action", "entities", "position", "more")),
    "e13_event_detail": lambda s, d: flat(
        U.event_detail(audit(s, d), 77, AS_OF)
        .select("event_id", "event_time", "user", "team", "model", "action", "prompt_sha256", "same_requests",
                "same_users", "same_first_seen")),
    "e13_same_prompts": lambda s, d: flat(U.same_prompts(audit(s, d), AS_OF)),
    "e1_summary_from_days": lambda s, d: states(s, d).summary(),
    "e2_daily_from_days": lambda s, d: states(s, d).daily(),
    "e3_by_team_from_days": lambda s, d: states(s, d).by_team(),
    "e4_by_model_from_days": lambda s, d: states(s, d).by_model(),
    "e5_entities_from_days": lambda s, d: states(s, d).entities(),
    "e6_rules_from_days": lambda s, d: states(s, d).rules(),
    "e7_by_format_from_days": lambda s, d: states(s, d).by_format(),
    "e8_top_users_from_days": lambda s, d: states(s, d).top_users(),
    "e9_users_from_days": lambda s, d: states(s, d).distinct_users("team", "model"),
    "e31_team_transfer": lambda s, d: U.team_transfer(audit(s, d), AS_OF, DAYS),
}

_COST = "round(sum(est_cost_usd), 6) AS est_cost_usd"
_UNKNOWN = "count(*) FILTER (WHERE est_cost_usd IS NULL) AS cost_unknown_requests"
_TOKENS = "CAST(sum(prompt_tokens+completion_tokens) AS BIGINT) AS tokens"
_LAT = "round(avg(latency_ms), 1) AS avg_latency_ms"


def n(cond: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {cond}) AS {name}"


ORACLES = {
    "e1_usage_summary": sql(f"""
SELECT count(*) AS requests, count(DISTINCT "user") AS users, count(DISTINCT team) AS teams,
 {n("destination='external'", "external_requests")}, {n("action='mask'", "masked")}, {n("action='block'", "blocked")},
 {n("injection_score>=0.5::DOUBLE", "injection_attempts")}, {n(HAS_SECRET, "secret_requests")},
 {n(EXT_UNMASKED, "external_unmasked_pii")}, {n("would_action<>'' AND would_action<>action", "monitor_diffs")},
 {n("would_action='block' AND action<>'block'", "would_block")}, {n("len(output_leaked)>0", "output_leaks")},
 {n("output_action IN ('mask','block')", "output_protected")}, {n("quota<>'' AND quota<>'backend_unavailable'", "quota_blocks")},
 CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
 {_COST}, {_UNKNOWN}, {_LAT} FROM audit WHERE {WINDOW}"""),
    "e2_usage_daily": sql(f"""
SELECT strftime(event_time, '%Y-%m-%d') AS day, count(*) AS requests, {n("action='allow'", "allow")}, {n("action='alert'", "alert")},
 {n("action='mask'", "mask")}, {n("action='block'", "block")}, {n("destination='external'", "external")}, {_COST}
 FROM audit WHERE {WINDOW} GROUP BY 1"""),
    "e3_usage_by_team": sql(f"""
SELECT team, count(*) AS requests, {n("destination='external'", "external")}, {n("action='mask'", "masked")},
 {n("action='block'", "blocked")}, {n("injection_score>=0.5::DOUBLE", "injection_attempts")},
 {n(EXT_UNMASKED, "external_unmasked_pii")}, {_TOKENS}, {_COST}, {_UNKNOWN}
 FROM audit WHERE {WINDOW} GROUP BY team ORDER BY requests DESC, team"""),
    "e4_usage_by_model": sql(f"""
SELECT model, min(destination) AS destination, count(*) AS requests, {_TOKENS}, {_COST}, {_UNKNOWN}, {_LAT}
 FROM audit WHERE {WINDOW} GROUP BY model ORDER BY requests DESC, model"""),
    "e5_usage_entities": sql(f"""
SELECT entity, count(*) AS requests, {n("destination='external'", "external")}, {n("action='block'", "blocked")},
 {n("action<>'block' AND list_contains(masked_entities, entity)", "masked")},
 {n("destination='external' AND action<>'block' AND NOT list_contains(masked_entities, entity)", "external_unmasked")}
 FROM (SELECT *, unnest(entities) AS entity FROM audit WHERE {WINDOW}) GROUP BY entity"""),
    "e6_usage_rules": sql(f"""
SELECT rule, mode, count(*) AS hits FROM (
 SELECT unnest(rules) AS rule, 'enforce' AS mode FROM audit WHERE {WINDOW}
 UNION ALL SELECT unnest(monitored_rules), 'monitor' FROM audit WHERE {WINDOW}) GROUP BY 1, 2"""),
    "e7_usage_by_format": sql(f"""
SELECT CASE WHEN api_format='' THEN 'chat' ELSE api_format END AS api_format, count(*) AS requests, {_COST}
 FROM audit WHERE {WINDOW} GROUP BY 1"""),
    "e8_usage_top_users": sql(f"""
SELECT * FROM (SELECT "user", min(team) AS team, count(*) AS requests, {n("action='block'", "blocked")},
 {n("injection_score>=0.5::DOUBLE", "injection_attempts")}, {n("destination='external' AND len(entities)>0", "external_with_pii")}
 FROM audit WHERE {WINDOW} GROUP BY "user") WHERE blocked+injection_attempts+external_with_pii>0
 ORDER BY blocked+injection_attempts DESC, external_with_pii DESC, "user" LIMIT 10"""),
    "e9_inventory_usage": sql(f"""
SELECT team, model, min(destination) AS destination, count(*) AS requests, count(DISTINCT "user") AS users,
 strftime(min(event_time), {MS}) AS first_seen, strftime(max(event_time), {MS}) AS last_seen,
 array_to_string(list_sort(list_distinct(flatten(list(entities)))), ',') AS entities,
 {n("destination='external' AND action<>'block' AND len(entities)>0", "external_with_pii")}
 FROM audit WHERE {WINDOW} GROUP BY team, model"""),
    "e10_register_usage": sql(f"""
SELECT entity, destination, model, team, count(*) AS requests, {provider_sql()} AS provider
 FROM (SELECT *, unnest(entities) AS entity FROM audit WHERE {WINDOW} AND action<>'block')
 GROUP BY entity, destination, model, team"""),
    "e11_transfer_month": sql(f"""
SELECT team, model, entity, count(*) AS requests, count(DISTINCT "user") AS users, {n("action='block'", "blocked")},
 {n("action<>'block' AND list_contains(masked_entities, entity)", "masked_sent")},
 {n("action<>'block' AND NOT list_contains(masked_entities, entity)", "unmasked_sent")},
 {provider_sql()} AS provider, {label_sql()} AS entity_label
 FROM (SELECT *, unnest(entities) AS entity FROM audit WHERE destination='external'
  AND event_time >= TIMESTAMP '2024-01-01' AND event_time < TIMESTAMP '2024-02-01')
 WHERE NOT starts_with(entity,'SECRET_') AND NOT starts_with(entity,'KURUM_') GROUP BY team, model, entity"""),
    "e12_events_page": sql(f"""
SELECT event_id, strftime(event_time, {MS}) AS event_time, "user", model, CASE WHEN api_format='' THEN 'chat' ELSE api_format END AS api_format,
 action, array_to_string(rules, ',') AS rules, array_to_string(entities, ',') AS entities,
 array_to_string(masked_entities, ',') AS masked_entities, est_cost_usd, position, total > 50 AS more FROM (
 SELECT *, row_number() OVER (ORDER BY event_time DESC, event_id DESC) AS position, count(*) OVER () AS total FROM audit
 WHERE {WINDOW} AND destination='external' AND team='finans' AND {EXT_UNMASKED} AND event_time < TIMESTAMP '2024-01-28')
 WHERE position <= 50"""),
    "e12_events_day_rule": sql(f"""
SELECT event_id, strftime(event_time, {MS}) AS event_time, "user", team, model, action, array_to_string(entities, ',') AS entities,
 position, total > 200 AS more FROM (
 SELECT *, row_number() OVER (ORDER BY event_time DESC, event_id DESC) AS position, count(*) OVER () AS total FROM audit
 WHERE CAST(event_time AS DATE) = DATE '2024-01-15' AND (list_contains(rules,'kvkk-yurtdisi-maskele')
  OR list_contains(monitored_rules,'kvkk-yurtdisi-maskele'))) WHERE position <= 200"""),
    "e13_event_detail": sql(f"""
SELECT a.event_id, strftime(a.event_time, {MS}) AS event_time, a."user", a.team, a.model, a.action, a.prompt_sha256,
 s.same_requests, s.same_users, s.same_first_seen FROM audit a JOIN (
 SELECT prompt_sha256, count(*) AS same_requests, count(DISTINCT "user") AS same_users,
  strftime(min(event_time), {MS}) AS same_first_seen FROM audit
  WHERE event_time >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY GROUP BY 1) s USING (prompt_sha256) WHERE a.event_id = 77"""),
    "e13_same_prompts": sql(f"""
SELECT prompt_sha256, count(*) AS requests, count(DISTINCT "user") AS users, strftime(min(event_time), {MS}) AS first_seen
 FROM audit WHERE event_time >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY GROUP BY 1"""),
    "e31_team_transfer": sql(f"""
SELECT team, entity, {n("action='mask'", "masked")}, {n("action='block'", "blocked")}
 FROM (SELECT *, unnest(entities) AS entity FROM audit WHERE {WINDOW} AND destination='external') GROUP BY 1, 2"""),
}
for _name, _twin in {"e1_summary": "e1_usage_summary", "e2_daily": "e2_usage_daily", "e3_by_team": "e3_usage_by_team", "e4_by_model": "e4_usage_by_model", "e5_entities": "e5_usage_entities",
                     "e6_rules": "e6_usage_rules", "e7_by_format": "e7_usage_by_format", "e8_top_users": "e8_usage_top_users"}.items():
    ORACLES[f"{_name}_from_days"] = ORACLES[_twin]
ORACLES["e9_users_from_days"] = sql(f'SELECT team, model, count(DISTINCT "user") AS users FROM audit WHERE {WINDOW} GROUP BY 1, 2')
