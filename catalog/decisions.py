"""D: destinations, rules, routing, access decisions, policy impact and the end-to-end job."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import AS_OF, DAYS, WINDOW, audit, flat, sql, table
from catalog.prompts import PROMPTS_CTE, prompts
from catalog.scan import _ENTITIES, _SCORE
from veilkit import defaults, fixed
from veilkit.operators import policy as P
from veilkit.operators import policy_log as L
from veilkit.operators import prefix_table as PX
from veilkit.operators import scan as S
from veilkit.plans import compliance as C
from veilkit.plans import guardrail as GR
from veilkit.plans import impact as IM
from veilkit.plans import requests as RQ
from veilkit.plans import usage as U

POLICY = defaults.policy()
PROVIDERS = [
    {"name": "Azure OpenAI", "match": ["gpt-"], "type": "azure", "country": "İsveç (AB)"},
    {"name": "Anthropic EU", "match": ["claude-"], "type": "anthropic"},
    {"name": "Mistral", "match": ["mistral"]},
    {"name": "Kurum içi vLLM", "match": ["qwen", "gemini-"], "destination": "internal"},
]
WITH_PROVIDERS = defaults.policy(providers=PROVIDERS)
ROUTING = [
    {"name": "gozlem-iban", "when": {"destination": "external", "entity_in": ["IBAN_TR"]}, "to": "vllm/qwen3", "mode": "monitor"},
    {"name": "kimlik-kurum-ici", "when": {"destination": "external", "entity_in": ["TCKN", "SECRET_*"]}, "to": "vllm/qwen3-72b"},
    {"name": "finans-disari", "when": {"teams": ["finans"], "model_not_in": ["vllm/*"]}, "to": "gpt-4o"},
]
CANDIDATE = defaults.policy(routing=ROUTING, rules=[
    *defaults.RULES,
    {"name": "finans-dis-model-engel", "when": {"teams": ["finans"], "destination": "external", "entity_in": ["PHONE_TR"]}, "action": "block",
     "message": "Finans ekibi telefon gönderemez."},
    {"name": "pahali-model", "when": {"model_in": ["claude-opus-*", "gpt-4?"]}, "action": "alert", "mode": "monitor"},
    {"name": "beyan-edilmemis", "when": {"declared": False, "destination": "external"}, "action": "alert"}], systems=defaults.SYSTEMS)


def recorded(s, d):
    """Recorded contexts as request rows, for the rules to run on."""
    return audit(s, d).select("event_id", "user", "team", "teams", "model", "api_format", "entities", "injection_score", "k", "user_id")


def decisions(s, d):
    rows = RQ.analyze_texts(prompts(s, d), POLICY, defaults.SCAN)
    return flat(rows.select("event_id", "destination", "entities", "injection_score", "decision.*"))


def providers(s, d):
    return P.resolve_provider(recorded(s, d), WITH_PROVIDERS).select("event_id", "provider", "provider_error", "destination")


def routed(s, d):
    rows = RQ.decide(P.resolve_provider(recorded(s, d), CANDIDATE), CANDIDATE)
    return flat(rows.select("event_id", "model", "destination", "routed_from", "decision.*"))


def declared(s, d):
    return C.declared(recorded(s, d), defaults.SYSTEMS).select("event_id", "declared")


def cost(s, d):
    a = audit(s, d)
    return a.select("event_id", P.estimate_cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"), POLICY).alias("cost"))


def unscannable(s, d):
    rows = P.resolve_provider(recorded(s, d), POLICY).withColumn("unscannable", F.expr(
        "if(k % 10 = 0, array('rapor.pdf: uzak adres', concat('ses-', cast(k AS string), ': ses kaydı')), cast(array() AS array<string>))"))
    rows = P.apply_unscannable(P.evaluate(rows, POLICY), "alert")
    return flat(rows.select("event_id", "decision.action", "decision.rules", "decision.reason", "decision.would_action"))


def groups(s, d):
    rows = table(s, d, "customer").select("c_custkey", F.expr(
        "array(concat('/ai-', lower(c_mktsegment)), concat('/ai-n', cast(c_nationkey AS string)), '/diger', "
        "if(c_custkey % 2 = 0, concat('/ai-', lower(c_mktsegment)), '/ai-'))").alias("groups"))
    return flat(rows.select("c_custkey", P.teams_from_groups("groups", "ai-").alias("teams"),
                            P.teams_from_groups("groups", "yok-").alias("none")))


def proxy(s, d):
    rows = table(s, d, "customer").select("c_custkey", F.expr(
        "CASE c_custkey % 5 WHEN 0 THEN concat('SIRKET\\\\Kisi', cast(c_custkey AS string)) "
        "WHEN 1 THEN concat('WinNT://SIRKET/kisi', cast(c_custkey AS string)) "
        "WHEN 2 THEN concat('ldap://dc/cn=kisi', cast(c_custkey AS string), ',ou=x') "
        "WHEN 3 THEN base64(encode(concat('kisi', cast(c_custkey AS string)), 'UTF-8')) ELSE 'iki kelime' END").alias("header"),
        F.expr("concat('SIRKET\\\\ekip', cast(c_nationkey AS string), ', LDAP://x/cn=grup', cast(c_custkey % 3 AS string), ';bos grup')").alias("groups"))
    return flat(rows.select("c_custkey", P.proxy_user("header").alias("name"), P.proxy_groups("groups").alias("groups")))


def agents(s, d):
    rows = recorded(s, d).withColumns({
        "destination": F.lit("external"), "client": F.expr("if(k % 2 = 0, 'cursor', 'cli')"), "routed": F.expr("k % 3 = 0"),
        "event": F.expr("element_at(array('prompt', 'file', 'shell', 'tool_input', 'tool_output'), cast(event_id % 5 AS int) + 1)")})
    out = P.agent_resolve(P.evaluate(rows, POLICY))
    return out.groupBy("client", "event", "routed", "hook_action", "audit_action", "audited").agg(F.count(F.lit(1)).alias("n"))


def network(s, d):
    hosts = ", ".join(f"'{h}'" for h, _, _ in fixed.SITES)
    rows = recorded(s, d).withColumns({
        "host": F.expr(f"concat(if(k % 2 = 0, '', 'eu.'), element_at(array({hosts}, 'www.example.com'), cast(event_id % 15 AS int) + 1))"),
        "path": F.expr("CASE k % 4 WHEN 0 THEN '/v1/messages' WHEN 1 THEN '/backend-api/conversation' WHEN 2 THEN '/v1/chat/completions' ELSE '/x' END"),
        "method": F.expr("if(k % 5 = 0, 'get', 'post')"), "destination": F.lit("external"),
        "truncated": F.expr("k % 11 = 0"), "unscannable": F.expr("k % 13 = 0")})
    out = P.network_decision(P.evaluate(P.match_site(rows).filter("site_name IS NOT NULL"), POLICY))
    return out.groupBy("site_name", "is_prompt", "network_action", "recorded").agg(F.count(F.lit(1)).alias("n"))


ACCESS = [
    {"name": "stajyer-yok", "teams": ["stajyer"], "deny": ["github-*", "crm.delete"]},
    {"name": "crm", "teams": ["finans", "analitik"], "allow": ["crm_*"]},
    {"name": "herkes", "teams": ["*"], "allow": ["search"]},
    {"name": "kisi", "users": ["U1?"], "allow": ["*"]},
]


def tool_calls(s, d):
    return recorded(s, d).withColumns({
        "tool": F.expr("element_at(array('mockcrm-crm-read', 'CRM.delete', 'gw-github-push', 'search', 'crm_update'), cast(k % 5 AS int) + 1)"),
        "original_tool": F.expr("if(k % 5 = 0, 'crm_read', NULL)")})


def access(s, d):
    return P.tool_access(tool_calls(s, d), ACCESS, "deny").select("event_id", "denied_by")


def exfiltration(s, d):
    rows = P.exfiltration(tool_calls(s, d), ["github*", "search"], ["TCKN", "IBAN_TR", "SECRET_*"])
    return flat(rows.select("event_id", "exfiltrated"))


def impact(s, d):
    return IM.replay(audit(s, d), AS_OF, DAYS, POLICY, CANDIDATE)


def simulated(s, d):
    """Whole prompts as the second part of a request, after a system text."""
    rows = prompts(s, d).withColumn("parts", F.expr(
        "array(named_struct('role', 'system', 'text', 'Yardımcı ol.'), named_struct('role', 'user', 'text', text))"))
    rows = RQ.mask_parts(RQ.analyze(rows, POLICY, defaults.SCAN))
    return rows.select("event_id", F.col("decision.action").alias("action"), F.array_join("masked_parts", "|").alias("sent"),
                       F.expr("coalesce(size(vault), 0)").cast("bigint").alias("masked_count"))


def flagship(s, d):
    """Prompts -> findings -> decisions -> audit rows -> entity report."""
    rows = RQ.analyze_texts(prompts(s, d), POLICY, defaults.SCAN)
    return U.entities(RQ.audit_rows(rows, POLICY), AS_OF, DAYS)


def guardrail_calls(s, d):
    """Every prompt as a call that a gateway asks about; the destination is stated for some, rightly or not."""
    return prompts(s, d).withColumns({
        "source": F.expr("if(event_id % 2 = 0, 'kapi-a', 'kapi-b')"), "session_id": F.concat(F.lit("oturum-"), F.col("event_id").cast("string")),
        "stated_destination": F.expr("element_at(array('internal', 'external', NULL), cast(event_id % 3 AS int) + 1)"),
        "parts": F.expr("array(named_struct('role', 'user', 'text', text))")})


def guardrail_requests(s, d):
    judged = GR.requests(guardrail_calls(s, d), POLICY, defaults.SCAN)
    return flat(GR.request_audit(judged, POLICY).select("event_id", "destination", "action", "rules", "masked_count", "prompt_sha256", "est_cost_usd", "auth_source"))


def guardrail_answers(s, d):
    """The answers half a minute later, as two texts; the session knows what the request sent unless it was blocked."""
    calls = guardrail_calls(s, d)
    asked = calls.select("event_id", F.expr("event_time + INTERVAL 30 SECONDS").alias("event_time"), "source", "session_id", F.lit("kimse").alias("user"),
                         F.expr("cast(array() AS array<string>)").alias("teams"), "model", F.lit(None).cast("string").alias("stated_destination"),
                         F.expr("array(answer, 'son')").alias("texts"))
    rows = GR.answer_audit(GR.answers(asked, GR.requests(calls, POLICY, defaults.SCAN), POLICY, defaults.SCAN))
    return flat(rows.select("event_id", "user", "team", "rules", "output_leaked", "output_action", "output_rules", "monitored_rules"))


def built_audit(s, d):
    rows = RQ.audit_rows(RQ.analyze_texts(prompts(s, d), POLICY, defaults.SCAN), POLICY)
    return flat(rows.select("event_id", "action", "rules", "reason", "masked_entities", "entities", "prompt_sha256", "prompt_chars", "est_cost_usd"))


VERSIONS = {1: POLICY, 2: defaults.policy(mode="monitor"), 3: defaults.policy(rules=[r for r in defaults.RULES if r["name"] == "sirlar-her-yerde-maskele"])}


def decided_at(s, d):
    """Recorded requests judged by the version that was in force at their time."""
    log = s.sql("SELECT * FROM VALUES (1L, TIMESTAMP_NTZ'2024-01-05 00:00:00', 'a', 'approved'), (9L, TIMESTAMP_NTZ'2024-01-06 00:00:00', 'b', 'created'), "
                "(2L, TIMESTAMP_NTZ'2024-01-15 12:00:00', 'c', 'emergency'), (3L, TIMESTAMP_NTZ'2024-01-22 00:00:00', 'd', 'applied') AS t(version, ts, event_id, event)")
    rows = L.evaluate_at(L.version_at(audit(s, d), log), VERSIONS)
    return rows.select("event_id", "policy_version", F.col("decision.action").alias("action"))


def provider_table(s, d):
    """Ten thousand prefixes, the real ones among them: the longest one names each request's provider."""
    wide = s.range(10_000).select(F.concat(F.lit("model-"), F.col("id")).alias("prefix"), F.concat(F.lit("P"), F.col("id")).alias("value"))
    real = s.sql("SELECT * FROM VALUES ('gpt-', 'OpenAI'), ('gpt-4o-', 'OpenAI mini'), ('claude-', 'Anthropic'), ('gemini', 'Google'), ('gemini-2', 'Google 2') AS t(prefix, value)")
    rows = PX.longest_prefix(audit(s, d).select("event_id", "model"), "model", wide.unionByName(real), into="provider")
    return rows.groupBy("model", "provider").agg(F.count(F.lit(1)).alias("n"))


def lint(s, d):
    rules = table(s, d, "part").select(F.lit("rules").alias("kind"), F.concat(F.lit("kural-"), F.col("p_partkey").cast("string")).alias("name"),
                                       F.expr("array(element_at(array('TCKN', 'TCKNN', 'SECRET_*', 'KURUM_X', 'IBAN_??', 'PHONE'), "
                                              "cast(p_partkey % 6 AS int) + 1), if(p_size > 25, 'PERSON', 'KISI*'))").alias("entity_in"))
    return P.unknown_entity_patterns(rules, S.known_entities())


QUERIES = {
    "d1_destinations": lambda s, d: recorded(s, d).select("event_id", P.destination_of(F.col("model"), POLICY).alias("destination")),
    "d2_providers": providers,
    "d3_provider_table": provider_table,
    "d16_decided_at": decided_at,
    "d5_decisions": decisions,
    "d7_routing": routed,
    "d8_declared": declared,
    "d9_cost": cost,
    "d10_unscannable": unscannable,
    "d11_teams_from_groups": groups,
    "d11_proxy_identity": proxy,
    "d12_agent_hooks": agents,
    "d13_network": network,
    "d14_tool_access": access,
    "d15_exfiltration": exfiltration,
    "d16_impact_totals": lambda s, d: IM.totals(impact(s, d)),
    "d16_impact_transitions": lambda s, d: IM.transitions(impact(s, d)),
    "d16_impact_teams": lambda s, d: IM.changed_teams(impact(s, d)),
    "d16_impact_rules": lambda s, d: IM.rule_changes(impact(s, d)),
    "d16_impact_examples": lambda s, d: flat(IM.examples(impact(s, d)).drop("reason")),
    "d16_impact_summary": lambda s, d: IM.summary(impact(s, d)),
    "d21_simulate": simulated,
    "d22_unknown_entities": lint,
    "a20_audit_rows": built_audit,
    "a20_guardrail_requests": guardrail_requests,
    "c7_guardrail_answers": guardrail_answers,
    "a20_requests_to_entities": flagship,
}

_SCORED = f"scored AS (SELECT *, CASE WHEN starts_with(model,'vllm/') THEN 'internal' ELSE 'external' END AS dest, {_SCORE} AS score FROM prompts)"


def _rules(score: str, ext: str) -> list[tuple[str, str, int]]:
    return [("prompt-injection-block", f"{score} >= 0.85::DOUBLE", 3), ("prompt-injection-alert", f"{score} >= 0.5::DOUBLE", 1),
            ("kvkk-yurtdisi-maskele", f"{ext} AND (k%4=0 OR k%5=0 OR k%7=0)", 2), ("kurum-terimleri-yurtdisi-maskele", f"{ext} AND k%17=0", 2),
            ("sirlar-her-yerde-maskele", "k%13=0", 2), ("stajyer-tckn-engel", f"team='stajyer' AND {ext} AND k%4=0", 3)]


def _decided(score: str, ext: str, source: str, extra=()) -> str:
    rules = _rules(score, ext) + list(extra)
    top = "greatest(0, " + ", ".join(f"CASE WHEN {c} THEN {s} ELSE 0 END" for _, c, s in rules) + ")"
    fired = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c, _ in rules) + "], lambda r: r IS NOT NULL)"
    masks = (f"list_filter([CASE WHEN k%7=0 AND {ext} THEN 'IBAN_TR' END, CASE WHEN k%17=0 AND {ext} THEN 'KURUM_PROJE' END, CASE WHEN k%5=0 AND {ext} THEN 'PHONE_TR' END, "
             f"CASE WHEN k%13=0 THEN 'SECRET_AWS_KEY' END, CASE WHEN k%4=0 AND {ext} THEN 'TCKN' END], lambda e: e IS NOT NULL)")
    return (f"SELECT *, CASE {top} WHEN 0 THEN 'allow' WHEN 1 THEN 'alert' WHEN 2 THEN 'mask' ELSE 'block' END AS decided, {fired} AS fired, {masks} AS masks, "
            f"CASE WHEN {score} >= 0.85::DOUBLE THEN 'Olası prompt injection tespit edildi.' WHEN team='stajyer' AND {ext} AND k%4=0 THEN 'Bu ekip dış modellere kimlik numarası gönderemez.' "
            f"WHEN {ext} AND (k%4=0 OR k%5=0 OR k%7=0) THEN 'kvkk-yurtdisi-maskele' WHEN {ext} AND k%17=0 THEN 'kurum-terimleri-yurtdisi-maskele' "
            f"WHEN k%13=0 THEN 'sirlar-her-yerde-maskele' WHEN {score} >= 0.5::DOUBLE THEN 'prompt-injection-alert' END AS why FROM {source}")


_GUARD_SCORED = _SCORED.replace("CASE WHEN starts_with", "CASE WHEN event_id % 3 = 1 THEN 'external' WHEN starts_with")
_DECIDED = "decided AS (" + _decided("score", "dest='external'", "scored") + ")"
_REC = "rec AS (SELECT *, injection_score AS score, destination AS dest FROM audit)"
_REC_EXT = "rec AS (SELECT *, injection_score AS score, 'external' AS dest FROM audit)"
_REC_DECIDED = "decided AS (" + _decided("score", "dest='external'", "rec") + ")"
# the candidate: routing first (TCKN or secret, external -> inside), then its rules on what is left
_DECLARED = ("((team='yazilim' AND (starts_with({m},'claude-') OR starts_with({m},'gpt-'))) OR (team='analitik' AND "
             "(starts_with({m},'claude-') OR starts_with({m},'gemini-') OR starts_with({m},'vllm/'))))")
_CAND = "cand AS (" + _decided("score", "dest='external'", """(SELECT *, CASE WHEN go THEN 'internal' ELSE dest0 END AS dest, CASE WHEN go THEN 'vllm/qwen3-72b' ELSE model END AS target
 FROM (SELECT *, injection_score AS score, destination AS dest0, (destination='external' AND (k%4=0 OR k%13=0) AND {gate}) AS go FROM audit))""",
    [("finans-dis-model-engel", "team='finans' AND dest='external' AND k%5=0", 3),
     ("beyan-edilmemis", f"dest='external' AND NOT {_DECLARED.format(m='target')}", 1)]) + ")"
_CAND_ALL, _CAND_GATED = _CAND.replace("{gate}", "true"), _CAND.replace("{gate}", "api_format IN ('chat','responses','messages','embeddings')")
_IMPACT = f"""replay AS (SELECT event_id, a.decided AS before, CASE WHEN c.go AND c.decided <> 'block' THEN 'route' ELSE c.decided END AS after, a.team, a.model,
 a.fired AS old_rules, CASE WHEN c.go THEN list_concat(['yonlendirme:kimlik-kurum-ici'], c.fired) ELSE c.fired END AS new_rules, a.teams_key, a."user", a.api_format, a.entities, a.injection_score, a.destination
 FROM (SELECT *, team AS teams_key FROM decided) a JOIN cand c USING (event_id) WHERE a.api_format <> 'browser' AND a.event_time >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY)"""
_T = "['mockcrm_crm_read', 'crm_delete', 'gw_github_push', 'search', 'crm_update'][k % 5 + 1]"

ORACLES = {
    "d1_destinations": sql("SELECT event_id, destination FROM audit"),
    "d2_providers": sql("""SELECT event_id, CASE WHEN starts_with(model,'gpt-') AND f <> 'messages' AND f IN ('chat','responses','embeddings') THEN 'Azure OpenAI'
 WHEN starts_with(model,'claude-') AND f = 'messages' THEN 'Anthropic EU' WHEN starts_with(model,'mistral') AND f = 'chat' THEN 'Mistral'
 WHEN starts_with(model,'gemini-') AND f = 'chat' THEN 'Kurum içi vLLM' END AS provider,
 CASE WHEN (starts_with(model,'gpt-') OR starts_with(model,'mistral') OR starts_with(model,'gemini-')) AND f <> 'chat' THEN 'chat, embeddings, responses'
 WHEN starts_with(model,'claude-') AND f <> 'messages' THEN 'messages' END AS provider_error,
 CASE WHEN starts_with(model,'gemini-') OR starts_with(model,'vllm/') THEN 'internal' ELSE 'external' END AS destination
 FROM (SELECT *, CASE WHEN api_format='' THEN 'chat' ELSE api_format END AS f FROM audit)"""),
    "d5_decisions": sql(f"""SELECT event_id, dest AS destination, {_ENTITIES} AS entities, score AS injection_score, decided AS action, array_to_string(masks, ',') AS mask_entities,
 array_to_string(fired, ',') AS rules, why AS reason, '' AS monitored_rules, decided AS would_action FROM decided""", PROMPTS_CTE, _SCORED, _DECIDED),
    "d7_routing": sql("""SELECT event_id, target AS model, dest AS destination, CASE WHEN go THEN model END AS routed_from, decided AS action,
 array_to_string(masks, ',') AS mask_entities,
 array_to_string(CASE WHEN go THEN list_concat(['yonlendirme:kimlik-kurum-ici'], fired) ELSE fired END, ',') AS rules,
 CASE WHEN decided='block' AND score < 0.85::DOUBLE AND team='finans' THEN 'Finans ekibi telefon gönderemez.'
  WHEN decided='alert' THEN coalesce(why, 'beyan-edilmemis') ELSE why END AS reason,
 array_to_string(list_concat(list_concat(CASE WHEN watched_before THEN ['pahali-model'] ELSE []::VARCHAR[] END,
  CASE WHEN dest0='external' AND k%7=0 THEN ['yonlendirme:gozlem-iban'] ELSE []::VARCHAR[] END),
  CASE WHEN go AND watched THEN ['pahali-model'] ELSE []::VARCHAR[] END), ',') AS monitored_rules,
 CASE WHEN decided='allow' AND watched THEN 'alert' ELSE decided END AS would_action
 FROM (SELECT *, (starts_with(target,'claude-opus-') OR target='gpt-4o') AS watched,
  (starts_with(model,'claude-opus-') OR model='gpt-4o') AS watched_before FROM cand)""", _CAND_ALL),
    "d8_declared": sql(f"SELECT event_id, {_DECLARED.format(m='model')} AS declared FROM audit"),
    "d9_cost": sql("""SELECT event_id, CASE WHEN starts_with(model,'claude-opus-5') THEN round((prompt_tokens*5::DOUBLE + completion_tokens*25::DOUBLE)/1000000, 6)
 WHEN starts_with(model,'vllm/') THEN 0::DOUBLE END AS cost FROM audit"""),
    "d10_unscannable": sql("""SELECT event_id, CASE WHEN hit AND decided='allow' THEN 'alert' ELSE decided END AS action,
 array_to_string(CASE WHEN hit THEN list_append(fired, 'ek-taranamadi') ELSE fired END, ',') AS rules,
 CASE WHEN hit AND decided='allow' THEN 'Taranamayan ek (rapor.pdf: uzak adres, ses-' || k || ': ses kaydı)' ELSE why END AS reason,
 CASE WHEN hit AND decided='allow' THEN 'alert' ELSE decided END AS would_action FROM (SELECT *, k%10=0 AND dest='external' AS hit FROM decided)""", _REC, _REC_DECIDED),
    "d11_teams_from_groups": """SELECT c_custkey, lower(c_mktsegment) || ',n' || c_nationkey AS teams, 'default' AS none FROM customer""",
    "d11_proxy_identity": """SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE 'kisi' || c_custkey END AS name,
 'ekip' || c_nationkey || ',grup' || (c_custkey % 3) AS groups FROM customer""",
    "d12_agent_hooks": sql("""SELECT client, event, routed, hook_action, CASE decided WHEN 'mask' THEN CASE WHEN hook_action='block' THEN 'block' ELSE 'mask' END ELSE decided END AS audit_action,
 (NOT (routed AND event IN ('prompt','file','tool_output') AND hook_action='allow') AND (event='prompt' OR hook_action<>'allow' OR len(entities)>0 OR score>=0.5::DOUBLE)) AS audited, count(*) AS n FROM (
 SELECT *, CASE decided WHEN 'block' THEN 'block' WHEN 'alert' THEN 'warn' WHEN 'mask' THEN CASE WHEN routed AND event IN ('prompt','file','tool_output') THEN 'allow'
 WHEN event='tool_output' THEN 'mask' ELSE 'block' END ELSE 'allow' END AS hook_action FROM (SELECT *, CASE WHEN k%2=0 THEN 'cursor' ELSE 'cli' END AS client, k%3=0 AS routed,
 ['prompt','file','shell','tool_input','tool_output'][event_id%5+1] AS event FROM decided)) GROUP BY ALL""", _REC_EXT, _REC_DECIDED),
    "d13_network": sql("""SELECT site_name, is_prompt, network_action, (is_prompt OR network_action<>'allow' OR len(entities)>0 OR score>=0.5::DOUBLE) AS recorded, count(*) AS n FROM (
 SELECT *, [""" + ", ".join(f"'{name}'" for _, name, _ in fixed.SITES) + """][event_id%15+1] AS site_name,
 CASE WHEN decided IN ('block','mask') OR k%11=0 THEN 'block' ELSE decided END AS network_action,
 CASE event_id%15 """ + " ".join(f"WHEN {i} THEN " + (" OR ".join(f"regexp_matches(path, '{p}')" for p in paths) or "false") for i, (_, _, paths) in enumerate(fixed.SITES))
        + """ END AS is_prompt FROM (SELECT *, CASE k%4 WHEN 0 THEN '/v1/messages' WHEN 1 THEN '/backend-api/conversation' WHEN 2 THEN '/v1/chat/completions' ELSE '/x' END AS path FROM decided
 WHERE event_id%15<>14 AND k%5<>0)) GROUP BY ALL""", _REC_EXT, _REC_DECIDED),
    "d14_tool_access": sql(f"""SELECT event_id, CASE WHEN team='stajyer' AND k%5 IN (1, 2) THEN 'stajyer-yok'
 WHEN (team IN ('finans','analitik') AND k%5 IN (0, 1, 4)) OR k%5=3 OR regexp_matches("user", '^u1.$') THEN NULL ELSE 'default-deny' END AS denied_by FROM audit"""),
    "d15_exfiltration": sql("""SELECT event_id, CASE WHEN k%5 IN (2, 3) THEN array_to_string(list_filter(entities, lambda e: e IN ('TCKN','IBAN_TR') OR starts_with(e,'SECRET_')), ',') ELSE '' END AS exfiltrated FROM audit"""),
    "d16_impact_totals": sql("""SELECT 'before' AS side, before AS action, count(*) AS requests FROM replay GROUP BY 2
 UNION ALL SELECT 'after', after, count(*) FROM replay GROUP BY 2""", _REC, _REC_DECIDED, _CAND_GATED, _IMPACT),
    "d16_impact_transitions": sql("SELECT before, after, count(*) AS requests FROM replay WHERE before <> after GROUP BY 1, 2", _REC, _REC_DECIDED, _CAND_GATED, _IMPACT),
    "d16_impact_teams": sql("SELECT team, count(*) AS requests FROM replay WHERE before <> after GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", _REC, _REC_DECIDED, _CAND_GATED, _IMPACT),
    "d16_impact_rules": sql("""SELECT change, rule, count(*) AS requests FROM (
 SELECT event_id, 'added' AS change, unnest(list_filter(new_rules, lambda r: NOT list_contains(old_rules, r))) AS rule FROM replay
 UNION ALL SELECT event_id, 'removed', unnest(list_filter(old_rules, lambda r: NOT list_contains(new_rules, r))) FROM replay) GROUP BY 1, 2""", _REC, _REC_DECIDED, _CAND_GATED, _IMPACT),
    "d16_impact_examples": sql("""SELECT team, model, destination, array_to_string(entities, ',') AS entities, round(injection_score, 2) AS injection_score, count(*) AS requests,
 count(DISTINCT "user") AS users, before, after, array_to_string(new_rules, ',') AS rules FROM replay WHERE before <> after
 GROUP BY team, model, destination, replay.entities, replay.injection_score, api_format, before, after, new_rules
 ORDER BY count(*) DESC, team, model, destination, round(injection_score, 2), array_to_string(replay.entities, ','), api_format LIMIT 12""", _REC, _REC_DECIDED, _CAND_GATED, _IMPACT),
    "d16_impact_summary": sql("""SELECT count(*) AS requests, count(DISTINCT (team, model, destination, entities, injection_score, api_format)) AS "groups",
 count(*) FILTER (WHERE before <> after) AS changed FROM replay""", _REC, _REC_DECIDED, _CAND_GATED, _IMPACT),
    "d21_simulate": sql("""SELECT event_id, decided AS action, 'Yardımcı ol.|' || CASE WHEN decided='mask' THEN replace(replace(replace(replace(replace(text,
 iban, CASE WHEN dest='external' THEN '[IBAN_TR_1]' ELSE iban END), project, CASE WHEN dest='external' THEN '[KURUM_PROJE_1]' ELSE project END),
 phone, CASE WHEN dest='external' THEN '[PHONE_TR_1]' ELSE phone END), aws, '[SECRET_AWS_KEY_1]'), shown, CASE WHEN dest='external' THEN '[TCKN_1]' ELSE shown END)
 ELSE text END AS sent, CASE WHEN decided='mask' THEN len(masks) ELSE 0 END AS masked_count FROM decided""", PROMPTS_CTE, _SCORED, _DECIDED),
    "d22_unknown_entities": """SELECT 'rules' AS kind, 'kural-' || p_partkey AS name, pattern FROM (SELECT p_partkey,
 unnest([['TCKN','TCKNN','SECRET_*','KURUM_X','IBAN_??','PHONE'][p_partkey % 6 + 1], CASE WHEN p_size > 25 THEN 'PERSON' ELSE 'KISI*' END]) AS pattern FROM part)
 WHERE pattern IN ('TCKNN', 'PHONE', 'KISI*')""",
    "a20_audit_rows": sql(f"""SELECT event_id, decided AS action, array_to_string(fired, ',') AS rules, coalesce(why, '') AS reason, array_to_string(masks, ',') AS masked_entities,
 {_ENTITIES} AS entities, sha256(text) AS prompt_sha256, length(text) AS prompt_chars, CASE WHEN decided='block' THEN 0::DOUBLE END AS est_cost_usd FROM decided""", PROMPTS_CTE, _SCORED, _DECIDED),
    "a20_guardrail_requests": sql("""SELECT event_id, dest AS destination, decided AS action, array_to_string(list_append(fired, 'guardrail:' || CASE WHEN event_id % 2 = 0 THEN 'kapi-a' ELSE 'kapi-b' END), ',') AS rules,
 CASE WHEN decided='mask' THEN len(masks) ELSE 0 END AS masked_count, sha256(text) AS prompt_sha256, CAST(NULL AS DOUBLE) AS est_cost_usd, 'guardrail' AS auth_source FROM decided""", PROMPTS_CTE, _GUARD_SCORED, _DECIDED),
    "c7_guardrail_answers": sql("""SELECT event_id, CASE WHEN decided='block' THEN 'kimse' ELSE "user" END AS "user", CASE WHEN decided='block' THEN 'default' ELSE team END AS team,
 'guardrail:' || CASE WHEN event_id % 2 = 0 THEN 'kapi-a' ELSE 'kapi-b' END || ',guardrail:cevap' AS rules, array_to_string(list_concat(leaked, more), ',') AS output_leaked,
 CASE WHEN list_contains(leaked, 'CREDIT_CARD') THEN 'mask' ELSE 'allow' END AS output_action, CASE WHEN list_contains(leaked, 'CREDIT_CARD') THEN 'cikti-kimlik-finans-gizle' ELSE '' END AS output_rules,
 CASE WHEN list_contains(leaked, 'EMAIL_ADDRESS') OR len(more) > 0 THEN 'cikti-iletisim-gizle' ELSE '' END AS monitored_rules
 FROM (SELECT *, list_filter([CASE WHEN event_type='purchase' AND k%3=0 THEN 'CREDIT_CARD' END, CASE WHEN event_type='click' AND k%9=0 THEN 'EMAIL_ADDRESS' END], lambda e: e IS NOT NULL) AS leaked,
  CASE WHEN decided='block' AND k%5=0 THEN ['PHONE_TR'] ELSE []::VARCHAR[] END AS more FROM decided) WHERE len(leaked) + len(more) > 0""", PROMPTS_CTE, _GUARD_SCORED, _DECIDED),
    "d3_provider_table": sql("""SELECT model, CASE WHEN starts_with(model, 'gpt-4o-') THEN 'OpenAI mini' WHEN starts_with(model, 'gpt-') THEN 'OpenAI' WHEN starts_with(model, 'claude-') THEN 'Anthropic'
 WHEN starts_with(model, 'gemini-2') THEN 'Google 2' WHEN starts_with(model, 'gemini') THEN 'Google' END AS provider, count(*) AS n FROM audit GROUP BY 1, 2"""),
    "d16_decided_at": sql("""SELECT event_id, CASE WHEN event_time < TIMESTAMP '2024-01-05' THEN NULL WHEN event_time < TIMESTAMP '2024-01-15 12:00:00' THEN 1
 WHEN event_time < TIMESTAMP '2024-01-22' THEN 2 ELSE 3 END AS policy_version, CASE WHEN event_time < TIMESTAMP '2024-01-05' THEN NULL WHEN event_time < TIMESTAMP '2024-01-15 12:00:00' THEN decided
 WHEN event_time < TIMESTAMP '2024-01-22' THEN 'allow' WHEN k%13=0 THEN 'mask' ELSE 'allow' END AS action FROM decided""", _REC, _REC_DECIDED),
    "a20_requests_to_entities": sql(f"""SELECT entity, count(*) AS requests, count(*) FILTER (WHERE dest='external') AS external, count(*) FILTER (WHERE decided='block') AS blocked,
 count(*) FILTER (WHERE decided<>'block' AND list_contains(masks, entity)) AS masked, count(*) FILTER (WHERE dest='external' AND decided<>'block' AND NOT list_contains(masks, entity)) AS external_unmasked
 FROM (SELECT d.*, unnest(string_split({_ENTITIES}, ',')) AS entity FROM decided d WHERE {WINDOW}) WHERE entity <> '' GROUP BY 1""", PROMPTS_CTE, _SCORED, _DECIDED),
}
