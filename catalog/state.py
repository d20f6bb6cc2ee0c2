"""F: counters, quotas, anomalies, notifications, sessions; A: sources and flattening."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import MS, audit, flat, sql, table
from veilkit.operators import anomaly as AN
from veilkit.operators import notify as N
from veilkit.operators import quota as Q
from veilkit.operators import sessions as SE
from veilkit.operators import shadow as SH

ANOMALY = {"window_minutes": 1440, "thresholds": {"subjects": 3, "blocked": 2, "overrides": 1, "secrets": 2, "injection": 2}}
QUOTAS = {"default": {"requests_per_minute": 1, "monthly_tokens": 150_000},
          "teams": {"stajyer": {"monthly_cost_usd": 0.3}, "finans": {"requests_per_minute": 2}}}
CHANNELS = [
    {"name": "guvenlik", "type": "slack", "when": {"actions": ["block"]}, "cooldown_seconds": 36_000},
    {"name": "sir", "type": "slack", "when": {"entity_in": ["SECRET_*"], "actions": ["mask", "alert", "allow"]}, "cooldown_seconds": 60},
    {"name": "golge", "type": "teams", "when": {"sources": ["browser"], "actions": ["alert", "block"]}, "cooldown_seconds": 86_400},
    {"name": "siem", "when": {"rules": ["golge-ai:*"], "teams": ["finans", "yazilim"]}, "cooldown_seconds": 0, "include_user": False},
]


def signals(s, d):
    return flat(AN.event_signals(audit(s, d)).select("event_id", "user", "signal", "hashes"))


def count_alerts(s, d):
    return flat(AN.count_alerts(audit(s, d), ANOMALY).select("event_id", "user", "signal", "slot", "threshold"))


def subject_alerts(s, d):
    return flat(AN.subject_alerts(audit(s, d), ANOMALY).select("event_id", "user", "slot", "count"))


def alert_events(s, d):
    rows = AN.alert_events(AN.alerts(audit(s, d), ANOMALY), ANOMALY)
    return flat(rows.select("event_id", "user", "rules", "reason", "api_format"))


def quota_rows(s, d):
    return Q.replay(audit(s, d).filter("action <> 'block'"), QUOTAS)


def quotas_applied(s, d):
    rows = Q.with_quotas(audit(s, d).withColumn("quota", F.lit("")), QUOTAS)
    return flat(rows.select("event_id", "action", "rules", "quota", "est_cost_usd"))


def matches(s, d):
    return N.match_channels(audit(s, d), CHANNELS)


def cooldown(s, d):
    return N.cooldown(matches(s, d)).select("event_id", "channel", "sent", "suppressed")


def payloads(s, d):
    sent = N.cooldown(matches(s, d)).filter("sent")
    return flat(N.payloads(sent).select("event_id", "channel", "summary", F.size("facts").alias("facts"),
                                        F.get_json_object("payload", "$.severity").alias("severity"),
                                        F.get_json_object("payload", "$.source").alias("source")))


def session_rows(s, d):
    rows = table(s, d, "events").select("event_id", F.col("ts").alias("event_time"), F.lit("proxy").alias("source"),
                                        F.col("user_id").alias("session_id"), "event_type")
    return rows.filter("event_type = 'view'").drop("event_type"), rows.filter("event_type <> 'view'").drop("event_type")


def sessions(s, d):
    asked, answered = session_rows(s, d)
    return flat(SE.join_sessions(asked, answered, 7200).select("event_id", "session_id", "request_id"))


def reported_once(s, d):
    """Leaking answers of a user, once per two hours without one."""
    leaks = audit(s, d).filter("size(output_leaked) > 0").select("event_id", "event_time", F.lit("proxy").alias("source"), F.col("user").alias("session_id"))
    return SE.report_once(leaks, 7200).select("event_id", "session_id")


def browser_events(s, d):
    """Browser events as the extension sends them, some of them malformed."""
    return audit(s, d).filter("api_format = 'browser'").select(
        "event_id", "event_time", F.expr("if(k % 11 = 0, 'Bad Site', upper(model))").alias("site"),
        F.expr("if(k % 13 = 0, 'copied', substr(rules[size(rules) - if(exists(rules, r -> startswith(r, 'golge-ai:gerekce')), 2, 1)], 10))").alias("action"),
        F.expr("element_at(array('paste', 'send', 'file', 'banner', 'live', NULL), cast(k % 6 AS int) + 1)").alias("trigger"),
        F.expr("if(k % 6 = 4, element_at(array('consent', 'test_data', 'false_positive', 'other'), cast(event_id % 4 AS int) + 1), NULL)").alias("justification"),
        F.expr("event_id % 10 = 0").alias("preview_unavailable"),
        F.expr("map_from_arrays(entities, transform(entities, e -> if(k % 17 = 0, 200000, cast(k AS int))))").alias("entities"),
        F.col("prompt_chars").alias("chars"), "user", "team", F.expr("if(k % 29 = 0, 'v1', '1.2.3')").alias("extension_version"))


def shadow_problems(s, d):
    return SH.validate(browser_events(s, d)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def shadow_audit(s, d):
    rows = SH.to_audit(SH.validate(browser_events(s, d)).filter("problem IS NULL"))
    return flat(rows.select("event_id", "model", "action", "rules", "reason", "entities", "masked_entities", "masked_count"))


def shadow_admission(s, d):
    """Events of a team and hour form one batch."""
    rows = browser_events(s, d).withColumn("at", F.date_trunc("hour", "event_time"))
    counted = rows.groupBy("team", "at", "user").agg(F.count(F.lit(1)).cast("int").alias("n"))
    batches = counted.groupBy("team", "at").agg(F.map_from_entries(F.collect_list(F.struct("user", "n"))).alias("users"))
    batches = batches.withColumn("batch_id", F.concat_ws("|", "team", F.date_format("at", "yyyyMMddHH")))
    return SH.admit_batches(batches, per_user=1, total=3).select("batch_id", "admitted")


def approximate_error(s, d):
    """Windows that the sketches report, and whether every estimate is within five per cent of the exact count."""
    rows = audit(s, d)
    found = AN.approximate_subjects(rows, ANOMALY)
    exact = (rows.filter("destination = 'external' AND action <> 'block'").withColumn("slot", AN.slot(ANOMALY["window_minutes"]))
             .select("user", "slot", F.explode("subject_hashes").alias("hash")).groupBy("user", "slot").agg(F.countDistinct("hash").alias("exact")))
    near = F.abs(F.col("subjects") - F.col("exact")) <= 0.05 * F.col("exact")
    return found.join(exact, ["user", "slot"]).groupBy("user").agg(F.count(F.lit(1)).alias("windows"), F.bool_and(near).alias("near"))


QUERIES = {
    "a18_shadow_problems": shadow_problems,
    "a18_shadow_audit": shadow_audit,
    "f1_event_signals": signals,
    "f2_count_alerts": count_alerts,
    "f2_alert_events": alert_events,
    "f3_subject_alerts": subject_alerts,
    "f3_subjects_approx_error": approximate_error,
    "f3_subjects_approx": lambda s, d: AN.approximate_subjects(audit(s, d), ANOMALY).select("user").distinct(),
    "f4_f5_quota_replay": lambda s, d: quota_rows(s, d).select("event_id", "minute_count", "quota_kind", "quota_limit", "quota_used"),
    "f7_quota_applied": quotas_applied,
    "f8_channel_matches": lambda s, d: matches(s, d).select("event_id", "channel", "cooldown", "repeat_key"),
    "f9_cooldown": cooldown,
    "f10_payloads": payloads,
    "f11_shadow_admission": shadow_admission,
    "f12_sessions": sessions,
    "f12_reported_once": reported_once,
}

_EFF = ("CASE greatest(list_position(['allow','alert','mask','block'], action), list_position(['allow','alert','mask','block'], "
        "CASE WHEN output_action='' THEN 'allow' ELSE output_action END)) WHEN 1 THEN 'allow' WHEN 2 THEN 'alert' WHEN 3 THEN 'mask' ELSE 'block' END")
_SIGNALS = f"""sig AS (SELECT *, date_trunc('day', event_time) AS slot, unnest(list_filter([CASE WHEN {_EFF}='block' THEN 'blocked' END, CASE WHEN list_contains(rules,'golge-ai:allowed_override') THEN 'overrides' END,
 CASE WHEN k%13=0 THEN 'secrets' END, CASE WHEN injection_score>=0.5::DOUBLE THEN 'injection' END], lambda x: x IS NOT NULL)) AS signal FROM audit)"""
_ALERTS = """thr AS (SELECT * FROM (VALUES ('blocked', 2), ('overrides', 1), ('secrets', 2), ('injection', 2)) t(signal, threshold)),
ca AS (SELECT event_id, "user", signal, slot, threshold FROM (SELECT *, row_number() OVER (PARTITION BY "user", signal, slot ORDER BY event_time, event_id) AS n
 FROM sig WHERE "user" <> 'anonymous') JOIN thr USING (signal) WHERE n = threshold)"""
_SUBJ = """fs AS (SELECT "user", slot, h, min((event_time, event_id)) AS first FROM (SELECT *, date_trunc('day', event_time) AS slot, unnest(subject_hashes) AS h FROM audit
 WHERE "user" <> 'anonymous' AND destination='external' AND action<>'block') GROUP BY 1, 2, 3),
hit AS (SELECT "user", slot, first AS pos FROM (SELECT *, row_number() OVER (PARTITION BY "user", slot ORDER BY first, h) AS n FROM fs) WHERE n = 3),
sa AS (SELECT struct_extract_at(pos, 2) AS event_id, "user", slot, count(*) AS n_subjects FROM fs JOIN hit USING ("user", slot) WHERE first <= pos GROUP BY pos, "user", slot)"""
_QUOTA = """q0 AS (SELECT *, CASE WHEN team='finans' THEN 2 ELSE 1 END AS rpm, CASE WHEN team='stajyer' THEN 0.3::DOUBLE END AS lc, 150000 AS lt,
 row_number() OVER (PARTITION BY team, date_trunc('minute', event_time) ORDER BY event_time, event_id) AS minute_count FROM audit WHERE action <> 'block'),
q1 AS (SELECT *, minute_count > rpm AS over_m, sum(CASE WHEN minute_count > rpm THEN 0 ELSE prompt_tokens + completion_tokens END) OVER w AS tb,
 sum(CASE WHEN minute_count > rpm THEN 0 ELSE CAST(round_even(coalesce(est_cost_usd, 0) * 1000000, 0) AS BIGINT) END) OVER w AS cb FROM q0
 WINDOW w AS (PARTITION BY team, date_trunc('month', event_time) ORDER BY event_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q2 AS (SELECT *, NOT over_m AND (coalesce(tb, 0) >= lt OR coalesce(coalesce(cb, 0) / 1000000::DOUBLE >= lc, false)) AS f FROM q1),
q3 AS (SELECT *, min(CASE WHEN f THEN tb END) OVER (PARTITION BY team, date_trunc('month', event_time)) AS ft,
 min(CASE WHEN f THEN cb / 1000000::DOUBLE END) OVER (PARTITION BY team, date_trunc('month', event_time)) AS fc FROM q2),
quota_rows AS (SELECT * EXCLUDE (quota), CASE WHEN over_m THEN 'requests_per_minute' WHEN f AND ft >= lt THEN 'monthly_tokens' WHEN f THEN 'monthly_cost_usd' END AS kind FROM q3)"""
_MATCHES = f"""m AS (SELECT event_id, event_time, team, "user", action, output_action, reason_key AS repeat_key, unnest(list_filter([
 CASE WHEN eff='block' THEN {{'channel': 'guvenlik', 'cooldown': 36000}} END,
 CASE WHEN k%13=0 AND eff IN ('mask','alert','allow') THEN {{'channel': 'sir', 'cooldown': 60}} END,
 CASE WHEN api_format='browser' AND eff IN ('alert','block') THEN {{'channel': 'golge', 'cooldown': 86400}} END,
 CASE WHEN team IN ('finans','yazilim') AND len(list_filter(rules, lambda r: starts_with(r, 'golge-ai:'))) > 0 THEN {{'channel': 'siem', 'cooldown': 0}} END], lambda c: c IS NOT NULL), recursive := true)
 FROM (SELECT *, {_EFF} AS eff, CASE WHEN len(rules) > 0 THEN array_to_string(rules, ',') ELSE {_EFF} END AS reason_key FROM audit))"""

ORACLES = {
    "f1_event_signals": sql("""SELECT event_id, "user", signal, NULL AS hashes FROM sig UNION ALL SELECT event_id, "user", 'subjects', array_to_string(subject_hashes, ',') FROM audit
 WHERE len(subject_hashes) > 0 AND destination='external' AND action<>'block'""", _SIGNALS),
    "f2_count_alerts": sql(f"SELECT event_id, \"user\", signal, strftime(slot, {MS}) AS slot, threshold FROM ca", _SIGNALS, _ALERTS),
    "f2_alert_events": sql("""SELECT event_id, "user", 'anomali:' || signal AS rules, 'Anomali: son 1440 dakikada ' || n || ' kez ' || CASE signal WHEN 'blocked' THEN 'istek engellendi'
 WHEN 'overrides' THEN 'uyarıya rağmen gönderim (tarayıcı eklentisi)' WHEN 'secrets' THEN 'sır içeren istek' WHEN 'injection' THEN 'injection denemesi'
 ELSE 'farklı kişinin kimlik / iletişim bilgisi yurt dışı modele gitti' END || ' (eşik ' || threshold || ')' AS reason, 'anomaly' AS api_format FROM (
 SELECT event_id, "user", signal, threshold, threshold AS n FROM ca UNION ALL SELECT event_id, "user", 'subjects', 3, n_subjects FROM sa)""", _SIGNALS, _ALERTS, _SUBJ),
    "f3_subjects_approx_error": sql(f"""SELECT "user", count(*) AS windows, true AS near FROM (SELECT "user", date_trunc('day', event_time) AS slot, count(DISTINCT h) AS n
 FROM (SELECT "user", event_time, unnest(subject_hashes) AS h FROM audit WHERE "user" <> 'anonymous' AND destination='external' AND action<>'block') GROUP BY 1, 2) WHERE n >= 3 GROUP BY 1"""),
    "f3_subjects_approx": sql("""SELECT DISTINCT "user" FROM (SELECT "user", date_trunc('day', event_time) AS slot, count(DISTINCT h) AS n FROM (SELECT "user", event_time,
 unnest(subject_hashes) AS h FROM audit WHERE "user" <> 'anonymous' AND destination='external' AND action<>'block') GROUP BY 1, 2) WHERE n >= 3"""),
    "f3_subject_alerts": sql(f"SELECT event_id, \"user\", strftime(slot, {MS}) AS slot, n_subjects AS count FROM sa", _SUBJ),
    "f4_f5_quota_replay": sql("""SELECT event_id, minute_count, kind AS quota_kind, CASE kind WHEN 'requests_per_minute' THEN rpm::DOUBLE WHEN 'monthly_tokens' THEN lt::DOUBLE
 WHEN 'monthly_cost_usd' THEN lc END AS quota_limit, CASE kind WHEN 'requests_per_minute' THEN minute_count::DOUBLE WHEN 'monthly_tokens' THEN ft::DOUBLE
 WHEN 'monthly_cost_usd' THEN round(fc, 4) END AS quota_used FROM quota_rows""", _QUOTA),
    "f7_quota_applied": sql("""SELECT event_id, CASE WHEN kind IS NULL THEN action ELSE 'block' END AS action, array_to_string(CASE WHEN kind IS NULL THEN rules ELSE list_append(rules, 'kota:' || kind) END, ',') AS rules,
 coalesce(kind, '') AS quota, CASE WHEN kind IS NULL THEN est_cost_usd ELSE 0 END AS est_cost_usd FROM quota_rows
 UNION ALL SELECT event_id, action, array_to_string(rules, ','), '', est_cost_usd FROM audit WHERE action='block'""", _QUOTA),
    "f8_channel_matches": sql("SELECT event_id, channel, cooldown, repeat_key FROM m", _MATCHES),
    "f12_sessions": """SELECT a.event_id, a.user_id AS session_id, CASE WHEN r.ts >= a.ts - INTERVAL 7200 SECOND THEN r.event_id END AS request_id
 FROM (SELECT * FROM events WHERE event_type <> 'view') a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) r
 ON a.user_id = r.user_id AND a.ts >= r.ts""",
    "f12_reported_once": sql("""SELECT event_id, "user" AS session_id FROM (SELECT event_id, "user", event_time, lag(event_time) OVER (PARTITION BY "user" ORDER BY event_time, event_id) AS p
 FROM audit WHERE len(output_leaked) > 0) WHERE p IS NULL OR event_time > p + INTERVAL 7200 SECOND"""),
}
ORACLES["f11_shadow_admission"] = sql("""SELECT batch_id, fits AS admitted FROM fold WHERE i > 0""", """
users AS (SELECT team, date_trunc('hour', event_time) AS hr, "user", CAST(count(*) AS BIGINT) AS n FROM audit WHERE api_format = 'browser' GROUP BY ALL),
batches AS (SELECT hr, batch_id, us, row_number() OVER (PARTITION BY hr ORDER BY batch_id) AS i FROM (
 SELECT hr, team || '|' || strftime(hr, '%Y%m%d%H') AS batch_id, list({'u': "user", 'n': n}) AS us FROM users GROUP BY hr, team)),
fold(hr, i, used, seen, batch_id, fits) AS (
 SELECT DISTINCT hr, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(MAP {} AS MAP(VARCHAR, BIGINT)), CAST(NULL AS VARCHAR), CAST(NULL AS BOOLEAN) FROM batches
 UNION ALL SELECT hr, i, CASE WHEN ok THEN now ELSE used END, CASE WHEN ok THEN map_concat(seen, wanted) ELSE seen END, batch_id, ok FROM (
  SELECT *, now <= 3 AND list_max(map_values(wanted)) <= 1 AS ok FROM (
   SELECT b.hr, b.i, b.batch_id, f.used, f.seen, f.used + CAST(list_sum(list_transform(b.us, lambda e: e.n)) AS BIGINT) AS now,
    map_from_entries(list_transform(b.us, lambda e: {'k': e.u, 'v': e.n + coalesce(f.seen[e.u], 0)})) AS wanted
   FROM fold f JOIN batches b ON b.hr = f.hr AND b.i = f.i + 1)))""").replace("WITH ", "WITH RECURSIVE ", 1)
_COOL = _MATCHES + """,
keyed AS (SELECT *, dense_rank() OVER (ORDER BY channel, team, repeat_key) AS g, row_number() OVER (PARTITION BY channel, team, repeat_key ORDER BY event_time, event_id) AS n FROM m WHERE cooldown > 0),
nx AS (SELECT a.g, a.n, min(b.n) AS nxt FROM keyed a JOIN keyed b ON a.g = b.g AND b.event_time >= a.event_time + to_seconds(a.cooldown) GROUP BY 1, 2),
chain(g, n, prev) AS (SELECT g, 1, 0 FROM (SELECT DISTINCT g FROM keyed) UNION ALL SELECT nx.g, nx.nxt, nx.n FROM chain JOIN nx ON nx.g = chain.g AND nx.n = chain.n)"""
ORACLES["f9_cooldown"] = sql("""SELECT event_id, channel, c.n IS NOT NULL AS sent, CASE WHEN c.n IS NULL OR prev = 0 THEN 0 ELSE c.n - prev - 1 END AS suppressed
 FROM keyed k LEFT JOIN chain c ON c.g = k.g AND c.n = k.n UNION ALL SELECT event_id, channel, true, 0 FROM m WHERE cooldown = 0""", _COOL).replace("WITH ", "WITH RECURSIVE ", 1)
_TITLE = "CASE eff WHEN 'block' THEN 'Engellendi' WHEN 'mask' THEN 'Maskelendi' WHEN 'alert' THEN 'Uyarı' ELSE 'İzin verildi' END"
_SEV = "list_position(['allow','alert','mask','block'], {})"
ORACLES["f10_payloads"] = sql(f"""SELECT event_id, channel, {_TITLE} || CASE WHEN output_action <> '' AND {_SEV.format('output_action')} >= {_SEV.format('action')} AND len(output_leaked) > 0
 THEN ' (model cevabında sızıntı)' ELSE '' END AS summary, 3 + (channel <> 'siem')::INT + (len(rules) > 0)::INT + (len(entities) > 0)::INT + (len(output_leaked) > 0)::INT + (injection_score >= 0.5::DOUBLE)::INT AS facts,
 eff AS severity, CASE api_format WHEN 'browser' THEN 'browser' WHEN 'icap' THEN 'network' ELSE 'gateway' END AS source
 FROM (SELECT event_id, channel FROM keyed k JOIN chain c ON c.g = k.g AND c.n = k.n UNION ALL SELECT event_id, channel FROM m WHERE cooldown = 0) s
 JOIN (SELECT *, {_EFF} AS eff FROM audit) a USING (event_id)""", _COOL).replace("WITH ", "WITH RECURSIVE ", 1)
ORACLES["a18_shadow_problems"] = sql("""SELECT problem, count(*) AS n FROM (SELECT CASE WHEN k%11=0 THEN 'site' WHEN k%13=0 THEN 'action'
 WHEN k%17=0 AND len(entities) > 0 THEN 'counts' WHEN k%29=0 THEN 'extension_version' END AS problem FROM audit WHERE api_format='browser') GROUP BY 1""")
ORACLES["a18_shadow_audit"] = sql("""SELECT event_id, model, CASE c WHEN 'masked' THEN 'mask' WHEN 'visit' THEN 'allow' WHEN 'allowed_override' THEN 'alert' ELSE 'block' END AS action,
 'golge-ai:' || c || CASE WHEN c='allowed_override' THEN ',golge-ai:gerekce:' || j ELSE '' END || CASE WHEN event_id%10=0 THEN ',golge-ai:onizleme-acilamadi' ELSE '' END AS rules,
 concat_ws(' · ', CASE k%6 WHEN 0 THEN 'Tarayıcı: yapıştırma sırasında' WHEN 1 THEN 'Tarayıcı: gönderim sırasında' WHEN 2 THEN 'Tarayıcı: dosya eklerken'
  WHEN 3 THEN 'Tarayıcı: bilgilendirme bandından' WHEN 4 THEN 'Tarayıcı: yazarken (canlı uyarı)' END, CASE WHEN c='allowed_override' THEN 'Gerekçe: ' || CASE j WHEN 'consent' THEN 'Müşteri / ilgili kişi onayı'
  WHEN 'test_data' THEN 'Test / sahte veri' WHEN 'false_positive' THEN 'Yanlış alarm' ELSE 'Diğer' END END) AS reason,
 array_to_string(entities, ',') AS entities, CASE WHEN c='masked' THEN array_to_string(entities, ',') ELSE '' END AS masked_entities,
 CASE WHEN c='masked' THEN len(entities) * k ELSE 0 END AS masked_count FROM (SELECT *, ['visit','masked','cancelled','blocked','allowed_override','redirected'][k%6+1] AS c,
 ['consent','test_data','false_positive','other'][event_id%4+1] AS j FROM audit WHERE api_format='browser' AND k%11<>0 AND k%13<>0 AND NOT (k%17=0 AND len(entities) > 0) AND k%29<>0)""")
