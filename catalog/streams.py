"""Streaming twins, drained over the whole tables and compared with the batch results' SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.bodies import json_events, scratch
from catalog.common import AS_OF, DAYS, audit, flat, sql, table
from catalog.prompts import PROMPTS_CTE, prompts
from catalog.state import ANOMALY, CHANNELS, QUOTAS, ORACLES as STATE, browser_events
from catalog.usage import ORACLES as USAGE
from veilkit import defaults
from veilkit.plans import usage as U
from veilkit.sources import audit as SA
from veilkit.sources.event_audit import audit_from_events
from veilkit.streaming import alerts as AL
from veilkit.streaming import guard as G
from veilkit.streaming import ingest as IN
from veilkit.streaming import quotas as QS
from veilkit.streaming import sessions as SS


def event_stream(s, d):
    return s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parque[t]")


def drained(rows, s, **options):
    """Run a stream to its end into a table of its own and read that table."""
    folder = scratch(s)
    IN.append(rows, f"{folder}/out", f"{folder}/checkpoint", **options).awaitTermination()
    return s.read.schema(rows.schema).parquet(f"{folder}/out")


def ingest(s, d):
    folder = scratch(s)
    SA.event_json(json_events(s, d)).select("value").repartition(4).write.text(f"{folder}/queue")
    lines = IN.folder_lines(s, f"{folder}/queue", 2)
    IN.ingest_audit(lines, f"{folder}/audit", f"{folder}/checkpoint").awaitTermination()
    return U.by_team(SA.read_audit(s, f"{folder}/audit"), AS_OF, DAYS)


def anomaly(s, d):
    alerts = drained(AL.anomaly_stream(audit_from_events(event_stream(s, d)), ANOMALY), s)
    return alerts.select(F.col("event_id").cast("bigint").alias("event_id"), "user", "signal")


def rejects(s, d):
    """Event lines of which some are broken: accepted and rejected ones add up, each with its reason."""
    folder = scratch(s)
    broken = F.expr("CASE event_id % 5 WHEN 0 THEN concat('bozuk ', event_id) WHEN 1 THEN concat('{\"event_id\":\"', event_id, '\"}') "
                    "ELSE concat('{\"event_id\":\"00000000-0000-0000-0000-', lpad(cast(event_id AS string), 12, '0'), '\",\"ts\":1}') END")
    table(s, d, "events").select(broken.alias("value")).write.text(f"{folder}/lines")
    lines = IN.folder_lines(s, f"{folder}/lines")
    IN.ingest_audit(lines, f"{folder}/audit", f"{folder}/c1").awaitTermination()
    IN.ingest_rejects(lines, f"{folder}/rejected", f"{folder}/c2").awaitTermination()
    out = s.read.parquet(f"{folder}/rejected").select("problem").unionByName(
        s.read.parquet(f"{folder}/audit").select(F.lit("none").alias("problem")))
    return out.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def cooldown(s, d):
    rows = drained(AL.cooldown_stream(audit_from_events(event_stream(s, d)), CHANNELS), s)
    return rows.select(F.col("event_id").cast("bigint").alias("event_id"), "channel", "sent", "suppressed")


def quota_decisions(s, d):
    """Requests in three parts by time, the stream started anew after each: the same decisions as the replay's."""
    folder = scratch(s)
    QS.keep_state_in_rocksdb(s)
    rows = audit(s, d).filter("action <> 'block'").select("event_id", "event_time", "team", "prompt_tokens", "completion_tokens", "est_cost_usd")
    for days in ("day(event_time) <= 9", "day(event_time) BETWEEN 10 AND 20", "day(event_time) > 20"):
        rows.filter(days).write.mode("append").parquet(f"{folder}/in")
        stream = s.readStream.schema(rows.schema).parquet(f"{folder}/in")
        IN.append(QS.quota_stream(stream, QUOTAS), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    out = s.read.parquet(f"{folder}/out")
    return out.select(F.col("event_id").cast("bigint").alias("event_id"), "minute_count", "quota_kind", "quota_limit", "quota_used")


def sessions(s, d):
    """Purchases with the latest view of the same user within half an hour, from two streams. Both end with an
    event long after all others, which lets the watermark pass every purchase."""
    folder = scratch(s)
    rows = table(s, d, "events").select("event_id", F.col("ts").alias("event_time"), F.lit("proxy").alias("source"),
                                        F.col("user_id").alias("session_id"), "event_type")

    def side(kind):
        own = rows.filter(F.col("event_type") == kind).drop("event_type")
        end = s.sql("SELECT -1L AS event_id, TIMESTAMP_NTZ'2100-01-01 00:00:00' AS event_time, 'end' AS source, -1L AS session_id")
        own.unionByName(end.select(*[F.col(c).cast(t) for c, t in own.dtypes])).write.parquet(f"{folder}/{kind}")
        return s.readStream.schema(own.schema).parquet(f"{folder}/{kind}")

    joined = drained(SS.join_stream(side("view"), side("purchase"), ttl_seconds=1800), s)
    return joined.filter("event_id >= 0").select("event_id", "request_id")


def network(s, d):
    stream = audit_from_events(event_stream(s, d)).select(
        "event_id", "event_time", "user", "team", "teams", F.lit("api.openai.com").alias("host"), F.lit("/v1/responses").alias("path"),
        F.expr("if(k % 10 = 0, 'GET', 'POST')").alias("method"),
        F.expr("concat('kayıt ', cast(k AS string), if(k % 4 = 0, ' yaz@ornek.com', ''))").alias("text"),
        F.expr("k % 50 = 3").alias("truncated"), F.lit(False).alias("unscannable"))
    rows = drained(IN.network_stream(stream, defaults.policy(), defaults.SCAN), s)
    return rows.groupBy("action", "api_format").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("entities")).alias("entities"))


def browser(s, d):
    """Browser events as JSON lines through the stream; invalid ones never reach the table."""
    folder = scratch(s)
    browser_events(s, d).select(F.to_json(F.struct("*")).alias("value")).repartition(3).write.text(f"{folder}/lines")
    rows = drained(IN.browser_stream(IN.folder_lines(s, f"{folder}/lines", 1)), s)
    return flat(rows.select(F.expr("cast(event_id AS bigint)").alias("event_id"), "model", "action", "rules", "reason", "entities", "masked_entities", "masked_count"))


def answer_deltas(s, d):
    """Answers as server-sent events of three formats, one event per word."""
    words = prompts(s, d).select("event_id", F.expr("element_at(array('chat', 'responses', 'messages'), cast(event_id % 3 AS int) + 1)").alias("api_format"),
                                 F.posexplode(F.expr("regexp_extract_all(answer, '\\\\S+|\\\\s+', 0)")).alias("seq", "word"))
    piece = "substr(to_json(named_struct('v', word)), 6, length(to_json(named_struct('v', word))) - 6)"
    data = (f"CASE api_format WHEN 'chat' THEN concat('{{\"choices\":[{{\"index\":0,\"delta\":{{\"content\":', {piece}, '}}}}]}}') "
            f"WHEN 'responses' THEN concat('{{\"type\":\"response.output_text.delta\",\"output_index\":0,\"content_index\":0,\"delta\":', {piece}, '}}') "
            f"ELSE concat('{{\"type\":\"content_block_delta\",\"index\":0,\"delta\":{{\"type\":\"text_delta\",\"text\":', {piece}, '}}}}') END")
    lines = words.select(F.col("event_id").cast("string").alias("request_id"), "api_format", "seq", F.concat(F.lit("data: "), F.expr(data)).alias("line"))
    return G.deltas(G.sse_lines(lines))


def assembled(s, d):
    return G.assemble(answer_deltas(s, d)).select(F.col("request_id").cast("bigint").alias("event_id"), "block", "text")


def guard_requests(s, d):
    return prompts(s, d).select(F.col("event_id").cast("string").alias("request_id"), F.col("text").alias("all_text"),
                                F.expr("cast(map() AS map<string,string>)").alias("vault"), "team", "teams", "model", F.lit("external").alias("destination"))


def guarded_whole(s, d):
    answers = prompts(s, d).select(F.col("event_id").cast("string").alias("request_id"), F.lit("text-0").alias("block"), F.col("answer").alias("text"))
    out = G.guard_whole(answers, guard_requests(s, d), defaults.policy(), defaults.SCAN)
    return flat(out.select(F.col("request_id").cast("bigint").alias("event_id"), "out", "leaked"))


def guarded_surrogates(s, d):
    """Answers that repeat a surrogate and a respelled surrogate number of the vault: opened, not reported."""
    answers = table(s, d, "events").select(F.col("event_id").cast("string").alias("request_id"), F.lit("text-0").alias("block"), F.concat(
        F.lit("Yaz: kisi.abcdef@example.com, ara: 0532-999 88 77, no "), F.col("event_id").cast("string")).alias("text"))
    requests = guard_requests(s, d).withColumn("vault", F.expr(
        "map('kisi.abcdef@example.com', concat('u', request_id, '@ornek.com'), '0532 999 88 77', '0555 123 45 67', '[TCKN_1]', '10000000146')"))
    out = G.guard_whole(answers, requests, defaults.policy(), defaults.SCAN)
    return flat(out.select(F.col("request_id").cast("bigint").alias("event_id"), "out", "leaked"))


def guarded_blocking(s, d):
    """A blocking output rule: answers with a new card number are stopped whole, the others go out."""
    rules = [{"name": "kart-durdur", "when": {"entity_in": ["CREDIT_CARD"]}, "action": "block", "message": "Kart numarası."}]
    answers = prompts(s, d).select(F.col("event_id").cast("string").alias("request_id"), F.explode(F.array(
        F.struct(F.lit("text-0").alias("block"), F.col("answer").alias("text")), F.struct(F.lit("text-1").alias("block"), F.lit("son").alias("text")))).alias("b"))
    out = G.guard_buffered(answers.select("request_id", "b.*"), guard_requests(s, d), defaults.policy(output_rules=rules), defaults.SCAN)
    return flat(out.select(F.col("request_id").cast("bigint").alias("event_id"), "block", "out", "leaked", "action"))


def guarded_stream(s, d):
    """The same answers in three micro-batches of chunks; the pieces are put together again."""
    folder = scratch(s)
    chunks = prompts(s, d).select(F.col("event_id").cast("string").alias("request_id"), F.lit("text-0").alias("block"), F.expr(
        "explode(array(named_struct('seq', 0, 'delta', substr(answer, 1, 9), 'closed', false), named_struct('seq', 1, 'delta', substr(answer, 10, 17), 'closed', false), "
        "named_struct('seq', 2, 'delta', substr(answer, 27), 'closed', true)))").alias("c")).select("request_id", "block", "c.*")
    for n in range(3):  # a round for each third of the texts; the stream goes on from its checkpoint
        chunks.filter(F.col("seq") == n).write.mode("append").parquet(f"{folder}/chunks")
        stream = s.readStream.schema(chunks.schema).parquet(f"{folder}/chunks")
        G.guard_stream(stream, guard_requests(s, d), defaults.policy(), defaults.SCAN, out_path=f"{folder}/out", state_path=f"{folder}/state",
                       checkpoint=f"{folder}/checkpoint").awaitTermination()
    pieces = s.read.parquet(f"{folder}/out")
    whole = G.assemble(pieces.select("request_id", "block", F.col("batch").alias("seq"), F.col("out").alias("delta")), ("request_id", "block"))
    return whole.select(F.col("request_id").cast("bigint").alias("event_id"), F.col("text").alias("out"))


QUERIES = {
    "a2_ingest_stream": ingest,
    "a2_rejected_lines": rejects,
    "c16_guard_whole": guarded_whole,
    "c16_guard_surrogates": guarded_surrogates,
    "c16_guard_blocking": guarded_blocking,
    "c16_guard_stream": guarded_stream,
    "c18_sse_assemble": assembled,
    "f2_anomaly_stream": anomaly,
    "f4_f5_quota_stream": quota_decisions,
    "f9_cooldown_stream": cooldown,
    "f12_session_stream": sessions,
    "f13_browser_stream": browser,
    "f13_network_stream": network,
}
_CLEAN = "replace(answer, '4111 1111 1111 1111', '[GİZLENDİ:CREDIT_CARD]')"
ORACLES = {
    "a2_ingest_stream": USAGE["e3_usage_by_team"],
    "a2_rejected_lines": "SELECT CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'event_id' ELSE 'none' END AS problem, count(*) AS n FROM events GROUP BY 1",
    "c16_guard_whole": sql(f"""SELECT event_id, {_CLEAN} AS out, array_to_string(list_filter([CASE WHEN event_type='purchase' AND k%3=0 THEN 'CREDIT_CARD' END,
 CASE WHEN event_type='click' AND k%9=0 THEN 'EMAIL_ADDRESS' END], lambda e: e IS NOT NULL), ',') AS leaked FROM prompts""", PROMPTS_CTE),
    "c16_guard_surrogates": """SELECT event_id, 'Yaz: u' || event_id || '@ornek.com, ara: 0555 123 45 67, no ' || event_id AS out, '' AS leaked FROM events""",
    "c16_guard_blocking": sql("""SELECT event_id, block, CASE WHEN hit THEN NULL WHEN block = 'text-0' THEN answer ELSE 'son' END AS out,
 CASE WHEN block = 'text-1' THEN '' WHEN hit THEN 'CREDIT_CARD' WHEN event_type='click' AND k%9=0 THEN 'EMAIL_ADDRESS' ELSE '' END AS leaked,
 CASE WHEN hit THEN 'block' ELSE 'allow' END AS action
 FROM (SELECT *, (event_type='purchase' AND k%3=0) AS hit, unnest(['text-0', 'text-1']) AS block FROM prompts)""", PROMPTS_CTE),
    "c16_guard_stream": sql(f"SELECT event_id, {_CLEAN} AS out FROM prompts", PROMPTS_CTE),
    "c18_sse_assemble": sql("SELECT event_id, CASE event_id % 3 WHEN 1 THEN 'text-0-0' ELSE 'text-0' END AS block, answer AS text FROM prompts", PROMPTS_CTE),
    "f2_anomaly_stream": STATE["f2_alert_events"].replace("""SELECT event_id, "user", 'anomali:' || signal AS rules, 'Anomali""", """SELECT event_id, "user", signal FROM (SELECT event_id, "user", signal, 'Anomali""", 1) + ")",
    "f4_f5_quota_stream": STATE["f4_f5_quota_replay"],
    "f9_cooldown_stream": STATE["f9_cooldown"],
    "f12_session_stream": """SELECT a.event_id, CASE WHEN r.ts >= a.ts - INTERVAL 1800 SECOND THEN r.event_id END AS request_id
 FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) r
 ON a.user_id = r.user_id AND a.ts >= r.ts""",
    "f13_browser_stream": STATE["a18_shadow_audit"],
    "f13_network_stream": sql("""SELECT action, 'icap' AS api_format, count(*) AS n, CAST(sum(e) AS BIGINT) AS entities FROM (SELECT CASE WHEN k%4=0 OR k%50=3 THEN 'block' ELSE 'allow' END AS action,
 CASE WHEN k%4=0 THEN 1 ELSE 0 END AS e FROM audit WHERE k%10<>0) GROUP BY 1"""),
}
