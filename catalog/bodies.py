"""A: request, response and HTTP bodies; attachments; report files; audit storage. C10: nested masking."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.common import AS_OF, DAYS, MS, audit, flat, label_sql, provider_sql, scratch, sql, table
from catalog.prompts import PROMPTS_CTE, prompts
from veilkit import defaults, fixed
from veilkit.functions.arrays import pinned
from veilkit.operators import attachments as AT
from veilkit.operators import bodies as B
from veilkit.operators import flatten as FL
from veilkit.operators import mask as M
from veilkit.operators import parts as PT
from veilkit.plans import usage as U
from veilkit.sources import audit as SA
from veilkit.sources import csv_report as CR

# built as text around quoted strings, because JSON arrays mix shapes that Spark structs cannot


def _quoted(column: str) -> str:
    return f"substr(to_json(named_struct('v', {column})), 6, length(to_json(named_struct('v', {column}))) - 6)"


_TEXT, _ANSWER = _quoted("text"), _quoted("answer")
_ARGS = _quoted("concat('{\"q\": ', substr(to_json(named_struct('v', project)), 6, length(to_json(named_struct('v', project))) - 6), ', \"n\": [1, \"iki\"]}')")
CHAT = (f"concat('{{\"model\":\"gpt-4o\",\"messages\":[{{\"role\":\"system\",\"content\":\"Kısa yanıtla.\"}},{{\"role\":\"user\",\"content\":[{{\"type\":\"text\",\"text\":', {_TEXT}, "
        f"'}},{{\"type\":\"image_url\",\"image_url\":{{\"url\":\"http://x/y.png\"}}}}]}},{{\"role\":\"assistant\",\"content\":null,\"tool_calls\":[{{\"id\":\"c1\",\"type\":\"function\",\"function\":{{\"name\":\"ara\",\"arguments\":', "
        f"{_ARGS}, '}}}}]}}],\"metadata\":{{\"no\":', cast(2000000000 + event_id AS string), ',\"adet\":5}}}}')")
RESPONSES = (f"concat('{{\"instructions\":\"Kısa\",\"input\":[{{\"role\":\"developer\",\"content\":\"Geliştirici\"}},{{\"type\":\"message\",\"role\":\"user\",\"content\":[{{\"type\":\"input_text\",\"text\":', {_TEXT}, "
             f"'}}]}},{{\"type\":\"reasoning\",\"summary\":\"imzalı\"}},{{\"type\":\"function_call_output\",\"call_id\":\"c\",\"output\":', {_ANSWER}, '}}]}}')")
MESSAGES = (f"concat('{{\"system\":\"Sistem\",\"tools\":[{{\"name\":\"ara\",\"description\":\"arama aracı\"}}],\"messages\":[{{\"role\":\"user\",\"content\":[{{\"type\":\"text\",\"text\":', {_TEXT}, "
            f"'}},{{\"type\":\"tool_result\",\"tool_use_id\":\"t\",\"content\":[{{\"type\":\"text\",\"text\":', {_ANSWER}, '}}]}},{{\"type\":\"thinking\",\"thinking\":\"gizli\",\"signature\":\"s\"}}]}}]}}')")
EMBEDDINGS = f"concat('{{\"input\":[', {_TEXT}, ',', {_ANSWER}, ']}}')"


def request_bodies(s, d):
    kind = "element_at(array('chat', 'responses', 'messages', 'embeddings'), cast(event_id % 4 AS int) + 1)"
    body = f"CASE event_id % 4 WHEN 0 THEN {CHAT} WHEN 1 THEN {RESPONSES} WHEN 2 THEN {MESSAGES} ELSE {EMBEDDINGS} END"
    return (prompts(s, d).withColumn("project", F.expr("concat('Proje ', team)")).withColumn("api_format", F.expr(kind))
            .select("event_id", "api_format", F.expr(body).alias("body")))


def request_parts(s, d):
    rows = FL.request_parts(request_bodies(s, d))
    return rows.select("event_id", "api_format", F.expr("array_join(transform(parts, p -> concat(p.role, '=', p.text)), '|')").alias("parts"))


def json_leaf_counts(s, d):
    rows = request_bodies(s, d).withColumn("leaves", FL.json_leaves("body"))
    return rows.select("event_id", F.explode("leaves").alias("l")).groupBy("event_id").agg(
        F.count_if(F.col("l.kind") == "string").alias("strings"), F.count_if(F.col("l.kind") == "int").alias("numbers"))


def response_bodies(s, d):
    usage = {
        "chat": "'{\"prompt_tokens\":', cast(k AS string), ',\"completion_tokens\":', cast(k * 2 AS string), '}'",
        "responses": "'{\"input_tokens\":', cast(k AS string), ',\"output_tokens\":', cast(k * 2 AS string), '}'",
        "messages": "'{\"input_tokens\":', cast(k AS string), ',\"cache_creation_input_tokens\":40,\"cache_read_input_tokens\":10,\"output_tokens\":', cast(k * 2 AS string), '}'",
    }
    chat = (f"concat('{{\"choices\":[{{\"index\":0,\"message\":{{\"role\":\"assistant\",\"content\":', {_ANSWER}, ',\"tool_calls\":[{{\"function\":{{\"name\":\"f\",\"arguments\":\"{{\\\\\"a\\\\\": \\\\\"b\\\\\"}}\"}}}}]}}}}],\"usage\":', {usage['chat']}, '}}')")
    responses = f"concat('{{\"output\":[{{\"type\":\"message\",\"content\":[{{\"type\":\"output_text\",\"text\":', {_ANSWER}, '}}]}}],\"usage\":', {usage['responses']}, '}}')"
    messages = (f"concat('{{\"content\":[{{\"type\":\"text\",\"text\":', {_ANSWER}, '}},{{\"type\":\"tool_use\",\"id\":\"i\",\"name\":\"n\",\"input\":{{\"p\":\"q\"}}}}],\"usage\":', {usage['messages']}, '}}')")
    kind = "element_at(array('chat', 'responses', 'messages', 'embeddings'), cast(event_id % 4 AS int) + 1)"
    body = f"CASE event_id % 4 WHEN 0 THEN {chat} WHEN 1 THEN {responses} WHEN 2 THEN {messages} ELSE '{{\"data\":[]}}' END"
    return prompts(s, d).select("event_id", F.expr(kind).alias("api_format"), F.expr(body).alias("response"))


def response_parts(s, d):
    rows = FL.usage_tokens(FL.response_parts(response_bodies(s, d), body="response"))
    return rows.select("event_id", F.expr("array_join(transform(parts, p -> concat(p.role, '=', p.text)), '|')").alias("parts"),
                       "prompt_tokens", "completion_tokens", "priced_prompt_tokens", "usage_known")


def nested_masking(s, d):
    """Every text inside a chat body is scanned and masked, then the JSON is put together again."""
    rows = prompts(s, d).withColumn("project", F.expr("concat('Proje ', team)")).withColumn("api_format", F.lit("chat"))
    rows = FL.request_parts(rows.withColumn("body", F.expr(CHAT)).select("event_id", "api_format", "body"))
    rows = PT.analyze_parts(rows, defaults.SCAN)
    row = M.mask_row("transform(parts, p -> p.text)", "part_findings", "true")
    rows = rows.withColumn("m", F.expr(pinned(row))).withColumn("masked", F.col("m.masked"))
    out = rows.withColumn("sent", FL.rebuild("body", "parts", "masked"))
    return out.select("event_id", F.get_json_object("sent", "$.messages[1].content[0].text").alias("user_text"),
                      F.get_json_object("sent", "$.messages[2].tool_calls[0].function.arguments").alias("arguments"),
                      F.expr("coalesce(size(m.vault), 0)").cast("bigint").alias("masked_values"))


def page_bodies(s, d):
    """Web pages as HTTP bodies of several content types; text bodies come back whole."""
    kind = F.expr("element_at(array('text/html; charset=utf-8', 'application/xhtml+xml', 'image/png', ''), cast(page_id % 4 AS int) + 1)")
    rows = table(s, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("body"), kind.alias("content_type"),
                                       F.expr("if(page_id % 10 = 9, 'br', '')").alias("content_encoding"))
    return B.extract_text(rows).select("page_id", F.sha2("text", 256).alias("sha"), "unscannable")


@F.pandas_udf(T.BinaryType())
def _two_members(body: pd.Series) -> pd.Series:
    return body.map(lambda b: gzip.compress(b[: len(b) // 2]) + gzip.compress(b[len(b) // 2:]))


def conversation_bodies(s, d):
    """Conversation turns as JSON, form and line bodies, those of every other conversation gzipped in two members."""
    rows = table(s, d, "conversations").withColumn("q", F.expr(_quoted("text")))
    body = F.expr("CASE turn % 3 WHEN 0 THEN concat('{\"a\":{\"b\":', q, '},\"n\":7,\"x\":\"1\"}') "
                  "WHEN 1 THEN concat('f=', url_encode(concat('[[', q, ']]')), '&bos=') ELSE concat('{\"t\":', q, '}\n{\"u\":\"son satır\"}\n') END")
    kind = F.expr("CASE turn % 3 WHEN 1 THEN 'application/x-www-form-urlencoded' ELSE 'application/json' END")
    rows = rows.select("conv_id", "turn", F.encode(body, "UTF-8").alias("body"), kind.alias("content_type"),
                       F.when(F.col("conv_id") % 2 == 0, "gzip").otherwise("").alias("content_encoding"))
    rows = rows.withColumn("body", F.when(F.col("content_encoding") == "gzip", _two_members("body")).otherwise(F.col("body")))
    return B.extract_text(rows).select("conv_id", "turn", "text", "unscannable")


def large_bodies(s, d):
    """Every document 45 JSON levels down, and the documents of a language and source in blocks of 2,000 together as plain
    texts, the largest of which have over 5 MiB; all end in a marker."""
    docs = table(s, d, "documents").select("doc_id", "lang", "source", "text")
    q = _quoted("concat(text, ' son ek')")
    nested = docs.select("doc_id", F.lit("").alias("of"), F.expr(f"encode(concat(repeat('[', 45), {q}, repeat(']', 45)), 'UTF-8')").alias("body"),
                         F.lit("application/json").alias("content_type"))
    block = F.floor(F.col("doc_id") / 2000).alias("doc_id")
    together = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n")
    long = (docs.groupBy(F.concat_ws("/", "lang", "source").alias("of"), block).agg(F.encode(F.concat(together, F.lit(" son ek")), "UTF-8").alias("body"))
            .select("doc_id", "of", "body", F.lit("text/plain").alias("content_type")))
    rows = nested.unionByName(long).withColumn("content_encoding", F.lit(""))
    return B.extract_text(rows).select("doc_id", "of", F.sha2("text", 256).alias("sha"), F.length("text").cast("bigint").alias("chars"), "unscannable")


def _attached(s, d):
    return table(s, d, "documents").select(
        "doc_id", (F.col("doc_id") % 40).alias("request_id"),
        F.expr("element_at(array('text/plain', 'application/pdf', 'image/png', 'application/zip', ''), cast(doc_id % 5 AS int) + 1)").alias("media_type"),
        F.expr("concat('ek', cast(doc_id AS string), if(doc_id % 5 = 4, '.MD', ''))").alias("name"),
        F.expr("if(doc_id % 7 = 0, NULL, encode(text, 'UTF-8'))").alias("content"),
        F.expr("if(doc_id % 14 = 0, 'file_id', NULL)").alias("remote_reason"))


def attachments(s, d):
    """Every document as a file: all are read."""
    out = AT.scan_texts(_attached(s, d), "request_id", "doc_id")
    return out.select("doc_id", "kind", "reason", F.length("text").cast("bigint").alias("chars"))


def attachment_limits(s, d):
    """The same files under a caller's limits of size and number, which mark what they leave out."""
    out = AT.scan_texts(_attached(s, d), "request_id", "doc_id", max_bytes=3000, max_count=20)
    return out.select("doc_id", "kind", "reason", F.length("text").cast("bigint").alias("chars"))


def unscannable_lists(s, d):
    """Forty documents a request, as files of all types: each one that cannot be read with the reason of its type."""
    rows = _attached(s, d).withColumn("request_id", F.floor(F.col("doc_id") / 40))
    return flat(AT.unscannable_lists(AT.scan_texts(rows, "request_id", "doc_id"), "request_id"))


def report_file(s, d):
    """The transfer report as spreadsheet lines, with a team name a spreadsheet would run as a formula."""
    rows = U.transfer(audit(s, d).withColumn("team", F.expr("if(team = 'finans', '=finans', team)")), "2024-01")
    lines = CR.report_lines(rows, fixed.TRANSFER_COLUMNS)
    return lines.filter("position >= 0").select("line")


def report_bytes(s, d):
    """The written report file byte by byte: mark, heading lines, rows in order, line ends."""
    folder = scratch(s)
    rows = U.transfer(audit(s, d).withColumn("team", F.expr("if(team = 'finans', '=finans', team)")), "2024-01")
    CR.write_report(rows, fixed.TRANSFER_COLUMNS, f"{folder}/report", title="Yurt dışı aktarım")
    files = s.read.format("binaryFile").load(f"{folder}/report/part-*")
    return files.select(F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha"), F.hex(F.substring("content", 1, 3)).alias("mark"))


def json_events(s, d):
    """Audit rows as queue events: UUID ids and epoch milliseconds (three hours behind local time)."""
    rows = audit(s, d)
    digits = "lpad(cast(event_id AS string), 12, '0')"
    at = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', event_time) - 3 * 3600 * 1000"
    return rows.withColumns({"event_id": F.expr(f"concat('00000000-0000-0000-0000-', {digits})"), "ts": F.expr(at),
                             "unknown_field": F.lit("x")}).drop("event_time")


def stored_audit(s, d):
    """Emit as JSON lines, read with the fixed schema, write by month, read back."""
    folder = scratch(s)
    SA.emit_json(json_events(s, d), f"{folder}/queue")
    rows = SA.to_audit(SA.read_audit_json(s, f"{folder}/queue"))
    SA.write_audit(rows, f"{folder}/audit", files_per_month=2)
    return U.by_team(SA.read_audit(s, f"{folder}/audit"), AS_OF, DAYS)


def read_typed(s, d):
    folder = scratch(s)
    SA.emit_json(json_events(s, d), f"{folder}/queue")
    rows = SA.to_audit(SA.read_audit_json(s, f"{folder}/queue"))
    return flat(rows.select("event_id", "event_time", "month", "user", "rules", "masked_prompt", "upstream_status", "output_rules", "est_cost_usd"))


def retention(s, d):
    rows = audit(s, d).withColumn("month", F.date_format("event_time", "yyyyMM").cast("int"))
    return SA.retained(rows, "2026-01-16 00:00:00").groupBy("month").agg(F.count(F.lit(1)).alias("rows"))


def subject_index(s, d):
    return SA.subject_index(audit(s, d)).groupBy("hash").agg(F.count(F.lit(1)).alias("events"), F.min("month").cast("bigint").alias("month"))


QUERIES = {
    "a1_read_audit_json": read_typed,
    "a3_month_partitions": stored_audit,
    "a3_retention": retention,
    "a4_emit_audit": lambda s, d: SA.event_json(json_events(s, d)).groupBy("key").agg(F.count(F.lit(1)).alias("n")),
    "a5_report_file": report_file,
    "a5_report_bytes": report_bytes,
    "a6_request_parts": request_parts,
    "a10_json_leaves": json_leaf_counts,
    "a13_response_parts": response_parts,
    "a15_page_bodies": page_bodies,
    "a15_conversation_bodies": conversation_bodies,
    "a15_large_bodies": large_bodies,
    "a16_attachments": attachments,
    "a16_attachment_limits": attachment_limits,
    "a17_unscannable": unscannable_lists,
    "c10_mask_nested": nested_masking,
    "e14_subject_index": subject_index,
}
_PARTS = """CASE event_id % 4 WHEN 0 THEN 'system=' || (2000000000 + event_id) || '|system=Kısa yanıtla.|user=' || text || '|assistant=Proje ' || team || '|assistant=iki'
 WHEN 1 THEN 'system=Kısa|system=Geliştirici|user=' || text || '|tool=' || answer WHEN 2 THEN 'system=arama aracı|system=Sistem|user=' || text || '|tool=' || answer
 ELSE 'user=' || text || '|user=' || answer END"""
ORACLES = {
    "a1_read_audit_json": sql(f"""SELECT '00000000-0000-0000-0000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, strftime(event_time, {MS}) AS event_time, 202401 AS month, "user",
 array_to_string(rules, ',') AS rules, '' AS masked_prompt, 0 AS upstream_status, '' AS output_rules, est_cost_usd FROM audit"""),
    "a3_retention": sql("SELECT 202401 AS month, count(*) AS rows FROM audit WHERE event_time >= TIMESTAMP '2024-01-16'"),
    "a4_emit_audit": sql("SELECT team AS key, count(*) AS n FROM audit GROUP BY 1"),
    "a5_report_file": sql(f"""SELECT CASE WHEN team='finans' THEN '''=finans' ELSE team END || ';' || {provider_sql()} || ';' || model || ';' || {label_sql()} || ';' || count(*) || ';' || count(DISTINCT "user")
 || ';' || count(*) FILTER (WHERE action<>'block' AND list_contains(masked_entities, entity)) || ';' || count(*) FILTER (WHERE action<>'block' AND NOT list_contains(masked_entities, entity))
 || ';' || count(*) FILTER (WHERE action='block') AS line FROM (SELECT *, unnest(entities) AS entity FROM audit WHERE destination='external') WHERE NOT starts_with(entity,'SECRET_')
 AND NOT starts_with(entity,'KURUM_') GROUP BY team, model, entity"""),
    "a5_report_bytes": sql(f"""SELECT strlen(body) AS bytes, sha256(body) AS sha, 'EFBBBF' AS mark FROM (SELECT chr(65279) || 'Yurt dışı aktarım' || chr(13) || chr(10) ||
 '{";".join(label for _, label in fixed.TRANSFER_COLUMNS)}' || chr(13) || chr(10) || string_agg(line || chr(13) || chr(10), '' ORDER BY unmasked DESC, requests DESC, team, model, entity) AS body FROM (
 SELECT team, model, entity, count(*) AS requests, count(*) FILTER (WHERE action<>'block' AND NOT list_contains(masked_entities, entity)) AS unmasked,
 CASE WHEN team='=finans' THEN chr(39) || '=finans' ELSE team END || ';' || {provider_sql()} || ';' || model || ';' || {label_sql()} || ';' || count(*) || ';' || count(DISTINCT "user")
 || ';' || count(*) FILTER (WHERE action<>'block' AND list_contains(masked_entities, entity)) || ';' || count(*) FILTER (WHERE action<>'block' AND NOT list_contains(masked_entities, entity))
 || ';' || count(*) FILTER (WHERE action='block') AS line FROM (SELECT * REPLACE (CASE WHEN team='finans' THEN '=finans' ELSE team END AS team), unnest(entities) AS entity FROM audit
 WHERE destination='external') WHERE NOT starts_with(entity,'SECRET_') AND NOT starts_with(entity,'KURUM_') GROUP BY team, model, entity))"""),
    "a6_request_parts": sql(f"SELECT event_id, ['chat','responses','messages','embeddings'][event_id % 4 + 1] AS api_format, {_PARTS} AS parts FROM prompts", PROMPTS_CTE),
    "a10_json_leaves": sql("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 13 WHEN 1 THEN 12 WHEN 2 THEN 13 ELSE 2 END AS strings, CASE event_id % 4 WHEN 0 THEN 2 ELSE 0 END AS numbers FROM audit"""),
    "a13_response_parts": sql("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'assistant=' || answer || '|assistant=b' WHEN 1 THEN 'assistant=' || answer WHEN 2 THEN 'assistant=' || answer || '|assistant=q' ELSE '' END AS parts,
 CASE event_id % 4 WHEN 3 THEN 0 WHEN 2 THEN k + 50 ELSE k END AS prompt_tokens, CASE event_id % 4 WHEN 3 THEN 0 ELSE k * 2 END AS completion_tokens,
 CASE event_id % 4 WHEN 3 THEN 0 WHEN 2 THEN k + 51 ELSE k END::DOUBLE AS priced_prompt_tokens, event_id % 4 <> 3 AS usage_known FROM prompts""", PROMPTS_CTE),
    "a15_page_bodies": """SELECT page_id, sha256(CASE WHEN page_id % 10 = 9 OR page_id % 4 = 2 THEN '' ELSE html END) AS sha, page_id % 10 = 9 OR page_id % 4 = 2 AS unscannable FROM pages""",
    "a15_conversation_bodies": """SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN trim(text) || chr(10) || 'son satır' ELSE trim(text) END AS text, false AS unscannable FROM conversations""",
    "a16_attachments": """SELECT doc_id, kind, CASE WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 14 = 0 THEN 'file_id' ELSE 'uzak adres' END WHEN kind = 'text' THEN NULL
 ELSE 'desteklenmeyen tür (' || ['text/plain','application/pdf','image/png','application/zip','bilinmiyor'][doc_id % 5 + 1] || ')' END AS reason,
 CASE WHEN kind = 'text' AND doc_id % 7 <> 0 THEN length(text) END AS chars
 FROM (SELECT *, ['text','pdf','image','other','text'][doc_id % 5 + 1] AS kind FROM documents)""",
    "a16_attachment_limits": """SELECT doc_id, kind, CASE WHEN n > 20 THEN 'ek sayısı sınırı (20)' WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 14 = 0 THEN 'file_id' ELSE 'uzak adres' END
 WHEN octet_length(encode(text)) > 3000 THEN 'boyut sınırı aşıldı (' || octet_length(encode(text)) || ' bayt)' WHEN kind = 'text' THEN NULL
 ELSE 'desteklenmeyen tür (' || ['text/plain','application/pdf','image/png','application/zip','bilinmiyor'][doc_id % 5 + 1] || ')' END AS reason,
 CASE WHEN kind = 'text' AND n <= 20 AND doc_id % 7 <> 0 AND octet_length(encode(text)) <= 3000 THEN length(text) END AS chars
 FROM (SELECT *, ['text','pdf','image','other','text'][doc_id % 5 + 1] AS kind, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS n FROM documents)""",
    "a15_large_bodies": """SELECT doc_id, '' AS of, sha256(trim(text || ' son ek', ' ')) AS sha, length(trim(text || ' son ek', ' ')) AS chars, false AS unscannable FROM documents
 UNION ALL SELECT doc_id, of, sha256(body), length(body), false FROM (SELECT doc_id // 2000 AS doc_id, lang || '/' || source AS of,
 string_agg(text, chr(10) ORDER BY doc_id, text) || ' son ek' AS body FROM documents GROUP BY 1, 2)""",
    "a17_unscannable": """SELECT request_id, string_agg(DISTINCT name || ': ' || reason, ',' ORDER BY name || ': ' || reason) AS unscannable FROM (
 SELECT doc_id // 40 AS request_id, 'ek' || doc_id || CASE WHEN doc_id % 5 = 4 THEN '.MD' ELSE '' END AS name,
 CASE WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 14 = 0 THEN 'file_id' ELSE 'uzak adres' END WHEN doc_id % 5 IN (0, 4) THEN NULL
 ELSE 'desteklenmeyen tür (' || ['text/plain','application/pdf','image/png','application/zip','bilinmiyor'][doc_id % 5 + 1] || ')' END AS reason
 FROM documents) WHERE reason IS NOT NULL GROUP BY 1""",
    "c10_mask_nested": sql("""SELECT event_id, replace(replace(replace(replace(replace(text, iban, '[IBAN_TR_1]'), project, '[KURUM_PROJE_1]'), phone, '[PHONE_TR_1]'), aws, '[SECRET_AWS_KEY_1]'), shown, '[TCKN_1]') AS user_text,
 '{"q": "Proje ' || team || '", "n": [1, "iki"]}' AS arguments, len(entities) AS masked_values FROM prompts""", PROMPTS_CTE),
    "e14_subject_index": sql("SELECT h AS hash, count(*) AS events, 202401 AS month FROM (SELECT unnest(subject_hashes) AS h FROM audit) GROUP BY 1"),
}
from catalog.usage import ORACLES as _USAGE_ORACLES  # noqa: E402

ORACLES["a3_month_partitions"] = _USAGE_ORACLES["e3_usage_by_team"]
