"""C: placeholders, masking, unmasking, surrogates, leaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import flat, joined, sql
from catalog.prompts import PROMPTS_CTE, prompts
from veilkit import defaults
from veilkit.functions.values import subject_hash
from veilkit.operators import leaks as LK
from veilkit.operators import mask as M
from veilkit.operators import policy as P
from veilkit.operators import scan as S
from veilkit.operators import surrogate as SG
from veilkit.operators import vault as V
from veilkit.plans import subjects as SJ
from veilkit.session import materialize

KEY = b"catalog-key-of-at-least-32-bytes!!"
SCOPE = ["user_id"]
POLICY = defaults.policy()


def scanned(s, d, columns=("event_id", "user_id", "event_time", "text")):
    return S.with_findings(prompts(s, d).select(*columns), defaults.SCAN)


def values(s, d):
    return M.finding_values(scanned(s, d), SCOPE, "event_id")


def vault(s, d):
    return M.assign_placeholders(values(s, d), SCOPE)


def vault_of_uuids(s, d):
    """The same numbering when parts are known by UUIDs, as in the audit."""
    rows = values(s, d).withColumn("part", F.format_string("00000000-0000-4000-8000-%012d", "part"))
    return M.assign_placeholders(rows, SCOPE)


def known_values(s, d):
    """What a vault with surrogates knows: real values, surrogates, and respelled surrogate numbers."""
    table_ = SG.assign_surrogates(vault(s, d), SCOPE, KEY)
    found = LK.known_values(table_, SCOPE)
    real = found.join(vault(s, d).select(*SCOPE, F.col("original").alias("known")).distinct(), [*SCOPE, "known"], "left_semi")
    return (real.select("user_id", F.lit("real").alias("kind")).unionByName(found.filter("respelled").select("user_id", F.lit("respelled").alias("kind")))
            .groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("n")))


def keyed_vault(s, d):
    """A vault that stores keyed hashes instead of canonical forms, extended twice: the second run adds nothing."""
    found = values(s, d)
    empty = vault(s, d).limit(0)
    first = materialize(V.extend(empty, found, SCOPE, key=KEY))
    again = V.extend(first, found, SCOPE, key=KEY)
    return (first.withColumn("hidden", F.col("canon").rlike("^[0-9a-f]{64}$") & ~F.col("canon").contains(F.col("original")))
            .select("user_id", "entity", "original", "n", "placeholder", "hidden")
            .unionByName(again.select("user_id", "entity", "original", "n", "placeholder", F.lit(False).alias("hidden"))))


def masked(s, d):
    return M.mask_scope(scanned(s, d), SCOPE, "event_id")


def round_trip(s, d):
    rows, known = masked(s, d)
    return M.unmask(rows, known, SCOPE, ["event_id"], text="masked").select("event_id", "unmasked")


def surrogates(s, d):
    """Surrogates of every distinct value, scanned again as texts: each is found as its own type."""
    table = SG.assign_surrogates(vault(s, d), SCOPE, KEY)
    found = S.with_findings(table.withColumn("text", F.concat(F.lit("TC "), "placeholder")), defaults.SCAN)
    own = F.expr("exists(findings, f -> f.entity = entity)")
    return found.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(own).alias("same_type"),
        F.count_if(F.col("placeholder") == F.col("original")).alias("unchanged"),
        F.count_if(F.col("placeholder").startswith("[")).alias("placeholders"))


def surrogate_round_trip(s, d):
    """Masked with surrogates, numbers respelled by the model, then unmasked."""
    source = prompts(s, d).select("event_id", "user_id", F.translate("text", "\u200b", "").alias("text"))
    rows = materialize(S.with_findings(source, defaults.SCAN))  # what follows reads each of these more than once
    found = materialize(M.finding_values(rows, SCOPE, "event_id"))
    table = materialize(SG.assign_surrogates(M.assign_placeholders(found, SCOPE), SCOPE, KEY))
    texts = M.mask_texts(rows.drop("findings"), M.replacements(found, table, SCOPE), SCOPE, "event_id")
    respelled = texts.withColumn("reply", F.regexp_replace("masked", r"(\d{3}) (\d{2}) (\d{2})", "$1-$2.$3"))
    respelled = materialize(respelled.drop("masked", "text"))
    plain = M.unmask(respelled, table, SCOPE, ["event_id"], text="reply", into="step")
    back = M.unmask_surrogates(materialize(plain.drop("reply")), table, SCOPE, ["event_id"], text="step")
    return back.select("event_id", "unmasked")


def answers(s, d):
    rows = prompts(s, d)
    replies = S.with_findings(rows.select("event_id", "team", "teams", "model", "event_type", F.col("answer").alias("text")), defaults.SCAN)
    asked = rows.select("event_id", F.col("text").alias("all_text"))
    return LK.leak_entities(LK.output_leaks(replies, asked, "event_id"))


def output_decision(s, d):
    rows = answers(s, d).withColumn("destination", P.destination_of(F.col("model"), POLICY))
    decided = P.evaluate_output(rows, POLICY)
    return decided.withColumn("clean", F.when(F.col("output.action") == "mask", M.redact("text", "leaks", "output.mask_entities"))
                              .otherwise(F.col("text")))


def session_leaks(s, d):
    rows = prompts(s, d)
    sent = S.exploded(S.with_findings(rows.select("event_id", "text"), defaults.SCAN)).select("event_id", "value")
    got = S.exploded(S.with_findings(rows.select("event_id", F.col("answer").alias("text")), defaults.SCAN)).select("event_id", "entity", "value")
    return LK.session_leaks(got, sent, ["event_id"]).select("event_id", "entity", "value")


def masked_requests(s, d):
    """Only requests the policy masks, and only the entities it names."""
    rows = S.with_findings(prompts(s, d), defaults.SCAN)
    rows = rows.withColumn("entities", F.array_sort(F.array_distinct("findings.entity"))).withColumn("injection_score", F.lit(0.0))
    rows = P.evaluate(P.resolve_provider(rows, POLICY), POLICY).filter("decision.action = 'mask'")
    row = M.mask_row("array(text)", "array(findings)", "array_contains(decision.mask_entities, f.entity)")
    return (rows.withColumn("m", F.expr(row))
            .select("event_id", F.col("m.masked")[0].alias("masked"), joined("m.vault.entity").alias("wanted")))


def two_jobs(s, d):
    """A first job fills the persistent vault, a second one reuses and extends it."""
    times = prompts(s, d).select(F.col("event_id").alias("part"), "event_time")
    found = materialize(M.finding_values(scanned(s, d), SCOPE, "event_id").join(times, "part"))
    early = F.col("event_time") < F.lit("2024-01-10").cast("timestamp_ntz")
    first = materialize(M.assign_placeholders(found.filter(early).drop("event_time"), SCOPE))
    second = V.extend(first, found.filter(~early).drop("event_time"), SCOPE)
    return first.unionByName(second).select("user_id", "entity", "canon", "n", "placeholder")


def vault_lookup(s, d):
    rows = prompts(s, d).select("event_id", "user_id", F.expr(
        "concat('geri: [TCKN_1], [KURUM_PROJE_2] ve [TCKN_', cast(event_id % 3 AS string), ']')").alias("text"))
    return V.lookup(rows, vault(s, d), SCOPE, ["event_id"]).select("event_id", "placeholder", "original")


def continued(s, d):
    """Texts that already carry placeholders: new values are numbered after the largest one."""
    rows = prompts(s, d).select("event_id", "user_id", F.expr(
        "concat(text, if(k % 4 = 0, concat('; eski [TCKN_', cast(k % 7 AS string), ']'), ''))").alias("text"))
    found = M.finding_values(S.with_findings(rows, defaults.SCAN), ["event_id"], "user_id")
    numbers = M.assign_placeholders(found, ["event_id"], start=M.numbers_in_text(rows, ["event_id"]))
    return numbers.select("event_id", "entity", "placeholder")


def subject_hashes(s, d):
    rows = S.exploded(scanned(s, d)).filter(F.col("entity").isin("TCKN", "IBAN_TR", "PHONE_TR"))
    hashed = rows.withColumn("hash", F.expr(subject_hash(KEY, "entity", "value")))
    return hashed.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("hash")), ",").alias("hashes"))


def holdback(s, d):
    rows = prompts(s, d).select("event_id", F.expr("substr(text, 1, cast(10 + k AS int))").alias("text"))
    return rows.select("event_id", M.partial_holdback("text").cast("bigint").alias("held"),
                       M.partial_holdback("text", tokens=False).cast("bigint").alias("held_placeholder"))


def resolved_subjects(s, d):
    """Searched values: identifiers inside a text, a given type, an unknown type, plain words."""
    rows = prompts(s, d, keep=("tckn", "phone", "iban")).select(
        "event_id", F.expr("CASE event_id % 6 WHEN 0 THEN concat('TC ', tckn) WHEN 1 THEN phone WHEN 2 THEN concat(iban, ' ', phone) "
                           "WHEN 3 THEN 'merhaba dünya' WHEN 4 THEN '123 456 78 90' ELSE 'x' END").alias("value"),
        F.expr("CASE event_id % 6 WHEN 4 THEN 'VKN' WHEN 5 THEN 'KISI' END").alias("entity"))
    return SJ.resolve(rows, KEY, b"old-key-" * 5).select("event_id", "label", "entity", "error", F.array_join("hashes", ",").alias("hashes"))


QUERIES = {
    "e15_subject_resolve": resolved_subjects,
    "c1_placeholders": vault,
    "c1_placeholders_uuid": vault_of_uuids,
    "c5_known_values": known_values,
    "c11_vault_keyed": keyed_vault,
    "c2_mask_texts": lambda s, d: masked(s, d)[0].select("event_id", "masked"),
    "c3_surrogates": surrogates,
    "c4_unmask": round_trip,
    "c4_unmask_surrogates": surrogate_round_trip,
    "c6_output_leaks": lambda s, d: flat(answers(s, d).select("event_id", "output_leaked", "output_entities")),
    "c7_session_leaks": session_leaks,
    "c8_redact": lambda s, d: output_decision(s, d).select("event_id", "clean"),
    "c9_mask_requests": masked_requests,
    "c11_vault_two_jobs": two_jobs,
    "c12_vault_lookup": vault_lookup,
    "c13_continue_numbering": continued,
    "c15_subject_hashes": subject_hashes,
    "c17_partial_holdback": holdback,
    "d6_output_rules": lambda s, d: output_decision(s, d).select(
        "event_id", "output.action", joined("output.rules").alias("rules"), joined("output.monitored_rules").alias("monitored_rules"),
        "output.would_action"),
}

_CANON = ("CASE entity WHEN 'TCKN' THEN regexp_replace(found, '[^0-9]', '', 'g') WHEN 'PHONE_TR' THEN right(regexp_replace(found, '[^0-9]', '', 'g'), 10) "
          "WHEN 'IBAN_TR' THEN replace(found, ' ', '') ELSE found END")
_VAULT = f"""vals AS (SELECT user_id, event_id, entity, start_at, end_at, found, {_CANON} AS canon FROM spans),
vault AS (SELECT user_id, entity, canon, original, n, '[' || entity || '_' || n || ']' AS placeholder FROM (
 SELECT user_id, entity, canon, first.found AS original, row_number() OVER (PARTITION BY user_id, entity ORDER BY first.event_id, first.start_at) AS n FROM (
 SELECT user_id, entity, canon, min({{'event_id': event_id, 'start_at': start_at, 'found': found}}) AS first FROM vals GROUP BY 1, 2, 3)))"""


def _replaced(table: str, columns: str) -> str:
    """Span by span replacement: each event has at most one span of each type, so replace() is exact."""
    return f"""rep AS (SELECT v.event_id, max(CASE WHEN v.entity='IBAN_TR' THEN {columns} END) AS iban_r, max(CASE WHEN v.entity='KURUM_PROJE' THEN {columns} END) AS project_r,
 max(CASE WHEN v.entity='PHONE_TR' THEN {columns} END) AS phone_r, max(CASE WHEN v.entity='SECRET_AWS_KEY' THEN {columns} END) AS aws_r,
 max(CASE WHEN v.entity='TCKN' THEN {columns} END) AS tckn_r FROM vals v JOIN {table} t USING (user_id, entity, canon) GROUP BY 1),
done AS (SELECT p.event_id, replace(replace(replace(replace(replace(text, iban, coalesce(iban_r, iban)), project, coalesce(project_r, project)),
 phone, coalesce(phone_r, phone)), aws, coalesce(aws_r, aws)), shown, coalesce(tckn_r, shown)) AS result FROM prompts p LEFT JOIN rep USING (event_id))"""


_DEST = "CASE WHEN starts_with(model, 'vllm/') THEN 'internal' ELSE 'external' END"
_LEAK = ("list_filter([CASE WHEN event_type='purchase' AND k%3=0 THEN 'CREDIT_CARD' END, "
         "CASE WHEN event_type='click' AND k%9=0 THEN 'EMAIL_ADDRESS' END], lambda e: e IS NOT NULL)")
_PAD = KEY.ljust(64, b"\0")
_IPAD, _OPAD = bytes(b ^ 0x36 for b in _PAD).hex(), bytes(b ^ 0x5C for b in _PAD).hex()
_EARLY = "event_time < TIMESTAMP '2024-01-10'"

_OLD = (b"old-key-" * 5).ljust(64, b"\0")


def _hmac_sql(pad: bytes, message: str) -> str:
    inner, outer = bytes(b ^ 0x36 for b in pad).hex(), bytes(b ^ 0x5C for b in pad).hex()
    return f"substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message})))), 1, 32)"


ORACLES = {
    "e15_subject_resolve": sql(f"""SELECT event_id, CASE event_id % 6 WHEN 3 THEN repeat('*', 8) || 'ünya' WHEN 5 THEN '****' ELSE repeat('*', length(raw) - 4) || right(raw, 4) END AS label, e AS entity,
 CASE event_id % 6 WHEN 3 THEN 'finding' WHEN 5 THEN 'type' END AS error, CASE WHEN e IS NOT NULL THEN {_hmac_sql(_PAD, "e || ':' || form")} || ',' || {_hmac_sql(_OLD, "e || ':' || form")} END AS hashes
 FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN tckn WHEN 1 THEN replace(phone, ' ', '') WHEN 2 THEN replace(iban, ' ', '') WHEN 4 THEN '1234567890' END AS raw,
 CASE event_id % 6 WHEN 0 THEN 'TCKN' WHEN 1 THEN 'PHONE_TR' WHEN 2 THEN 'IBAN_TR' WHEN 4 THEN 'VKN' END AS e,
 CASE event_id % 6 WHEN 0 THEN tckn WHEN 1 THEN right(replace(phone, ' ', ''), 10) WHEN 2 THEN replace(iban, ' ', '') WHEN 4 THEN '1234567890' END AS form FROM prompts)""", PROMPTS_CTE),
    "c1_placeholders": sql("SELECT * FROM vault", PROMPTS_CTE, _VAULT),
    "c1_placeholders_uuid": sql("SELECT * FROM vault", PROMPTS_CTE, _VAULT),
    "c5_known_values": sql("""SELECT user_id, 'real' AS kind, count(DISTINCT original) AS n FROM vault GROUP BY 1
 UNION ALL SELECT user_id, 'respelled', count(*) FROM vault WHERE entity IN ('TCKN','IBAN_TR','PHONE_TR') GROUP BY 1""", PROMPTS_CTE, _VAULT),
    "c11_vault_keyed": sql("SELECT user_id, entity, original, n, placeholder, true AS hidden FROM vault", PROMPTS_CTE, _VAULT),
    "c2_mask_texts": sql("SELECT event_id, result AS masked FROM done", PROMPTS_CTE, _VAULT, _replaced("vault", "placeholder")),
    "c3_surrogates": sql("""SELECT entity, count(*) AS n, count(*) FILTER (WHERE entity IN ('TCKN','IBAN_TR','PHONE_TR')) AS same_type, 0 AS unchanged,
 count(*) FILTER (WHERE entity NOT IN ('TCKN','IBAN_TR','PHONE_TR')) AS placeholders FROM vault GROUP BY entity""", PROMPTS_CTE, _VAULT),
    "c4_unmask": sql("SELECT event_id, result AS unmasked FROM done", PROMPTS_CTE, _VAULT, _replaced("vault", "original")),
    "c4_unmask_surrogates": sql("SELECT event_id, replace(result, '\u200b', '') AS unmasked FROM done", PROMPTS_CTE, _VAULT, _replaced("vault", "original")),
    "c6_output_leaks": sql(f"""SELECT event_id, array_to_string({_LEAK}, ',') AS output_leaked, array_to_string(list_concat({_LEAK},
 CASE WHEN k%5=0 THEN ['PHONE_TR'] ELSE []::VARCHAR[] END), ',') AS output_entities FROM prompts""", PROMPTS_CTE),
    "c7_session_leaks": sql("""SELECT event_id, 'CREDIT_CARD' AS entity, '4111 1111 1111 1111' AS value FROM prompts WHERE event_type='purchase' AND k%3=0
 UNION ALL SELECT event_id, 'EMAIL_ADDRESS', 'destek' || k || '@ornek.com' FROM prompts WHERE event_type='click' AND k%9=0""", PROMPTS_CTE),
    "c8_redact": sql("SELECT event_id, replace(answer, '4111 1111 1111 1111', '[GİZLENDİ:CREDIT_CARD]') AS clean FROM prompts", PROMPTS_CTE),
    "c9_mask_requests": sql(f"""SELECT event_id, replace(replace(replace(replace(replace(text, iban, CASE WHEN ext THEN '[IBAN_TR_1]' ELSE iban END),
 project, CASE WHEN ext THEN '[KURUM_PROJE_1]' ELSE project END), phone, CASE WHEN ext THEN '[PHONE_TR_1]' ELSE phone END), aws, '[SECRET_AWS_KEY_1]'),
 shown, CASE WHEN ext THEN '[TCKN_1]' ELSE shown END) AS masked, array_to_string(list_filter([CASE WHEN k%7=0 AND ext THEN 'IBAN_TR' END,
 CASE WHEN k%17=0 AND ext THEN 'KURUM_PROJE' END, CASE WHEN k%5=0 AND ext THEN 'PHONE_TR' END, CASE WHEN k%13=0 THEN 'SECRET_AWS_KEY' END,
 CASE WHEN k%4=0 AND ext THEN 'TCKN' END], lambda e: e IS NOT NULL), ',') AS wanted FROM (SELECT *, {_DEST} = 'external' AS ext FROM prompts)
 WHERE (k%13=0 OR (ext AND (k%7=0 OR k%17=0 OR k%5=0 OR k%4=0))) AND NOT (team='stajyer' AND ext AND k%4=0)""", PROMPTS_CTE),
    "c11_vault_two_jobs": sql(f"""vals AS (SELECT user_id, entity, {_CANON} AS canon, event_id, start_at, {_EARLY} AS early FROM spans),
 f AS (SELECT user_id, entity, canon, bool_or(early) AS seen, min(CASE WHEN early THEN (event_id, start_at) END) AS e, min((event_id, start_at)) AS a FROM vals GROUP BY 1, 2, 3)
 SELECT user_id, entity, canon, n, '[' || entity || '_' || n || ']' AS placeholder FROM (
 SELECT user_id, entity, canon, row_number() OVER (PARTITION BY user_id, entity ORDER BY CASE WHEN seen THEN 0 ELSE 1 END, CASE WHEN seen THEN e ELSE a END) AS n FROM f)"""
        .replace("vals AS", "SELECT * FROM (WITH vals AS", 1) + ")", PROMPTS_CTE),
    "c12_vault_lookup": sql("""SELECT event_id, placeholder, original FROM (SELECT DISTINCT event_id, user_id, unnest(['[TCKN_1]', '[KURUM_PROJE_2]', '[TCKN_' || (event_id % 3) || ']']) AS placeholder
 FROM prompts) LEFT JOIN vault USING (user_id, placeholder)""", PROMPTS_CTE, _VAULT),
    "c13_continue_numbering": sql("""SELECT event_id, entity, '[' || entity || '_' || CASE WHEN entity='TCKN' THEN 1 + k % 7 ELSE 1 END || ']' AS placeholder FROM spans""", PROMPTS_CTE),
    "c15_subject_hashes": sql(f"""SELECT event_id, string_agg(h, ',' ORDER BY h) AS hashes FROM (SELECT DISTINCT event_id,
 substr(sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(entity || ':' || canon)))), 1, 32) AS h FROM vals
 WHERE entity IN ('TCKN','IBAN_TR','PHONE_TR')) GROUP BY 1""", PROMPTS_CTE, _VAULT),
    "c17_partial_holdback": sql(r"""SELECT event_id, least(64, length(regexp_extract(t, '(?i)(?:(?:\+?\d+|TR\d*)[ -])*\S*$'))) AS held,
 least(64, length(regexp_extract(t, '\[[A-Z0-9_]*$'))) AS held_placeholder FROM (SELECT event_id, substr(text, 1, 10 + k) AS t FROM prompts)""", PROMPTS_CTE),
    "d6_output_rules": sql(f"""SELECT event_id, CASE WHEN list_contains(l, 'CREDIT_CARD') THEN 'mask' ELSE 'allow' END AS action,
 CASE WHEN list_contains(l, 'CREDIT_CARD') THEN 'cikti-kimlik-finans-gizle' ELSE '' END AS rules,
 CASE WHEN list_contains(l, 'EMAIL_ADDRESS') THEN 'cikti-iletisim-gizle' ELSE '' END AS monitored_rules,
 CASE WHEN len(l) > 0 THEN 'mask' ELSE 'allow' END AS would_action FROM (SELECT *, {_LEAK} AS l FROM prompts)""", PROMPTS_CTE),
}
