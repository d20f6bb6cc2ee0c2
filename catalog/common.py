"""Helpers shared by the registered queries and their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilkit.session import checkpoint_dir
from veilkit.sources.event_audit import audit_from_events

AS_OF = "2024-01-31 00:00:00"
DAYS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_from_events(table(spark, sf_dir, "events"))


def scratch(s) -> str:
    """A folder of its own inside the shared checkpoint folder."""
    return f"{checkpoint_dir(s)}/veilkit-{uuid.uuid4().hex}"


def joined(column: str | Column) -> Column:
    return F.array_join(column, ",")


def flat(df: DataFrame, **renames) -> DataFrame:
    """Arrays as comma-joined strings and timestamps as text, so engines compare equal."""
    out = []
    for field in df.schema.fields:
        kind, col = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind == "array<string>":
            col = joined(col)
        elif kind.startswith("array<"):
            col = F.array_join(col.cast("array<string>"), ",")
        elif kind in ("timestamp", "timestamp_ntz"):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSS")
        elif kind == "date":
            col = F.date_format(col, "yyyy-MM-dd")
        elif kind in ("int", "smallint", "tinyint"):
            col = col.cast("bigint")
        out.append(col.alias(renames.get(field.name, field.name)))
    return df.select(*out)


_SHADOW = "api_format IN ('browser', 'icap')"
AUDIT_CTE = f"""
base AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
s1 AS (SELECT *,
  CASE event_id % 11 WHEN 0 THEN 'browser' WHEN 1 THEN 'icap' WHEN 2 THEN 'messages' WHEN 3 THEN '' ELSE 'chat' END AS api_format,
  CASE user_id % 5 WHEN 0 THEN 'analitik' WHEN 1 THEN 'yazilim' WHEN 2 THEN 'finans' WHEN 3 THEN 'stajyer' ELSE 'pazarlama' END AS team,
  list_filter([CASE WHEN k%7=0 THEN 'IBAN_TR' END, CASE WHEN k%17=0 THEN 'KURUM_PROJE' END, CASE WHEN k%5=0 THEN 'PHONE_TR' END,
    CASE WHEN k%13=0 THEN 'SECRET_AWS_KEY' END, CASE WHEN k%4=0 THEN 'TCKN' END], lambda e: e IS NOT NULL) AS entities,
  CASE WHEN k%19=0 THEN 0.9::DOUBLE WHEN k%23=0 THEN 0.6::DOUBLE ELSE 0::DOUBLE END AS injection_score FROM base),
s2 AS (SELECT *, CASE WHEN {_SHADOW} THEN CASE event_id % 3 WHEN 0 THEN 'chatgpt.com' WHEN 1 THEN 'claude.ai' ELSE 'gemini.google.com' END
  ELSE CASE k % 6 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'claude-opus-5' WHEN 3 THEN 'gemini-2.5-pro'
  WHEN 4 THEN 'vllm/qwen3' ELSE 'mistral-large' END END AS model FROM s1),
s3 AS (SELECT *, CASE WHEN starts_with(model,'vllm/') THEN 'internal' ELSE 'external' END AS destination FROM s2),
s4 AS (SELECT *, CASE WHEN injection_score >= 0.85::DOUBLE THEN 'block'
  WHEN destination='external' AND (k%4=0 OR k%7=0) AND event_id%3<>0 THEN 'mask'
  WHEN injection_score >= 0.5::DOUBLE THEN 'alert' ELSE 'allow' END AS action FROM s3),
s5 AS (SELECT *, CASE WHEN action='block' THEN 0 ELSE 50+3*k END AS prompt_tokens,
  CASE WHEN action='block' THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS completion_tokens,
  CASE WHEN action='allow' AND destination='external' AND k%5=0 THEN 'mask' ELSE action END AS would_action,
  (event_type='purchase' AND k%3=0) AS leaks FROM s4),
audit AS (SELECT event_id, ts AS event_time, value AS latency_ms,
  CASE WHEN user_id%25=0 THEN 'anonymous' ELSE 'u'||user_id END AS "user", team, api_format, model, destination, entities,
  injection_score, action,
  CASE WHEN action='mask' THEN list_filter(entities, lambda e: e IN ('IBAN_TR','TCKN')) ELSE []::VARCHAR[] END AS masked_entities,
  would_action, CASE WHEN leaks THEN ['CREDIT_CARD'] ELSE []::VARCHAR[] END AS output_leaked,
  CASE WHEN NOT leaks THEN '' WHEN event_id%2=0 THEN 'mask' ELSE 'allow' END AS output_action,
  prompt_tokens, completion_tokens,
  CASE WHEN model='mistral-large' OR {_SHADOW} THEN NULL WHEN action='block' OR destination='internal' THEN 0::DOUBLE
    ELSE CAST(2*prompt_tokens+10*completion_tokens AS DOUBLE)/1000000::DOUBLE END AS est_cost_usd,
  CASE WHEN k%97=0 THEN 'requests_per_minute' ELSE '' END AS quota,
  list_concat(list_concat(
    CASE action WHEN 'block' THEN ['prompt-injection-block'] WHEN 'alert' THEN ['prompt-injection-alert']
      WHEN 'mask' THEN ['kvkk-yurtdisi-maskele'] ELSE []::VARCHAR[] END,
    CASE WHEN {_SHADOW} THEN ['golge-ai:' || CASE k%6 WHEN 0 THEN 'visit' WHEN 1 THEN 'masked' WHEN 2 THEN 'cancelled'
      WHEN 3 THEN 'blocked' WHEN 4 THEN 'allowed_override' ELSE 'redirected' END] ELSE []::VARCHAR[] END),
    CASE WHEN {_SHADOW} AND k%6=4 THEN ['golge-ai:gerekce:' || CASE event_id%4 WHEN 0 THEN 'consent' WHEN 1 THEN 'test_data'
      WHEN 2 THEN 'false_positive' ELSE 'other' END] ELSE []::VARCHAR[] END) AS rules,
  CASE WHEN would_action<>action THEN ['telefon-gozlem'] ELSE []::VARCHAR[] END AS monitored_rules,
  list_sort(list_transform(list_filter(entities, lambda e: e IN ('IBAN_TR','PHONE_TR','TCKN')),
    lambda e: substr(sha256(e || ':' || CAST(user_id%40 AS VARCHAR)),1,32))) AS subject_hashes,
  sha256('prompt-' || CAST(k AS VARCHAR)) AS prompt_sha256, prompt_tokens*4 AS prompt_chars, k, user_id, event_type FROM s5)
"""

# the same conditions the Spark side keeps in veilkit.functions.predicates, in DuckDB SQL
NOT_PII = "(starts_with(e,'SECRET_') OR starts_with(e,'KURUM_'))"


def any_entity(test: str) -> str:
    return f"len(list_filter(entities, lambda e: {test})) > 0"


HAS_SECRET = any_entity("starts_with(e,'SECRET_')")
UNMASKED_PII = any_entity(f"NOT {NOT_PII} AND NOT list_contains(masked_entities, e)")
EXT_UNMASKED = f"(destination='external' AND action<>'block' AND {UNMASKED_PII})"
WINDOW = f"event_time >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY"
MS = "'%Y-%m-%d %H:%M:%S.%g'"
RISKY = (f"(action='block' OR injection_score>=0.5::DOUBLE OR len(output_leaked)>0 OR "
         f"list_contains(rules,'golge-ai:allowed_override') OR {HAS_SECRET} OR {EXT_UNMASKED})")


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([AUDIT_CTE.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()


def provider_sql(model: str = "model") -> str:
    return (f"CASE WHEN starts_with({model},'gpt-') OR starts_with({model},'o1') OR starts_with({model},'o3') "
            f"OR starts_with({model},'text-embedding-') THEN 'OpenAI' WHEN starts_with({model},'claude-') THEN 'Anthropic' "
            f"WHEN starts_with({model},'gemini-') THEN 'Google' WHEN starts_with({model},'mistral') THEN 'Mistral' "
            f"WHEN starts_with({model},'command') THEN 'Cohere' ELSE 'Diğer / bilinmiyor' END")


def label_sql(entity: str = "entity") -> str:
    return (f"CASE {entity} WHEN 'TCKN' THEN 'T.C. kimlik no' WHEN 'IBAN_TR' THEN 'IBAN' WHEN 'PHONE_TR' THEN 'Telefon' "
            f"WHEN 'CREDIT_CARD' THEN 'Kredi kartı' WHEN 'EMAIL_ADDRESS' THEN 'E-posta' "
            f"WHEN 'SECRET_AWS_KEY' THEN 'Sır: aws key' WHEN 'KURUM_PROJE' THEN 'Kurum: proje' ELSE {entity} END")
