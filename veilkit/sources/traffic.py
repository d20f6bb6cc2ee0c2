"""Synthetic audit traffic: seeded, sized by row count, generated where the rows live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# team, weight, people, models, share of rows with personal data / secrets / injection (percent)
TEAMS = [
    ("musteri-hizmetleri", 30, 24, ["gpt-4o", "gpt-4o-mini", "claude-sonnet-4"], 26, 0, 2),
    ("yazilim", 24, 18, ["claude-sonnet-4", "claude-opus-4", "vllm/qwen3-coder"], 0, 12, 2),
    ("finans", 12, 8, ["gpt-4o", "gemini-2.5-pro"], 40, 0, 0),
    ("insan-kaynaklari", 8, 6, ["gpt-4o-mini", "gemini-2.5-flash"], 50, 0, 0),
    ("analitik", 12, 7, ["gemini-2.5-pro", "vllm/qwen3", "text-embedding-3-small"], 12, 0, 0),
    ("pazarlama", 9, 6, ["gpt-4o", "gemini-2.5-flash"], 10, 0, 0),
    ("stajyer", 5, 9, ["gpt-4o", "gpt-4o-mini"], 18, 8, 12),
]
SITES = [("chatgpt.com", 50), ("gemini.google.com", 20), ("claude.ai", 14), ("chat.deepseek.com", 10), ("www.perplexity.ai", 6)]
CHOICES = [("masked", 50), ("cancelled", 14), ("allowed_override", 24), ("redirected", 12)]


def _draw(seed: int, name: str, size: int) -> Column:
    """A number below `size`, fixed by (row, seed, name)."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(name)), F.lit(size))


def _weighted(draw: Column, table: list[tuple[str, int]]) -> Column:
    reached, out = 0, None
    for value, weight in table:
        reached += weight
        out = (F.when if out is None else out.when)(draw < reached, F.lit(value))
    return out


def traffic(spark: SparkSession, rows: int, *, seed: int = 1, as_of: str = "2024-01-31 00:00:00", days: int = 14,
            shadow_share: int = 10) -> DataFrame:
    """Audit-shaped rows with weekday and office-hour density; `shadow_share` percent are browser events."""
    base = spark.range(rows)
    team = _weighted(_draw(seed, "team", sum(t[1] for t in TEAMS)), [(t[0], t[1]) for t in TEAMS])
    by_team = [F.when(F.col("team") == t[0], F.struct(
        F.lit(t[2]).alias("people"), F.array(*map(F.lit, t[3])).alias("models"), F.lit(t[4]).alias("pii"),
        F.lit(t[5]).alias("secret"), F.lit(t[6]).alias("attack"))) for t in TEAMS]
    # newer days are busier; a weekend or night draw is mostly moved into working hours
    day = F.floor(days * (1 - F.sqrt((_draw(seed, "age", 10_000) + 1) / 10_000)))
    moment = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(day.cast("int") + 1)
    hour = F.when(_draw(seed, "night", 100) < 8, _draw(seed, "hour", 24)).otherwise(8 + _draw(seed, "hour", 11))
    shift = F.when((F.weekday(moment) >= 5) & (_draw(seed, "weekend", 100) >= 15), F.weekday(moment) - 4).otherwise(0)
    at = moment - F.make_dt_interval(shift) + F.make_dt_interval(F.lit(0), hour.cast("int"), _draw(seed, "minute", 60).cast("int"))
    share = _draw(seed, "kind", 100)
    shadow = _draw(seed, "shadow", 100) < shadow_share
    external = ~F.col("model").startswith("vllm/")
    empty = F.array().cast("array<string>")
    return (
        base.withColumn("team", team).withColumn("_t", F.coalesce(*by_team))
        .withColumn("user", F.concat("team", F.lit("-"), _draw(seed, "person", 1_000_000) % F.col("_t.people"), F.lit("@sirket.com.tr")))
        .withColumn("api_format", F.when(shadow, "browser").when(F.col("team") == "yazilim", "messages").otherwise("chat"))
        .withColumn("model", F.when(shadow, _weighted(_draw(seed, "site", 100), SITES)).otherwise(
            F.col("_t.models")[(_draw(seed, "model", 1_000_000) % F.size("_t.models")).cast("int")]))
        .withColumn("destination", F.when(external, "external").otherwise("internal"))
        .withColumn("event_time", at)
        .withColumn("injection_score", F.when(share < F.col("_t.attack"), 0.9).otherwise(0.0))
        .withColumn("entities", F.when(share < F.col("_t.attack"), empty)
                    .when(share < F.col("_t.attack") + F.col("_t.secret"), F.array(F.lit("SECRET_OPENAI_KEY")))
                    .when(share < F.col("_t.attack") + F.col("_t.secret") + F.col("_t.pii"), F.array(F.lit("PHONE_TR"), F.lit("TCKN")))
                    .otherwise(empty))
        .withColumn("choice", F.when(shadow, _weighted(_draw(seed, "choice", 100), CHOICES)))
        .withColumn("action", F.expr("CASE WHEN choice = 'masked' THEN 'mask' WHEN choice = 'allowed_override' THEN 'alert' "
                                     "WHEN choice IS NOT NULL OR injection_score >= 0.85 THEN 'block' "
                                     "WHEN size(entities) > 0 AND destination = 'external' THEN 'mask' ELSE 'allow' END"))
        .withColumn("masked_entities", F.when(F.col("action") == "mask", F.col("entities")).otherwise(empty))
        .withColumn("rules", F.when(F.col("choice").isNotNull(), F.array(F.concat(F.lit("golge-ai:"), "choice"))).otherwise(empty))
        .withColumn("event_id", F.expr("concat_ws('-', substr(md5(cast(id AS string)), 1, 8), substr(md5(cast(id AS string)), 9, 4), "
                                       "substr(md5(cast(id AS string)), 13, 4), substr(md5(cast(id AS string)), 17, 4), "
                                       "substr(md5(cast(id AS string)), 21, 12))"))
        .withColumn("prompt_tokens", F.when(F.col("action") == "block", 0).otherwise(40 + _draw(seed, "in", 400)).cast("bigint"))
        .withColumn("completion_tokens", F.when(F.col("action") == "block", 0).otherwise(80 + _draw(seed, "out", 820)).cast("bigint"))
        .withColumn("latency_ms", F.when(F.col("action") == "block", 4 + _draw(seed, "ms", 21)).otherwise(350 + _draw(seed, "ms", 3850)).cast("double"))
        .withColumn("would_action", F.col("action"))
        .drop("_t", "choice", "id")
    )
