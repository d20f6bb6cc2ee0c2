"""Subject-access search: which requests carried a person's identifiers, and what became of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions import predicates as P
from veilkit.functions.lookups import entity_label, mapped, provider_of
from veilkit.functions.values import mask_label, subject_hash, subject_value
from veilkit.operators.scan import ScanConfig, with_findings
from veilkit.plans.usage import audit_window

NO_TYPE = "type"
NO_FINDING = "finding"
NO_VALUE = "value"
STATUS = ("CASE WHEN action = 'block' THEN 'blocked' WHEN destination <> 'external' THEN 'internal' "
          "WHEN array_contains(masked_entities, entity) THEN 'masked' ELSE 'unmasked' END")


def subject_hits(audit: DataFrame, subjects: DataFrame, as_of: str, days: int,
                 limit: int | None = fixed.SUBJECT_LIMIT, providers=(), index: DataFrame | None = None) -> DataFrame:
    """One row per (event, subject). `subjects` has (label, entity, hashes); newest events first up to
    `limit`, None for all. `truncated` marks that more events matched.

    Hashes are looked up in `index` (sources.audit.subject_index, as stored), or without one in the audit's own
    arrays; the audit is then read once, for the events found. A search of a few values broadcasts by its size, a
    bulk search of many shuffles.
    """
    wanted = subjects.select("label", "entity", F.explode("hashes").alias("hash"))
    if index is None:
        index = audit.select("event_id", "event_time", *(["month"] if "month" in audit.columns else []), F.explode("subject_hashes").alias("hash"))
    found = audit_window(index, as_of, days).join(wanted, "hash").select("event_id", "event_time", "label", "entity").distinct()
    if limit is not None:
        newest = found.select("event_id", "event_time").distinct().orderBy(F.desc("event_time"), F.desc("event_id")).limit(limit + 1)
        numbered = (newest.withColumn("_n", F.expr("row_number() OVER (ORDER BY event_time DESC, event_id DESC)"))
                    .withColumn("truncated", F.expr("count(*) OVER ()") > limit).filter(F.col("_n") <= limit))
        found = found.drop("event_time").join(numbered.select("event_id", "truncated"), "event_id")
    else:
        found = found.drop("event_time").withColumn("truncated", F.lit(False))
    rows = audit_window(audit, as_of, days).select(
        "event_id", "event_time", "team", "user", "model", "destination", F.expr(P.API_FORMAT).alias("api_format"), "action", "masked_entities")
    return (
        rows.join(found, "event_id")
        .withColumn("status", F.expr(STATUS))
        .withColumn("provider", provider_of(F.col("model"), providers))
        .drop("masked_entities")
    )


def resolve(values: DataFrame, key: bytes, old_key: bytes | None = None, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Searched values to (label, entity, hashes) or (label, error). `values` has value and entity; without
    an entity the longest identifier found in the text counts. Labels hide the value."""
    types = ", ".join(f"'{e}'" for e in fixed.SUBJECT_ENTITIES)
    best = (f"array_max(transform(filter(findings, f -> f.entity IN ({types})), f -> named_struct('size', f.end - f.start, "
            "'early', -f.start, 'entity', f.entity)))")
    rows = with_findings(values.withColumn("_v", F.trim(F.coalesce("value", F.lit("")))), config, text="_v")
    rows = (rows.withColumn("_best", F.expr(best))
            .withColumn("_given", F.expr("entity IS NOT NULL AND entity <> ''"))
            .withColumn("_entity", F.expr("if(_given, entity, _best.entity)"))
            .withColumn("_value", F.expr("if(_given OR _best IS NULL, _v, substr(_v, 1 - _best.early, _best.size))")))
    error = F.expr(f"CASE WHEN _given AND _entity NOT IN ({types}) THEN '{NO_TYPE}' WHEN NOT _given AND _best IS NULL THEN '{NO_FINDING}' "
                   f"WHEN {subject_value('_entity', '_value')} = '' THEN '{NO_VALUE}' END")
    hashes = ", ".join(subject_hash(k, "_entity", "_value") for k in (key, old_key) if k)
    none = "cast(NULL AS array<string>)"
    return (rows.withColumn("error", error)
            .withColumn("label", F.expr(f"if(error IS NULL, {mask_label('_entity', '_value')}, {mask_label(repr(''), '_v')})"))
            .withColumn("entity", F.expr("if(error IS NULL, _entity, NULL)"))
            .withColumn("hashes", F.expr(f"if(error IS NULL, array({hashes}), {none})"))
            .drop("_v", "_best", "_given", "_entity", "_value", "findings"))


def subject_summary(hits: DataFrame, subjects: DataFrame, countries: Mapping[str, str] | None = None) -> DataFrame:
    """Per subject: events by status, first and last seen, recipients of unmasked data with counts."""
    recipient = F.when(F.col("provider").isin(list(countries or {})),
                       F.concat(F.col("provider"), F.lit(" ("),
                                mapped(F.col("provider"), countries or {}), F.lit(")"))).otherwise(F.col("provider"))
    counted = hits.groupBy("label", "entity").agg(
        F.count(F.lit(1)).alias("events"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"),
        *[F.count_if(F.col("status") == s).alias(s) for s in fixed.SUBJECT_STATUS])
    recipients = (
        hits.filter("status = 'unmasked'").groupBy("label", "entity", recipient.alias("recipient"))
        .agg(F.count(F.lit(1)).alias("n")).groupBy("label", "entity")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("recipient", "n")))).alias("recipients"))
    )
    empty = F.expr("cast(map() AS map<string, bigint>)")
    return (
        subjects.select("label", "entity").dropDuplicates()
        .join(counted, ["label", "entity"], "left").join(recipients, ["label", "entity"], "left")
        .na.fill(0, ["events", *fixed.SUBJECT_STATUS])
        .withColumn("recipients", F.coalesce("recipients", empty))
        .withColumn("entity_label", entity_label(F.col("entity")))
    )
