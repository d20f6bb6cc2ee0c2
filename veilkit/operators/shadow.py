"""Browser-extension events: validation, audit mapping, per-minute admission."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions.globs import literal
from veilkit.functions.lookups import mapped
from veilkit.functions.values import in_list
from veilkit.operators.scan import known_entities

EVENT_SCHEMA = ("site string, action string, trigger string, justification string, preview_unavailable boolean, "
                "entities map<string,int>, chars bigint, `user` string, team string, extension_version string")
_STRINGS = "cast(array() AS array<string>)"


def validate(events: DataFrame) -> DataFrame:
    """Adds `problem`: the first field that is out of bounds, NULL for a valid event. The site is lowered
    and missing optional fields get their defaults."""
    known = in_list("e", known_entities())
    filled = events.withColumns({
        "site": F.lower("site"), "user": F.coalesce("user", F.lit("unknown")), "team": F.coalesce("team", F.lit("default")),
        "chars": F.coalesce("chars", F.lit(0)), "extension_version": F.coalesce("extension_version", F.lit("")),
        "preview_unavailable": F.coalesce("preview_unavailable", F.lit(False)),
        "entities": F.coalesce("entities", F.expr("cast(map() AS map<string,int>)"))})
    checks = [
        ("site", f"site IS NOT NULL AND site rlike {literal(fixed.SHADOW_SITE_PATTERN)}"),
        ("action", in_list("coalesce(action, '')", fixed.SHADOW_ACTIONS)),
        ("trigger", f"trigger IS NULL OR {in_list('trigger', fixed.TRIGGERS)}"),
        ("justification", f"justification IS NULL OR {in_list('justification', fixed.JUSTIFICATIONS)}"),
        ("entities", f"forall(map_keys(entities), e -> {known} OR e rlike {literal(fixed.DICTIONARY_ENTITY_PATTERN)})"),
        ("counts", f"forall(map_values(entities), n -> n IS NOT NULL AND n BETWEEN 0 AND {fixed.SHADOW_MAX_COUNT})"),
        ("chars", f"chars BETWEEN 0 AND {fixed.SHADOW_MAX_CHARS}"),
        ("user", f"`user` rlike {literal('(?U)' + fixed.SHADOW_IDENT_PATTERN)}"),
        ("team", f"team rlike {literal('(?U)' + fixed.SHADOW_IDENT_PATTERN)}"),
        ("extension_version", f"extension_version = '' OR extension_version rlike {literal(fixed.SHADOW_VERSION_PATTERN)}"),
    ]
    problem = "CASE " + " ".join(f"WHEN NOT ({ok}) THEN '{name}'" for name, ok in checks) + " END"
    return filled.withColumn("problem", F.expr(problem))


def to_audit(valid: DataFrame) -> DataFrame:
    """Audit columns of valid events: the user's choice as an action and as rules, never any text."""
    rules = (f"concat(array(concat('{fixed.SHADOW_RULE}', choice)), "
             f"if(justification IS NOT NULL AND choice = 'allowed_override', array(concat('{fixed.JUSTIFICATION_RULE}', justification)), {_STRINGS}), "
             f"if(preview_unavailable, array('{fixed.SHADOW_RULE}onizleme-acilamadi'), {_STRINGS}))")
    where = mapped(F.col("trigger"), fixed.TRIGGERS, F.lit(None).cast("string"))
    why = F.when(F.col("choice") == "allowed_override",
                 F.concat(F.lit("Gerekçe: "), mapped(F.col("justification"), fixed.JUSTIFICATIONS, F.lit(None).cast("string"))))
    total = "aggregate(map_values(counts), 0L, (t, n) -> t + n)"
    rows = valid.withColumnRenamed("action", "choice").withColumnRenamed("entities", "counts")
    return (
        rows.withColumn("action", mapped(F.col("choice"), fixed.SHADOW_ACTIONS, F.lit("allow")))
        .withColumn("rules", F.expr(rules)).withColumn("reason", F.concat_ws(" · ", where, why))
        .withColumn("entities", F.array_sort(F.map_keys("counts")))
        .withColumn("masked_entities", F.expr(f"if(choice = 'masked', entities, {_STRINGS})"))
        .withColumn("masked_count", F.expr(f"if(choice = 'masked', {total}, 0L)"))
        .withColumns({
            "model": F.col("site"), "destination": F.lit("external"), "would_action": F.col("action"), "teams": F.array("team"),
            "injection_score": F.lit(0.0), "injection_engine": F.lit("browser"), "prompt_sha256": F.lit("0" * 64),
            "prompt_chars": F.col("chars"), "monitored_rules": F.expr(_STRINGS), "prompt_tokens": F.lit(0).cast("bigint"),
            "completion_tokens": F.lit(0).cast("bigint"), "usage_known": F.lit(0), "est_cost_usd": F.lit(None).cast("double"),
            "auth_source": F.lit("browser_extension"), "api_format": F.lit("browser"), "output_leaked": F.expr(_STRINGS),
            "output_action": F.lit(""), "output_rules": F.expr(_STRINGS), "quota": F.lit("")})
        .drop("choice", "counts", "site", "chars", "trigger", "justification", "preview_unavailable", "extension_version", "problem")
    )


def _counts(users: str = "users") -> str:
    return f"transform(map_values({users}), n -> coalesce(n, 0))"


def admit_batches(batches: DataFrame, *, per_user: int = fixed.SHADOW_USER_PER_MINUTE, total: int = fixed.SHADOW_TOTAL_PER_MINUTE,
                  keys: Sequence[str] = ()) -> DataFrame:
    """All-or-nothing admission of event batches per minute. `batches` has (batch_id, at, users), users a
    map of user to event count. Adds `admitted`.

    A batch without events is admitted and one that is larger than a whole minute's limits is refused without looking
    at any other. The rest of a minute is judged in order, Arrow block by Arrow block of a sorted partition: what is
    carried from block to block is the number of events admitted so far, by user, which the limit itself bounds, so
    memory does not grow with the minute. Minutes are independent of each other.
    """
    size = f"aggregate({_counts()}, 0L, (t, n) -> t + n)"
    alone = F.expr(f"CASE WHEN coalesce({size}, 0) = 0 THEN true WHEN {size} > {int(total)} OR exists({_counts()}, n -> n > {int(per_user)}) THEN false END")
    kind, named = batches.schema["batch_id"].dataType.simpleString(), ["minute", *keys]
    slim = (batches.withColumn("minute", F.date_trunc("minute", F.col("at"))).filter(alone.isNull())
            .select(*named, "at", "batch_id", F.map_keys("users").alias("names"), F.expr(_counts()).cast("array<bigint>").alias("counts")))

    def judged(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        minute, left, seen = None, total, {}
        for block in blocks:
            fits = []
            for at, names, counts in zip(zip(*(block[c] for c in named)), block["names"], block["counts"]):
                if at != minute:
                    minute, left, seen = at, total, {}
                wanted = {user: seen.get(user, 0) + n for user, n in zip(names, counts)}
                fits.append(bool(sum(counts) <= left and max(wanted.values()) <= per_user))
                if fits[-1]:
                    left -= sum(counts)
                    seen.update(wanted)
            yield block[["batch_id"]].assign(admitted=fits)

    done = (slim.repartition(*named).sortWithinPartitions(*named, "at", "batch_id")
            .mapInPandas(judged, f"batch_id {kind}, admitted boolean").withColumnRenamed("admitted", "_judged"))
    return batches.join(done, "batch_id", "left").withColumn("admitted", F.coalesce(alone, "_judged")).drop("_judged")
