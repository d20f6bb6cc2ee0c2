"""Policy advice from the evaluation aggregates: one row per finding that applies."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilkit import fixed

COLUMNS = ["position", "priority", "title", "detail", "policy"]


def _filled(template: str | None) -> Column:
    """A text with the columns named in angle brackets put in."""
    if template is None:
        return F.lit(None).cast("string")
    pieces = re.split(r"⟨(\w+)⟩", template)
    return F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(pieces)])


def _advice(rows: DataFrame, finding: str) -> DataFrame:
    position, priority, title, detail, policy = fixed.ADVICE[finding]
    return rows.select(F.lit(position).alias("position"), F.lit(priority).alias("priority"), F.lit(title).alias("title"),
                       _filled(detail).alias("detail"), _filled(policy).alias("policy"))


def _exposed(entities: DataFrame, kind: str) -> DataFrame:
    """One row when a kind has exposed entities: their number, labels and names, most exposed first."""
    order = F.struct(F.expr("-exposed").alias("a"), F.expr("-would").alias("b"), F.expr("-total").alias("c"), "entity", "label")
    return (entities.filter((F.col("kind") == kind) & (F.col("exposed") > 0))
            .agg(F.sum("exposed").alias("n"), F.array_sort(F.collect_list(order)).alias("rows"))
            .filter("n IS NOT NULL")
            .select("n", F.expr("array_join(transform(rows, r -> r.label), ', ')").alias("labels"),
                    F.expr("array_join(transform(rows, r -> r.entity), ', ')").alias("types")))


def _watching(outcomes: DataFrame, rules: DataFrame) -> DataFrame:
    """One row when monitored rules were hit: the five most frequent, and what they would have protected."""
    none = F.lit(None)
    top = (rules.filter("mode = 'monitor' AND hits > 0").orderBy(F.desc("hits"), "rule").limit(5)
           .select("hits", "rule", none.cast("bigint").alias("would")))
    would = outcomes.filter("risk = 'risky'").select(none.cast("bigint").alias("hits"), none.cast("string").alias("rule"), "would")
    return (top.unionByName(would)
            .agg(F.max("would").alias("would"),
                 F.array_sort(F.collect_list(F.when(F.col("rule").isNotNull(), F.struct(F.expr("-hits").alias("h"), "rule")))).alias("r"))
            .filter("size(r) > 0")
            .select("would", F.expr("array_join(transform(r, x -> concat(x.rule, ' (', -x.h, ')')), ', ')").alias("rules")))


def _noisy(shadow_entities: DataFrame) -> DataFrame:
    """One row when users called many alerts of some types false, the most frequent type first."""
    rate = F.col("false_positives") / F.col("events")
    shown = F.concat("label", F.lit(" (%"), F.bround(100 * rate, 0).cast("int").cast("string"), F.lit(")"))
    return (shadow_entities.filter((F.col("events") >= fixed.FALSE_POSITIVE_MIN_EVENTS) & (rate >= fixed.FALSE_POSITIVE_RATE))
            .agg(F.array_sort(F.collect_list(F.struct(F.expr("-events").alias("e"), "entity", shown.alias("t")))).alias("r"))
            .filter("size(r) > 0").select(F.expr("array_join(transform(r, x -> x.t), ', ')").alias("types")))


def recommend(outcomes: DataFrame, entities: DataFrame, rules: DataFrame, sites: DataFrame, totals: DataFrame,
              shadow_entities: DataFrame, undeclared_count: DataFrame) -> DataFrame:
    """`outcomes`, `entities`, `sites`, `totals` and `shadow_entities` are evaluation results, `rules` has
    rule hits by mode, `undeclared_count` one row with `unclassified`. All inputs are small aggregates:
    entity types, rules and sites, not events."""
    warned = totals.withColumn("risky", F.expr("masked + cancelled + blocked + overridden"))
    findings = {
        "personal_data": _exposed(entities, "pii"),
        "secrets": _exposed(entities, "secret"),
        "injection": outcomes.filter("risk = 'injection' AND exposed > 0"),
        "output_leaks": outcomes.filter("risk = 'output_leak' AND exposed > 0"),
        "corporate": _exposed(entities, "corporate"),
        "monitored": _watching(outcomes, rules),
        "no_browser_events": sites.agg(F.count(F.lit(1)).alias("n")).filter("n = 0"),
        "overrides": (warned.filter(f"risky > 0 AND try_divide(overridden, risky) >= {fixed.OVERRIDE_SHARE}")
                      .withColumn("share", F.bround(100 * F.col("overridden") / F.col("risky"), 0).cast("int"))),
        "false_positives": _noisy(shadow_entities),
        "undeclared": undeclared_count.filter("unclassified > 0"),
    }
    return reduce(DataFrame.unionByName, [_advice(rows, name) for name, rows in findings.items()]).orderBy("position")
