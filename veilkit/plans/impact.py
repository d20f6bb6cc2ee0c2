"""What a candidate policy would have changed: recorded contexts replayed through both policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilkit.functions.globs import literal
from veilkit.operators.policy import Policy, evaluate, route
from veilkit.plans.usage import audit_window

ROUTABLE = "api_format IN ('chat', 'responses', 'messages', 'embeddings')"


def contexts(audit: DataFrame, as_of: str, days: int) -> DataFrame:
    """Requests grouped by everything a rule can see; no cap on the number of groups."""
    return (
        audit_window(audit, as_of, days).filter("api_format <> 'browser'")
        .groupBy("team", "teams", "model", "destination", "entities", F.round("injection_score", 2).alias("injection_score"),
                 "api_format")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user").alias("users"))
    )


def outcome(groups: DataFrame, policy: Policy, into: str) -> DataFrame:
    """Adds `<into>` (action, or 'route' when sent inside and not blocked there) and `<into>_decision`."""
    decided = route(evaluate(groups.withColumn("_model", F.col("model")).withColumn("_dest", F.col("destination")), policy),
                    policy, ROUTABLE)
    return (decided.withColumn(into, F.expr("if(routed_from IS NOT NULL AND decision.action <> 'block', 'route', decision.action)"))
            .withColumnRenamed("decision", f"{into}_decision")
            .withColumn("model", F.col("_model")).withColumn("destination", F.col("_dest"))
            .drop("_model", "_dest", "routed_from"))


def replay(audit: DataFrame, as_of: str, days: int, current: Policy, candidate: Policy) -> DataFrame:
    return outcome(outcome(contexts(audit, as_of, days), current, "before"), candidate, "after")


def totals(replayed: DataFrame) -> DataFrame:
    return (replayed.select("n", F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("before").alias("action")),
                                                   F.struct(F.lit("after").alias("side"), F.col("after").alias("action")))).alias("x"))
            .groupBy("x.side", "x.action").agg(F.sum("n").alias("requests")))


def transitions(replayed: DataFrame) -> DataFrame:
    return (replayed.filter("before <> after").groupBy("before", "after").agg(F.sum("n").alias("requests"))
            .orderBy(F.desc("requests"), "before", "after"))


def changed_teams(replayed: DataFrame, limit: int = 10) -> DataFrame:
    return (replayed.filter("before <> after").groupBy("team").agg(F.sum("n").alias("requests"))
            .orderBy(F.desc("requests"), "team").limit(limit))


def rule_changes(replayed: DataFrame) -> DataFrame:
    """Rules that fire only under one of the policies, with the requests they cover."""
    def side(name: str, ours: str, theirs: str) -> str:
        return (f"transform(array_distinct(array_except({ours}, {theirs})), r -> named_struct('change', {literal(name)}, 'rule', r))")
    both = (f"concat({side('added', 'after_decision.rules', 'before_decision.rules')}, "
            f"{side('removed', 'before_decision.rules', 'after_decision.rules')})")
    return (replayed.select("n", F.explode(F.expr(both)).alias("c")).groupBy("c.change", "c.rule")
            .agg(F.sum("n").alias("requests")).orderBy("change", F.desc("requests"), "rule"))


def examples(replayed: DataFrame, limit: int = 12) -> DataFrame:
    return (replayed.filter("before <> after")
            .orderBy(F.desc("n"), "team", "model", "destination", "injection_score", F.array_join("entities", ","), "api_format")
            .limit(limit)
            .select("team", "model", "destination", "entities", "injection_score", F.col("n").alias("requests"), "users",
                    "before", "after", F.col("after_decision.rules").alias("rules"), F.col("after_decision.reason").alias("reason")))


def summary(replayed: DataFrame) -> DataFrame:
    return replayed.agg(F.sum("n").alias("requests"), F.count(F.lit(1)).alias("groups"),
                        F.coalesce(F.sum(F.when(F.col("before") != F.col("after"), F.col("n"))), F.lit(0)).alias("changed"))
