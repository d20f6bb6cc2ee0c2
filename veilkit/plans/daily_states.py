"""Usage reports from stored daily states: a report merges the days of its window instead of reading the audit.

A day's states are partial aggregates: counts and sums by team, model, destination and format; users as bitmaps over
numbered users, so that distinct counts merge exactly; entities, rule hits and users' risks by day. Closed days are
written once, a partition each. What the stored days do not cover, such as the current day or the cut first day of a
window, is aggregated from the audit's rows of those days alone and merged with the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions import predicates as P
from veilkit.operators.ordered import numbered
from veilkit.plans.usage import ntz

_BY = ["day", "team", "model", "destination", "api_format"]
_COUNTS = {
    "external": "destination = 'external'", **{a: f"action = '{a}'" for a in fixed.SEVERITY}, "injection_attempts": P.INJECTION, "secret_requests": P.HAS_SECRET,
    "external_unmasked_pii": P.EXTERNAL_UNMASKED_PII, "monitor_diffs": P.MONITOR_DIFF, "would_block": P.WOULD_BLOCK, "output_leaks": P.OUTPUT_LEAK,
    "output_protected": "output_action IN ('mask', 'block')", "quota_blocks": P.QUOTA_HIT, "cost_unknown_requests": "est_cost_usd IS NULL",
}
_SUMS = {"prompt_tokens": "prompt_tokens", "completion_tokens": "completion_tokens", "est_cost_usd": "est_cost_usd", "latency_sum": "latency_ms",
         "latency_n": "if(latency_ms IS NULL, 0, 1)"}
_EXTERNAL_UNMASKED = "destination = 'external' AND action <> 'block' AND NOT array_contains(masked_entities, entity)"


def number_users(audit: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(user, number) of users without a number yet; numbers go on after the largest known one, without gaps."""
    users = audit.select("user").filter("user IS NOT NULL").distinct()
    start = 0
    if known is not None:
        users = users.join(known.select("user"), "user", "left_anti")
        start = known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
    return numbered(users, ["user"], "number").withColumn("number", F.col("number") + start)


def partials(audit: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """States of the days that the rows belong to. `users` numbers all their users."""
    rows = audit.withColumn("day", F.to_date("event_time")).withColumn("api_format", F.expr(P.API_FORMAT))
    usage = rows.groupBy(*_BY).agg(F.count(F.lit(1)).alias("requests"), *[F.count_if(F.expr(c)).alias(n) for n, c in _COUNTS.items()],
                                   *[F.sum(F.expr(c)).alias(n) for n, c in _SUMS.items()])
    seen = rows.select("day", "team", "model", "user").distinct().join(users, "user")
    bitmaps = (seen.groupBy("day", "team", "model", F.expr("bitmap_bucket_number(number)").alias("bucket"))
               .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(number))").alias("users")))
    entities = (rows.select("day", "team", "destination", "action", "masked_entities", F.explode("entities").alias("entity")).groupBy("day", "team", "entity")
                .agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.expr("destination = 'external'")).alias("external"),
                     F.count_if(F.expr("action = 'block'")).alias("blocked"),
                     F.count_if(F.expr("action <> 'block' AND array_contains(masked_entities, entity)")).alias("masked"),
                     F.count_if(F.expr(_EXTERNAL_UNMASKED)).alias("external_unmasked")))
    tagged = F.expr("concat(transform(rules, r -> named_struct('rule', r, 'mode', 'enforce')), transform(monitored_rules, r -> named_struct('rule', r, 'mode', 'monitor')))")
    rules = rows.select("day", "team", F.inline(tagged)).groupBy("day", "team", "rule", "mode").agg(F.count(F.lit(1)).alias("hits"))
    people = (rows.groupBy("day", "team", "user").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.expr("action = 'block'")).alias("blocked"), F.count_if(F.expr(P.INJECTION)).alias("injection_attempts"),
        F.count_if(F.expr("destination = 'external' AND size(entities) > 0")).alias("external_with_pii")))
    return {"usage": usage, "bitmaps": bitmaps, "entities": entities, "rules": rules, "people": people}


def write_days(audit: DataFrame, users: DataFrame, path: str) -> None:
    """Add the states of closed days: `audit` holds all rows of these days, which must not be stored yet."""
    for name, state in partials(audit, users).items():
        state.write.mode("append").partitionBy("day").parquet(f"{path}/{name}")


class States:
    """The states of one window: stored days merged with what only the audit has."""

    def __init__(self, spark: SparkSession, path: str, audit: DataFrame, users: DataFrame, as_of: str, days: int, team: str = ""):
        start = ntz(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
        whole = F.when(start == F.date_trunc("day", start), F.to_date(start)).otherwise(F.date_add(F.to_date(start), 1))
        stored = spark.read.parquet(f"{path}/usage").select("day").distinct()  # partition names only
        closed = sorted(r.day for r in stored.filter(F.col("day") >= whole).collect())
        rest = audit.filter((F.col("event_time") >= start) & ~F.to_date("event_time").isin(closed)) if closed else audit.filter(F.col("event_time") >= start)
        if closed:  # whole days at either end let the scan skip what is stored
            first, last = closed[0], closed[-1]
            gaps = len(closed) < (last - first).days + 1
            outside = (F.col("event_time") < F.lit(first).cast("timestamp_ntz")) | (F.col("event_time") >= F.date_add(F.lit(last), 1).cast("timestamp_ntz"))
            rest = rest if gaps else audit.filter((F.col("event_time") >= start) & outside)
        self.rest = rest
        fresh = partials(rest, users)
        self.of = {}
        for name, own in fresh.items():
            kept = spark.read.parquet(f"{path}/{name}").filter(F.col("day").isin(closed) if closed else F.lit(False))
            both = kept.select(*own.columns).unionByName(own)
            self.of[name] = both.filter(F.col("team") == team) if team else both

    def _sum(self, *names: str):
        return [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]

    def _cost(self):
        return F.round(F.sum("est_cost_usd"), 6).alias("est_cost_usd")

    def _latency(self):
        return F.round(F.sum("latency_sum") / F.sum("latency_n"), 1).alias("avg_latency_ms")

    def distinct_users(self, *by: str) -> DataFrame:
        """Exact numbers of distinct users: bitmaps of equal buckets are united, their bits counted."""
        united = self.of["bitmaps"].groupBy(*by, "bucket").agg(F.expr("bitmap_or_agg(users)").alias("users"))
        return united.groupBy(*by).agg(F.coalesce(F.sum(F.expr("bitmap_count(users)")), F.lit(0)).alias("users"))

    def summary(self) -> DataFrame:
        rows = self.of["usage"].agg(
            *self._sum("requests"), F.countDistinct("team").alias("teams"), F.coalesce(F.sum("external"), F.lit(0)).alias("external_requests"),
            F.coalesce(F.sum("mask"), F.lit(0)).alias("masked"), F.coalesce(F.sum("block"), F.lit(0)).alias("blocked"),
            *self._sum("injection_attempts", "secret_requests", "external_unmasked_pii", "monitor_diffs", "would_block", "output_leaks", "output_protected", "quota_blocks",
                       "prompt_tokens", "completion_tokens"), self._cost(), *self._sum("cost_unknown_requests"), self._latency())
        return rows.withColumn("users", self.distinct_users().scalar())

    def daily(self) -> DataFrame:
        return (self.of["usage"].groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"))
                .agg(*self._sum("requests", *fixed.SEVERITY, "external"), self._cost()).orderBy("day"))

    def by_team(self) -> DataFrame:
        return (self.of["usage"].groupBy("team").agg(
            *self._sum("requests", "external"), F.sum("mask").alias("masked"), F.sum("block").alias("blocked"), *self._sum("injection_attempts", "external_unmasked_pii"),
            F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), self._cost(), *self._sum("cost_unknown_requests")).orderBy(F.desc("requests"), "team"))

    def by_model(self) -> DataFrame:
        return (self.of["usage"].groupBy("model").agg(
            F.min("destination").alias("destination"), *self._sum("requests"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), self._cost(),
            *self._sum("cost_unknown_requests"), self._latency()).orderBy(F.desc("requests"), "model"))

    def by_format(self) -> DataFrame:
        return self.of["usage"].groupBy("api_format").agg(*self._sum("requests"), self._cost()).orderBy(F.desc("requests"), "api_format")

    def entities(self) -> DataFrame:
        return (self.of["entities"].groupBy("entity").agg(*self._sum("requests", "external", "blocked", "masked", "external_unmasked"))
                .orderBy(F.desc("requests"), "entity"))

    def rules(self) -> DataFrame:
        return self.of["rules"].groupBy("rule", "mode").agg(*self._sum("hits")).orderBy(F.desc("hits"), "rule", "mode")

    def top_users(self, limit: int = 10) -> DataFrame:
        risk = F.col("blocked") + F.col("injection_attempts")
        return (self.of["people"].groupBy("user").agg(F.min("team").alias("team"), *self._sum("requests", "blocked", "injection_attempts", "external_with_pii"))
                .filter(risk + F.col("external_with_pii") > 0).orderBy(risk.desc(), F.desc("external_with_pii"), "user").limit(limit))
