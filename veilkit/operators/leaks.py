"""New values in a model's answer: found there, but not part of what was sent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilkit.functions.values import alnum
from veilkit.operators.scan import FINDINGS_TYPE


def _value(text: str) -> str:
    return f"substr(`{text}`, f.start + 1, f.end - f.start)"


def known_values(vault: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, known, respelled): real values, surrogates and, for surrogate numbers, any respelling."""
    surrogate = ~F.col("placeholder").startswith("[")
    real = vault.select(*scope, F.col("original").alias("known"), F.lit(False).alias("respelled"))
    fake = vault.filter(surrogate).select(*scope, F.col("placeholder").alias("known"), F.lit(False).alias("respelled"))
    loose = (vault.filter(surrogate & ~F.col("placeholder").contains("@"))
             .select(*scope, F.expr(alnum("placeholder")).alias("known"), F.lit(True).alias("respelled")))
    return real.unionByName(fake).unionByName(loose).distinct()


def output_leaks(responses: DataFrame, requests: DataFrame, key: str, *, text: str = "text",
                 findings: str = "findings", sent: str = "all_text", vault: DataFrame | None = None) -> DataFrame:
    """Adds `leaks`, the findings whose value is neither a substring of the request's whole text nor a
    known value. Answers without findings match no request: they get join keys of their own, so that they
    spread evenly instead of meeting in the partition of a common NULL."""
    asked = requests.select(F.col(key).alias("_k"), F.lit(0).cast("bigint").alias("_apart"), F.col(sent).alias("_sent"))
    has = F.size(findings) > 0
    rows = responses.withColumn("_k", F.when(has, F.col(key))).withColumn("_apart", F.when(has, F.lit(0)).otherwise(F.xxhash64(key)))
    rows = rows.join(asked, ["_k", "_apart"], "left").drop("_k", "_apart")
    known = "cast(array() AS array<string>)"
    if vault is not None:
        values = known_values(vault, [key])
        packed = values.groupBy(key).agg(
            F.collect_set(F.expr("if(respelled, NULL, known)")).alias("_known"),
            F.collect_set(F.expr("if(respelled, known, NULL)")).alias("_loose"))
        rows = rows.join(packed, key, "left")
        known, loose = "coalesce(_known, array())", "coalesce(_loose, array())"
    else:
        loose = known
    v = _value(text)
    new = (f"filter(`{findings}`, f -> NOT contains(coalesce(_sent, ''), {v}) AND NOT array_contains({known}, {v}) "
           f"AND NOT array_contains({loose}, {alnum(v)}))")
    return rows.withColumn("leaks", F.expr(new)).drop("_sent", "_known", "_loose")


def session_leaks(response_values: DataFrame, request_values: DataFrame, session: Sequence[str], vault: DataFrame | None = None) -> DataFrame:
    """The set form for sessions that keep only the found values: what the session did not send. Real values of
    a vault, its surrogates and respellings of its surrogate numbers are no leaks either."""
    sent = request_values.select(*session, "value").distinct()
    if vault is None:
        return response_values.join(sent, [*session, "value"], "left_anti")
    known = known_values(vault, session)
    plain = known.filter("NOT respelled").select(*session, F.col("known").alias("value"))
    loose = known.filter("respelled").select(*session, F.col("known").alias("_bare"))
    rows = response_values.join(sent.unionByName(plain).distinct(), [*session, "value"], "left_anti")
    return rows.withColumn("_bare", F.expr(alnum("value"))).join(loose, [*session, "_bare"], "left_anti").drop("_bare")


def leak_entities(df: DataFrame, column: str = "leaks") -> DataFrame:
    return (df.withColumn("output_leaked", F.array_sort(F.array_distinct(F.expr(f"transform(`{column}`, f -> f.entity)"))))
            .withColumn("output_entities", F.array_sort(F.array_distinct(F.expr("transform(findings, f -> f.entity)")))))


EMPTY_FINDINGS = f"cast(array() AS {FINDINGS_TYPE})"
