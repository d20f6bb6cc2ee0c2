"""Tables of prefixes and globs matched by equi-join: the cost does not grow with their number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilkit.functions.globs import glob_regex


def _heads(values: DataFrame, table: DataFrame) -> DataFrame:
    """(value, head): the beginnings of every value in the lengths that the table has."""
    lengths = table.agg(F.array_sort(F.collect_set(F.length("head")))).scalar()
    rows = values.withColumn("_lengths", lengths)
    return rows.select("value", F.explode(F.expr("filter(_lengths, n -> n <= length(value))")).alias("_n")).select("value", F.expr("substr(value, 1, _n)").alias("head"))


def longest_prefix(df: DataFrame, column: str, prefixes: DataFrame, *, into: str, ordered: bool = False) -> DataFrame:
    """Adds the value of the longest prefix that starts `column`, NULL without one. `prefixes` has (prefix, value); with
    `ordered` it has a number `place`, too, and the smallest place wins instead. Of equal prefixes the smallest value counts.
    Each distinct value is looked up once."""
    table = prefixes.select(F.col("prefix").alias("head"), F.col("value").alias("_hit"), (F.col("place") if ordered else F.lit(0)).alias("_place")).filter("head IS NOT NULL")
    best = F.min_by("_hit", F.struct("_place", "_hit")) if ordered else F.max_by("_hit", F.struct(F.length("head"), F.lit(0)))
    if not ordered:
        table = table.groupBy("head").agg(F.min("_hit").alias("_hit"))
    values = df.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    found = _heads(values, table).join(table, "head").groupBy("value").agg(best.alias(into))
    return df.join(found.withColumnRenamed("value", column), column, "left")


def glob_rows(globs) -> list[tuple[str, str]]:
    """(head, pattern) of globs: what comes before the first wildcard, and the whole as a regular expression."""
    out = []
    for glob in globs:
        cut = min((i for i in map(glob.find, "*?[") if i >= 0), default=len(glob))
        out.append((glob[:cut], glob_regex(glob)))
    return out


def glob_matches(df: DataFrame, column: str, globs: DataFrame) -> DataFrame:
    """(value, id) of every distinct value and every glob that matches it. `globs` has (id, head, pattern); rows meet on
    the head, so only globs that begin with a wildcard are tried on every value."""
    values = df.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    return _heads(values, globs).join(globs, "head").filter("value rlike pattern").select("value", "id").distinct()
