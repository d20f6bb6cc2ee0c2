"""Prompt-injection heuristics: weighted rules over folded text, with cheap literal gates per rule."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions.arrays import let, pinned
from veilkit.functions.globs import literal
from veilkit.functions.normalize import nfkc

# words a folded text must contain for the rule at the same position to match at all
_STEMS = [
    ("talimat", "kural", "yönerge", "komut"), ("talimat", "kural", "yönerge"), ("sistem", "gizli"), ("mod",), ("artik",),
    ("ignore",), ("system", "hidden"), ("now",), (),
]


def _java(pattern: str) -> str:
    return "(?U)" + re.sub(r"\\U([0-9a-fA-F]{8})", r"\\x{\1}", pattern.replace("ı", "i"))


def folded(text: str) -> str:
    """Compatibility-folded lower case in which dotted and dotless i are one letter."""
    return f"translate(lower(translate({nfkc(text)}, 'İ\\u0307', 'i')), 'ı', 'i')"


def rule_label(number: int) -> str:
    return fixed.INJECTION_RULES[number][0].replace("ı", "i")[: fixed.INJECTION_LABEL_CHARS]


def hits_sql(text: str) -> str:
    """Numbers of the matching rules, ascending."""
    tests = []
    for i, (pattern, _) in enumerate(fixed.INJECTION_RULES):
        stems = _STEMS[i]
        gate = "(" + " OR ".join(f"contains(f, {literal(s)})" for s in stems) + ") AND " if stems else ""
        # only texts outside ASCII can hold invisible characters
        gate = gate or f"f rlike {literal('[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} AND "
        tests.append(f"if({gate}f rlike {literal(_java(pattern))}, {i}, NULL)")
    return let("f", folded(f"coalesce({text}, '')"), f"filter(array({', '.join(tests)}), r -> r IS NOT NULL)")


def score_sql(hits: str) -> str:
    weights = ", ".join(f"{w}D" for _, w in fixed.INJECTION_RULES)
    return f"coalesce(array_max(transform({hits}, r -> array({weights})[r])), 0D)"


def injection_hits(text: str) -> Column:
    return F.expr(hits_sql(f"`{text}`"))


def with_injection(df: DataFrame, text: str = "text") -> DataFrame:
    return (df.withColumn("injection_rules", F.expr(pinned(hits_sql(f"`{text}`"))))
            .withColumn("injection_score", F.expr(score_sql("injection_rules"))))


def classifier_override(df: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """Lift the score of texts a separate classifier flagged. `flagged` has (key, is_injection)."""
    marks = flagged.filter("is_injection").select(key).distinct().withColumn("_flag", F.lit(True))
    lifted = F.coalesce("_flag", F.lit(False)) & (F.col("injection_score") < fixed.CLASSIFIER_SCORE)
    return (df.join(marks, key, "left")
            .withColumn("injection_engine", F.when(lifted, fixed.CLASSIFIER_RULE).otherwise("heuristic"))
            .withColumn("injection_score", F.when(lifted, F.lit(fixed.CLASSIFIER_SCORE)).otherwise(F.col("injection_score")))
            .drop("_flag"))
