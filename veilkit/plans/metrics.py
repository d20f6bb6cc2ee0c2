"""Service counters and latency histograms over bounded labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions import predicates as P


def counters(audit: DataFrame) -> DataFrame:
    """Every counter from one scan: each row becomes its (metric, label, label) hits, counted map-side."""
    hits = F.expr(f"""
      filter(concat(
        array(named_struct('metric', 'requests', 'a', action, 'b', destination, 'c', {P.API_FORMAT}),
              if({P.INJECTION}, named_struct('metric', 'injection_detected', 'a', '', 'b', '', 'c', ''), NULL),
              if({P.OUTPUT_LEAK}, named_struct('metric', 'output_actions', 'a', output_action, 'b', '', 'c', ''), NULL),
              if({P.QUOTA_HIT}, named_struct('metric', 'quota_exceeded', 'a', quota, 'b', '', 'c', ''), NULL)),
        transform(entities, e -> named_struct('metric', 'entities_detected', 'a', e, 'b', 'input', 'c', '')),
        transform(output_leaked, e -> named_struct('metric', 'entities_detected', 'a', e, 'b', 'output_leak', 'c', '')),
        if(api_format = 'browser',
           transform(filter(rules, r -> startswith(r, '{fixed.SHADOW_RULE}') AND NOT startswith(r, '{fixed.JUSTIFICATION_RULE}')),
                     r -> named_struct('metric', 'browser_events', 'a', substring(r, {len(fixed.SHADOW_RULE) + 1}), 'b', '', 'c', '')),
           array()),
        if(api_format = 'icap', array(named_struct('metric', 'network_checks', 'a', action, 'b', '', 'c', '')), array())
      ), h -> h IS NOT NULL)""")
    return audit.select(F.inline(hits)).groupBy("metric", "a", "b", "c").agg(F.count(F.lit(1)).alias("value"))


def latency_histogram(audit: DataFrame) -> DataFrame:
    """Cumulative request-duration buckets per destination, with the open last bucket, sum and count."""
    seconds = F.col("latency_ms") / 1000
    edges = fixed.REQUEST_BUCKETS
    per = audit.groupBy("destination").agg(
        *[F.count_if(seconds <= e).alias(f"le_{i}") for i, e in enumerate(edges)],
        F.count("latency_ms").alias("le_inf"), F.round(F.sum(seconds), 3).alias("sum_seconds"))
    buckets = ", ".join(f"named_struct('le', '{e:g}', 'value', le_{i})" for i, e in enumerate(edges))
    return per.select("destination", "sum_seconds",
                      F.inline(F.expr(f"array({buckets}, named_struct('le', '+Inf', 'value', le_inf))")))
