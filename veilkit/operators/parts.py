"""Texts that come in parts: each part is scanned once, plus a short window over every boundary.

A value or phrase split over two parts is found in the window; what a window finds near its cut edges
or on top of a finding inside a part is dropped. A finding inside a part always wins, so the result differs from a
scan of the joined text where a part's own text reads differently with its neighbour's: a longer value over the
boundary is not found if a shorter one inside a part is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions.arrays import let, pinned, running_sum
from veilkit.operators.injection import hits_sql, score_sql
from veilkit.operators.ordered import lead_struct, running_totals
from veilkit.operators.scan import FINDINGS_TYPE, ScanConfig, findings_sql, resolve_overlaps
from veilkit.session import materialize

_SPAN = "named_struct('start', {f}.start + {u}.base, 'end', {f}.end + {u}.base, 'score', {f}.score, 'rec', {rec}, " \
        "'ord', {o}, 'entity', {f}.entity)"


def _window(prev: str, following: str, size: int) -> str:
    return f"concat(right({prev}, {size}), '\\n', substr({following}, 1, {size}))"


def _edge_unit(tail: str, prev_length: str, head: str, next_length: str, base: str) -> str:
    """The boundary window with its place in the joined text and the limits inside which a finding
    counts. `base` is where the next part starts."""
    n, edge = fixed.BOUNDARY_CHARS, fixed.BOUNDARY_EDGE
    cut = f"least({prev_length}, {n})"
    size = f"({cut} + 1 + least({next_length}, {n}))"
    return (f"named_struct('text', {_window(tail, head, n)}, 'base', cast({base} - {cut} - 1 AS int), 'cut', {cut}, "
            f"'lo', if({prev_length} > {n}, {edge}, 0), 'hi', {size} - if({next_length} > {n}, {edge}, 0))")


_INSIDE = "((f.start <= u.cut AND u.cut < f.end) OR (f.start >= u.lo AND f.end <= u.hi))"


def analyze_parts(df: DataFrame, config: ScanConfig = ScanConfig(), parts: str = "parts") -> DataFrame:
    """For rows that carry an array of parts (with a `text` field): adds `part_findings`, one findings
    array per part, and `findings`, those of the parts joined by newlines. Nothing is shuffled. Only `findings` reads
    the scan of the windows: where a job uses the parts' own findings alone, Spark leaves that column out."""
    texts = f"transform(`{parts}`, p -> coalesce(p.text, ''))"
    edges = ("if(size(_texts) < 2, array(), transform(filter(sequence(1, size(_texts) - 1), "
             "i -> _texts[i - 1] <> '' AND _texts[i] <> ''), "
             f"i -> {_edge_unit('_texts[i - 1]', 'length(_texts[i - 1])', '_texts[i]', 'length(_texts[i])', '_starts[i]')}))")
    inside = (f"transform(part_findings, (fs, i) -> transform(fs, (f, j) -> named_struct('start', f.start + _starts[i], "
              "'end', f.end + _starts[i], 'score', f.score, 'rec', 0, 'ord', j, 'entity', f.entity)))")
    over = (f"transform(_found, (fs, n) -> {let('u', '_units[n]', 'transform(filter(fs, f -> ' + _INSIDE + '), (f, j) -> ' + _SPAN.format(f='f', u='u', rec='n + 1', o='j') + ')')})")
    spans = f"concat(flatten({inside}), flatten({over}))"
    combined = (f"transform({resolve_overlaps(spans, by_score=False)}, x -> named_struct('entity', x.entity, "
                "'start', x.start, 'end', x.end, 'score', x.score))")
    return (
        df.withColumn("_texts", F.expr(texts))
        .withColumn("_starts", F.expr(running_sum("transform(_texts, x -> length(x) + 1)")))
        .withColumn("_units", F.expr(edges))
        .withColumn("part_findings", F.expr(pinned(f"transform(_texts, x -> {findings_sql('x', config)})")))
        .withColumn("_found", F.expr(pinned(f"transform(_units, u -> {findings_sql('u.text', config)})")))
        .withColumn("findings", F.expr(combined))
        .drop("_texts", "_starts", "_units", "_found")
    )


def injection_parts(df: DataFrame, parts: str = "parts", roles: Sequence[str] = tuple(fixed.INJECTION_ROLES)) -> DataFrame:
    """Adds injection_rules and injection_score over the parts of the scanned roles and their boundaries."""
    if not roles:
        return (df.withColumn("injection_rules", F.expr("cast(array() AS array<int>)"))
                .withColumn("injection_score", F.lit(0.0)))
    n = fixed.INJECTION_BOUNDARY_CHARS
    chosen = ", ".join(f"'{r}'" for r in roles)
    texts = f"transform(filter(`{parts}`, p -> p.role IN ({chosen})), p -> coalesce(p.text, ''))"
    edges = ("if(size(_texts) < 2, array(), transform(filter(sequence(1, size(_texts) - 1), "
             f"i -> _texts[i - 1] <> '' AND _texts[i] <> ''), i -> {_window('_texts[i - 1]', '_texts[i]', n)}))")
    return (
        df.withColumn("_texts", F.expr(texts))
        .withColumn("injection_rules", F.expr(
            pinned(f"array_sort(array_distinct(flatten(transform(concat(_texts, {edges}), x -> {hits_sql('x')}))))")))
        .withColumn("injection_score", F.expr(score_sql("injection_rules")))
        .drop("_texts")
    )


def analyze_turns(df: DataFrame, config: ScanConfig = ScanConfig(), *, keys: Sequence[str], turn: str, text: str = "text",
                  keep: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """The same for parts stored one per row (conversation turns): keys, turn, the `keep` columns,
    `findings` of the turn and `edge_findings`, spans over the boundary to the next turn, positioned
    from the turn's start.

    Texts are scanned where they lie and never shuffled. What travels is one slim row per turn (its
    findings, its first and last characters); it is checkpointed because boundary work reads it twice.
    A conversation may be huge, so the next turn comes from a bucketed lead, and only boundary spans, a
    tiny share of the rows, are ordered within a whole conversation.
    """
    n = fixed.BOUNDARY_CHARS
    bucket = F.floor(F.col(turn) / 1024) if bucket is None else bucket
    body = F.coalesce(F.col(text), F.lit(""))
    slim = (df.withColumn("_t", body).withColumn("findings", F.expr(pinned(findings_sql("_t", config))))
            .select(*keys, turn, *keep, "findings", F.substring("_t", 1, n).alias("_head"),
                    F.right("_t", F.lit(n)).alias("_tail"), F.length("_t").alias("_length")))
    slim = materialize(slim.withColumn("_near", F.expr(f"filter(findings, f -> f.start < {n})")))
    rows = lead_struct(slim, keys, [turn], bucket, ["_head", "_length", "_near"], "_next")
    unit = _edge_unit("_tail", "_length", "_next._head", "_next._length", "_length + 1")
    none = f"cast(array() AS {FINDINGS_TYPE})"
    placed = (f"transform(filter(_found, f -> {_INSIDE.replace('u.', '_edge.')}), f -> named_struct('entity', f.entity, "
              "'start', f.start + _edge.base, 'end', f.end + _edge.base, 'score', f.score))")
    free = ("filter(_edges, e -> NOT exists(findings, f -> f.start < e.end AND e.start < f.end) AND NOT "
            f"exists(coalesce(_next._near, {none}), f -> f.start + _length + 1 < e.end AND e.start < f.end + _length + 1))")
    rows = (
        rows.withColumn("_edge", F.expr(f"if(_next IS NULL OR _length = 0 OR _next._length = 0, NULL, {unit})"))
        .withColumn("_found", F.expr(pinned(findings_sql("_edge.text", config))))
        .withColumn("_edges", F.expr(f"if(_edge IS NULL, {none}, {placed})"))
        .withColumn("_edges", F.expr(free))
        .select(*keys, turn, "_edges", "_length")
    )
    rows = running_totals(rows, keys, [turn], bucket, {"_base": F.col("_length") + 1}, inclusive=False)
    accepted = _settle(rows.filter(F.size("_edges") > 0), keys, turn)
    return (slim.select(*keys, turn, *keep, "findings").join(accepted, [*keys, turn], "left")
            .withColumn("edge_findings", F.coalesce("edge_findings", F.expr(none))))


def _settle(rows: DataFrame, keys: Sequence[str], turn: str) -> DataFrame:
    """Overlaps between spans of neighbouring windows: the earlier window wins."""
    spans = (rows.select(*keys, turn, "_base", F.posexplode("_edges").alias("_no", "_e"))
             .withColumn("_start", F.col("_e.start") + F.col("_base")).withColumn("_end", F.col("_e.end") + F.col("_base")))
    by_start = Window.partitionBy(*keys).orderBy("_start", "_end", turn, "_no")
    reach = F.max("_end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.when(reach.isNull() | (reach <= F.col("_start")), 1).otherwise(0))
    spans = spans.withColumn("_run", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    gathered = spans.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct(turn, "_no", "_start", "_end", "_e"))).alias("_r"))
    kept = ("aggregate(_r, slice(_r, 1, 0), (acc, y) -> if(exists(acc, z -> z._start < y._end AND y._start < z._end), "
            "acc, array_append(acc, y)))")
    return (gathered.select(*keys, F.inline(F.expr(kept)))
            .groupBy(*keys, turn).agg(F.array_sort(F.collect_list(F.struct("_no", "_e"))).alias("_x"))
            .select(*keys, turn, F.expr("transform(_x, x -> x._e)").alias("edge_findings")))
