"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source wants the same number of copies, target / size of the source. Its whole part is
certain; the fraction is a probability. Two fractional documents at a time, probability mass (in words, so
that p1 * w1 + p2 * w2 stays as it is) moves from one to the other at random, each way with the odds that keep
both expectations, until one of them is 0 or 1; the other goes on. Buckets of a source reduce to one
fractional document each, those are bucketed again, and so on up a tree until one is left per source, which
is rounded alone. The words taken from a source thus miss its target by less than its largest document.

Draws depend on ids and the seed only, so reruns agree. Nulls: a null source is a source of its own, last in
order; null or wordless text has size 0 and takes no words. Rows that repeat an id are rounded one by one.
Empty input gives an empty result. Only the id, source and text columns are read, extra ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilkit.llm.frames import free_name, materialize, n_words, per_group
from veilkit.llm.hashing import mix

FAN_IN = 4096
WEIGHTS = (5.0, 2.0, 1.0)


def ranked(names: DataFrame, order: str) -> DataFrame:
    """0-based `rank` of distinct values, nulls last, without bringing all rows to one task: range
    partitions are numbered by themselves and shifted by the sizes of those before (one count a partition)."""
    parts = names.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = materialize(names.repartitionByRange(int(parts), F.col(order).asc_nulls_last())
                        .withColumn("part", F.spark_partition_id()))
    counts = dict(dealt.groupBy("part").count().collect())  # as many rows as partitions
    shift, before = [], 0
    for part in range(max(counts, default=-1) + 1):
        shift.append(before)
        before += counts.get(part, 0)
    inside = Window.partitionBy("part").orderBy(F.col(order).asc_nulls_last())
    base = F.array(*[F.lit(x).cast("long") for x in shift or [0]])
    return dealt.withColumn("rank", F.row_number().over(inside) - 1 + F.get(base, F.col("part"))).drop("part")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n) -> with `target`: `share` of all sizes dealt by repeating weights in source
    order, no target above `most` times its source, the excess dealt again by weight."""
    cycle = F.array(*[F.lit(w) for w in weights])
    t = materialize(ranked(sizes, "source")
                    .withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))
                    .withColumn("cap", F.col("source_size") * F.lit(most)))
    total = t.agg(F.sum("source_size")).first()[0] or 0
    left, level = share * total, 0.0
    capped = -1
    while True:  # a round more for every source that reaches its cap; one scalar row each
        row = t.agg(F.sum(F.when(F.col("weight") * level >= F.col("cap"), F.col("cap"))).alias("full"),
                    F.sum(F.when(F.col("weight") * level >= F.col("cap"), 1).otherwise(0)).alias("n"),
                    F.sum(F.when(F.col("weight") * level < F.col("cap"), F.col("weight"))).alias("open")).first()
        if not row["open"] or row["n"] == capped:
            break
        capped = row["n"]
        level = (left - (row["full"] or 0.0)) / row["open"]
    return t.select("source", "source_size", "n", F.least(F.col("weight") * level, F.col("cap")).alias("target"))


def _uniform(seed: int, ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64) ^ mix(np.full(1, seed, np.uint64))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def _pair_off(seed: int):
    """Rounds one bucket: rows (bucket, row, size, p) come back with `p` 0 or 1, all but at most one."""
    def each(rows: pd.DataFrame) -> pd.DataFrame:
        size, p = rows["size"].to_numpy(np.float64), rows["p"].to_numpy(np.float64).copy()
        draw = _uniform(seed, rows["draw"].to_numpy(np.int64))
        open_ = -1
        for i in range(len(p)):
            if open_ < 0:
                open_ = i
                continue
            a, b = open_, i
            wa, wb = size[a], size[b]
            up = min((1 - p[a]) * wa, p[b] * wb)      # words that a may gain from b
            down = min(p[a] * wa, (1 - p[b]) * wb)    # words that b may gain from a
            move = up if draw[b] * (up + down) < down else -down
            full_a = move == (1 - p[a]) * wa if move > 0 else -move == p[a] * wa
            if full_a:
                p[b] = min(1.0, max(0.0, p[b] - move / wb))
                p[a] = 1.0 if move > 0 else 0.0
                open_ = b if 0.0 < p[b] < 1.0 else -1
            else:
                p[a] = min(1.0, max(0.0, p[a] + move / wa))
                p[b] = 0.0 if move > 0 else 1.0
                open_ = a if 0.0 < p[a] < 1.0 else -1
        return rows.assign(p=p)
    return each


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17,
                draw_cols: tuple[str, ...] | None = None) -> DataFrame:
    """A row per document: id, `size`, `source_size`, `target` of its source, `copies`, `taken` words. Draws are hashed
    from `draw_cols`, id and text by default."""
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                                   n_words(F.col(text_col)).alias("size"),
                                   F.xxhash64(F.lit(seed), *[F.col(c) for c in draw_cols or (id_col, text_col)]).alias("draw")))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goals = materialize(targets(sources, weights, share, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = (rows.withColumnRenamed("source", "s").join(goals, F.col("s").eqNullSafe(F.col("source")))
              .withColumn("whole", F.floor(rate).cast("int")).withColumn("p", rate - F.floor(rate))
              .withColumn("key", F.xxhash64(F.lit(seed + 1), "source"))
              .withColumn("leaves", F.ceil(F.col("n") / FAN_IN))
              .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 2), "draw"), F.col("leaves"))))
    keep = "id", "size", "source_size", "target", "whole", "p", "draw", "key", "leaves", "bucket"
    wanted = wanted.select(*keep)
    settled = (F.col("p") <= 0) | (F.col("p") >= 1) | (F.col("size") == 0)
    done, open_ = [wanted.filter(settled).withColumn("p", F.when(F.col("p") >= 1, 1.0).otherwise(0.0))], wanted.filter(~settled)
    schema = ("id {}, size long, source_size long, target double, whole int, p double, draw long, key long, leaves long, "
              "bucket long, node long").format(dict(rows.dtypes)["id"])
    widest = goals.agg(F.max(F.ceil(F.col("n") / FAN_IN))).first()[0] or 1
    level = 0
    while True:
        grouped = open_.withColumn("node", F.xxhash64("key", "bucket", F.lit(level)))
        step = materialize(per_group(grouped, "node", _pair_off(seed + level), schema, within=("draw", "id")).drop("node"))
        done.append(step.filter("p <= 0 or p >= 1"))
        open_ = step.filter("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
        if widest <= 1:
            break
        widest, level = -(-widest // FAN_IN), level + 1
    last = (F.pmod(F.xxhash64(F.lit(seed + 3), "draw"), F.lit(1 << 30)) / float(1 << 30)) < F.col("p")
    done.append(open_.withColumn("p", F.when(last, 1.0).otherwise(0.0)))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = out.withColumn("copies", (F.col("whole") + F.col("p")).cast("int"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as many times as it is taken, with all its columns. Rows are known by their number
    in the scan, so that rows which repeat an id are each taken as often as their own rounding says; the
    input must give the same rows in the same order when read again, as files do."""
    names, drawn = docs.columns, (options.pop("id_col", "doc_id"), options.get("text_col", "text"))
    own, n, copy = free_name(docs, "mixed_row"), free_name(docs, "mixed_n"), free_name(docs, "mixed_copy")
    numbered = docs.withColumn(own, F.monotonically_increasing_id())
    copies = mix_sources(numbered, id_col=own, draw_cols=drawn, **options).filter("copies > 0").select(own, F.col("copies").alias(n))
    rows = numbered.join(copies, own)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in names])
