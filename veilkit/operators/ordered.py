"""Order-dependent state that survives hot keys.

A plain window over a key puts every row of that key into one task. Here each key's order axis is cut
into buckets: windows run inside (key, bucket), and only one summary row per bucket goes through the
window over the whole key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilkit.session import materialize


def lead_struct(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, columns: Sequence[str],
                into: str) -> DataFrame:
    """The next row's `columns` (a struct, NULL on the last row of a key)."""
    rows = df.withColumn("_bucket", bucket).withColumn("_self", F.struct(*columns))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = rows.withColumn(into, F.lead("_self").over(inside)).withColumn("_n", F.row_number().over(inside))
    heads = rows.filter("_n = 1").select(*keys, "_bucket", "_self")
    following = heads.select(*keys, "_bucket",
                             F.lead("_self").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_upcoming"))
    return (rows.join(following, [*keys, "_bucket"], "left")
            .withColumn(into, F.coalesce(into, "_upcoming")).drop("_bucket", "_self", "_n", "_upcoming"))


def range_buckets(df: DataFrame, order: Sequence[str], into: str, ranges: int | None = None) -> DataFrame:
    """Adds `into`, a number that rises with the order of any sortable columns and has about as many rows for every
    value: the range partition a row falls in, written down so that it stays."""
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return materialize(dealt.withColumn(into, F.spark_partition_id()))


def numbered(df: DataFrame, order: Sequence[str], into: str, ranges: int | None = None) -> DataFrame:
    """Adds `into`, the row's place in the order from 0 on, over the whole table: rows are sorted in range partitions,
    written down, and shifted by the sizes of the partitions before (one number a partition)."""
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    rows = materialize(dealt.sortWithinPartitions(*order)).withColumns({"_part": F.spark_partition_id(), into: F.monotonically_increasing_id()})
    before, shift = 0, {}
    for part, n in sorted(rows.groupBy("_part").count().collect()):
        shift[part], before = before - (part << 33), before + n
    start = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in shift.items() for x in pair]), F.col("_part").cast("bigint")) if shift else F.lit(0)
    return rows.withColumn(into, F.col(into) + start).drop("_part")


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                   sums: Mapping[str, Column], *, inclusive: bool = True) -> DataFrame:
    """Running sum of each expression within a key. Exclusive sums leave the current row out."""
    names = list(sums)
    rows = df.withColumn("_bucket", bucket)
    for name in names:
        rows = rows.withColumn(f"_v_{name}", sums[name])
    totals = rows.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_bucket", *[F.sum(f"_t_{n}").over(before).alias(f"_s_{n}") for n in names])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    zero = F.lit(0)
    out = rows
    for name in names:
        out = out.withColumn(f"_w_{name}", F.sum(f"_v_{name}").over(inside))
    out = out.join(starts, [*keys, "_bucket"], "left")
    for name in names:
        out = out.withColumn(name, F.coalesce(f"_s_{name}", zero) + F.coalesce(f"_w_{name}", zero))
    return out.drop("_bucket", *[f"_{p}_{n}" for p in "vsw" for n in names])


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, into: str) -> DataFrame:
    """row_number() within a key."""
    numbered = running_totals(df, keys, order, bucket, {into: F.lit(1).cast("bigint")})
    return numbered


def grouped(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """A fold over sorted groups, for very many small ones: partitions stream through Arrow batches and
    each batch's groups are folded together, instead of one Python call per group. `fold` gets a group in
    order and returns columns; the keys (that are not among them) come first in `schema`."""
    keys, order = list(keys), list(order)

    def finished(frame: pd.DataFrame) -> pd.DataFrame:
        cuts = [0, *(i for i in range(1, len(frame)) if change[i]), len(frame)] if (change := _changes(frame, keys)) else []
        out: dict[str, list] = {}
        for a, b in zip(cuts, cuts[1:]):
            columns = fold(frame.iloc[a:b])
            size = len(next(iter(columns.values())))
            for k in keys:
                if k not in columns:
                    out.setdefault(k, []).extend([frame[k].iat[a]] * size)
            for name, values in columns.items():
                out.setdefault(name, []).extend(values)
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(frame):
                continue
            change = _changes(frame, keys)
            last = max((i for i in range(1, len(frame)) if change[i]), default=0)
            held = frame.iloc[last:]
            if last:
                yield finished(frame.iloc[:last].reset_index(drop=True))
        if held is not None and len(held):
            yield finished(held.reset_index(drop=True))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _changes(frame: pd.DataFrame, keys: Sequence[str]) -> list[bool]:
    """True where a row starts a new group."""
    differs = pd.Series(False, index=frame.index)
    for k in keys:
        differs |= frame[k] != frame[k].shift()
    return differs.tolist()
