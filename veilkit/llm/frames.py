"""Helpers shared by the operators: tables, group-wise passes, connected components, ranks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilkit.session import checkpoint_dir, materialize

__all__ = ["checkpoint_dir", "materialize", "stored", "table", "by_bytes", "free_name", "n_words", "per_group", "components"]

WORD = r"[^\x20\x09-\x0D]+"
EDGES_PER_FILE = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The table written as Parquet in the shared checkpoint folder and read again."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"stored-{spark._jvm.java.util.UUID.randomUUID()}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts take `limit` bytes at most, or one row."""
    for batch in batches:
        sizes = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        ends = np.cumsum(pa.compute.binary_length(sizes).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def per_group(df: DataFrame, key: str, each: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str,
              within: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Run `each` on the rows of every key, one key after the other in a stream, so very many small groups
    cost no call into Spark each. A group is held in memory whole: callers bound its size."""
    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[key].to_numpy()
            cuts = [0, *((keys[1:] != keys[:-1]).nonzero()[0] + 1).tolist(), len(batch)]
            out = []
            for lo, hi in zip(cuts, cuts[1:]):
                if held and (lo > 0 or held[0][key].iloc[0] != keys[0]):
                    out.append(each(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]))
                    held = []
                held.append(batch.iloc[lo:hi].reset_index(drop=True))
            out = [x for x in out if x is not None and len(x)]
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            last = each(pd.concat(held, ignore_index=True))
            if last is not None and len(last):
                yield last

    dealt = df.repartition(parts, key) if parts else df.repartition(key)
    return dealt.sortWithinPartitions(key, *within).mapInPandas(stream, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph of longs as (node, component): the smallest node reached.

    Alternating star contraction: every round links larger neighbours, then smaller ones, to the smallest
    known neighbour, until all edges point at a root. Only slim edges move; each round is cut by a
    checkpoint, and only counts come to the driver. Nodes without an edge to another node are left out.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    n = e.count()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        e = materialize(small.coalesce(1 + n // EDGES_PER_FILE))
        # done when every node has one parent and no parent has one itself
        seen = (e.select("u", F.lit(1).alias("up"), F.lit(0).alias("down"))
                .unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
        nodes = seen.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        unsettled, n = nodes.agg(F.count_if(F.expr("up + down > 1")), F.coalesce(F.sum("up"), F.lit(0))).first()
        if not unsettled:
            break
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
