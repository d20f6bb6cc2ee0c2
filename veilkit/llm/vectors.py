"""Exact top-k by inner product: columnar branch and bound over blocks.

Queries and candidates are dealt into blocks of bounded size, and every pair of a query block and a candidate
block is one group: both sides are copied to the groups that need them, so work and memory of a task do not
depend on the table. In a group candidates lie in vertical layout, a row per dimension. A query adds up its
products dimension block by dimension block; what the remaining dimensions can still add is at most the product
of the remaining norms (Cauchy-Schwarz), so a candidate whose upper bound is below the k-th best lower bound is
out, and the survivors are compacted before the next block. Each group hands on its k best per query, from which
the k best of all are taken.

Components are floor(1024 * x), scores integers, computed exactly; scores beyond 64 bits are held at the bounds
of a long. Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as
filled with zeros, an empty one scores 0. A query is compared with every row but itself: a row that repeats its
id is a candidate. A null id is no query; as a candidate it loses ties. Empty input gives an empty result. Only id
and vector are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilkit.llm.frames import materialize, per_group

SCALE = 1024
CANDIDATE_ROWS, QUERY_ROWS = 4096, 1024
DIMENSIONS = 8
EXACT = float(1 << 53)
LONG = np.iinfo(np.int64)


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows padded with zeros, as floats that hold the integers exactly or, if too large, as Python integers."""
    lists = vectors.tolist()
    width = max(map(len, lists), default=0)
    if all(len(v) == width for v in lists):
        m = np.array(lists, dtype=np.float64).reshape(len(lists), width)
    else:
        m = np.zeros((len(lists), width))
        for i, v in enumerate(lists):
            m[i, : len(v)] = v
    return m


def _rest(m: np.ndarray) -> np.ndarray:
    """Norm of the dimensions from each block's first one on: blocks + 1 rows."""
    squares = np.add.reduceat(m * m, np.arange(0, m.shape[1], DIMENSIONS), axis=1).T
    sums = np.concatenate((squares[::-1].cumsum(axis=0)[::-1], np.zeros((1, len(m)))))
    return np.sqrt(sums) * (1 + 1e-12)


def _group(k: int):
    def each(rows: pd.DataFrame) -> pd.DataFrame | None:
        asked = rows["asked"].to_numpy(bool)
        q, c = rows[asked], rows[~asked]
        if not len(q) or not len(c):
            return None
        both = _matrix(rows["v"])
        if not both.shape[1]:
            both = np.zeros((len(rows), 1))
        energy = np.argsort(-(both * both).sum(axis=0), kind="stable")  # heavy dimensions first
        both = both[:, energy]
        vq, vc = both[asked], both[~asked]
        columns = np.ascontiguousarray(vc.T)
        rest_q, rest_c = _rest(vq), _rest(vc)
        exact = rest_q[0].max() * rest_c[0].max() < EXACT
        ids, nulls, uid = c["id"].to_numpy(np.int64), c["no_id"].to_numpy(bool), c["uid"].to_numpy(np.int64)
        vectors = c["v"].to_numpy()
        out = []
        for i, (query_uid, query_id, own) in enumerate(zip(q["uid"], q["id"], q["v"])):
            alive = np.flatnonzero(uid != query_uid)
            part, bar = np.zeros(len(alive)), -np.inf
            for b, d in enumerate(range(0, vq.shape[1], DIMENSIONS)):
                block = columns[d: d + DIMENSIONS]
                part = part + vq[i, d: d + DIMENSIONS] @ (block if len(alive) == len(uid) else block[:, alive])
                if len(alive) <= k:
                    continue
                open_ = rest_q[b + 1, i] * rest_c[b + 1][alive] + 1e-9 * np.abs(part)
                bar = max(bar, np.partition(part - open_, len(alive) - k)[len(alive) - k])
                keep = part + open_ >= bar
                if keep.sum() < 0.75 * len(alive) or b + 1 == len(rest_q) - 1:
                    alive, part = alive[keep], part[keep]
            if exact:
                scores = part.astype(np.int64)
            else:  # beyond the floats' integers: survivors once more in whole numbers
                scores = np.array([min(LONG.max, max(LONG.min, sum(int(x) * int(y) for x, y in zip(own, vectors[j])))) for j in alive],
                                  dtype=np.int64)
            best = np.lexsort((uid[alive], ids[alive], nulls[alive], -(scores.astype(np.float64) if exact else scores.astype(object))))[:k]
            out += [(query_uid, query_id, uid[j], ids[j], nulls[j], s) for j, s in zip(alive[best], scores[best])]
        return pd.DataFrame(out, columns=["query_uid", "query_id", "uid", "id", "no_id", "score"])
    return each


def valid(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def top_k(vectors: DataFrame, is_query: str, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k largest inner products. `is_query` is an SQL condition on
    `id`, the id column under that name."""
    v = F.col(vector_col).cast("array<double>")
    rows = materialize(vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("x")).filter(valid(F.col("x")))
                       .select("id", F.transform("x", lambda x: F.floor(x * SCALE)).alias("v")))
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), F.coalesce("id", F.lit(0)).alias("id"),
                       F.col("id").isNull().alias("no_id"), "v", F.coalesce(F.expr(is_query), F.lit(False)).alias("query"))
    rows = materialize(rows)
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("query")).first()
    c_blocks, q_blocks = 1 + n // CANDIDATE_ROWS, 1 + asked // QUERY_ROWS
    cell = (F.col("c") * q_blocks + F.col("q")).alias("cell")
    columns = "uid", "id", "no_id", "v"
    own = F.xxhash64("uid")
    candidates = (rows.withColumn("c", F.pmod(own, F.lit(c_blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
                  .select(cell, F.lit(False).alias("asked"), *columns))
    queries = (rows.filter("query").withColumn("q", F.pmod(own, F.lit(q_blocks)))
               .withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))).select(cell, F.lit(True).alias("asked"), *columns))
    found = per_group(candidates.unionByName(queries), "cell", _group(k),
                      "query_uid long, query_id long, uid long, id long, no_id boolean, score long", parts=c_blocks * q_blocks)
    order = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "no_id", "id", "uid")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.when(~F.col("no_id"), F.col("id")).alias(id_col), "score"))
