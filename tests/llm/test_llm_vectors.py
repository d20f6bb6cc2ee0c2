"""Exact top-k against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilkit.llm import vectors as X

SCHEMA = "vec_id long, embedding array<float>, label int"
ASKED = "id % 100 = 0"


def brute(rows, k=10):
    """Rows (vec_id, vector); every query row against all other rows."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, v)), j is None, j or 0) for b, (j, v) in enumerate(kept) if a != b))[:k]
        out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(scored, 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def given(df):
    return [(r["vec_id"], r["embedding"]) for r in df.collect()]


@pytest.mark.parametrize("rows, queries", [(4096, 1024), (60, 2)])
def test_embeddings_table(spark, sf, monkeypatch, rows, queries):
    monkeypatch.setattr(X, "CANDIDATE_ROWS", rows)
    monkeypatch.setattr(X, "QUERY_ROWS", queries)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert found(X.top_k(table, ASKED)) == brute(given(table))


def test_ties_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(X, "CANDIDATE_ROWS", 64)
    rng = np.random.default_rng(3)
    few = rng.normal(size=(5, 19)).astype(float).tolist()
    table = spark.createDataFrame([(i, few[i % 5 if i % 3 else 0], 0) for i in range(600)], SCHEMA)
    assert found(X.top_k(table, ASKED, k=7)) == brute(given(table), 7)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0, -0.5], 1), (100, None, 1), (200, [nan, 1.0], 1), (300, [None, 1.0], 1), (400, [], 1), (1, [inf], 1), (2, [-0.0001], 1),
            (0, [1.0, 2.0, -0.5], 1), (None, [9.0, 9.0], 1), (None, [9.0, 9.0], 1), (500, [0.5] * 40, 1), (3, [1e7, -1e7], 1), (-100, [3.0], 1)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "v", "uid", "c", "q", "cell", "rank", "score")})
    got = found(X.top_k(table, ASKED))
    assert got == brute(given(table))
    assert X.top_k(spark.createDataFrame([], SCHEMA), ASKED).count() == 0
    assert X.top_k(spark.createDataFrame([(100, [1.0], 0)], SCHEMA), ASKED).count() == 0


def test_beyond_the_floats(spark):
    rows = [(100, [1e13, 1.0, 3.0], 0), (1, [1e-3, 2.0, 1.0], 0), (2, [1e13, 1.0, 1.0], 0), (3, [-1e13, 0.0, 0.0], 0), (4, [1e5, 1.0, 1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = [(i, r, j, min(2**63 - 1, max(-2**63, s))) for i, r, j, s in brute(given(table))]
    assert found(X.top_k(table, ASKED)) == sorted(want, key=str)


def test_candidates_are_compacted():
    """The bounds drop candidates before the last block and never a result."""
    import pandas as pd

    rng = np.random.default_rng(1)
    vectors = [[math.floor(1024 * x) for x in row * np.linspace(3, 0.1, 64)] for row in rng.normal(size=(900, 64))]
    rows = pd.DataFrame({"cell": 0, "asked": [True] * 10 + [False] * 890, "uid": range(900), "id": range(900), "no_id": False, "v": vectors})
    got = X._group(5)(rows)
    m = np.array(vectors, dtype=np.int64)
    for q in range(10):
        scores = m[10:] @ m[q]
        best = np.lexsort((np.arange(890), -scores))[:5]
        own = got[got["query_id"] == q]
        assert own["id"].tolist() == (best + 10).tolist() and own["score"].tolist() == scores[best].tolist()
