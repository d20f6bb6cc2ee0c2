"""Ranked lexical search against scoring every document in plain Python."""

import math
import re
from collections import Counter

import pytest
from odd_rows import empty_documents, odd_documents, with_clashes
from pyspark.sql import functions as F

from veilkit.llm import lexical
from veilkit.llm.lexical import rank, term_counts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=20):
    found = [(i, terms(t)) for i, t in docs]
    found = [(i, len(t), Counter(t)) for i, t in found if t]
    n_docs, n_terms = len(found), sum(n for _, n, _ in found)
    df = Counter(t for _, _, c in found for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scores = []
        for i, n, c in found:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def ranked(docs, items, **more):
    return sorted((tuple(r) for r in rank(docs, items, **more).collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")


def test_terms():
    text = "Don't STOPİ cafÉ x 3.14 \U0001f600a\x00b [k] {z} é"
    assert term_counts(text) == Counter(t.encode() for t in terms(text))


def test_terms_in_blocks(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 5)
    text = "Alpha beta, GAMMA-delta alpha  x " * 30
    assert term_counts(text) == Counter(t.encode() for t in terms(text))


@pytest.mark.parametrize("bucket, stretch", [(4096, 8_000_000), (7, 500)])
def test_all_documents(tables, monkeypatch, bucket, stretch):
    monkeypatch.setattr(lexical, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(lexical, "STRETCH_TERMS", stretch)
    docs, items = tables
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert ranked(docs, items) == want
    assert ranked(docs.repartition(13), items) == want


def test_items_in_blocks(tables):
    docs, items = tables
    assert ranked(docs, items, item_terms=40, k=3) == ranked(docs, items, k=3)


def test_ties_and_large_groups(spark):
    """A third of the rows are one text: equal scores, by id."""
    rows = [(i, "the same words again") if i % 3 == 0 else (i, f"the word{i % 50} again and word{i % 7}") for i in range(600)]
    items = [(1, "same words"), (2, "again the word3 word3"), (3, "nowhere"), (4, None), (1, "word1 same")]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranked(docs, asked) == plain(rows, items)


def test_odd_rows(spark):
    docs = with_clashes(odd_documents(spark), "n")
    items = [(1, "word1x1 word976x2929 end"), (None, "id at all"), (2, ""), (3, "one three two two")]
    asked = with_clashes(spark.createDataFrame(items, "item_id long, text string")).withColumns({"item_number": F.lit(1), "rank": F.lit(2)})
    assert ranked(docs, asked) == plain([(r.doc_id, r.text) for r in docs.collect()], items)


def test_empty_tables(spark, tables):
    docs, items = tables
    assert rank(empty_documents(spark), items).count() == 0
    assert rank(docs, items.limit(0)).count() == 0


def test_buckets_and_rows_are_left_out(spark, tables):
    """Bars keep most rows from being scored in full."""
    import numpy as np

    rng = np.random.default_rng(3)
    sizes = np.full(500, 20)
    ids = np.concatenate([np.sort(rng.choice(200, 20, replace=False)) for _ in range(500)]).astype(np.int32)
    impacts = rng.integers(1, 1000, len(ids))
    norms = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, np.arange(0, len(ids), 20)))
    bucket = lexical._Bucket(norms, sizes, ids, impacts)
    wanted = np.zeros(200, np.int64)
    asked, counts = np.array([3, 50, 120, 199]), np.array([1, 2, 1, 1])
    wanted[asked] = counts
    full = np.array([(wanted[ids[i * 20:(i + 1) * 20]] * impacts[i * 20:(i + 1) * 20]).sum() for i in range(500)])
    for bar in (0, 500, 1500, 2500, 10_000):
        rows, scores = bucket.above(asked, counts, wanted, bar)
        assert rows.tolist() == np.flatnonzero(full >= max(bar, 1)).tolist()
        assert scores.tolist() == full[rows].tolist()
