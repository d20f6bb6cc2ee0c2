"""Phrase collocations against counting every phrase in plain Python."""

import re
from collections import Counter

import pytest
from odd_rows import empty_documents, odd_documents, with_clashes
from pyspark.sql import functions as F

from veilkit.llm import phrases as P
from veilkit.llm.phrases import collocations, frequent

LOWER = {c: c + 32 for c in range(65, 91)}


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def plain(rows, least=30, keep=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i:i + k])) for k in range(1, 5) for i in range(len(ws) - k + 1))
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    covered = set()
    for (lang, ws), a in found.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                if 100 * a >= 80 * f[lang, ws[i:i + k]]:
                    covered.add((lang, ws[i:i + k]))
    out = {}
    for (lang, ws), a in found.items():
        if (lang, ws) not in covered:
            score, _, l, r = min((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
            out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, best in out.items()
                  for rank, (s, a, p, l, r) in enumerate(sorted(best)[:keep], 1))


def found(docs, **more):
    return sorted(tuple(r) for r in collocations(docs, **more).collect())


@pytest.mark.parametrize("least", [30, 4])
def test_all_documents(spark, sf, least):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(docs, least=least) == plain([(r.lang, r.text) for r in docs.collect()], least)


def test_counts_of_all_lengths(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counted, totals = frequent(docs, least=3)
    f, n = Counter(), Counter()
    for r in docs.collect():
        for ws in pieces(r.text):
            n[r.lang] += len(ws)
            f.update((r.lang, " ".join(ws[i:i + k]), k) for k in range(1, 5) for i in range(len(ws) - k + 1))
    assert {(r.lang, r.phrase, r["size"]): r.a for r in counted.collect()} == {key: a for key, a in f.items() if a >= 3}
    assert {r.lang: r.n for r in totals.collect()} == n


@pytest.mark.parametrize("parse, longest", [(1, 4096), (2, 3), (10 ** 6, 4), (10 ** 6, 1), (24, 4096)])
def test_any_cuts_count_the_same(spark, monkeypatch, parse, longest):
    monkeypatch.setattr(P, "PARSE", parse)
    monkeypatch.setattr(P, "LONGEST", longest)
    texts = ["New York is big. New\tYork  City is, New York City hall", "a a a a a a a\na a a", "new york city HALL new york city hall", "É é X\x00y z\rq r s t u v w"]
    rows = [("en" if i % 3 else None, texts[i % 4]) for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert found(docs, least=5) == plain(rows, 5)


def test_large_groups(spark):
    """One passage is a third of all rows, one word fills long texts."""
    rows = [("en", "one passage that many rows have in common") if i % 3 == 0 else ("de", "wort " * (i % 40)) for i in range(900)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert found(docs) == plain(rows)


def test_chunks_of_copies_are_equal(spark):
    passage = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([("en", f"start{i} {passage}") for i in range(50)], "lang string, text string")
    chunks = docs.mapInArrow(P._chunks, "lang string, chunk string, own int")
    counts = chunks.groupBy("chunk").count().toPandas()["count"]
    assert chunks.agg(F.sum("own")).first()[0] == 50 * 401
    assert (counts == 50).sum() >= 5 and (counts == 1).sum() <= 100


def test_wrong_bits_and_equal_hashes_change_nothing(spark, sf, monkeypatch):
    """A bitmap of 64 places is full, and hashes of which four values are left are almost all equal."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    want = plain([(r.lang, r.text) for r in docs.collect()], 4)
    monkeypatch.setattr(P, "PLACES", 64)
    assert found(docs, least=4) == want


def test_odd_rows(spark):
    docs = with_clashes(odd_documents(spark).unionByName(odd_documents(spark))).withColumns({"phrase": F.lit(1), "f": F.lit(2), "a": F.lit(1)})
    assert found(docs, least=2) == plain([(r.lang, r.text) for r in docs.collect()], 2)


def test_empty_table_and_few_rows(spark):
    assert collocations(empty_documents(spark)).count() == 0
    assert collocations(odd_documents(spark).filter("doc_id < 4")).count() == 0


def test_keep_is_per_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(docs, least=5, keep=3) == plain([(r.lang, r.text) for r in docs.collect()], 5, 3)
