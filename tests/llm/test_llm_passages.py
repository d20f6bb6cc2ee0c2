"""Passage removal against brute force."""

import hashlib
import random

import pytest

from odd_rows import empty_documents, odd_documents, with_clashes
from veilkit.llm import passages as P


def brute(rows, size=20):
    """Rows (id, text): repeated rows count once."""
    order = sorted({(i is None, i or 0, 0, t) for i, t in rows}, key=lambda r: r[:2])
    first, result = set(), {}
    for none, i, _, text in order:
        w = (text or "").encode().split()
        gone = set()
        for p in range(len(w) - size + 1):
            run = tuple(w[p: p + size])
            if run in first:
                gone.update(range(p, p + size))
            first.add(run)
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        result[none, i, text] = (None if none else i, len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return sorted((result[i is None, i or 0, t] for i, t in rows), key=str)


def found(df):
    rows = df.collect()
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in rows)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    passages = [[f"p{k}_{j}" for j in range(rng.choice([19, 20, 21, 35, 60]))] for k in range(8)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 30))]
            words += rng.choice(passages)
        words += ["the"] * rng.choice([0, 0, 25, 70])  # overlaps itself
        rows.append((i * 3, " ".join(words) + rng.choice(["", "\n", "  "])))
    rows.append((1, "a b " * 40))
    rng.shuffle(rows)
    return rows


def test_generated_passages(spark, corpus):
    assert found(P.remove_repeats(spark.createDataFrame(corpus, "doc_id long, text string"))) == brute(corpus)


def test_many_ranges_and_stretches(spark, corpus, monkeypatch):
    """The same with small hash ranges."""
    monkeypatch.setattr(P, "RANGE_BYTES", 20_000)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    assert found(P.remove_repeats(docs)) == brute(corpus)


def test_other_window(spark, corpus):
    assert found(P.remove_repeats(spark.createDataFrame(corpus[:60], "doc_id long, text string"), window=8)) == brute(corpus[:60], 8)
    with pytest.raises(ValueError):
        P.remove_repeats(spark.createDataFrame(corpus[:1], "doc_id long, text string"), window=7)


def test_documents_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(P.remove_repeats(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = found(P.remove_repeats(with_clashes(docs)))
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert P.remove_repeats(empty_documents(spark)).count() == 0


def test_copies_go_whole(spark):
    text = " ".join(f"w{i}" for i in range(200))
    got = found(P.remove_repeats(spark.createDataFrame([(i, text) for i in range(9)], "doc_id long, text string")))
    assert [r[2] for r in got] == [0] + [200] * 8
