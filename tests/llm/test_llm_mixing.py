"""Targets, rounding and the mix."""

import random

import pytest

from odd_rows import empty_documents, odd_documents, with_clashes
from veilkit.llm import mixing as M


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Deal shares by weight; what is above a cap is dealt again among the rest, until nothing is."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows = []
    for i in range(6000):
        source = rng.choice(["hot"] * 10 + ["a", "b", "c", "d", "é", "Z", None])
        rows.append((i, source, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 5, 20, 80])))))
    return spark.createDataFrame(rows, "doc_id long, source string, text string").cache()


def test_targets_and_taken_words(corpus):
    rows = M.mix_sources(corpus).collect()
    source = {r["doc_id"]: r["source"] for r in corpus.collect()}
    size, words = {}, {r["doc_id"]: len((r["text"] or "").split()) for r in corpus.collect()}
    for i, s in source.items():
        size[s] = size.get(s, 0) + words[i]
    want = plain_targets(size)
    taken, largest = {}, {}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == size[s]
        assert r["target"] == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert r["copies"] in (int(want[s] / size[s]), int(want[s] / size[s]) + 1)
        taken[s] = taken.get(s, 0) + r["taken"]
        largest[s] = max(largest.get(s, 0), r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in want)
    assert len(rows) == corpus.count()


def test_reduction_tree(corpus, monkeypatch):
    """With small buckets the tree has several levels; the sums hold all the same, and expectations do."""
    monkeypatch.setattr(M, "FAN_IN", 8)
    rows = M.mix_sources(corpus).join(corpus.select("doc_id", "source"), "doc_id").collect()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    for group in by.values():
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= max(r["size"] for r in group) + 1e-6
        rate = group[0]["target"] / group[0]["source_size"]
        small = [r for r in group if r["size"] == 5]
        if len(small) > 300:  # no size is favoured
            assert abs(sum(r["copies"] for r in small) / len(small) - rate) < 0.08


def test_reruns_agree(corpus):
    a = M.mix_sources(corpus.repartition(7)).collect()
    b = M.mix_sources(corpus.coalesce(1)).collect()
    assert sorted(a) == sorted(b)


def test_expectation_of_each_document(spark):
    """Over many seeds each document is taken as often as its probability says."""
    docs = spark.createDataFrame([(i, "s", "w " * (i + 1)) for i in range(8)], "doc_id long, source string, text string").cache()
    runs = 60
    total = [0] * 8
    for seed in range(runs):
        for r in M._pair_off(seed)(_bucket(seed)).itertuples():
            total[r.id] += r.p >= 1
    assert all(abs(t / runs - 0.4) < 0.25 for t in total)
    assert docs.count() == 8


def _bucket(seed):
    import numpy as np
    import pandas as pd

    draws = np.random.default_rng(seed).integers(-2**62, 2**62, 8)
    return pd.DataFrame({"id": range(8), "size": range(1, 9), "p": [0.4] * 8, "draw": draws}).sort_values("draw", ignore_index=True)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = M.mix_sources(with_clashes(docs))
    assert got.count() == docs.count()
    assert {r["size"] for r in got.filter("doc_id in (1, 2, 3)").collect()} == {0}
    assert M.mix_sources(empty_documents(spark)).count() == 0
    assert M.mixed_documents(empty_documents(spark)).count() == 0
    mixed = M.mixed_documents(with_clashes(docs))
    assert mixed.columns == with_clashes(docs).columns


def test_rows_that_repeat_an_id_get_their_own_copies(spark):
    """Two texts an id, and two equal rows an id: what is delivered is what was taken."""
    rows = [(i // 2, "a" if i % 3 else "b", "w " * (1 + i % 7 if i < 200 else 4)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken = {(r["target"]): 0 for r in M.mix_sources(docs).collect()}
    for r in M.mix_sources(docs).collect():
        taken[r["target"]] += r["taken"]
    mixed = M.mixed_documents(docs).collect()
    assert sum(len(r["text"].split()) for r in mixed) == sum(taken.values())
    for source, target in (("a", max(taken)), ("b", min(taken))):
        assert abs(sum(len(r["text"].split()) for r in mixed if r["source"] == source) - target) <= 14


def test_mixed_documents_follow_copies(corpus):
    copies = {r["doc_id"]: r["copies"] for r in M.mix_sources(corpus).collect()}
    seen = {}
    for r in M.mixed_documents(corpus).collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {i: n for i, n in copies.items() if n}
