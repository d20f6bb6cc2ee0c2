"""Near-duplicates against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from odd_rows import empty_documents, odd_documents, with_clashes
from veilkit.llm import near_dups as N


def brute(rows, percent=85):
    """(id, n_shingles, component) per row; copies by set are compared once."""
    sets, up, by_set = [], {}, {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)

    for i, text in rows:
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
        s = frozenset([tuple(w)] if 0 < len(w) < 5 else zip(*[w[j:] for j in range(5)])) if w else frozenset()
        sets.append((i, s))
        if i is not None:
            up.setdefault(i, i)
            if s:
                join(i, by_set.setdefault(s, i))
    distinct = list(by_set.items())
    for x, (s, i) in enumerate(distinct):
        for t, j in distinct[x + 1:]:
            if 100 * len(s & t) >= percent * len(s | t):
                join(i, j)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def found(df):
    rows = df.collect()
    assert all(r["kept"] == (None if r["doc_id"] is None else r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str)


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows = []
    for g in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            rows.append(edited(rng, words, rng.choice([0, 0, 1, 2, 4, 8])))
    rng.shuffle(rows)
    return list(enumerate(rows, 5))


def test_generated_groups(spark, corpus):
    assert found(N.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string"))) == brute(corpus)


def test_documents_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(N.near_duplicates(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_large_group_in_blocks(spark, monkeypatch):
    """A chain of edits longer than a block: neighbours are linked, the ends are far apart."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    rng = random.Random(2)
    words, rows = [f"c{i}" for i in range(200)], []
    for i in range(120):
        rows.append((1000 - i, " ".join(words)))
        for _ in range(2):
            words[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
    rows += [(2000 + i, edited(rng, [f"d{j}" for j in range(150)], 12)) for i in range(60)]  # about 0.3: no links
    got = found(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = found(N.near_duplicates(with_clashes(docs)))
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert (6, 1, 5) in got and (8, 29_997, 7) in got and (2, 0, 2) in got
    assert N.near_duplicates(empty_documents(spark)).count() == 0


def test_one_of_each_stays_with_all_columns(spark):
    docs = with_clashes(odd_documents(spark))
    kept = N.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 7, 9, 10]
    assert kept.filter("doc_id is null").count() == 2


def test_different_texts_of_one_id_are_no_copies(spark):
    """Ids 1, 1, 2, 3, 4 with texts A, B, B, C, A: one each of A, B and C stays, the same one whatever the order."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "x"), (1, b, "y"), (2, b, "z"), (3, c, "x"), (4, a, "y"), (5, None, "x"), (5, "", "x"), (6, c, "q"), (6, c, "p"), (6, c, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    kept = sorted(map(tuple, N.first_of_each(docs).collect()), key=str)
    assert sorted(str(t) for _, t, _ in kept) == sorted(map(str, (a, b, c, None, "")))
    assert kept == sorted(map(tuple, N.first_of_each(docs.repartition(7)).collect()), key=str)
    same = spark.createDataFrame([(7, c, str(i)) for i in range(9)], docs.schema)
    assert N.first_of_each(same).collect() == N.first_of_each(same.repartition(3)).collect()


def test_pigeonhole_guarantee():
    """Signatures within the distance share a key, wherever they differ."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 16, N.CHUNKS * N.WIDTH).astype(np.uint16)
    most = N.CHUNKS * (N.ERRORS + 1) - 1
    own = set(N._keys(base[None], N.CHUNKS, N.WIDTH, N.ERRORS)[0].tolist())
    for _ in range(300):
        other = base.copy()
        other[rng.choice(len(base), most, replace=False)] ^= 1
        assert own & set(N._keys(other[None], N.CHUNKS, N.WIDTH, N.ERRORS)[0].tolist())


def test_signatures_estimate_similarity():
    text = pa.array([" ".join(f"w{i}" for i in range(500)), " ".join(f"w{i}" for i in range(25, 525))])
    sets = list(N.shingle_sets(text))
    seeds = np.random.default_rng(7).integers(1, 1 << 62, 2000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    a, b = N._signatures(sets, seeds)
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    assert abs((a == b).mean() - true) < 0.03
