"""Hashes and graph helpers of the training-text operators."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilkit.llm import hashing
from veilkit.llm.frames import components, free_name, per_group
from veilkit.llm.mixing import ranked


def plain(texts):
    return [(t or "").encode().split() for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b é😀", max_size=30)), max_size=8))
def test_words_are_those_of_the_bytes(texts):
    raw, offsets = hashing.text_bytes(pa.array(texts, pa.string()))
    starts, ends, hashes, first = hashing.words(raw, offsets)
    got = [[raw[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert got == plain(texts)
    by_word = {}
    for words, a, b in zip(got, first[:-1], first[1:]):
        for w, h in zip(words, hashes[a:b].tolist()):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_segments_do_not_change_words(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc \n") for _ in range(rng.randrange(400))) for _ in range(30)] + ["x" * 300, "", None]
    column = pa.array(texts)
    whole = hashing.words(*hashing.text_bytes(column))
    monkeypatch.setattr(hashing, "_SEGMENT", 37)
    for a, b in zip(whole, hashing.words(*hashing.text_bytes(column))):
        assert (a == b).all()


def test_slices_of_a_column():
    column = pa.array(["one two", None, "three", "four five six"])
    assert len(hashing.words(*hashing.text_bytes(column.slice(2, 2)))[0]) == 4


def test_windows():
    h = np.arange(10, dtype=np.uint64)
    assert len(hashing.windows(h, 11)) == 0
    assert len(set(hashing.windows(h, 3).tolist())) == 8
    again = np.concatenate((h, h))
    assert hashing.windows(again, 4)[0] == hashing.windows(again, 4)[10]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {(x, find(x)) for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_per_group_sees_whole_groups(spark):
    rows = spark.range(5000).select((F.col("id") % 37).alias("k"), "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = per_group(rows, "k", lambda g: g.groupby("k", as_index=False).agg(n=("id", "size"), s=("id", "sum")), "k long, n long, s long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 37
    assert all(r["n"] == len(range(r["k"], 5000, 37)) and r["s"] == sum(range(r["k"], 5000, 37)) for r in got)


def test_ranked(spark):
    names = [f"s{i}" for i in range(50)] + [None]
    got = {r["s"]: r["rank"] for r in ranked(spark.createDataFrame([(x,) for x in names], "s string"), "s").collect()}
    assert got == {x: i for i, x in enumerate([*sorted(n for n in names if n), None])}


def test_free_name(spark):
    assert free_name(spark.range(1).select(F.col("id").alias("Kept"), F.col("id").alias("kept_")), "kept") == "kept__"


