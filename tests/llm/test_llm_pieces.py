"""Streaming search against a full one, and exact round trips."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from odd_rows import empty_documents, odd_documents, with_clashes
from veilkit.llm import pieces as V


@pytest.fixture(scope="module")
def vocabulary():
    return V.Vocabulary.load()


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return V.Encoder(vocabulary)


def full(vocabulary, text, longest=16):
    """The best of all segmentations by a search over the whole text at once."""
    if not text:
        return []
    known = {p: (s, i) for p, s, i in vocabulary.pieces}
    unknown = min(s for s, _ in known.values()) - V.UNKNOWN_PENALTY
    t = V.MARK + text.replace(V.MARK, V.MARK_ITSELF).replace(" ", V.MARK)
    best, back = [0.0], [None]
    for i in range(1, len(t) + 1):
        top, came = -np.inf, None
        for j in range(max(0, i - longest), i):
            hit = known.get(t[j:i])
            if hit and best[j] + hit[0] > top:
                top, came = best[j] + hit[0], (j, [hit[1]])
        if t[i - 1] not in known and best[i - 1] + unknown > top:
            c = V.MARK if t[i - 1] == V.MARK_ITSELF else t[i - 1]
            top, came = best[i - 1] + unknown, (i - 1, [vocabulary.bytes_ids[b] for b in c.encode()])
        best.append(top)
        back.append(came)
    out, i = [], len(t)
    while i:
        i, ids = back[i][0], back[i][1] + out
        out = ids
    return out


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdefghinorst  ▁\n\t.,ßé中😀\r(){}"), max_size=250))
def test_equals_full_search(vocabulary, encoder, text):
    got = ids(encoder, text)
    assert got == full(vocabulary, text)
    assert encoder.decode(np.array(got, dtype=np.int64)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_round_trips(encoder, text):
    assert encoder.decode(np.frombuffer(encoder.encode(text), np.int32)) == text


def test_long_stretches_commit_early(vocabulary, encoder):
    rng = random.Random(4)
    for text in ("a" * 3000, "".join(rng.choice("eraton") for _ in range(5000)), " " * 2000, "(){};" * 700):
        assert ids(encoder, text) == full(vocabulary, text)
    stretch = "".join(rng.choice("eraton") for _ in range(4000))
    first = next(encoder.search(stretch))  # committed long before the end is read
    assert first == next(iter(full(vocabulary, stretch.replace(V.MARK, " "))[1:]), first) or first >= 0


def test_blocks_and_table_bounds(vocabulary, monkeypatch):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(1, 9))) for _ in range(900))
    want = full(vocabulary, text)
    monkeypatch.setattr(V, "BLOCK", 50)
    monkeypatch.setattr(V, "SEEN", 30)
    assert ids(V.Encoder(vocabulary), text) == want


def test_scores_are_those_of_the_model(vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=V.MODEL)
    assert all(sp.id_to_piece(i) == p and sp.get_score(i) == s for p, s, i in vocabulary.pieces[:500])


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    coded = V.encode(docs)
    rows = coded.collect()
    assert len(rows) == docs.count() and all(r["round_trip"] and len(r["ids"]) == r["n_ids"] for r in rows)
    back = V.decode(coded).withColumnRenamed("text", "back").join(docs, "doc_id")
    assert back.filter("back = text").count() == len(rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = V.encode(with_clashes(docs)).collect()
    assert len(rows) == docs.count()
    assert all(r["ids"] is None and r["round_trip"] is None for r in rows if r["doc_id"] == 1)
    assert [r["ids"] for r in rows if r["doc_id"] == 2] == [[]]
    assert all(r["round_trip"] for r in rows if r["n_chars"] is not None)
    assert V.encode(empty_documents(spark)).count() == 0
    assert V.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect() == [(1, None), (2, "")]
