"""Byte-level BPE against the rule itself, the public library, round trips and odd rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import empty_documents, odd_documents, with_clashes
from pyspark.sql import functions as F

from veilkit.llm import byte_pairs as B
from veilkit.llm.registry import QUERIES

VOCABULARY = B.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(VOCABULARY.tokens), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return B.ready(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


@settings(max_examples=300, deadline=None)
@given(raw=st.one_of(st.binary(max_size=40), st.text("abeht né中", max_size=40).map(str.encode)))
def test_prefixes_are_what_merging_leaves(raw):
    e = B.ready(VOCABULARY)
    prefixes = B.Prefixes(e, raw)
    for end in range(len(raw) + 1):
        assert [e.decoded[i] for i in prefixes.ids(end)] == (e.merged(raw[:end]) if end else [])


def test_neighbours(encoder):
    draw, ids = random.Random(5), list(encoder.halves)
    for _ in range(20_000):
        a, b = draw.choice(ids), draw.choice(ids)
        x, y = encoder.decoded[a], encoder.decoded[b]
        assert encoder.beside(a, b) == (encoder.merged(x + y) == [x, y])


def test_append_and_replace(encoder):
    draw = random.Random(6)
    for _ in range(500):
        raw = bytes(draw.choice(b"the aning\xc3\xa9\xe4") for _ in range(draw.randint(0, 80)))
        cut, new = draw.randint(0, len(raw)), bytes(draw.choice(b"ab the") for _ in range(draw.randint(0, 6)))
        grown = B.Prefixes(encoder, raw[:cut])
        grown.append(raw[cut:])
        assert grown.last == B.Prefixes(encoder, raw).last
        lo = draw.randint(0, len(raw))
        hi = draw.randint(lo, len(raw))
        grown.replace(lo, hi, new)
        assert grown.last == B.Prefixes(encoder, raw[:lo] + new + raw[hi:]).last


def test_replace_seeks_near_the_edit_only(encoder):
    raw = b"internationalisation" * 500
    prefixes = B.Prefixes(encoder, raw)
    assert prefixes.replace(5000, 5001, b"x") < 20 * encoder.longest
    assert prefixes.last == B.Prefixes(encoder, raw[:5000] + b"x" + raw[5001:]).last


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_texts_as_the_library(text):
    e = B.ready(VOCABULARY)
    ids = np.frombuffer(e.encode(text), np.int32).tolist()
    assert ids == LIBRARY.encode_ordinary(text)
    assert e.decode(ids) == text.encode()


def test_documents_as_the_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = QUERIES["op13_byte_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_odd_rows(spark, library):
    docs = with_clashes(odd_documents(spark)).withColumns({"n_tokens": F.lit(1), "ids": F.lit(1), "decoded": F.lit(1)})
    rows = B.encode(docs, VOCABULARY)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    want = [(str(r.doc_id), None if r.text is None else len(library.encode_ordinary(r.text)), None if r.text is None else r.text.encode()) for r in docs.collect()]
    got = [(str(r.doc_id), r.n_tokens, None if r.decoded is None else bytes(r.decoded)) for r in rows.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = B.decode(rows.select("doc_id", "ids"), VOCABULARY).collect()
    assert sorted((str(r.doc_id), None if r.decoded is None else bytes(r.decoded)) for r in back if r.decoded is not None) == sorted(
        (a, c) for a, _, c in want if c is not None)
    assert [r for r in B.digests(rows).collect() if r.n_tokens is None or r.ids_sha256 is None or r.decoded_sha256 is None] == []


def test_blocks_change_nothing(encoder, library, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 7)
    text = "one  two\n three   'll x's\t\t four é中文 12 345 " * 20 + "x" * 100
    assert np.frombuffer(encoder.encode(text), np.int32).tolist() == library.encode_ordinary(text)


def test_empty_table(spark):
    rows = B.encode(empty_documents(spark), VOCABULARY)
    assert rows.count() == 0 and B.decode(rows, VOCABULARY).count() == 0 and B.digests(rows).count() == 0


def test_edits_and_appends(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.join(B.encode(docs, VOCABULARY).select("doc_id", "ids"), "doc_id")
    edits = {"append": (F.length("text"), F.lit(0), F.lit(" and more's")), "cut": (F.length("text") / 2, F.lit(37), F.lit("")),
             "insert": (F.pmod("doc_id", F.greatest(F.length("text"), F.lit(1))), F.lit(0), F.lit("\n x ")), "nulls": (F.lit(None), F.lit(None), F.lit(None)),
             "start": (F.lit(0), F.lit(1), F.lit("A")), "outside": (F.lit(-5), F.lit(1 << 40), F.lit("all new"))}
    for name, (at, gone, new) in edits.items():
        got = {r.doc_id: r.ids for r in B.edited(rows, VOCABULARY, at, gone, new).collect()}
        for r in rows.withColumns({"at": at.cast("long"), "gone": gone.cast("long"), "new": new}).collect():
            place = len(r.text) if r.at is None else min(max(r.at, 0), len(r.text))
            after = r.text[:place] + (r.new or "") + r.text[place + (r.gone or 0):]
            assert got[r.doc_id] == library.encode_ordinary(after), (name, r.doc_id)
    nothing = B.edited(rows.withColumn("ids", F.lit(None).cast("array<int>")), VOCABULARY, F.lit(0), F.lit(0), F.lit(""))
    assert nothing.filter("ids is not null").count() == 0


def test_vocabulary_needs_all_bytes(tmp_path):
    (tmp_path / "few").write_text("YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError):
        B.Vocabulary.load(str(tmp_path / "few"), public_tokenizers.PATTERN)
