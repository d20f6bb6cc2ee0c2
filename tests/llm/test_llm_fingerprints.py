"""I-Match fingerprints."""

import hashlib
import random
import re

import pytest

from odd_rows import empty_documents, odd_documents, with_clashes
from veilkit.llm import fingerprints as I


def edited_text(rows):
    """{id: (n_chars, edited text, next id)} of rows with distinct ids, None last."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for at, (i, text) in enumerate(order):
        nxt = order[(at + 1) % len(order)]
        half = len(text) // 2
        out[i] = len(text), text[: len(text) - half] + nxt[1][:half], nxt[0]
    return out


def check(rows, got):
    want = edited_text(rows)
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert len(got) == len(rows)
    for r in got:
        n, text, nxt = want[r["doc_id"]]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        parts = [list(zip(a.split("-"), b.split("-"))) for a, b in ((r["fingerprint"], r["edited_fingerprint"]), (r["fingerprint"], prints[nxt]))]
        for likeness, pairs in zip((r["near_edited"], r["near_next"]), parts):
            n = len(I.DENSITY)
            if not all(any(pair[side] != "0" * 16 for pair in pairs[n:2 * n]) for side in (0, 1)):
                pairs = pairs[:n] + pairs[2 * n:]
            used = [a == b for a, b in pairs if {a, b} != {"0" * 16}]
            assert likeness == pytest.approx(sum(used) / len(used) if used else 1.0)
    texts = dict(rows)
    by = {}
    for i, p in prints.items():
        by.setdefault(texts[i], set()).add(p)
    assert all(len(p) == 1 for p in by.values())


@pytest.mark.parametrize("bucket", [1024, 40])
def test_documents_table(spark, sf, monkeypatch, bucket):
    monkeypatch.setattr(I, "BUCKET_ROWS", bucket)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check([(r["doc_id"], r["text"]) for r in docs.collect()], I.fingerprints(docs).collect())


def test_lexicon_and_parts_against_plain_python(spark, sf):
    """Two texts agree in a part exactly if their lexicon terms of that sub-lexicon agree."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120).cache()
    rows = docs.collect()
    terms = {r["doc_id"]: {t for t in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r["text"].lower()) if t} for r in rows}
    df = {}
    for s in terms.values():
        for t in s:
            df[t] = df.get(t, 0) + 1
    band = {t for t, n in df.items() if max(2, 0.02 * 120) <= n <= 0.2 * 120}
    got = I.fingerprints(docs, least=0.02, most=0.2, density=(1,)).collect()
    by = {}
    for r in got:
        by.setdefault(r["fingerprint"].split("-")[0], set()).add(frozenset(terms[r["doc_id"]] & band))
    assert all(len(s) == 1 for s in by.values())
    assert len(by) == len({frozenset(s & band) for s in terms.values()})


def test_small_edits_stay_near(spark):
    rng = random.Random(6)
    vocabulary = [f"term{i}" for i in range(400)]
    rows = []
    for i in range(0, 300, 2):
        words = [rng.choice(vocabulary) for _ in range(60)]
        rows.append((i, " ".join(words)))
        words[5] = "changed"
        rows.append((i + 1, " ".join(words)))
    got = I.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), least=0.01, most=0.5).collect()
    near = {r["doc_id"]: r["near_next"] for r in got}
    like = [near[i] for i in range(1, 300, 2)]     # 1 is followed by 0
    unlike = [near[i] for i in range(2, 300, 2)]
    assert sum(like) / len(like) > 0.6 > 0.2 > sum(unlike) / len(unlike)


def test_near_copies_that_are_a_third_of_all_texts(spark):
    """Their own terms are above the production band, the words that differ below it."""
    rng = random.Random(8)
    shared = [f"family{i}" for i in range(80)]
    rows = []
    for i in range(1500):
        if i < 500:
            words = list(shared)
            words[rng.randrange(80)] = f"own{i}"
        else:
            words = [f"term{rng.randrange(4000)}" for _ in range(60)]
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["near_next"] for r in I.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    family, others = [got[i] for i in range(1, 500)], [got[i] for i in range(501, 1500)]
    assert sum(family) / len(family) > 0.6 > 0.2 > sum(others) / len(others)


def test_likeness_over_the_line_of_few_terms(spark):
    """Pairs one lexicon term apart are as alike on both sides of the line as across it."""
    rows, names = [], {}
    for n in range(4, 13):
        for pair in range(12):
            words = [f"t{(pair * 31 + i * 7) % 90}" for i in range(n)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:-1]))]
            names[len(rows) - 1] = n
    rows += [(10_000 + i, " ".join(f"fill{i}x{j}" for j in range(5))) for i in range(400)]
    got = {r["doc_id"]: r["near_next"] for r in I.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    mean = {n: sum(got[i] for i, m in names.items() if m == n) / 12 for n in range(4, 13)}
    assert len({n for n in mean if n - 1 < I.FEW_TERMS <= n}) == 1
    assert mean[I.FEW_TERMS] > 0.65 and mean[I.FEW_TERMS] > min(mean[n] for n in (5, 6, 7)) - 0.1


def test_odd_rows(spark):
    docs = odd_documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    check(rows, I.fingerprints(with_clashes(docs)).collect())
    everything = I.fingerprints(odd_documents(spark)).collect()  # null and repeated ids
    assert len(everything) == odd_documents(spark).count()
    assert I.fingerprints(empty_documents(spark)).count() == 0
    alone = I.fingerprints(spark.createDataFrame([(3, "only one")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"onlyonly").hexdigest()


def test_sparse_ids_and_native_plan(spark):
    rows = [(i ** 5 * 7919, f"text {i} " + "alpha beta " * (i % 5)) for i in range(1, 200)]
    got = I.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    check(rows, got.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
