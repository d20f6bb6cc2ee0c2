"""Importance resampling: held-out accuracy, the sample's odds, exact selection."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from odd_rows import empty_documents, odd_documents, with_clashes
from veilkit.llm import quality as Q

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=1500, seed=3):
    rng = random.Random(seed)
    good = [f"prose{i}" for i in range(400)]
    junk = [f"{a}$$$" for a in good[:150]] + ["buy", "now", "!!!"] * 20
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        rows.append((i, " ".join(rng.choices(junk if bad else good, k=rng.choice([30, 60, 200])))))
        if rng.random() < 0.4:
            labels.append((i, int(not bad), 0))
    truth = {i: "$$$" not in t and "buy" not in t for i, t in rows}
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS), truth


def test_unlabelled_documents_are_judged_right(spark):
    docs, labels, truth = corpus(spark)
    known = {r["doc_id"] for r in labels.collect()}
    rest = [(r["kept"], truth[r["doc_id"]]) for r in Q.weigh(docs, labels).collect() if r["doc_id"] not in known]
    assert sum(k for k, good in rest if good) / sum(good for _, good in rest) > 0.99
    assert sum(k for k, good in rest if not good) / sum(not good for _, good in rest) < 0.02


def test_documents_table(spark, sf):
    """Labels of a third of the documents; the others' labels tell the held-out accuracy."""
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = Q.weigh(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.4


def test_clean_text_of_new_words_stays(spark):
    """Words that no label and hardly any document shows are no evidence."""
    docs, labels, _ = corpus(spark)
    new = spark.createDataFrame([(90_000 + i, " ".join(f"unseen{i}x{j}" for j in range(80))) for i in range(5)], "doc_id long, text string")
    got = Q.weigh(docs.unionByName(new), labels).filter("doc_id >= 90000").collect()
    assert len(got) == 5 and all(r["kept"] for r in got)


def test_weights_against_plain_sums(spark):
    """log weights from counts made with a dictionary."""
    docs, labels, _ = corpus(spark, 200)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(30), "doc_id"), F.lit(Q.FOLDS)).alias("f")).collect()}
    grams = {}
    for i, t in texts.items():
        g, _ = Q.ngrams(pa.array([t]))
        grams[i] = g[g >= 0]
        assert len(grams[i]) == 2 * len(t.split()) - 1
    raw = np.bincount(np.concatenate(list(grams.values())), minlength=Q.BUCKETS)
    share = (raw + 1) / (raw.sum() + Q.BUCKETS)
    for r in Q.weigh(docs, labels).collect()[:40]:
        mine = np.bincount(np.concatenate([grams[i] for i in good if fold[i] != fold[r["doc_id"]]]), minlength=Q.BUCKETS)
        ratio = np.log((mine + Q.PSEUDO) / (mine.sum() * share + Q.PSEUDO))
        assert r["log_weight"] == pytest.approx(ratio[grams[r["doc_id"]]].sum(), abs=1e-6)
        assert r["n_grams"] == len(grams[r["doc_id"]])


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) for _ in range(500)] + [0.5] * 50 + [-1e9, 1e9]
    keys = spark.createDataFrame([(v,) for v in values], "key double").cache()
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 40, 200, 300, 551, 552):
        assert Q.kth_largest(keys, k) == ranked[k - 1]


def test_noise_is_gumbel(spark):
    """Keys of equal weights differ by standard Gumbel noise."""
    for n_grams in (1, 3000):  # whatever the length
        score, key = Q._noisy(F.lit(2.0), F.lit(n_grams), F.xxhash64("id"))
        mean, sd = spark.range(4000).select((key - Q.SHARPNESS * score).alias("noise")).agg(F.avg("noise"), F.stddev("noise")).first()
        assert abs(mean - 0.5772) < 0.08 and abs(sd - math.pi / math.sqrt(6)) < 0.08


def test_inclusion_follows_the_weights(spark):
    """Of 30,000 documents of weights 1, 2 and 4 and any length, the first 300 drawn: shares of 1, 2 and 4 sevenths."""
    n_grams = F.when(F.pmod("id", F.lit(2)) == 0, 5).otherwise(5000)
    weight = F.element_at(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), (F.pmod("id", F.lit(3)) + 1).cast("int"))
    score = F.log(weight) / Q.SHARPNESS
    key = Q._noisy(score * (n_grams + Q.NEUTRAL), n_grams, F.xxhash64("id"))[1]
    drawn = {}
    for seed in range(8):
        rows = spark.range(30_000 * seed, 30_000 * (seed + 1)).select("id", weight.alias("w"), n_grams.alias("n"), key.alias("key"))
        for r in rows.orderBy(F.col("key").desc()).limit(300).collect():
            drawn[r["w"]] = drawn.get(r["w"], 0) + 1
            drawn[r["n"]] = drawn.get(r["n"], 0) + 1
    for w in (1.0, 2.0, 4.0):
        assert abs(drawn[w] / 2400 - w / 7) < 0.04
    assert abs(drawn[5.0 if 5.0 in drawn else 5] / 2400 - 0.5) < 0.05


def test_reruns_and_whole_rows(spark):
    docs, labels, _ = corpus(spark, 400)
    kept = {r["doc_id"] for r in Q.weigh(docs, labels).collect() if r["kept"]}
    again = Q.good_only(with_clashes(docs.repartition(5)), with_clashes(labels))
    assert again.columns == with_clashes(docs).columns
    assert {r["doc_id"] for r in again.collect()} == kept


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (6, 0, 0), (None, 1, 0), (99, 1, 1), (7, None, 0)], LABELS)
    got = Q.weigh(with_clashes(docs), labels).collect()
    assert len(got) == docs.count()
    assert all(r["log_weight"] == 0 and r["n_grams"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    nothing = spark.createDataFrame([], LABELS)
    assert Q.weigh(empty_documents(spark), nothing).count() == 0 and Q.good_only(empty_documents(spark), labels).count() == 0
    assert all(r["kept"] for r in Q.weigh(docs, nothing).collect())
    assert Q.good_only(docs, nothing).count() == docs.count()
    only_bad = spark.createDataFrame([(5, 0, 0), (7, 0, 0)], LABELS)
    assert all(r["kept"] for r in Q.weigh(docs, only_bad).collect())
