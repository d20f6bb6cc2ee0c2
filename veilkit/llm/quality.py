"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and pairs of neighbouring words are hashed to `BUCKETS`. The raw model holds the shares of the buckets over
all documents; the target model those over labelled documents of good quality (a sample by a hash of the id, of about
`FIT_ROWS` rows: its ids are small enough to be sent to all tasks, so no text moves). Both are compared as counts:
those seen in the target, and those that the raw model expects in as much text, each plus `PSEUDO`. A bucket that is
rare in both says nothing, however new its words are; one that is frequent in the raw text and missing in the target
says much. The sum of the log ratios over a document's n-grams is divided by their number, with `NEUTRAL` ones of no weight
added, which keep very short texts near the middle: its score, which compares documents of any length. `SHARPNESS`
times the score is the logarithm of its weight. Gumbel noise is added to that, and the k largest are a sample without
replacement with probabilities in proportion to the weights; the noise is hashed from id and text, so reruns agree.

k is no cap: it is the number of documents that the labels say are good. Among the labelled documents every score
range (of `BINS`) has a share of good documents, made to rise with the score, and k counts all documents above the
last range with a share under `accept`; ranges without labels are given the benefit of the doubt. The k-th largest key is found by counting keys in ranges, again and again inside
one, never by sorting in one place. No document is judged by a model that saw its own label: labels are dealt into
`FOLDS`, and a document is scored by the target model of the other folds.

Null and empty texts have no n-grams, score 0, and compete by their noise alone. Rows that repeat an id are
judged one by one. Without good or without bad labels every document is kept. Empty input gives an empty result.
Only id and text, and the labels' id and quality, are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilkit.llm.frames import materialize
from veilkit.llm.hashing import LOWER, mix, text_bytes, words

BITS = 18
BUCKETS = 1 << BITS
PSEUDO = 10.0
NEUTRAL = 50
#: a score higher by 1 / SHARPNESS makes a document e times as likely to be drawn next
SHARPNESS = 400.0
LOWEST, BINS, BIN = -1.5, 200, 0.01
FOLDS = 4
ACCEPT = 0.5
FIT_ROWS = 50_000
SLICE = 256  # rows hashed at a time


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words and neighbouring pairs, and the bounds of each text among them."""
    raw, offsets = text_bytes(column)
    _, _, h, first = words(LOWER[raw], offsets)
    n = len(h)
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if n > 1 else h[:0]
    ends_text = np.zeros(n, dtype=bool)
    ends_text[first[1:][first[1:] > first[:-1]] - 1] = True
    out = np.empty(2 * n, dtype=np.int64)
    out[0::2] = (h >> np.uint64(64 - BITS)).astype(np.int64)
    out[1::2] = -1
    if n > 1:
        out[1:-1:2] = (pairs >> np.uint64(64 - BITS)).astype(np.int64)
    out[1::2][ends_text] = -1  # a text's last word has no pair
    return out, 2 * first


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Raw counts of a partition and target counts by fold, a row per bucket that occurs."""
    total = np.zeros((1 + FOLDS, BUCKETS), dtype=np.int64)
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            grams, bounds = ngrams(batch.column(0))
            fold = np.repeat(batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False), np.diff(bounds))
            fold, grams = fold[grams >= 0], grams[grams >= 0]
            total[0] += np.bincount(grams, minlength=BUCKETS)
            for f in range(FOLDS):
                total[1 + f] += np.bincount(grams[fold == f], minlength=BUCKETS)
    used = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(used), *map(pa.array, total[:, used])], ["bucket", "raw", *(f"good{f}" for f in range(FOLDS))])


def _scores(ratio: np.ndarray):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        padded = np.append(ratio, np.zeros((FOLDS, 1)), axis=1).ravel()  # -1 finds the last entry of a fold
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                grams, bounds = ngrams(batch.column(1))
                fold = np.repeat(batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(bounds))
                values = padded[fold * (BUCKETS + 1) + np.where(grams < 0, BUCKETS, grams)]
                sums = np.concatenate(([0.0], np.cumsum(values)))
                many = np.concatenate(([0], np.cumsum(grams >= 0)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(sums[bounds[1:]] - sums[bounds[:-1]]), pa.array(many[bounds[1:]] - many[bounds[:-1]])],
                    ["id", "draw", "log_weight", "n_grams"])
    return each


def log_ratios(texts: DataFrame) -> np.ndarray:
    """log(target / raw) of every bucket, a row per fold left out, from rows (text, fold; null where not known
    to be good): FOLDS x BUCKETS numbers, whatever the input."""
    names = ["raw", *(f"good{f}" for f in range(FOLDS))]
    counts = (texts.mapInArrow(_counts, "bucket long, " + ", ".join(f"{c} long" for c in names)).groupBy("bucket")
              .agg(*[F.sum(c).alias(c) for c in names]).toArrow())
    full = np.zeros((1 + FOLDS, BUCKETS))
    full[:, counts["bucket"].to_numpy()] = [counts[c].to_numpy() for c in names]
    raw, good = full[0], full[1:].sum(axis=0) - full[1:]
    share = (raw + 1) / (raw.sum() + BUCKETS)
    expected = good.sum(axis=1, keepdims=True) * share
    return np.log((good + PSEUDO) / (expected + PSEUDO))  # all 0 where the target has no text


def kth_largest(keys: DataFrame, k: int, key: str = "key") -> float:
    """The k-th largest of a column of doubles: counts over 1024 ranges, then inside the one that holds it."""
    lo, hi = keys.agg(F.min(key), F.max(key)).first()
    for _ in range(12):
        if lo >= hi:
            break
        width = (hi - lo) / 1024
        cell = F.least(F.floor((F.col(key) - lo) / width), F.lit(1023))
        counts = dict(keys.filter((F.col(key) >= lo) & (F.col(key) <= hi)).groupBy(cell.alias("c")).count().collect())
        above = keys.filter(F.col(key) > hi).count()
        for c in range(1023, -1, -1):
            if above + counts.get(c, 0) >= k:
                break
            above += counts.get(c, 0)
        found = keys.filter((F.col(key) >= lo) & (F.col(key) <= hi)).filter(cell == c).agg(F.min(key), F.max(key)).first()
        if counts.get(c, 0) <= 1 or found[0] is None:
            lo = found[0] if found[0] is not None else lo
            break
        lo, hi = found
    return lo


def good_documents(scored: DataFrame, labels: DataFrame, accept: float) -> tuple[int, int]:
    """(documents in score ranges that the labels accept, all documents), from counts in BINS ranges."""
    with_labels = scored.join(labels, "id", "left")
    cell = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(BINS - 1.0), (F.col("score") - LOWEST) / BIN))).alias("cell")
    rows = (with_labels.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"),
                                          F.sum((F.col("quality") == 1).cast("long")).alias("good")).orderBy("cell").collect())
    # pool neighbouring labelled ranges until the share of good documents rises with the score
    pools: list[list[int]] = []  # labelled, good, last range
    for r in rows:
        if r["labelled"]:
            pools.append([r["labelled"], r["good"], r["cell"]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            labelled, good, last = pools.pop()
            pools[-1] = [pools[-1][0] + labelled, pools[-1][1] + good, last]
    some_good = any(good for _, good, _ in pools)
    refused = max((last for labelled, good, last in pools if some_good and good < accept * labelled), default=-1)
    return sum(r["n"] for r in rows if r["cell"] > refused), sum(r["n"] for r in rows)


def _prepared(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, quality_col: str, seed: int, fit_rows: int):
    """(rows with id, text, draw, fold; the labels by id; log ratios by fold)."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    known = (labels.select(F.col(id_col).cast(kind).alias("id"), F.col(quality_col).alias("quality")).filter("id is not null")
             .groupBy("id").agg(F.max("quality").alias("quality")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *_dealt(id_col, text_col, seed))
    good = known.filter("quality = 1").select("id", F.lit(1).alias("good"))
    share = min(1.0, fit_rows / max(1, good.count()))
    good = good.filter(F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    marked = texts.join(F.broadcast(good), "id", "left").select("text", F.when(F.col("good") == 1, F.col("fold")).alias("fold"))
    return texts, known, log_ratios(marked)


def _dealt(id_col: str, text_col: str, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw"),
            F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col)), F.lit(FOLDS)).cast("int").alias("fold")]


def _noisy(log_weight: Column, n_grams: Column, draw: Column) -> tuple[Column, Column]:
    """(score, key): the log ratio per n-gram, and the log weight made of it with Gumbel noise added."""
    noise = -F.log(-F.log((F.pmod(draw, F.lit(1 << 40)) + 0.5) / float(1 << 40)))
    score = log_weight / (n_grams + F.lit(NEUTRAL))
    return score, SHARPNESS * score + noise


def _limit(rows: DataFrame, known: DataFrame, accept: float) -> float:
    """The smallest key that stays."""
    k, n = good_documents(rows, known, accept)
    return float("inf") if k <= 0 < n else kth_largest(rows, k) if k < n else -float("inf")


def weigh(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
          accept: float = ACCEPT, seed: int = 29, fit_rows: int = FIT_ROWS) -> DataFrame:
    """A row per document: id, n_grams, log_weight, score, key (noisy), kept."""
    texts, known, ratio = _prepared(docs, labels, id_col, text_col, quality_col, seed, fit_rows)
    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.mapInArrow(_scores(ratio), f"id {kind}, draw long, log_weight double, n_grams long")
    score, key = _noisy(F.col("log_weight"), F.col("n_grams"), F.col("draw"))
    rows = materialize(rows.withColumn("score", score).withColumn("key", key).drop("draw"))
    return rows.withColumn("kept", F.col("key") >= _limit(rows, known, accept)).withColumnRenamed("id", id_col)


def good_only(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
              accept: float = ACCEPT, seed: int = 29, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that `weigh` keeps, with all their columns. Texts are scored twice rather than moved."""
    texts, known, ratio = _prepared(docs, labels, id_col, text_col, quality_col, seed, fit_rows)
    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.mapInArrow(_scores(ratio), f"id {kind}, draw long, log_weight double, n_grams long")
    score, key = _noisy(F.col("log_weight"), F.col("n_grams"), F.col("draw"))
    limit = _limit(materialize(rows.select("id", score.alias("score"), key.alias("key"))), known, accept)
    width = len(docs.columns)
    whole = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)],
                        F.col(id_col).alias("id"), F.col(text_col).alias("text"), *_dealt(id_col, text_col, seed))
    judged = whole.drop("id", "text", "fold", "draw")
    plain = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in judged.schema)
    score_of = _scores(ratio)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays(batch.columns[width: width + 4], ["id", "text", "draw", "fold"])
            got = pa.Table.from_batches(score_of(iter([own]))).combine_chunks()
            extra = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (got["draw"], got["log_weight"], got["n_grams"])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *extra], [f"c{i}" for i in range(width)] + ["draw", "log_weight", "n_grams"])

    scored = whole.mapInArrow(each, f"{plain}, draw long, log_weight double, n_grams long")
    return scored.filter(key >= limit).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
