"""Language of pages by Bayesian fusion of evidence.

Four kinds of evidence meet as log probabilities per language:

- the text: a naive Bayes model of hashed byte trigrams, trained on labelled documents (a sample of about
  `TRAIN_ROWS` rows, taken by a hash of the id), divided by the square root of the number of trigrams, since
  neighbouring trigrams are no independent witnesses;
- the language that the markup declares, by how often pages of a language declare it;
- the address suffix, likewise;
- the host: its share of languages, smoothed towards its registered domain's, which is smoothed towards the share
  over all pages, with `SMOOTHING` pages' weight each.

The last three are learned from the pages themselves by grouped sums of the texts' posterior probabilities; a
page's own part is taken out of every sum before it is judged. Only slim rows of a page are grouped and joined.

Pages without text are judged by the other evidence, those without any by the shares over all pages. Null url or
html count as empty. Rows are judged one by one, repeated ones alike. Without labelled documents the language is
null; no pages, no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilkit.llm.frames import materialize
from veilkit.llm.hashing import LOWER, SPACE, text_bytes
from veilkit.llm.pages import blocks, main_text

BUCKETS = 1 << 16
TRAIN_ROWS = 50_000
SMOOTHING = 5.0
DECLARED = re.compile(r"""<html\b[^>]*?\b(?:xml:)?lang\s*=\s*["']?\s*([a-zA-Z]{2,3})\b""", re.I)
DECLARED_META = re.compile(r"""<meta\b[^>]*?content-language[^>]*?content\s*=\s*["']?\s*([a-zA-Z]{2,3})\b""", re.I)


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all texts (lower case, white space as one kind), and each text's bounds."""
    raw, offsets = text_bytes(column)
    b = LOWER[raw].astype(np.int64)
    b[SPACE[raw]] = 32
    if len(b) < 3:
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    grams = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * 0x9E3779B1 >> 8 & BUCKETS - 1
    inside = np.ones(len(grams), dtype=bool)
    for back in (1, 2):
        at = offsets[1:-1] - back
        inside[at[(at >= 0) & (at < len(grams))]] = False
    kept = np.concatenate(([0], np.cumsum(inside)))
    return grams[inside], kept[np.minimum(offsets, len(grams))]


def _counts(languages: list[str]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                grams, bounds = trigrams(batch.column(1))
                for lo, hi, name in zip(bounds[:-1], bounds[1:], batch.column(0).to_pylist()):
                    np.add.at(total[languages.index(name)], grams[lo:hi], 1)
        language, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(language), pa.array(bucket), pa.array(total[language, bucket])], ["language", "bucket", "n"])
    return each


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", language_col: str = "lang",
          rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of every bucket per language): its size depends on the languages only."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(language_col).alias("language")).filter(
        "language is not null and text is not null")
    sizes = {r["language"]: r["n"] for r in labelled.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages, n = sorted(sizes), sum(sizes.values())
    share = min(1.0, rows / n) if n else 1.0
    sample = labelled.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else labelled
    counts = (sample.select("language", "text").mapInArrow(_counts(languages), "language long, bucket long, n long")
              .groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow())
    full = np.zeros((len(languages), BUCKETS))
    full[counts["language"].to_numpy(), counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    full += 0.5
    return languages, np.log(full / full.sum(axis=1, keepdims=True))


def declared_language(html: str) -> str:
    found = DECLARED.search(html) or DECLARED_META.search(html)
    return found[1].lower() if found else ""


def _evidence(model: np.ndarray):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                pages = [h or "" for h in batch.column(2).to_pylist()]
                texts = [main_text(h) or " ".join(b[0] for b in blocks(h)) for h in pages]
                grams, bounds = trigrams(pa.array(texts, pa.string()))
                n = np.diff(bounds)
                scores = np.empty((len(texts), len(model)))
                for i, row in enumerate(model):
                    sums = np.concatenate(([0.0], np.cumsum(row[grams])))
                    scores[:, i] = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.sqrt(np.maximum(n, 1))
                scores -= scores.max(axis=1, keepdims=True) if len(model) else 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(model), pa.int32()), pa.array(scores.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([declared_language(h) for h in pages]), pa.array(n.astype(np.int64)), lists],
                    ["id", "url", "declared", "n_grams", "text_scores"])
    return each


def _shares(scores: Column) -> Column:
    """Log scores to probabilities."""
    top = F.array_max(scores)
    raised = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(raised, lambda s: s / F.aggregate(raised, F.lit(0.0), lambda t, x: t + x))


def identify(pages: DataFrame, docs: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
             smoothing: float = SMOOTHING, **labels) -> DataFrame:
    """A row per page: id, url, lang, probability, text_lang (by the text alone), declared, suffix, host."""
    languages, model = train(docs, **labels)
    m = len(languages)
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    kind = slim.schema["id"].dataType.simpleString()
    if not m:
        return slim.select(F.col("id").alias(id_col), "url", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"), ("suffix", "string"), ("host", "string"))])
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = (slim.mapInArrow(_evidence(model), f"id {kind}, url string, declared string, n_grams long, text_scores array<double>")
            .withColumn("host", host)
            .withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
            .withColumn("suffix", F.regexp_extract("host", r"\.([a-z][^.]*)$", 1))
            .withColumn("own", _shares(F.col("text_scores"))))
    # a page without text says nothing about the languages of its host, suffix and declaration
    rows = materialize(rows.withColumn("own", F.when(F.col("n_grams") > 0, F.col("own")).otherwise(F.array_repeat(F.lit(0.0), m))))

    def sums(df: DataFrame, *keys: str) -> DataFrame:
        """Posterior mass per key and language: an array, summed map-side first."""
        got = df.groupBy(*keys).agg(*[F.sum(F.get("own", F.lit(i))).alias(f"s{i}") for i in range(m)])
        return got.select(*keys, F.array(*[f"s{i}" for i in range(m)]).alias("sum"))

    total = [x or 0.0 for x in rows.agg(*[F.sum(F.get("own", F.lit(i))) for i in range(m)]).first()]
    everywhere = F.array(*[F.lit((x + 1) / (sum(total) + m)) for x in total])
    joined = rows
    for key in ("declared", "suffix", "domain", "host"):
        part = sums(rows, key).select(F.col(key).alias(f"_{key}"), F.col("sum").alias(f"{key}_sum"))
        joined = joined.join(part, F.col(key) == F.col(f"_{key}")).drop(f"_{key}")

    def minus(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))

    def seen(key: str) -> Column:
        """log of how often a language's other pages have this page's value, against all languages' pages."""
        others = minus(F.col(f"{key}_sum"), F.col("own"))
        whole = F.aggregate(others, F.lit(0.0), lambda t, x: t + x)
        base = F.array(*[F.lit(x) for x in total])
        ratio = F.zip_with(others, base, lambda o, t: F.log((o + smoothing * (whole + 1) / (sum(total) + m)) / (t + smoothing)))
        return F.when(F.col(key) != "", ratio).otherwise(F.array_repeat(F.lit(0.0), m))

    def smoothed(sums_: Column, towards: Column) -> Column:
        others = minus(sums_, F.col("own"))
        whole = F.aggregate(others, F.lit(0.0), lambda t, x: t + x)
        return F.zip_with(others, towards, lambda o, p: (o + p * smoothing) / (whole + smoothing))

    joined = (joined.withColumn("prior", smoothed(F.col("host_sum"), smoothed(F.col("domain_sum"), everywhere)))
              .withColumn("by_declared", seen("declared")).withColumn("by_suffix", seen("suffix")))
    log_post = F.transform(F.col("text_scores"), lambda s, i: s + F.get("by_declared", i) + F.get("by_suffix", i) + F.log(F.get("prior", i)))
    names = F.array(*[F.lit(x) for x in languages])

    def first_largest(values: Column) -> Column:
        return F.get(names, (F.array_position(values, F.array_max(values)) - 1).cast("int"))

    judged = joined.withColumn("post", _shares(log_post))
    return judged.select(F.col("id").alias(id_col), "url", first_largest(F.col("post")).alias("lang"), F.array_max("post").alias("probability"),
                         F.when(F.col("n_grams") > 0, first_largest(F.col("text_scores"))).alias("text_lang"), "declared", "suffix", "host")
