"""I-Match document fingerprints, by DataFrame functions alone.

The lexicon holds the terms whose document frequency lies in a band, as shares of all documents: very common
terms say little, rare ones do not survive edits. Terms are hashed to SLOTS values, so that the lexicon is one
bitmap of fixed size, whatever the corpus, which every task reads as a constant. Rare terms that share a slot
add at most (distinct terms of a mean document) / SLOTS to its share, far below the band. A document keeps its
distinct lexicon terms, sorted, and hashes the part of them that falls in each of several randomised
sub-lexicons of different density; without a term in a sub-lexicon the part is empty. The fingerprint is the
parts' hashes in order. A text with few lexicon terms, such as one of a family of near copies that is a large share
of all texts, has as many further parts, of its distinct terms whether in the lexicon or not. The likeness of two fingerprints
is the share of equal parts among those not empty in both, 1 for equal texts; the further parts count only where both
texts have them, so a text just below and one just above the line are compared by their lexicon terms.

Terms are lower-cased runs of characters that are neither white space, control characters nor ASCII
punctuation. A text whose parts are all empty is told apart by the hash of the whole text, as a last part.
Null and empty texts are the same text. Documents are ordered by id, descending, nulls last; rows of one id by
a hash of their text. Empty input gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilkit.llm.frames import materialize

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEAST, MOST = 1 / 1000, 1 / 10
#: one sub-lexicon per entry: it holds a term of the lexicon with probability 1 / entry
DENSITY = (4, 4, 8, 8, 16, 16, 16, 16, 32, 32, 32, 32, 64, 64, 64, 64)
SLOTS = 1 << 21
#: so few lexicon terms, or less than one in so many distinct terms, do not tell whether a text is a near copy
FEW_TERMS, FEW_SHARE = 8, 8
BUCKET_ROWS, MAX_BUCKETS = 1024, 16384


def terms(text: Column) -> Column:
    """Hashed terms, with repeats."""
    return F.transform(F.filter(F.split(F.lower(text), GAP), lambda w: w != ""),
                       lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int"))


def lexicon(docs: DataFrame, text: Column, least: float = LEAST, most: float = MOST) -> Column:
    """The bitmap of the terms in at least `least` and at most `most` of all documents, as a constant."""
    n = docs.count()
    counts = docs.select(F.explode(F.array_distinct(terms(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = counts.filter((F.col("df") >= max(2, math.ceil(least * n))) & (F.col("df") <= max(2, most * n)))
    words = (band.groupBy(F.shiftright("term", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, term & 63)")).alias("bits")).collect())  # at most SLOTS / 64 rows
    bitmap = [0] * (SLOTS // 64)
    for word, bits in words:
        bitmap[word] = bits
    return F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")


def in_band(every: Column, lex: Column) -> Column:
    """Those of a text's distinct terms that are in the lexicon, sorted."""
    return F.array_sort(F.filter(every, lambda t: F.getbit(F.get(lex, F.shiftright(t, 6)), t.bitwiseAND(63)) == 1))


def _part(kept: Column, number: int, one_in: int) -> Column:
    part = F.filter(kept, lambda t: F.pmod(F.xxhash64(t, F.lit(number)), F.lit(one_in)) == 0)
    return F.when(F.size(part) > 0, F.xxhash64(part, F.lit(number))).otherwise(F.lit(0).cast("long"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value found once."""
    return F.get(F.transform(F.array(value), use), 0)


def _parts(kept: Column, first: int, density: tuple[int, ...]) -> Column:
    return F.array(*[_part(kept, k, d) for k, d in enumerate(density, first)])


def _hashed(every: Column, kept: Column, text: Column, density: tuple[int, ...]) -> Column:
    """The hash of each sub-lexicon's part, 0 for an empty one; the same over all terms, 0 unless those of the lexicon
    are few; and last the text's where all parts are empty."""
    def whole(parts: Column) -> Column:
        alone = F.when(F.forall(parts, lambda p: p == 0), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))
        return F.concat(parts, F.array(alone))

    few = (F.size(kept) < FEW_TERMS) | (F.size(kept) * FEW_SHARE < F.size(every))
    common = F.when(few, _bound(F.array_sort(every), lambda terms_: _parts(terms_, len(density), density)))
    none = F.array(*[F.lit(0).cast("long")] * len(density))
    return _bound(F.concat(_parts(kept, 0, density), F.coalesce(common, none)), whole)


def _fingerprint(text: Column, lex: Column, density: tuple[int, ...]) -> Column:
    """The array of part hashes."""
    return _bound(F.array_distinct(terms(text)),
                  lambda every: _bound(in_band(every, lex), lambda kept: _hashed(every, kept, text, density)))


def printed(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "-")


def likeness(a: Column, b: Column, parts: int = len(DENSITY)) -> Column:
    """Share of equal parts among those not empty in both; 1 if all are equal. The second `parts` parts count only if
    neither text lacks all of them."""
    def further(fp: Column) -> Column:
        return F.exists(F.slice(fp, parts + 1, parts), lambda x: x != 0)

    def compared(both: Column) -> Column:
        pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(None)).otherwise((x == y).cast("int")))
        left_out = F.transform(pairs, lambda x, i: F.when(both | (i < parts) | (i >= 2 * parts), x))
        return F.filter(left_out, lambda x: x.isNotNull())

    used = _bound(further(a) & further(b), compared)
    same = F.aggregate(used, F.lit(0), lambda s, x: s + x)
    return F.when(F.size(used) == 0, F.lit(1.0)).otherwise(same.cast("double") / F.size(used))


def _bucketed(ids: DataFrame) -> tuple[Column, int]:
    """A Column that deals `id` to ranges of about BUCKET_ROWS rows (MAX_BUCKETS at most), larger ids first."""
    n = ids.count()
    buckets = min(MAX_BUCKETS, max(1, -(-n // BUCKET_ROWS)))
    bounds = ids.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)] or [0.5], 100_000)).first()[0]
    bounds = sorted(set(bounds or [])) if buckets > 1 else []
    if not bounds:
        return F.lit(0), 1
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    known = F.array(*[F.lit(int(b)) for b in bounds])
    # binary search: how many bounds are smaller
    below = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                        lambda at, s: F.when(F.get(known, at + s - 1) < F.col("id"), at + s).otherwise(at))
    return F.when(F.col("id").isNull(), len(bounds) + 1).otherwise(F.lit(len(bounds)) - below), len(bounds) + 2


def beside_next(rows: DataFrame, computed: dict[str, Column], following: dict[str, str]) -> DataFrame:
    """Rows (id, tie, ...) with the columns `computed` from their own, and `following`: new names of columns of the
    next row by descending id, after the last the first. Rows are moved once, into ranges of ids; the first row of
    every range is sent along to the range before."""
    bucket, _ = _bucketed(rows.select("id"))
    rows = rows.withColumn("bucket", bucket)
    heads = rows.groupBy("bucket").agg(F.max("id").alias("head"))  # at most MAX_BUCKETS + 1 rows from here on
    order = Window.orderBy("bucket")
    heads = (heads.withColumn("before", F.lag("bucket").over(order))
             .withColumn("last", F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
             .select("head", F.coalesce("before", "last").alias("to")))
    heads = materialize(heads)
    sent = (rows.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("head")))
            .withColumn("bucket", F.col("to")).drop("head", "to").withColumn("copy", F.lit(1)))
    every = rows.withColumn("copy", F.lit(0)).unionByName(sent).withColumns(computed)
    along = Window.partitionBy("bucket").orderBy("copy", F.col("id").desc_nulls_last(), "tie")
    # plain columns only: an expression inside lead() would be moved beside the columns it is made of
    return every.withColumns({new: F.lead(c).over(along) for new, c in following.items()}).filter("copy = 0").drop("bucket", "copy")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, most: float = MOST,
                 density: tuple[int, ...] = DENSITY) -> DataFrame:
    """A row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lex = lexicon(texts, F.col("text"), least, most)
    rows = beside_next(texts.withColumn("tie", F.xxhash64("text")), {"fp": _fingerprint(F.col("text"), lex, density)},
                       {"next_text": "text", "next_fp": "fp"})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", 1, n - half), F.substring("next_text", 1, half))
    return (rows.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
            .withColumn("edited_fp", _fingerprint(F.col("edited"), lex, density))
            .select(F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                    printed(F.col("fp")).alias("fingerprint"), printed(F.col("edited_fp")).alias("edited_fingerprint"),
                    likeness(F.col("fp"), F.col("edited_fp"), len(density)).alias("near_edited"),
                    likeness(F.col("fp"), F.col("next_fp"), len(density)).alias("near_next")))
