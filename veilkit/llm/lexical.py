"""Ranked lexical search in the manner of LEMP: impact vectors in buckets by length.

A document is the sparse vector of its terms' impacts, an item the vector of its terms' counts, and the score their
inner product. One pass over the texts keeps, per document, its length and the counts of terms that some item has;
this slim table is written once. Where it is read, a stretch of vectors is ordered by norm and cut into buckets.
An item skips a bucket whose longest vector cannot reach its bar by Cauchy-Schwarz, and all shorter ones with it.
Inside a bucket, the largest impact of each coordinate bounds what the item's terms can give: the terms are taken in
order of that bound until the others together stay below the bar, so a document without any of these focus terms is
out; of the rest those stay whose focus part and the smaller of the two bounds on the remainder (coordinates,
Cauchy-Schwarz) reach the bar. Only they are scored in full, in 64-bit integers.

An item's bar is its k-th best score so far: at first over the longest bucket of every stretch, then rising in each
task. Ties at the bar stay. Every task hands on k rows an item, and a window over these takes the k best.

Items are read in blocks of bounded size (ITEM_TERMS occurrences of terms), each with a pass of its own, so their
terms fit a task whatever the table of items; documents never come to the driver, only the document frequencies of
an item block's terms and a bar per item do.

A null or empty text has no term: it counts in neither N nor L, is never ranked, and as an item gets no rows. Texts
are read whole, in blocks. Items that repeat an id are ranked one by one. Rows that repeat an id are documents of
their own and may both be ranked; equal scores come by ascending id, null ids last. Empty documents or items give an
empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilkit.llm.frames import by_bytes, stored

ITEM_TERMS = 1_000_000
BLOCK = 1 << 20
STRETCH_TERMS = 8_000_000
BUCKET_ROWS = 4096
BATCH_BYTES = 8 << 20
SCALE = 1_000_000_000
LONG = 1 << 63

#: bytes of terms stay, A-Z in lower case, all others become spaces
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def term_counts(text: str | None) -> Counter[bytes]:
    """How often each term occurs; terms are cut as UTF-8 bytes, since every byte of another character is a letter."""
    raw, counts, at = (text or "").encode().translate(_LETTERS), Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + BLOCK)
        end = len(raw) if end < 0 else end
        counts.update(raw[at:end].split() if end - at < len(raw) else raw.split())
        at = end
    return counts


def _packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _vectors(numbers: dict[bytes, int]):
    """(id, text) -> (id, n, terms, counts) of every document with terms; terms of items only, ascending."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.get
        for batch in by_bytes(batches, 1, BATCH_BYTES):
            at, n, terms, counts = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = term_counts(text)
                if found:
                    own = sorted((number(t), c) for t, c in found.items() if t in numbers)
                    at.append(i)
                    n.append(found.total())
                    terms.append(np.array([t for t, _ in own], np.int32))
                    counts.append(np.array([c for _, c in own], np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), _packed(terms), _packed(counts)],
                                             ["id", "n", "terms", "counts"])
    return each


def _frequencies(size: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for terms in batch.column(0).to_pylist():
                df[np.frombuffer(terms, np.int32)] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["term", "df"])
    return each


class _Bucket:
    """Vectors of similar length, by row and by coordinate."""

    def __init__(self, norms: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        self.norms, self.terms, self.impacts = norms, terms, impacts
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        order = np.argsort(terms, kind="stable")
        self.rows = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.by_term = impacts[order]
        self.known, first = np.unique(terms[order], return_index=True)
        self.first = np.concatenate((first, [len(terms)]))
        self.most = np.maximum.reduceat(self.by_term, first) if len(first) else np.empty(0, np.int64)

    def above(self, terms: np.ndarray, counts: np.ndarray, wanted: np.ndarray, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may score `bar` or more, at least 1, and their exact scores."""
        bar = max(bar, 1)
        place = np.searchsorted(self.known, terms)
        here = place < len(self.known)
        here[here] = self.known[place[here]] == terms[here]
        place, counts = place[here], counts[here]
        most = counts * self.most[place]
        order = np.argsort(-most, kind="stable")
        place, counts, most = place[order], counts[order], most[order]
        rest = np.concatenate((np.cumsum(most[::-1])[::-1], [0]))  # what the coordinates from each one on can add
        if rest[0] < bar:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        focus = int(np.flatnonzero(rest < bar)[0])
        part, square = np.zeros(len(self.norms), np.int64), np.zeros(len(self.norms))
        for p, c in zip(place[:focus].tolist(), counts[:focus].tolist()):
            at = slice(self.first[p], self.first[p + 1])
            part[self.rows[at]] += c * self.by_term[at]
            square[self.rows[at]] += self.by_term[at].astype(np.float64) ** 2
        length = math.sqrt(float((counts[focus:].astype(np.float64) ** 2).sum()))
        slant = length * np.sqrt(np.maximum(self.norms ** 2 * (1 + 1e-9) - square, 0)) * (1 + 1e-9) + 1
        rows = np.flatnonzero((part > 0) & (part + np.minimum(slant, float(rest[focus])) >= bar))
        if not len(rows):
            return rows, rows
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[rows] - ends + sizes, sizes)
        scores = np.add.reduceat(wanted[self.terms[at]] * self.impacts[at], ends - sizes)
        keep = scores >= bar
        return rows[keep], scores[keep]


def _search(items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, bars: np.ndarray, longest_only: bool):
    """(id, n, terms, counts) -> (item, id, no_id, score): the k best rows of a task for each item."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bar, wanted = bars.copy(), np.zeros(len(weights), np.int64)
        best: dict[int, pd.DataFrame] = {}
        lengths = np.array([math.sqrt(float((c.astype(np.float64) ** 2).sum())) * (1 + 1e-9) for _, c in items])

        def stretch(rows: pa.Table) -> None:
            sizes = pa.compute.binary_length(rows.column("terms")).to_numpy() // 4
            terms = np.frombuffer(b"".join(rows.column("terms").to_pylist()), np.int32)
            counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.int32).astype(np.int64)
            n = rows.column("n").to_numpy()
            if 25 * int(n.max()) * n_docs < LONG:
                m = 75 + 25 * n * n_docs // n_terms
            else:
                m = np.array([75 + 25 * x * n_docs // n_terms for x in n.tolist()], np.int64)
            impacts = weights[terms] * (SCALE * counts // (1000 * counts + 12 * np.repeat(m, sizes)))
            starts = np.cumsum(sizes) - sizes
            norms = np.sqrt(np.add.reduceat(impacts.astype(np.float64) ** 2, starts))
            no_id = rows.column("id").is_null().to_numpy()
            ids = rows.column("id").fill_null(0).to_numpy()
            order = np.lexsort((ids, -norms))
            reaching = np.ones(len(items), bool)
            for lo in range(0, len(order), BUCKET_ROWS):
                own = order[lo: lo + BUCKET_ROWS]
                reaching &= lengths * norms[own[0]] * (1 + 1e-9) >= np.maximum(bar, 1)
                asked = np.flatnonzero(reaching)
                if not len(asked):
                    break
                ends = np.cumsum(sizes[own])
                at = np.arange(ends[-1]) + np.repeat(starts[own] - ends + sizes[own], sizes[own])
                bucket = _Bucket(norms[own], sizes[own], terms[at], impacts[at])
                for i in asked.tolist():
                    item_terms, item_counts = items[i]
                    wanted[item_terms] = item_counts
                    found, scores = bucket.above(item_terms, item_counts, wanted, int(bar[i]))
                    wanted[item_terms] = 0
                    if len(found):
                        new = pd.DataFrame({"id": ids[own[found]], "no_id": no_id[own[found]], "score": scores})
                        both = pd.concat([best[i], new]) if i in best else new
                        best[i] = both.iloc[np.lexsort((both["id"], both["no_id"], -both["score"]))[:k]]
                        if len(best[i]) == k:
                            bar[i] = max(bar[i], int(best[i]["score"].iloc[-1]))
                if longest_only:
                    break

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += pa.compute.sum(pa.compute.binary_length(batch.column(2))).as_py() // 4
            if size >= STRETCH_TERMS:
                stretch(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            stretch(pa.Table.from_batches(held))
        for i, rows in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(rows), pa.int32()), pa.array(rows["id"], pa.int64()), pa.array(rows["no_id"], pa.bool_()),
                                              pa.array(rows["score"], pa.int64())], ["item_number", "id", "no_id", "score"])
    return each


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[object, Counter]]]:
    """Items with terms, so many at a time that their terms stay bounded."""
    block, size = [], 0
    for item, text in items.toLocalIterator():
        found = term_counts(text)
        if found and size + len(found) > limit and block:
            yield block
            block, size = [], 0
        if found:
            block.append((item, found))
            size += len(found)
    if block:
        yield block


def rank(docs: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", item_terms: int = ITEM_TERMS) -> DataFrame:
    """(item, rank, id, score) of each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col), F.col(item_text_col).alias("asked_text"))
    item_type = asked.schema[0].dataType.simpleString()
    out = spark.createDataFrame([], f"`{item_col}` {item_type}, rank int, `{id_col}` long, score long")
    for block in _blocks(asked, item_terms):
        numbers = {t: i for i, t in enumerate(sorted({t for _, found in block for t in found}))}
        queries = [(np.array([numbers[t] for t in sorted(found)], np.int64), np.array([found[t] for t in sorted(found)], np.int64)) for _, found in block]
        vectors = stored(texts.mapInArrow(_vectors(numbers), "id long, n long, terms binary, counts binary"))
        n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        own = vectors.filter(F.octet_length("terms") > 0)
        df = np.zeros(len(numbers), np.int64)
        for row in own.select("terms").mapInArrow(_frequencies(len(numbers)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[row["term"]] = row["df"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

        def search(bars: np.ndarray, longest_only: bool) -> DataFrame:
            order = Window.partitionBy("item_number").orderBy(F.col("score").desc(), "no_id", "id")
            found = own.mapInArrow(_search(queries, weights, n_docs, n_terms, k, bars, longest_only), "item_number int, id long, no_id boolean, score long")
            return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

        bars = np.zeros(len(block), np.int64)
        for row in search(bars, True).filter(F.col("rank") == k).select("item_number", "score").collect():
            bars[row["item_number"]] = row["score"]
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item_number int, `{item_col}` {item_type}")
        found = search(bars, False).select("item_number", "rank", F.when(~F.col("no_id"), F.col("id")).alias("found_id"), F.col("score").alias("found_score"))
        out = out.unionByName(found.join(names, "item_number").select(item_col, "rank", F.col("found_id").alias(id_col), F.col("found_score").alias("score")))
    return out
