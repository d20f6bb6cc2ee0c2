"""Phrase collocations by prefix-free parsing: chunks cut by content, counted once, weighted by their frequency.

Words stand in pieces of text, and a trigger is a word at which the hash of the next TRIGGER words falls into one of
PARSE classes. Every document's words are cut before each trigger (and after LONGEST words without one), so equal
passages fall into equal chunks wherever they stand. A chunk is its own words and, behind a bar, up to three more of
the same piece: all phrases that begin in its own words lie in it, and phrases that begin behind the bar belong to
the next chunk, so that each is counted once. The dictionary of distinct chunks and their frequencies is written;
all counts come from it, and a passage repeated a million times is counted in one row.

Phrases are counted by their number of words. Of the words all are counted, of longer phrases only those whose two
shorter parts both have `least` occurrences: no other one can have as many. What has them is kept as bits at hashed
places in a bitmap of fixed size, made by grouping; a wrong bit costs work, never a result, as phrases are counted
by their text. Tasks add up equal phrases of a batch (found by hash, confirmed byte by byte) before Spark does.

Scores and the rule for phrases inside longer ones are joins of these tables; divisions are exact in decimals.

Null or empty text has no words; null groups count as `und`. Texts are read whole. Rows that repeat an id or a text
are counted each. Equal scores come by occurrences, then by phrase in byte order. Empty input gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilkit.llm.frames import by_bytes, stored
from veilkit.llm.hashing import mix, text_bytes, windows, words

PARSE, TRIGGER, LONGEST = 24, 3, 4096
WORDS = 4
LEAST = 30
PLACES = 1 << 26
TEXT_BYTES = 4 << 20
GROUP_BYTES = 8 << 20
NO_LANGUAGE = "und"

#: a text's bytes with A-Z in lower case, ends of pieces as line ends and tabs as spaces; a bar is never in a word
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[0x41:0x5B] += 0x20
_BYTES[[*b".,;:!?", *range(0x0A, 0x0E)]] = 0x0A
_BYTES[0x09] = 0x20
BAR = 0x0D


def _slices(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many slices one after the other, and where each ends."""
    sizes = ends - starts
    to = np.cumsum(sizes)
    return raw[np.arange(to[-1] if len(to) else 0) + np.repeat(starts - to + sizes, sizes)], to


def _strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    data, to = _slices(raw, starts, ends)
    offsets = np.concatenate(([0], to)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, chunk, own): the text's words joined by single spaces, or line ends between pieces, cut
    into chunks of `own` words and, after a bar, the words that phrases beginning in them may reach."""
    for batch in by_bytes(batches, 1, TEXT_BYTES):
        raw, offsets = text_bytes(batch.column(1))
        raw = _BYTES[raw]
        starts, ends, hashes, first = words(raw, offsets)
        n = len(starts)
        if not n:
            continue
        rows = np.repeat(np.arange(batch.num_rows), np.diff(first))
        pieces = np.concatenate(([0], np.cumsum(raw == 0x0A)))[starts]
        new_row = np.concatenate(([True], rows[1:] != rows[:-1]))
        new_piece = new_row | np.concatenate(([True], pieces[1:] != pieces[:-1]))
        # one byte between words of a row, none before a row's first word
        gaps = starts[~new_row] - 1
        raw[gaps] = np.where(new_piece[~new_row], 0x0A, 0x20)
        keep = np.zeros(len(raw) + 1, np.int64)
        keep[starts] += 1
        keep[ends] -= 1
        keep = np.cumsum(keep)[:-1] > 0
        keep[gaps] = True
        place = np.concatenate(([0], np.cumsum(keep)))
        starts, ends, data = place[starts], place[ends], raw[keep].tobytes()
        # cuts: rows, triggers that lie in one row, and long stretches without any
        cut = new_row.copy()
        trigger = np.flatnonzero(windows(hashes, TRIGGER, seed=12) % np.uint64(PARSE) == 0)
        cut[trigger[rows[trigger] == rows[np.minimum(trigger + TRIGGER - 1, n - 1)]]] = True
        at = np.flatnonzero(cut)
        more = np.arange(n) - np.repeat(at, np.diff(np.concatenate((at, [n]))))
        at = np.flatnonzero(cut | (more % LONGEST == 0))
        to = np.concatenate((at[1:], [n]))
        # up to three words more, as far as the piece of the last own word goes
        piece = np.cumsum(new_piece)
        tail = to.copy()
        for _ in range(WORDS - 1):
            tail += (tail < n) & (piece[np.minimum(tail, n - 1)] == piece[to - 1])
        out = [data[s:e] if j == t else data[s:e] + b"\r" + data[e + 1:x]
               for s, e, j, t, x in zip(starts[at].tolist(), ends[to - 1].tolist(), to.tolist(), tail.tolist(), ends[tail - 1].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[at])), pa.array(out, pa.binary()).cast(pa.string()), pa.array(to - at, pa.int32())],
                                         ["lang", "chunk", "own"])


def _known(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys % np.uint64(PLACES)
    return bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) == 1


def _counted(size: int, bits):
    """(lang, lang_hash, chunk, own, f) -> (lang, phrase, key, f): phrases of `size` words, equal ones of a group added up."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter = None if bits is None else bits.value
        for batch in _groups(batches):
            raw, offsets = text_bytes(batch.column(2))
            starts, ends, hashes, first = words(raw, offsets)
            if len(starts) < size:
                continue
            raw = np.where(raw == BAR, np.uint8(0x20), raw)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(first))
            segment = np.concatenate(([0], np.cumsum(raw == 0x0A)))[starts] + rows
            last = len(starts) - size + 1
            own = np.arange(len(starts)) - first[rows] < batch.column(3).to_numpy()[rows]
            good = own[:last] & (segment[:last] == segment[size - 1:])
            spoken = batch.column(1).to_numpy().astype(np.uint64)[rows]
            if shorter is not None:
                parts = _known(shorter, mix(windows(hashes, size - 1) ^ spoken[: last + 1]))
                good &= parts[:-1] & parts[1:]
            at = np.flatnonzero(good)
            if not len(at):
                continue
            keys = mix(windows(hashes, size) ^ spoken[:last])[at]
            lo, hi, f = starts[at], ends[at + size - 1], batch.column(4).to_numpy()[rows[at]]
            order = np.argsort(keys, kind="stable")
            keys, lo, hi, f, row = keys[order], lo[order], hi[order], f[order], rows[at][order]
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            # the same bytes as the group's first one, or a row of its own
            sample = np.flatnonzero(new)[np.cumsum(new) - 1]
            other = np.flatnonzero(~new)
            differ = hi[other] - lo[other] != hi[sample[other]] - lo[sample[other]]
            same = other[~differ]
            a, to = _slices(raw, lo[same], hi[same])
            b, _ = _slices(raw, lo[sample[same]], hi[sample[same]])
            unequal = np.zeros(len(keys), bool)
            unequal[other[differ]] = True
            if len(same):
                unequal[same] = np.add.reduceat((a != b).astype(np.int64), to - (hi[same] - lo[same])) > 0
            sums = np.add.reduceat(np.where(unequal, 0, f), np.flatnonzero(new))
            kept = np.concatenate((np.flatnonzero(new), np.flatnonzero(unequal)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row[kept])), _strings(raw, lo[kept], hi[kept]), pa.array(keys[kept].view(np.int64)),
                 pa.array(np.concatenate((sums, f[unequal])), pa.int64())], ["lang", "phrase", "key", "f"])
    return each


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined until their texts take GROUP_BYTES."""
    held, size = [], 0
    for batch in by_bytes(batches, 2, GROUP_BYTES):
        held.append(batch)
        size += batch.column(2).nbytes
        if size >= GROUP_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _bitmap(phrases: DataFrame) -> np.ndarray:
    place = F.pmod("key", F.lit(PLACES))
    rows = (phrases.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(key, {PLACES}) & 63 as int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas())  # at most PLACES / 64 rows
    bits = np.zeros(PLACES >> 6, np.uint64)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def frequent(docs: DataFrame, *, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """All phrases of one to four words with `least` or more occurrences (lang, phrase, size, a), and the number of
    all words (lang, n)."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).alias("text"))
    dictionary = stored(texts.mapInArrow(_chunks, "lang string, chunk string, own int").groupBy("lang", "chunk", "own").agg(F.count(F.lit(1)).alias("f")))
    spark, bits, levels = docs.sparkSession, None, []
    chunks = dictionary.select("lang", F.xxhash64("lang").alias("lang_hash"), "chunk", "own", "f")
    for size in range(1, WORDS + 1):
        counts = (chunks.mapInArrow(_counted(size, bits), "lang string, phrase string, key long, f long")
                  .groupBy("lang", "phrase", "key").agg(F.sum("f").alias("a")).filter(F.col("a") >= least))
        level = stored(counts)
        levels.append(level.select("lang", "phrase", F.lit(size).alias("size"), "a"))
        if size < WORDS:
            bits = spark.sparkContext.broadcast(_bitmap(level))  # PLACES bits
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.unionByName(level)
    return phrases, dictionary.groupBy("lang").agg(F.sum(F.col("f") * F.col("own")).alias("n"))


def collocations(docs: DataFrame, *, least: int = LEAST, keep: int = 2000, covered_percent: int = 80, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `keep` phrases. A phrase's score is its least
    floor(2000000 a / (l + r)) over all cuts into two parts with l and r occurrences; phrases that lie in a longer
    one of at least `covered_percent` of their occurrences are left out."""
    phrases, totals = frequent(docs, least=least, text_col=text_col, lang_col=lang_col)
    candidates = phrases.filter("size > 1")
    joined = lambda lo, n: f"array_join(slice(split(phrase, ' '), {lo}, {n}), ' ')"
    cuts = candidates.withColumn("cut", F.explode(F.expr("sequence(1, size - 1)"))).selectExpr(
        "lang", "phrase", "a", "size", "cut", f"{joined('1', 'cut')} as head", f"{joined('cut + 1', 'size - cut')} as rest")
    heads = phrases.selectExpr("lang", "phrase as head", "a as l")
    rests = phrases.selectExpr("lang", "phrase as rest", "a as r")
    scored = (cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
              .withColumn("score", F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0))"))
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")))
    longer = (candidates.filter("size > 2").withColumn("part", F.explode(F.expr("sequence(2, size - 1)")))
              .withColumn("at", F.explode(F.expr("sequence(1, size - part + 1)")))
              .selectExpr("lang", f"{joined('at', 'part')} as phrase", "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    covered = F.expr(f"cast(100 as decimal(3,0)) * cast(longer as decimal(20,0)) >= cast({int(covered_percent)} as decimal(3,0)) * cast(a as decimal(20,0))")
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    return (scored.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False)))
            .withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= keep).join(totals, "lang")
            .select("lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score")))
