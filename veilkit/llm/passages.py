"""Removing passages that occur before: fixed-block anchors, probed by every rolling window.

A repeated run of 20 words holds, where it first occurs, a whole block of 10 words that starts at a multiple
of 10. So the non-overlapping blocks of all documents are the index, and every rolling window of 10 words
probes it. Windows travel as packed arrays, one row per (stretch of documents, hash range) of about six bytes
a window; what comes back are the windows that occur elsewhere, marked as anchors where they equal an indexed
block. An anchor is extended left and right while the following windows occur elsewhere too. The 20-word
windows inside such a stretch, each known by its two halves, are then compared exactly by grouping; all but
the first occurrence are removed. No pairs of documents are formed: a passage shared by many documents costs
one entry per occurrence.

The hash ranges are as many as the text needs for a bounded number of windows in each; stretches are bounded
by bytes. Order of occurrence: smaller doc_id, then start. Null ids come last. Rows that repeat an id are
ordered by a hash of their text; rows that repeat id and text are the same document and share its result.
Null or empty text has no words; texts of less than a window stay whole. Empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilkit.llm.frames import per_group
from veilkit.llm.hashing import mix, text_bytes, windows, words

WINDOW = 20
STRETCH_BYTES = 6 << 20
RANGE_BYTES = 16 << 20  # text per hash range: about three million windows
LAST = np.iinfo(np.int64).max


def _planes(values: np.ndarray) -> bytes:
    """32-bit integers byte plane by byte plane, which compresses where they grow slowly."""
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offsets = text_bytes(batch.column(2))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STRETCH_BYTES, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _probes(ranges: int, half: int):
    """(id, th, text) -> a row (part, uid, hashes, places, blocks, docs) per stretch and hash range."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(_stretches(batches)):
            raw, offsets = text_bytes(batch.column(2))
            _, _, hashes, first = words(raw, offsets)
            n = np.diff(first)
            rows = np.flatnonzero(n >= 2 * half)
            if not len(rows):
                continue
            counts = n[rows] - half + 1
            h = np.concatenate([windows(hashes[first[r]: first[r + 1]], half, seed=2) for r in rows])
            place = np.arange(len(h)) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
            block = place % half == 0
            part = (h >> np.uint64(32)) % np.uint64(ranges)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(ranges + 1, dtype=np.uint64))
            docs = np.stack([batch.column(0).to_numpy(zero_copy_only=False)[rows],
                             batch.column(1).to_numpy(zero_copy_only=False)[rows], counts]).astype(np.int64).tobytes()
            out = []
            for p in range(ranges):
                at = order[cuts[p]: cuts[p + 1]]
                if not len(at) and p:
                    continue
                out.append((p, task << 32 | number, h[at].astype(np.uint32).tobytes(), _planes(at),
                            np.packbits(block[at]).tobytes(), docs if p == 0 else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), *[pa.binary()] * 4))],
                ["part", "uid", "hashes", "places", "blocks", "docs"])
    return each


def _answers(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one hash range: the windows that occur more than once, and which of them equal an indexed block."""
    sizes = [len(x) // 4 for x in rows["hashes"]]
    h = np.frombuffer(b"".join(rows["hashes"]), np.uint32)
    block = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(rows["blocks"], sizes)] or [[]])
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(h) else np.empty(0, int)
    counts = np.diff(np.concatenate((starts, [len(h)])))
    anchors = np.add.reduceat(block[order].astype(np.int64), starts) > 0 if len(h) else np.empty(0, bool)
    state = np.empty(len(h), np.uint8)
    state[order] = np.repeat(np.where(counts > 1, 1 + anchors, 0).astype(np.uint8), counts)
    out, at = [], 0
    for uid, part, places, docs, n in zip(rows["uid"], rows["part"], rows["places"], rows["docs"], sizes):
        s = state[at: at + n]
        if (s > 0).any() or docs is not None:
            keep = np.flatnonzero(s)
            out.append((uid, part, h[at: at + n][keep].tobytes(), _planes(_unplanes(places)[keep]),
                        np.packbits(s[keep] == 2).tobytes(), docs))
        at += n
    return pd.DataFrame(out, columns=["uid", "part", "hashes", "places", "anchors", "docs"])


def _extended(ranges: int, half: int):
    """Of one stretch: the full windows around anchors, packed by their hash."""
    def each(rows: pd.DataFrame) -> pd.DataFrame | None:
        sizes = [len(x) // 4 for x in rows["hashes"]]
        h = np.frombuffer(b"".join(rows["hashes"]), np.uint32).astype(np.uint64)
        h = mix(h | np.repeat(rows["part"].to_numpy(np.uint64) + np.uint64(1), sizes) << np.uint64(32))
        g = np.concatenate([_unplanes(b) for b in rows["places"]]).astype(np.int64)
        anchor = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(rows["anchors"], sizes)])
        order = np.argsort(g)
        g, h, anchor = g[order], h[order], anchor[order].astype(np.int64)
        ids, th, counts = np.frombuffer(next(d for d in rows["docs"] if d is not None), np.int64).reshape(3, -1)
        first = np.concatenate(([0], np.cumsum(counts)))
        doc = np.searchsorted(first, g, "right") - 1
        if len(g) <= half:
            return None
        seen = np.concatenate(([0], np.cumsum(anchor)))
        i = np.flatnonzero((g[half:] - g[:-half] == half) & (doc[half:] == doc[:-half])
                           & (seen[half + 1:] > seen[:-half - 1]))
        if not len(i):
            return None
        whole = mix(h[i] * np.uint64(0x9E3779B97F4A7C15) + h[i + half])
        part = ((whole >> np.uint64(20)) % np.uint64(ranges)).astype(np.int64)
        return _dealt(part, ids[doc[i]], th[doc[i]], g[i] - first[doc[i]], whole)
    return each


def _dealt(part: np.ndarray, ids: np.ndarray, th: np.ndarray, place: np.ndarray, whole: np.ndarray | None = None) -> pd.DataFrame:
    """Entries packed by part: those of a document stand together, so its id is written once."""
    by = np.lexsort((place, th, ids, part))
    part, ids, th, place = part[by], ids[by], th[by], place[by]
    new = np.concatenate(([True], (part[1:] != part[:-1]) | (ids[1:] != ids[:-1]) | (th[1:] != th[:-1])))
    out, cuts = [], np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    for lo, hi in zip(cuts, [*cuts[1:], len(part)]):
        heads = lo + np.flatnonzero(new[lo:hi])
        docs = np.stack([ids[heads], th[heads], np.diff(np.append(heads, hi))]).astype(np.int64)
        out.append((int(part[lo]), docs.tobytes(), _planes(place[lo:hi]), None if whole is None else whole[by[lo:hi]].tobytes()))
    return pd.DataFrame(out, columns=["part", "docs", "places", "windows"])


def _entries(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, th, place) of all packed entries."""
    ids, th, counts = np.concatenate([np.frombuffer(b, np.int64).reshape(3, -1) for b in rows["docs"]], axis=1)
    return np.repeat(ids, counts), np.repeat(th, counts), np.concatenate([_unplanes(b) for b in rows["places"]]).astype(np.int64)


def _later(ranges: int):
    """Of one hash range: all windows but the first of each hash, dealt by document."""
    def each(rows: pd.DataFrame) -> pd.DataFrame | None:
        ids, th, place = _entries(rows)
        whole = np.frombuffer(b"".join(rows["windows"]), np.uint64)
        order = np.lexsort((place, th, ids, whole))
        whole, ids, th, place = whole[order], ids[order], th[order], place[order]
        new = np.concatenate(([True], whole[1:] != whole[:-1]))
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        later = np.flatnonzero((ids != ids[head]) | (th != th[head]) | (place != place[head]))
        if not len(later):
            return None
        part = (mix(ids[later].view(np.uint64) ^ mix(th[later].view(np.uint64))) % np.uint64(ranges)).astype(np.int64)
        return _dealt(part, ids[later], th[later], place[later])
    return each


def _spans(size: int):
    """Of some documents: the maximal stretches covered by removed windows, a row per document."""
    def each(rows: pd.DataFrame) -> pd.DataFrame:
        ids, th, place = _entries(rows)
        by = np.lexsort((place, th, ids))
        ids, th, place = ids[by], th[by], place[by]
        doc = np.concatenate(([True], (ids[1:] != ids[:-1]) | (th[1:] != th[:-1])))
        apart = doc.copy()
        apart[1:] |= place[1:] > place[:-1] + size
        starts = np.flatnonzero(apart)
        ends = place[np.append(starts[1:], len(place)) - 1] + size
        spans = np.stack([place[starts], ends], axis=1).astype(np.int32)
        heads = np.flatnonzero(doc)
        cuts = np.searchsorted(starts, heads)
        return pd.DataFrame({"id": ids[heads], "th": th[heads],
                             "spans": [spans[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(starts)])]})
    return each


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            total, removed, digest, kept_text = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                text = text.as_buffer()
                w = text.to_pybytes().split() if text is not None else []
                kept, done = w, 0
                if spans:
                    kept = []
                    for start, end in np.frombuffer(spans, np.int32).reshape(-1, 2).tolist():
                        kept += w[done:start]
                        done = end
                    kept += w[done:]
                joined = b" ".join(kept)
                total.append(len(w))
                removed.append(len(w) - len(kept))
                digest.append(hashlib.sha256(joined).hexdigest())
                kept_text.append(joined)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest),
                 pa.array(kept_text, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per document: id, n_words, n_removed, kept_sha256, kept_text (kept words, single spaces).
    `window` is even; blocks are half of it."""
    half = window // 2
    if window % 2 or half < 1:
        raise ValueError("window must be even")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 + size // RANGE_BYTES
    keyed = texts.select("doc", F.coalesce("doc", F.lit(int(LAST))).alias("id"), F.xxhash64("text").alias("th"), "text")
    probes = keyed.select("id", "th", "text").mapInArrow(
        _probes(ranges, half), "part int, uid long, hashes binary, places binary, blocks binary, docs binary")
    answers = per_group(probes, "part", _answers, "uid long, part int, hashes binary, places binary, anchors binary, docs binary",
                        parts=ranges)
    packed = "part int, docs binary, places binary, windows binary"
    full = per_group(answers, "uid", _extended(ranges, half), packed)
    later = per_group(full, "part", _later(ranges), packed, parts=ranges)
    spans = per_group(later, "part", _spans(window), "id long, th long, spans binary", parts=ranges)
    cut = keyed.join(spans, ["id", "th"], "left").select("doc", "text", "spans").mapInArrow(
        _cut, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return cut.withColumnRenamed("id", id_col)
