"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, exact confirmation.

1. Every text becomes its set of word shingles (64-bit hashes). Equal sets are one class, found by a digest
   of the whole set with map-side aggregation, so copies cost one slim row each.
2. A class has a signature of `chunks` x `width` symbols of 16 bits, b-bit MinHash values. Cut in chunks,
   two signatures that differ in at most chunks * (errors + 1) - 1 symbols have a chunk with at most
   `errors` differing symbols (pigeonhole). Each chunk is indexed under every choice of `errors` left-out
   symbols, so all pairs within that distance meet under a key. With the defaults (10 chunks of 4, 1 error)
   that is 19 of 40 symbols; a pair of similarity 0.85 differs in 6 on average and fails to meet in any
   chunk once in 4e9 pairs.
3. Classes that meet are contracted to clusters over slim edges (class, smallest class under the key).
   Clusters are cut into blocks of bounded size; the full sets of a block are compared through an inverted
   index, only between classes not yet joined, and only the smallest class joined to each leaves the task.
   Clusters of several blocks then compare block pairs that share a key, only between groups not yet joined;
   a last contraction puts the blocks' groups together.

No pairs within a group are written out, and no group has to fit in one task.

Nulls and empty texts: no words means an empty set, linked with nothing. Fewer words than a shingle make one
shingle of all. Rows that repeat a doc_id count as one document, each with its own n_shingles. A null doc_id
gives a null component and kept. Empty input gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilkit.llm.frames import components, free_name, materialize, per_group
from veilkit.llm.hashing import LOWER, mix, text_bytes, windows, words

SHINGLE = 5
CHUNKS, WIDTH, ERRORS = 10, 4, 1
ROWS_PER_FILE = 16_384
BLOCK_ROWS = 512
BLOCK_SHINGLES = 200_000


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text, in order."""
    raw, offsets = text_bytes(column)
    starts, _, hashes, first = words(LOWER[raw], offsets)
    for lo, hi in zip(first[:-1], first[1:]):
        h = hashes[lo:hi]
        yield np.unique(windows(h, min(size, len(h)), seed=1)) if len(h) else h


def _signatures(sets: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """b-bit MinHash symbols, a row per set (none empty): 16 mixed bits of the smallest value under each
    hash function."""
    out = np.empty((len(sets), len(seeds)), dtype=np.uint16)
    at, values = np.cumsum([0, *map(len, sets[:-1])]), np.concatenate(sets)
    high = values >> np.uint64(31)
    for i, s in enumerate(seeds):
        low = np.minimum.reduceat((values * s) ^ high * (s >> np.uint64(7) | np.uint64(1)), at)
        out[:, i] = (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _keys(symbols: np.ndarray, chunks: int, width: int, errors: int) -> np.ndarray:
    """A row per set: one 64-bit key per chunk and choice of left-out symbols."""
    grid = symbols.reshape(len(symbols), chunks, width).astype(np.uint64)
    out = []
    for pattern, kept in enumerate(combinations(range(width), width - errors)):
        h = np.arange(chunks, dtype=np.uint64) * np.uint64(1021) + np.uint64(pattern + 1)
        for j in kept:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + grid[:, :, j])
        out.append(h)
    return np.concatenate(out, axis=1).view(np.int64)


def _sketch(chunks: int, width: int, errors: int, size: int):
    seeds = np.random.default_rng(7).integers(1, 1 << 62, chunks * width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = list(shingle_sets(part.column(1), size))
                digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                full = [x for x in sets if len(x)]
                rows = iter(_keys(_signatures(full, seeds), chunks, width, errors) if full else ())
                keys = [next(rows).tobytes() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(digest, pa.binary()),
                     pa.array(keys, pa.binary())], ["id", "n", "digest", "keys"])
    return each


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, keys) -> a row (key, rep) for every key."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            keys = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
            counts = np.array([len(k) for k in keys])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), counts))],
                ["key", "rep"])


def _sets(size: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [s.tobytes() for s in shingle_sets(part.column(2), size)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(sets, pa.large_binary()).cast(pa.binary())],
                                                 ["block", "rep", "shingles"])
    return each


class _Roots:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def all(self) -> np.ndarray:
        while True:
            higher = self.up[self.up]
            if (higher == self.up).all():
                return self.up
            self.up = higher

    def join(self, a: int, b: int) -> None:
        up = self.all()
        lo, hi = sorted((up[a], up[b]))
        self.up = np.where(up == hi, lo, up)


def _grouped(root: np.ndarray, side: np.ndarray, blobs: list, percent: int) -> tuple[_Roots, list[tuple[int, int]]]:
    """Rows joined by links of their sets, and the links that joined groups, as row numbers. Rows of one root count
    as joined; with two sides only pairs across are compared, those of one side were before."""
    sets = [np.frombuffer(b, np.uint64) for b in blobs]
    n = np.array([len(s) for s in sets])
    shingles = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    by = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[by], owner[by]
    starts = np.flatnonzero(np.concatenate(([True], shingles[1:] != shingles[:-1])))
    distinct, lengths = shingles[starts], np.diff(np.concatenate((starts, [len(shingles)])))
    group = _Roots(len(sets))
    _, same = np.unique(root, return_inverse=True)
    first = np.full(same.max() + 1, len(sets))
    np.minimum.at(first, same, np.arange(len(sets)))
    group.up = first[same]
    links, done = [], np.zeros(len(sets), dtype=bool)
    cross = side.min() != side.max()
    for a in np.argsort(-n, kind="stable"):
        done[a] = True
        up = group.all()
        others = ~done & (up != up[a]) & (100 * np.minimum(n, n[a]) >= percent * np.maximum(n, n[a]))
        if cross:
            others &= side != side[a]
        if not others.any():
            continue
        at = np.searchsorted(distinct, sets[a])
        many = lengths[at]
        hit = np.repeat(starts[at] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        common = np.bincount(owner[hit], minlength=len(sets))
        for b in np.flatnonzero(others & (100 * common >= percent * (n + n[a] - common))):
            if group.all()[b] != group.all()[a]:
                group.join(a, b)
                links.append((a, b))
    return group, links


def _within(percent: int):
    """Of one block: (rep, root), the smallest class joined to each inside the block."""
    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rep = rows["rep"].to_numpy()
        if len(rep) == 1:
            return pd.DataFrame({"rep": rep, "root": rep})
        up = _grouped(rep, np.zeros(len(rep), int), rows["shingles"].tolist(), percent)[0].all()
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, up, rep)
        return pd.DataFrame({"rep": rep, "root": least[up]})
    return each


def _across(percent: int):
    """Of two blocks: the links that join their groups."""
    def each(rows: pd.DataFrame) -> pd.DataFrame | None:
        side, rep = rows["side"].to_numpy(), rows["rep"].to_numpy()
        if side.min() == side.max():
            return None
        links = _grouped(rows["root"].to_numpy(), side, rows["shingles"].tolist(), percent)[1]
        return pd.DataFrame([(rep[a], rep[b]) for a, b in links], columns=["a", "b"], dtype="int64")
    return each


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85,
                    shingle: int = SHINGLE, chunks: int = CHUNKS, width: int = WIDTH, errors: int = ERRORS) -> DataFrame:
    """A row per document: id, n_shingles, component_id (the smallest id reachable over links of at least
    `percent` per cent similarity), kept (the component's first document)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = materialize(texts.mapInArrow(_sketch(chunks, width, errors, shingle), "id long, n long, digest binary, keys binary"))
    named = rows.filter("id is not null and n > 0")
    files = 1 + rows.count() // ROWS_PER_FILE  # slim tables are written in few pieces, whatever a shuffle dealt them to

    def cut(df: DataFrame) -> DataFrame:
        return materialize(df.coalesce(files))

    classes = cut(named.groupBy("digest").agg(F.min("id").alias("rep"), F.max("n").alias("n"),
                                                      F.min("keys").alias("keys")))
    rows_of_class = cut(rows.select("id", "n", "digest").join(classes.select("digest", "rep"), "digest", "left")
                                .select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")))
    index = classes.select("rep", "keys").mapInArrow(_unfold, "key long, rep long")
    centers = index.groupBy("key").agg(F.min("rep").alias("center"), F.max("rep").alias("last")).filter("center < last")
    met = cut(index.join(centers.select("key", "center"), "key"))
    cluster = components(met.select(F.col("rep").alias("a"), F.col("center").alias("b")))
    members = cluster.join(classes.groupBy("rep").agg(F.sum("n").alias("n")), F.col("node") == F.col("rep"))
    # blocks: clusters are cut so that neither rows nor shingles of a block grow with the cluster
    sizes = members.groupBy("component").agg(
        F.ceil(F.greatest(F.count("rep") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    members = cut(
        members.join(sizes, "component")
        .select("rep", "component", "blocks",
                F.when(F.col("blocks") > 1, F.xxhash64("component", F.pmod(F.xxhash64("rep"), F.col("blocks"))))
                .otherwise(F.xxhash64("component", F.lit(0))).alias("block")))
    # full sets only for classes that met another one
    wanted = members.join(classes.select("rep", "digest"), "rep").select(F.col("rep").alias("id"), "block", "rep")
    sets = (texts.join(wanted.distinct(), "id").select("block", "rep", "text")
            .mapInArrow(_sets(shingle), "block long, rep long, shingles binary"))
    large = members.filter("blocks > 1")
    several = not large.isEmpty()
    if several:
        sets = materialize(sets)
    inside = cut(per_group(sets, "block", _within(percent), "rep long, root long"))
    # a doc_id that occurs with several texts joins their classes
    repeated = rows_of_class.filter("id is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b")
    shared = rows_of_class.join(repeated.select("id", F.col("a").alias("m")), "id").select(F.col("rep").alias("a"), F.col("m").alias("b"))
    links = inside.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(shared)
    if several:
        keys = met.join(large.select("rep", "block"), "rep").select("key", "block").distinct()
        spans = keys.groupBy("key").agg(F.min("block").alias("x"), F.max("block").alias("y")).filter("x < y").select("key")
        keys = keys.join(spans, "key")
        pairs = (keys.join(keys.select("key", F.col("block").alias("other")), "key").filter("block < other")
                 .select("block", "other").distinct()
                 .select(F.xxhash64("block", "other").alias("pair"), F.posexplode(F.array("block", "other")).alias("side", "block")))
        rooted = sets.join(large.select("rep", "block"), ["rep", "block"], "left_semi").join(inside.distinct(), "rep")
        across = rooted.join(pairs, "block").select("pair", "side", "rep", "root", "shingles")
        links = links.unionByName(per_group(across, "pair", _across(percent), "a long, b long"))
    roots = components(links)
    first = roots.select(F.col("node").alias("rep"), "component")
    out = (rows_of_class.join(first, "rep", "left")
           .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def _keyed(docs: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    """The rows that have an id, with a long `key`: the id, or where different texts share it a number for each text."""
    named = docs.filter(F.col(id_col).isNotNull())
    text = F.xxhash64(F.col(text_col))
    slim = named.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    several = slim.groupBy("id").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b")
    several = materialize(several.select(F.col("id").alias(f"{key}_of")))
    if several.isEmpty():
        return named.withColumn(key, F.col(id_col).cast("long"))
    marked = named.join(several, F.col(id_col).cast("long") == F.col(f"{key}_of"), "left")
    for seed in count(1):
        own = F.when(F.col(f"{key}_of").isNull(), F.col(id_col).cast("long")).otherwise(F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), text))
        numbers = marked.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), own.alias("key"))
        clash = numbers.groupBy("key").agg(F.min(F.struct("id", "text")).alias("a"), F.max(F.struct("id", "text")).alias("b")).filter("a <> b")
        if clash.filter("a.id <> b.id").isEmpty() and clash.join(several, F.expr(f"a.id = {key}_of"), "left_semi").isEmpty():
            return marked.withColumn(key, own).drop(f"{key}_of")


def first_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, with all its columns. Different texts that share an id are documents of their
    own: neither is the other's copy for that. Of rows that repeat id and text the one whose columns have the smallest
    hash stays, so reruns agree. Rows without an id are nobody's copies and stay."""
    own = free_name(docs, "kept_id")
    keyed = _keyed(docs, own, id_col, text_col)
    kept = near_duplicates(keyed, id_col=own, text_col=text_col, **options).filter("kept").select(F.col("component_id").alias(own)).distinct()
    rows = keyed.join(kept, own, "left_semi")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    first = rows.groupBy(own).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*plain)).alias("row"))
    return first.select("row.*").unionByName(docs.filter(F.col(id_col).isNull()))
