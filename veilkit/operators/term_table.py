"""Dictionaries of any length: terms in a table, found through an index of their first words.

A term list that is configuration becomes part of the scan's expression (`operators.dictionary`). A long one stays a
table. Two bitmaps of fixed size are made of it by grouping: one of the first words, one of the whole terms. They and the
terms' lengths in units reach the texts as scalar subqueries, so the plan holds no term and no term comes to the driver.
In a text, word groups start only at words of the first bitmap and are kept only if the second one has them; what is
left, a few slim rows, meets the terms by an equi-join on hash and text. At each place the longest term wins, then
places are taken from the left; runs of overlapping places are settled by themselves.

A list of salted hashes works alike, without the index of first words: only hashes are compared.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions.arrays import let, pinned, running_sum
from veilkit.functions.globs import literal
from veilkit.functions.normalize import normalized
from veilkit.operators.dictionary import UNITS, fold_sql, match_sql
from veilkit.operators.ordered import grouped

PLACES = 1 << 22
_SPAN = "array<struct<start:int,end:int,key:string>>"


def prepared(terms: DataFrame) -> DataFrame:
    """(entity, term, case_sensitive) -> the terms as they are compared: (entity, case_sensitive, key, first, units)."""
    plain = "regexp_replace(trim(term), '(?U)\\\\s+', ' ')"
    key = F.expr(f"if(case_sensitive, {plain}, {match_sql(plain)})")
    units = F.expr(f"regexp_extract_all(key, {literal(UNITS)}, 0)")
    rows = terms.select("entity", F.coalesce("case_sensitive", F.lit(False)).alias("case_sensitive"), "term").withColumn("key", key).filter("key <> ''")
    return rows.select("entity", "case_sensitive", "key", units[0].alias("first"), F.size(units).alias("units")).distinct()


def hashed(hashes: DataFrame) -> DataFrame:
    """(entity, hash, units) of `dictionary.term_hashes` -> the same form, without first words."""
    return hashes.select("entity", F.lit(False).alias("case_sensitive"), F.col("hash").alias("key"), F.lit(None).cast("string").alias("first"),
                         F.col("units").cast("int").alias("units")).distinct()


def bitmap(values: DataFrame, places: int | None = None) -> DataFrame:
    """One row with as many bits as `places` (PLACES if none are given): those at the hashed places of a string column are set."""
    places = places or PLACES
    place = F.pmod(F.xxhash64(F.col(values.columns[0])), F.lit(places)).alias("place")
    words = (values.select(place).groupBy(F.shiftright("place", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")))
    every = values.sparkSession.range(places >> 6).withColumnRenamed("id", "word").join(words, "word", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).cast("bigint").alias("bits")))), lambda x: x["bits"]))


def _in(bitmap: str, value: str) -> str:
    at = f"pmod(xxhash64({value}), {PLACES})"  # twice is cheaper than a binding
    return f"getbit(get({bitmap}, cast(shiftright({at}, 6) as int)), cast({at} & 63 as int)) = 1"


def in_bitmap(bits: Column, value: Column, places: int) -> Column:
    """The same test of a column, outside a higher-order function."""
    at = F.pmod(F.xxhash64(value), F.lit(places))
    return F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def _spans(text: str, case_sensitive: bool, has_first: bool, salt: str | None, original: bool) -> str:
    """array<struct<start,end,key>> of the word groups that both bitmaps know."""
    group = "array_join(slice(norm, i + 1, k), '')"
    if salt is not None:
        group = f"substr(sha2(concat({literal(salt)}, '\\n', {group}), 256), 1, {fixed.TERM_HASH_HEX})"
    fold = fold_sql if salt is not None else match_sql
    starts = "u[i] rlike '(?U)\\\\S' AND NOT (coalesce(get(u, i - 1), '') rlike '(?U)[^\\\\W_]$')"
    if has_first:
        starts = f"{_in('_firsts', 'u[i]')} AND {starts}"
    ends = "i + k <= size(u) AND NOT (coalesce(get(u, i + k), '') rlike '^(?U)[^\\\\W_]')"
    kept = (f"flatten(transform(firsts, i -> filter(transform(filter(_sizes, k -> {ends}), k -> named_struct('i', i, 'k', k, 'key', {group})), "
            f"m -> {_in('_keys', 'm.key')})))")
    start, end = "off[m.i]", "off[m.i + m.k - 1] + length(u[m.i + m.k - 1])"
    if original:
        start, end = f"if(n.index IS NULL, {start}, n.index[{start}])", f"if(n.index IS NULL, {end}, n.index[{end} - 1] + 1)"
    none = f"cast(array() AS {_SPAN})"
    placed = let("found", kept, f"if(size(found) = 0, {none}, "
                 + let("off", running_sum("transform(u, x -> length(x))"),
                       f"transform(found, m -> named_struct('start', {start}, 'end', {end}, 'key', m.key))") + ")")
    firsts = let("firsts", f"filter(sequence(0, size(u) - 1), i -> {starts})",
                 f"if(size(firsts) = 0, {none}, " + let("norm", "transform(u, x -> if(x rlike '^(?U)\\\\s', ' ', x))", placed) + ")")
    matched = let("u", f"regexp_extract_all(folded, {literal(UNITS)}, 0)", f"if(size(u) = 0, {none}, {firsts})")
    if has_first:  # most texts hold no word that a term starts with: their distinct words tell
        words = f"exists(array_distinct(split(folded, '(?U)[\\\\W_]+')), w -> {_in('_firsts', 'w')})"
        matched = f"if(_wordy AND NOT {words}, {none}, {matched})"
    return f"if({text} IS NULL, {none}, " + let("n", normalized(text), let("folded", fold("n.text", case_sensitive), matched)) + ")"


def _leftmost(group: pd.DataFrame) -> dict:
    """The places of a run that stay: from the left, none inside one before."""
    until, starts, ends = 0, [], []
    for start, end in zip(group["start"], group["end"]):
        if start >= until:
            until = end
            starts.append(start)
            ends.append(end)
    return {"start": starts, "end": ends}


def term_findings(texts: DataFrame, table: DataFrame, *, id_col: str, text_col: str = "text", salt: str | None = None,
                  original: bool = True) -> DataFrame:
    """(id, entity, start, end, score) of the terms of a `prepared` table, or with a salt of a `hashed` one, in every text.
    Each entity's terms are taken for themselves, as separate lists would be. `id_col` names one text. Without `original`
    positions are those of the normalized text, as `findings(external=)` takes them."""
    kind = texts.select(F.col(id_col)).schema[0].dataType.simpleString()
    out = None
    for case_sensitive in (False, True):
        own = table.filter(F.col("case_sensitive") == case_sensitive)
        if own.isEmpty():
            continue
        index = {"_keys": bitmap(own.select("key")), "_sizes": own.agg(F.array_sort(F.collect_set("units")))}
        if salt is None:
            index["_firsts"] = bitmap(own.select("first"))
            index["_wordy"] = own.agg(F.bool_and(F.expr("first rlike '(?U)^[^\\\\W_]+$'")))
        rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).withColumns({name: df.scalar() for name, df in index.items()})
        spans = F.expr(pinned(_spans("_text", case_sensitive, salt is None, salt, original)))
        found = rows.select("id", F.explode_outer(spans).alias("m")).filter("m IS NOT NULL").select("id", "m.*")
        hits = (found.withColumn("h", F.xxhash64("key")).join(own.select("entity", "key", F.xxhash64("key").alias("h")), ["h", "key"])
                .groupBy("id", "entity", "start").agg(F.max("end").alias("end"))
                .withColumn("case_sensitive", F.lit(case_sensitive)))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return texts.select(F.col(id_col), F.lit("").alias("entity"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(1.0).alias("score")).limit(0)
    of_list = Window.partitionBy("id", "entity", "case_sensitive")
    along = of_list.orderBy("start")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    run = out.withColumn("_new", (F.col("start") >= F.coalesce(reach, F.lit(0))).cast("int")).withColumn("run", F.sum("_new").over(along))
    run = run.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("id", "entity", "case_sensitive", "run")))
    several = grouped(run.filter("_size > 1").select("id", "entity", "case_sensitive", "run", "start", "end"), ["id", "entity", "case_sensitive", "run"],
                      ["start"], _leftmost, f"id {kind}, entity string, case_sensitive boolean, run bigint, start int, end int")
    settled = run.filter("_size = 1").select("id", "entity", "start", "end").unionByName(several.select("id", "entity", "start", "end"))
    return settled.select(F.col("id").alias(id_col), "entity", "start", "end", F.lit(1.0).alias("score")).distinct()


def collected(found: DataFrame, id_col: str, into: str) -> DataFrame:
    """(id, findings array) per text that has any, to be joined where texts are scanned with `findings(external=)`."""
    one: Column = F.struct("entity", "start", "end", "score")
    return found.groupBy(id_col).agg(F.array_sort(F.collect_list(one)).alias(into))
