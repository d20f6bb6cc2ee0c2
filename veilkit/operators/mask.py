"""Reversible masking: placeholders per scope, replacement in text, and the way back.

A scope (request, conversation, user) shares one vault: the same value gets the same placeholder in all
its parts. Only findings are shuffled to number them, never texts; texts meet their replacements once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions.arrays import let
from veilkit.functions.globs import any_glob, literal
from veilkit.functions.values import alnum, canonical_value
from veilkit.operators.ordered import range_buckets, row_numbers
from veilkit.operators.term_table import bitmap, in_bitmap
from veilkit.session import materialize

SPANS_TYPE = "array<struct<start:int,end:int,replacement:string>>"
_DENSE = 64
_LONGEST = 26  # letters and digits of a number, an IBAN's
_PLACES = 1 << 24


def apply_spans(text: str, spans: str) -> str:
    """The text with sorted, non-overlapping spans replaced. Many spans cut a character array instead of
    the string, whose positions cost a walk from the start each."""
    def cut(source: str) -> str:
        def piece(lo: str, hi: str) -> str:
            return f"substr({source}, {lo} + 1, {hi} - {lo})" if source != "ch" else \
                f"array_join(slice(ch, {lo} + 1, {hi} - {lo}), '')"
        body = (f"flatten(transform(sp, (s, i) -> array({piece('coalesce(get(sp, i - 1).end, 0)', 's.start')}, "
                "s.replacement)))")
        size = "size(ch)" if source == "ch" else f"length({source})"
        return f"concat(array_join({body}, ''), {piece('sp[size(sp) - 1].end', size)})"

    return let("sp", spans, f"CASE WHEN size(sp) = 0 THEN {text} WHEN size(sp) <= {_DENSE} THEN {cut(text)} ELSE "
               + let("ch", f"split({text}, '')", cut("ch")) + " END")


def redact(text: str, findings: str, entities: str) -> Column:
    """Irreversible: findings of the listed entities become a fixed token."""
    before, after = fixed.REDACTED_FORMAT.split("{}")
    spans = (f"transform(filter({findings}, f -> array_contains({entities}, f.entity)), f -> named_struct('start', f.start, "
             f"'end', f.end, 'replacement', concat({literal(before)}, f.entity, {literal(after)})))")
    return F.expr(apply_spans(f"`{text}`", spans))


def selected(findings: str, entities: Sequence[str] | str | None) -> str:
    """Findings to mask: all, those matching glob patterns, or those in an array column (by name)."""
    if entities is None:
        return findings
    if isinstance(entities, str):
        return f"filter({findings}, f -> array_contains({entities}, f.entity))"
    return f"filter({findings}, f -> {any_glob('f.entity', entities)})"


def finding_values(df: DataFrame, scope: Sequence[str], part: str, *, text: str = "text", findings: str = "findings",
                   entities: Sequence[str] | str | None = None) -> DataFrame:
    """(scope, part, start, end, entity, value, canon), one row per finding to mask."""
    value = f"substr(`{text}`, f.start + 1, f.end - f.start)"
    packed = (f"transform({selected('`' + findings + '`', entities)}, f -> named_struct('start', f.start, 'end', f.end, "
              f"'entity', f.entity, 'value', {value}))")
    rows = df.select(*scope, F.col(part).alias("part"), F.inline_outer(F.expr(packed))).filter("entity IS NOT NULL")
    return rows.withColumn("canon", F.expr(canonical_value("entity", "value")))


def assign_placeholders(values: DataFrame, scope: Sequence[str], *, known: DataFrame | None = None,
                        start: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """The vault rows of new values: (scope, entity, canon, original, n, placeholder).

    Numbers follow first appearance within (scope, entity). `known` rows keep their placeholder and new
    numbers continue after them; `start` (scope, entity, n) raises the first number. Distinct values are
    pre-aggregated, then numbered range by range of the parts, so a scope with a third of all values still
    spreads, whatever type the parts' ids have and however sparse they are.
    """
    keys = [*scope, "entity", "canon"]
    firsts = (values.groupBy(*keys).agg(F.min(F.struct("part", "start", "value")).alias("_first"))
              .select(*keys, F.col("_first.part").alias("_part"), F.col("_first.start").alias("_start"),
                      F.col("_first.value").alias("original")))
    offsets = start
    if known is not None:
        firsts = firsts.join(known.select(*keys), keys, "left_anti")
        used = known.groupBy(*scope, "entity").agg(F.max("n").alias("n"))
        offsets = used if start is None else start.unionByName(used)
    firsts = range_buckets(firsts, ["_part", "_start"], "_range", ranges)
    numbered = row_numbers(firsts, [*scope, "entity"], ["_part", "_start"], F.col("_range"), "n")
    if offsets is not None:
        top = offsets.groupBy(*scope, "entity").agg(F.max("n").alias("_offset"))
        numbered = (numbered.join(top, [*scope, "entity"], "left")
                    .withColumn("n", F.col("n") + F.coalesce("_offset", F.lit(0))))
    return numbered.select(*keys, "original", "n",
                           F.concat(F.lit("["), "entity", F.lit("_"), F.col("n").cast("string"), F.lit("]")).alias("placeholder"))


def numbers_in_text(df: DataFrame, scope: Sequence[str], text: str = "text") -> DataFrame:
    """Highest placeholder number already present per (scope, entity): numbering continues after it."""
    tokens = F.expr(f"regexp_extract_all(`{text}`, '\\\\[[A-Z][A-Z0-9_]*_\\\\d+\\\\]', 0)")
    return (df.select(*scope, F.explode(tokens).alias("_t"))
            .select(*scope, F.regexp_extract("_t", r"^\[(.*)_\d+\]$", 1).alias("entity"),
                    F.regexp_extract("_t", r"_(\d+)\]$", 1).cast("bigint").alias("_n"))
            .groupBy(*scope, "entity").agg(F.max("_n").alias("n")))


def replacements(values: DataFrame, vault: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, part) -> the spans of that part with their placeholders, in order."""
    return (values.join(vault.select(*scope, "entity", "canon", "placeholder"), [*scope, "entity", "canon"])
            .groupBy(*scope, "part")
            .agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("placeholder").alias("replacement")))).alias("spans")))


def mask_texts(df: DataFrame, spans: DataFrame, scope: Sequence[str], part: str, *, text: str = "text",
               into: str = "masked") -> DataFrame:
    """Texts without a span keep their text; a part's spans are bounded by its own findings."""
    joined = df.join(spans.withColumnRenamed("part", part), [*scope, part], "left")
    none = f"cast(array() AS {SPANS_TYPE})"
    return joined.withColumn(into, F.expr(apply_spans(f"`{text}`", f"coalesce(spans, {none})"))).drop("spans")


def mask_scope(df: DataFrame, scope: Sequence[str], part: str, *, text: str = "text", findings: str = "findings",
               entities: Sequence[str] | str | None = None, known: DataFrame | None = None,
               start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Masked texts (without the findings) and the vault. The found values, a small table, are
    checkpointed: numbering and replacing both read them, and the texts are scanned once."""
    values = materialize(finding_values(df, scope, part, text=text, findings=findings, entities=entities))
    fresh = assign_placeholders(values, scope, known=known, start=start)
    vault = fresh if known is None else known.select(*fresh.columns).unionByName(fresh)
    return mask_texts(df.drop(findings), replacements(values, vault, scope), scope, part, text=text), vault


def mask_row(texts: str, part_findings: str, wanted: str) -> str:
    """Mask the texts of one row (a request) with one vault, inside the row: nothing is shuffled.

    struct<masked array<string>, vault array<struct<entity,n,canon,original,placeholder>>>. `wanted` is an
    SQL condition over `f.entity`. Numbers are positions among the distinct values of each type.
    """
    value = f"substr({texts}[i], f.start + 1, f.end - f.start)"
    picked = (f"transform({part_findings}, (fs, i) -> transform(filter(fs, f -> {wanted}), f -> named_struct('start', f.start, "
              f"'end', f.end, 'entity', f.entity, 'value', {value}, 'canon', {canonical_value('f.entity', value)})))")
    names = ("map_from_arrays(es, transform(es, e -> array_distinct(transform(filter(seen, x -> x.entity = e), x -> x.canon))))")
    token = "concat('[', f.entity, '_', array_position(names[f.entity], f.canon), ']')"
    spans = f"transform(fs, f -> named_struct('start', f.start, 'end', f.end, 'replacement', {token}))"
    masked = f"transform(pf, (fs, n) -> {let('tx', texts + '[n]', apply_spans('tx', spans))})"
    first = "get(filter(seen, x -> x.entity = e AND x.canon = c), 0).value"
    vault = (f"flatten(transform(es, e -> transform(names[e], (c, j) -> named_struct('entity', e, 'n', j + 1, 'canon', c, "
             f"'original', {first}, 'placeholder', concat('[', e, '_', j + 1, ']')))))")
    result = f"named_struct('masked', {masked}, 'vault', {vault})"
    return let("pf", picked, let("seen", "flatten(pf)", let(
        "es", "array_distinct(transform(seen, x -> x.entity))", let("names", names, result))))


def token_pieces(text: str) -> str:
    return f"split(regexp_replace({text}, {literal(fixed.PLACEHOLDER_PATTERN)}, '\\u0001$0\\u0001'), '\\u0001', -1)"


def unmask(df: DataFrame, vault: DataFrame, scope: Sequence[str], key: Sequence[str], *, text: str = "text",
           into: str = "unmasked") -> DataFrame:
    """Placeholders back to originals by a join on (scope, placeholder); unknown ones stay as they are.
    `key` identifies a row. Only the distinct tokens of a text travel to the join."""
    tokens = F.expr(f"array_distinct(regexp_extract_all(`{text}`, {literal(fixed.PLACEHOLDER_PATTERN)}, 0))")
    used = list(dict.fromkeys([*scope, *key]))
    found = (df.select(*used, F.explode(tokens).alias("placeholder"))
             .join(vault.select(*scope, "placeholder", "original"), [*scope, "placeholder"])
             .groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original"))).alias("_map")))
    rebuilt = (f"if(_map IS NULL, `{text}`, array_join(transform({token_pieces('`' + text + '`')}, "
               "(p, i) -> if(i % 2 = 1, coalesce(_map[p], p), p)), ''))")
    return df.join(found, list(key), "left").withColumn(into, F.expr(rebuilt)).drop("_map")


def _number_groups(df: DataFrame, text: str, numbers: DataFrame) -> DataFrame:
    """(columns of df without the text, i, k, canon): k runs of letters and digits from run i on that single separators
    join to a value of `numbers`, or to one that shares its place in a bitmap of fixed size.

    One pattern lists what may follow each run; groups are cut from it as rows, where code is generated, and most are left
    out by the lengths of the numbers and by the bitmap before anything is shuffled. Both come as scalar subqueries.
    """
    run = "[0-9A-Za-z]{1,26}+(?![0-9A-Za-z])"
    chains = f"regexp_extract_all(`{text}`, '(?=((?:{run}(?:[ .\\\\-]{run}){{0,25}})?))[0-9A-Za-z]+', 1)"
    rows = (df.select(*[c for c in df.columns if c != text], F.posexplode(F.expr(chains)).alias("i", "_c"))
            # 52 characters hold 27 letters and digits or more, so a group that ends in a cut run is too long
            .withColumn("_c", F.expr(f"upper(translate(substr(_c, 1, {2 * _LONGEST}), '.-', '  '))")).filter("_c <> ''")
            .select("*", F.explode(F.expr(f"sequence(1, least({_LONGEST}, 1 + length(_c) - length(replace(_c, ' ', ''))))")).alias("k"))
            .withColumn("canon", F.expr("replace(substring_index(_c, ' ', k), ' ', '')")).drop("_c"))
    lengths = numbers.filter(f"length(canon) <= {_LONGEST}").agg(F.bit_or(F.expr("shiftleft(1, length(canon))"))).scalar()
    known = bitmap(numbers.select("canon"), _PLACES).scalar()
    return (rows.filter(F.expr(f"length(canon) BETWEEN 5 AND {_LONGEST}")).filter(F.getbit(lengths, F.length("canon")) == 1)
            .filter(in_bitmap(known, F.col("canon"), _PLACES)))


def unmask_surrogates(df: DataFrame, vault: DataFrame, scope: Sequence[str], key: Sequence[str], *, text: str = "text",
                      into: str = "unmasked") -> DataFrame:
    """Surrogates back to originals, also where a number was respelled with single separators.

    The text's runs of letters and digits are joined into every group of at most 26 characters; groups
    meet the vault's surrogates by equality, so no pattern is built from a scope's whole vault. The
    leftmost, then longest group wins. `df` and `vault` are read several times.
    """
    used = list(dict.fromkeys([*scope, *key]))
    mark = F.xxhash64(F.col(text)).alias("_t")  # rows may share a key: a hit belongs to its own text
    numbers = vault.filter("NOT startswith(placeholder, '[') AND NOT contains(placeholder, '@')")
    numbers = numbers.select(*scope, F.expr(alnum("placeholder")).alias("canon"), "original")
    groups = _number_groups(df.select(*used, mark, F.col(text).alias("_text")), "_text", numbers)
    hits = (groups.join(numbers, [*scope, "canon"])
            .groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", F.expr("-k").alias("k"), "original", "_t"))).alias("_h")))
    own = f"filter(_h, h -> h._t = xxhash64(`{text}`))"
    free = f"aggregate({own}, slice(_h, 1, 0), (a, h) -> if(h.i < coalesce(get(a, size(a) - 1).i - get(a, size(a) - 1).k, 0), a, array_append(a, h)))"
    emails = vault.filter("NOT startswith(placeholder, '[') AND contains(placeholder, '@')").select(
        *scope, F.col("placeholder").alias("_mail"), "original")
    mail_token = literal(fixed.SURROGATE_EMAIL_PREFIX.replace(".", "\\.") + "[0-9a-f]{6}@"
                         + fixed.SURROGATE_EMAIL_DOMAIN.replace(".", "\\."))
    mail = (df.select(*used, F.explode(F.expr(f"array_distinct(regexp_extract_all(`{text}`, {mail_token}, 0))")).alias("_mail"))
            .join(emails, [*scope, "_mail"]).groupBy(*key)
            .agg(F.map_from_entries(F.collect_list(F.struct("_mail", "original"))).alias("_mails")))
    # cut before each run: a piece is a run and what follows it, the first may have no run
    pieces = f"split(`{text}`, '(?<![0-9A-Za-z])(?=[0-9A-Za-z])', -1)"
    at = f"j - if(`{text}` rlike '^[0-9A-Za-z]', 0, 1)"
    put = ("if(h IS NULL, x, concat(if(r = h.i, coalesce(h.original, ''), ''), "
           "if(r = h.i - h.k - 1, regexp_replace(x, '^[0-9A-Za-z]+', ''), '')))")
    placed = let("r", at, let("h", "get(filter(_f, h -> h.i <= r AND r < h.i - h.k), 0)", put))
    rebuilt = f"array_join(transform({pieces}, (x, j) -> {placed}), '')"
    numbered = (df.join(hits, list(key), "left")
                .withColumn("_f", F.expr(f"if(_h IS NULL, NULL, {free})"))
                .withColumn("_n", F.expr(f"if(_h IS NULL, `{text}`, {rebuilt})")))
    split_mail = f"split(regexp_replace(_n, {mail_token}, '\\u0001$0\\u0001'), '\\u0001', -1)"
    return (numbered.join(mail, list(key), "left")
            .withColumn(into, F.expr(f"if(_mails IS NULL, _n, array_join(transform({split_mail}, (p, i) -> "
                                     "if(i % 2 = 1, coalesce(_mails[p], p), p)), ''))"))
            .drop("_h", "_f", "_n", "_mails"))


def partial_holdback(text: str, *, placeholders: bool = True, tokens: bool = True) -> Column:
    """Characters to keep back at the end of streamed text: an unfinished placeholder, number or word."""
    parts = ["0"]
    if placeholders:
        parts.append(f"length(regexp_extract(`{text}`, {literal('(' + fixed.PARTIAL_PLACEHOLDER + ')')}, 1))")
    if tokens:
        parts.append(f"length(regexp_extract(`{text}`, {literal('(?Ui)(' + fixed.PARTIAL_TOKEN + ')')}, 1))")
    return F.expr(f"least({fixed.STREAM_HOLDBACK}, greatest({', '.join(parts)}))") if len(parts) > 1 else F.lit(0)
