"""Corporate dictionary: listed terms and patterns as recognizers.

Short lists become one alternation, longest term first. Long lists would make that regex slow, so the
text's word groups are looked up in a hash set instead; both stay inside the projection and both take the same
letters for equal, so that a term is found or not whatever the length of its list.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions.arrays import let, running_sum
from veilkit.functions.globs import literal
from veilkit.functions.normalize import among, normalized

ALTERNATION_LIMIT = 200
FEW_STARTS = 32
_WORD = r"[^\W_]"
UNITS = r"(?U)[^\W_]+|\s+|[\s\S]"


def fold_term(term: str, case_sensitive: bool = False) -> str:
    term = re.sub(r"\s+", " ", term.strip())
    return term if case_sensitive else term.replace("İ", "i").replace("I", "ı").lower()


def fold_sql(text: str, case_sensitive: bool = False) -> str:
    return text if case_sensitive else f"lower(translate({text}, 'İI', 'iı'))"


# characters that a case-insensitive pattern takes for the same letter although lower() keeps them apart
_SAME = {c: low for c in map(chr, range(0x80, 0x10000))
         if len(c.upper()) == 1 and len(low := c.upper().lower()) == 1 and low != c.lower()} | {"İ": "i", "I": "i", "ı": "i", "Σ": "σ"}
_SAME_FROM, _SAME_TO = "".join(_SAME), "".join(_SAME.values())


def match_term(term: str, case_sensitive: bool = False) -> str:
    """A listed term as it is compared with a text: what a case-insensitive pattern takes for equal is equal."""
    term = re.sub(r"\s+", " ", term.strip())
    return term if case_sensitive else term.translate(str.maketrans(_SAME)).lower()


# lower() alone does right by I; most texts have none of the others and skip the table
_SPECIAL = among([ord(c) for c in _SAME if c != "I"])


def match_sql(text: str, case_sensitive: bool = False) -> str:
    if case_sensitive:
        return text
    return f"lower(if({text} rlike {literal(_SPECIAL)}, translate({text}, {literal(_SAME_FROM)}, {literal(_SAME_TO)}), {text}))"


def _term_regex(term: str) -> str:
    out = []
    for ch in term:
        if ch == " ":
            out.append(r"\s+")
        elif ch in "iİıI":
            out.append("[iİıI]")
        else:
            out.append(ch if ch.isalnum() else re.sub(r"([^\w\s])", r"\\\1", ch))
    return "".join(out)


@dataclass(frozen=True)
class Entry:
    entity: str
    terms: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    label: str = ""
    case_sensitive: bool = False
    whole_word: bool = True

    def __post_init__(self):
        if not re.match(fixed.DICTIONARY_ENTITY_PATTERN, self.entity):
            raise ValueError(f"{self.entity}: dictionary entities start with {fixed.DICTIONARY_PREFIX}")
        if not self.terms and not self.patterns:
            raise ValueError(f"{self.entity}: terms or patterns needed")
        bad = [t for t in self.terms
               if not fixed.DICTIONARY_MIN_TERM_LEN <= len(t.strip()) <= fixed.DICTIONARY_MAX_TERM_LEN]
        if bad or len(self.terms) > fixed.DICTIONARY_MAX_TERMS:
            raise ValueError(f"{self.entity}: term length or number out of bounds")
        if any(re.search(p, "") for p in self.patterns):
            raise ValueError(f"{self.entity}: a pattern matches the empty text")

    @property
    def folded(self) -> list[str]:
        return sorted({match_term(t, self.case_sensitive) for t in self.terms}, key=lambda t: (-len(t), t))

    @property
    def uses_hash_set(self) -> bool:
        return self.whole_word and len(self.terms) > ALTERNATION_LIMIT

    def recognizers(self) -> list:
        from veilkit.operators.scan import Recognizer

        left, right = (f"(?<!{_WORD})", f"(?!{_WORD})") if self.whole_word else ("", "")
        out = []
        if self.terms and not self.uses_hash_set:
            regex = "|".join(map(_term_regex, self.folded)) if not self.case_sensitive else \
                "|".join(re.sub(r"([^\w\s])", r"\\\1", t).replace(" ", r"\s+") for t in self.folded)
            out.append(Recognizer(self.entity, f"{left}(?:{regex}){right}", not self.case_sensitive))
        out += [Recognizer(self.entity, f"{left}(?:{p}){right}", not self.case_sensitive) for p in self.patterns]
        return out


def _unit_count(term: str) -> int:
    return len(re.findall(r"[^\W_]+|\s+|[\s\S]", term))


def gram_matches(text: str, sizes: Sequence[int], test, case_sensitive: bool = False,
                 first_units: Sequence[str] = (), fold=fold_sql) -> str:
    """array<struct<start,end,score>> of word groups that pass `test` (SQL over the folded group), taken
    from the left, the longest group first at each position. `sizes` are the unit counts of the terms;
    `first_units`, where known, keep groups from being built at words no term starts with.

    Folding keeps every character's width, so the whole text is folded once.
    """
    group = "array_join(slice(norm, i + 1, k), '')"
    starts_ok = "u[i] rlike '(?U)\\\\S' AND NOT (coalesce(get(u, i - 1), '') rlike '(?U)[^\\\\W_]$')"
    if first_units:
        starts_ok = f"u[i] IN ({', '.join(map(literal, sorted(set(first_units))))}) AND {starts_ok}"
    ends_ok = "NOT (coalesce(get(u, i + k), '') rlike '^(?U)[^\\\\W_]')"
    ks = ", ".join(str(k) for k in sorted(set(sizes), reverse=True))
    longest = (f"get(filter(transform(filter(array({ks}), k -> i + k <= size(u) AND {ends_ok}), "
               f"k -> if({test(group)}, k, 0)), k -> k > 0), 0)")
    found = (f"filter(transform(filter(sequence(0, size(u) - 1), i -> {starts_ok}), i -> named_struct('i', i, 'k', "
             f"coalesce({longest}, 0))), m -> m.k > 0)")
    spans = ("transform(found, m -> named_struct('start', off[m.i], 'end', off[m.i + m.k - 1] + length(u[m.i + m.k - 1]), "
             "'score', 1.0D))")
    free = (f"aggregate({spans}, cast(array() AS array<struct<start:int,end:int,score:double>>), (acc, m) -> "
            "if(m.start < coalesce(element_at(acc, -1).end, 0), acc, array_append(acc, m)))")
    placed = let("found", found, f"if(size(found) = 0, cast(array() AS array<struct<start:int,end:int,score:double>>), "
                 + let("off", running_sum("transform(u, x -> length(x))"),
                       free.replace("element_at(acc, -1).end", "get(acc, size(acc) - 1).end")) + ")")
    none = "cast(array() AS array<struct<start:int,end:int,score:double>>)"
    units = f"regexp_extract_all(folded, {literal(UNITS)}, 0)"
    matched = let("u", units, f"if(size(u) = 0, {none}, "
                  + let("norm", "transform(u, x -> if(x rlike '^(?U)\\\\s', ' ', x))", placed) + ")")
    starts = sorted(set(first_units))
    if 0 < len(starts) <= FEW_STARTS:
        matched = f"if({' OR '.join(f'contains(folded, {literal(x)})' for x in starts)}, {matched}, {none})"
    elif starts and all(re.fullmatch(r"[^\W_]+", x) for x in starts):
        # most texts hold no word a term starts with: their distinct words decide that alone
        words = ", ".join(map(literal, starts))
        matched = f"if(exists(array_distinct(split(folded, '(?U)[\\\\W_]+')), w -> w IN ({words})), {matched}, {none})"
    return let("folded", fold(text, case_sensitive), matched)


def term_findings(entry: Entry, text: str) -> str:
    """Findings of a long term list: membership in a hash set the plan carries once."""
    options = ", ".join(map(literal, entry.folded))
    firsts = [re.match(r"[^\W_]+|[\s\S]", t).group(0) for t in entry.folded]
    found = gram_matches(text, [_unit_count(t) for t in entry.folded], lambda g: f"{g} IN ({options})",
                         entry.case_sensitive, firsts, match_sql)
    return f"transform({found}, f -> named_struct('entity', {literal(entry.entity)}, 'start', f.start, 'end', f.end, 'score', f.score))"


def hashed_term_findings(entity: str, hashes: Sequence[str], sizes: Sequence[int], salt: str, text: str,
                         case_sensitive: bool = False) -> Column:
    """Match salted hash prefixes of folded word groups, for a list kept without its clear terms."""
    options = ", ".join(map(literal, sorted(set(hashes))))

    def test(group: str) -> str:
        return f"substr(sha2(concat({literal(salt)}, '\\n', {group}), 256), 1, {fixed.TERM_HASH_HEX}) IN ({options})"

    body = gram_matches("n.text", sizes, test, case_sensitive)
    placed = (f"transform({body}, f -> named_struct('entity', {literal(entity)}, 'start', "
              "if(n.index IS NULL, f.start, n.index[f.start]), 'end', "
              "if(n.index IS NULL, f.end, n.index[f.end - 1] + 1), 'score', f.score))")
    return F.expr(let("n", normalized(f"`{text}`"), placed))


def term_hashes(terms: DataFrame, salt: str) -> DataFrame:
    """(entity, term, case_sensitive) -> salted hash prefix and unit count, without the clear term."""
    folded = F.expr("if(case_sensitive, regexp_replace(trim(term), '(?U)\\\\s+', ' '), "
                    + fold_sql("regexp_replace(trim(term), '(?U)\\\\s+', ' ')") + ")")
    return terms.withColumn("_f", folded).select(
        "entity", F.substring(F.sha2(F.concat(F.lit(salt + "\n"), "_f"), 256), 1, fixed.TERM_HASH_HEX).alias("hash"),
        F.expr(f"size(regexp_extract_all(_f, {literal(UNITS)}, 0))").alias("units")).distinct()


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """One term per line; blank lines and `#` comments are dropped."""
    return (spark.read.text(path).select(F.trim("value").alias("term"))
            .filter((F.col("term") != "") & ~F.col("term").startswith("#")))


def entries_from_terms(terms: DataFrame, entity: str, **options) -> Entry:
    """A bounded term table as configuration (checked against the term limit before it is collected)."""
    rows = terms.select("term").distinct().limit(fixed.DICTIONARY_MAX_TERMS + 1).collect()
    return Entry(entity, tuple(sorted(r.term for r in rows)), **options)


def describe(terms: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Per entity how many terms and patterns there are; never the terms themselves."""
    rows = terms.select("entity", F.lit(1).alias("terms"), F.lit(0).alias("patterns"))
    if patterns is not None:
        rows = rows.unionByName(patterns.select("entity", F.lit(0).alias("terms"), F.lit(1).alias("patterns")))
    return rows.groupBy("entity").agg(F.sum("terms").alias("terms"), F.sum("patterns").alias("patterns"))


def labels(entries: Sequence[Entry]) -> Mapping[str, str]:
    return {e.entity: e.label for e in entries if e.label}
