"""Secret scans, by SQL functions alone: fixed patterns plus a battery of randomness tests.

Base spans come from three patterns (a keyword with an assigned value, access keys, long hexadecimal runs),
each leftmost and non-overlapping, failing matches dropped. The battery then looks at every other run of
`TOKEN_MIN` or more characters of [A-Za-z0-9+/_-] that touches no base span, infers its encoding (hexadecimal,
base 32, one-case base 36, base 62, base 64) and measures the symbols' indices in that alphabet:

- chi-squared of the symbol counts against uniformity of the alphabet;
- the number of runs above and below the alphabet's middle;
- the serial correlation of neighbouring indices.

A token is a candidate if none of the three rejects randomness (one per cent, chi-squared from above, the others
from both sides). Short tokens pass such tests easily, so each also gets a p-value for "ordinary text of this
length looks as even as this", from the non-central chi-squared that the coincidence rate of written language
implies; it falls with the length. Within a document the Benjamini-Hochberg step-up rule over all tested tokens,
each weighted by its length over their mean length, holds the share of false discoveries at `FDR`. Discoveries
become spans of kind `random`; base spans stay as they are.

Positions are code points, end exclusive. Null and empty texts have no spans. Empty input gives an empty result.
Every row is judged by itself, so repeated rows and ties in doc_id change nothing; only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilkit.functions.arrays import let, running_sum
from veilkit.functions.globs import literal
from veilkit.llm.frames import free_name

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEYWORD = r"""^(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 characters: within a shorter run none can be longer
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN_MIN = 20
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}"
FDR = 0.01
LIMIT = 2.576  # two-sided one per cent
LIMIT_ABOVE = 2.326

#: inferred encodings, first that fits: pattern of a whole token, folded to lower case, symbols in index order
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", True, "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+$", True, "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", True, "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[0-9A-Za-z]+$", False, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "", False, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: two symbols of ordinary text agree this often, or by this factor more often than evenly spread ones
COINCIDENCE, FACTOR = 0.065, 1.8

_SPANS = "array<struct<s:int,e:int,k:int,m:string>>"
_FENCE = "\\u0001"


def _matches(text: str, pattern: str, kind: int) -> str:
    """Spans (s, e, k, m) of a pattern: fence every match, split, add up lengths. A fence character in the text
    itself is replaced by another control character, which no pattern knows either."""
    cut = f"split(regexp_replace(translate({text}, '{_FENCE}', '\\u0002'), {literal(pattern)}, '{_FENCE}$0{_FENCE}'), '{_FENCE}', -1)"
    spans = let("off", running_sum("transform(ps, p -> length(p))"),
                f"transform(sequence(1, size(ps) - 2, 2), i -> named_struct('s', off[i], 'e', off[i] + length(ps[i]), 'k', {kind}, 'm', ps[i]))")
    return f"if({text} rlike {literal(pattern)}, {let('ps', cut, spans)}, cast(array() AS {_SPANS}))"


def _encoded(token: str) -> str:
    """(encoding, alphabet, folded token)."""
    cases = "".join(
        (f" WHEN {token} rlike {literal(pattern)} THEN " if pattern else " ELSE ")
        + f"named_struct('name', '{name}', 'abc', '{abc}', 'w', {f'lower({token})' if fold else token})"
        for name, pattern, fold, abc in ENCODINGS)
    return f"CASE{cases} END"


def _battery(token: str) -> str:
    """The tests of one token: a struct of the encoding, the statistics' normal scores, whether the token passes,
    and the p-value under ordinary text."""
    indices = "transform(split(enc.w, ''), c -> cast(instr(enc.abc, c) - 1 AS double))"
    squares = ("aggregate(split(enc.abc, ''), 0D, (t, c) -> t + pow(length(enc.w) - length(replace(enc.w, c, '')), 2))")
    steps = "sequence(1, size(x) - 1)"
    stats = ("named_struct('n', cast(size(x) AS double), 'a', cast(length(enc.abc) AS double), "
             f"'sq', {squares}, "
             "'up', cast(size(filter(x, v -> 2 * v >= length(enc.abc))) AS double), "
             f"'turns', cast(size(filter({steps}, i -> (2 * x[i] >= length(enc.abc)) <> (2 * x[i - 1] >= length(enc.abc)))) AS double), "
             "'mean', aggregate(x, 0D, (t, v) -> t + v) / size(x))")
    moments = ("named_struct('chi', st.a / st.n * st.sq - st.n, "
               "'lam', (st.n - 1) * (greatest(st.a * %s, %s) - 1), "
               "'mu', 1 + 2 * st.up * (st.n - st.up) / st.n, "
               "'ss', aggregate(x, 0D, (t, v) -> t + pow(v - st.mean, 2)), "
               "'sp', aggregate(%s, 0D, (t, i) -> t + (x[i] - st.mean) * (x[i - 1] - st.mean)))" % (COINCIDENCE, FACTOR, steps))
    scores = ("named_struct('encoding', enc.name, 'n', st.n, "
              "'chi', (mo.chi - (st.a - 1)) / sqrt(2 * (st.a - 1)), "
              "'runs', if(mo.mu <= 2, 99D, (st.turns + 1 - mo.mu) / sqrt((mo.mu - 1) * (mo.mu - 2) / (st.n - 1))), "
              "'serial', if(mo.ss = 0, 99D, (mo.sp / mo.ss + 1 / st.n) * sqrt(st.n)), "
              "'text', (st.a - 1 + mo.lam - mo.chi) / sqrt(2 * (st.a - 1) + 4 * mo.lam))")
    passes = f"(sc.chi <= {LIMIT_ABOVE} AND abs(sc.runs) <= {LIMIT} AND abs(sc.serial) <= {LIMIT})"
    # the normal upper tail by its logistic approximation
    tail = "1 / (1 + exp(least(1.5976 * sc.text + 0.07056 * pow(sc.text, 3), 700D)))"
    result = ("named_struct('encoding', sc.encoding, 'n', sc.n, 'chi', sc.chi, 'runs', sc.runs, 'serial', sc.serial, "
              f"'passes', {passes}, 'p', if({passes}, {tail}, 1D))")
    return let("enc", _encoded(token), let("x", indices, let("st", stats, let("mo", moments, let("sc", scores, result)))))


def _discovered(tokens: str, fdr: float) -> str:
    """Weighted step-up rule: of structs (..., t) the ones at or below the largest ranked ratio that holds."""
    mean = "aggregate(tk, 0D, (t, v) -> t + v.t.n) / size(tk)"
    ratios = "array_sort(transform(tk, v -> v.t.p * mean / v.t.n))"
    bound = f"array_max(transform(qs, (q, i) -> if(q <= (i + 1) * {fdr}D / size(qs), q, -1D)))"
    return let("tk", tokens, f"if(size(tk) = 0, tk, "
               + let("mean", mean, let("qs", ratios, let("lim", bound, "filter(tk, v -> v.t.p * mean / v.t.n <= lim)"))) + ")")


def _spans(text: str, token_min: int, fdr: float) -> str:
    assigned = f"filter({_matches(text, ASSIGN, 0)}, x -> length(regexp_replace(x.m, {literal(KEYWORD)}, '')) >= 8)"
    base = f"concat({assigned}, {_matches(text, ACCESS, 1)}, {_matches(text, HEX, 2)})"
    apart = f"filter({_matches(text, TOKEN % token_min, 3)}, x -> NOT exists(base, b -> b.s < x.e AND x.s < b.e))"
    tested = f"transform({apart}, x -> named_struct('s', x.s, 'e', x.e, 'k', 3, 't', {_battery('x.m')}))"
    slim = "transform({}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e{}))"
    return let("base", base, "named_struct('base', array_sort(" + slim.format("base", "") + "), 'more', "
               + slim.format(_discovered(tested, fdr), ", 'encoding', x.t.encoding, 'p', x.t.p") + ")")


def with_secrets(docs: DataFrame, *, text_col: str = "text", into: str = "secrets", token_min: int = TOKEN_MIN,
                 fdr: float = FDR) -> DataFrame:
    """All columns and `into`: a struct of `base`, spans (s, k, e) by start then kind, and `more`, discovered
    spans (s, k, e, encoding, p). k numbers KINDS."""
    text = free_name(docs, "scanned_text")
    # kept where it is by a condition that always holds: Catalyst would run the scan again for every use of its result
    found = F.expr(f"if(rand(1) + 1 >= 0, {_spans(text, token_min, fdr)}, NULL)")
    return docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumn(into, found).drop(text)


def _listed(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat_ws(':', {names}[x.k], x.s, x.e)), ',')"


def secret_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = with_secrets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), into="f")
    both = "array_sort(concat(f.base, transform(f.more, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))))"
    counts = [F.expr(f"cast(size(filter(f.base, x -> x.k = {k})) AS bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return found.select(F.col("id").alias(id_col), *counts, F.expr(f"sha2({_listed('f.base')}, 256)").alias("base_sha256"),
                        F.expr(_listed(both)).alias("spans"))


def redacted(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same columns, every span of the text replaced by `mark`; touching and overlapping spans by one."""
    names = docs.columns
    own = free_name(docs, "found_secrets")
    found = with_secrets(docs, text_col=text_col, into=own)
    spans = f"array_sort(concat({own}.base, transform({own}.more, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))))"
    # left to right: text so far, end of the last span
    walked = (f"aggregate({spans}, named_struct('out', cast(array() AS array<string>), 'at', 0), (acc, x) -> "
              f"named_struct('out', if(x.s >= acc.at AND (x.s > acc.at OR acc.at = 0), "
              f"concat(acc.out, array(substring(`{text_col}`, acc.at + 1, x.s - acc.at), {literal(mark)})), acc.out), 'at', greatest(acc.at, x.e)))")
    text = f"if(size({spans}) = 0, `{text_col}`, {let('wk', walked, f'concat(array_join(wk.out, ' + chr(39) * 2 + f'), substring(`{text_col}`, wk.at + 1))')})"
    return found.withColumn(text_col, F.expr(text)).select(*[F.col(f"`{c}`") for c in names])
