"""Checksums and value tests as Spark SQL over a candidate string."""

from __future__ import annotations

import sys
import unicodedata

from veilkit import fixed
from veilkit.functions.arrays import let
from veilkit.functions.globs import literal

# every decimal digit of Unicode next to its ASCII value (built from the character database)
_DIGITS = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.decimal(chr(c), None) is not None]
_UNICODE_DIGITS = literal("".join(_DIGITS))
_ASCII_DIGITS = literal("".join(str(unicodedata.decimal(d)) for d in _DIGITS))


def ascii_digits(value: str) -> str:
    """Unicode digits written as ASCII; only values that have any pay for the translation."""
    return (f"if({value} rlike '[^\\\\x00-\\\\x7F]', translate({value}, {_UNICODE_DIGITS}, {_ASCII_DIGITS}), {value})")


def digits(value: str) -> str:
    return ascii_digits(f"regexp_replace({value}, '(?U)\\\\D', '')")


def _digit_array(value: str) -> str:
    return f"transform(split({digits(value)}, ''), c -> cast(c AS int))"


def _total(arr: str) -> str:
    return f"aggregate({arr}, 0, (t, x) -> t + x)"


def is_tckn(value: str) -> str:
    """The tenth digit checks seven times the odd places less the even ones, the eleventh checks all ten."""
    place = [f"(n div {10 ** (10 - i)} % 10)" for i in range(11)]
    tenth = f"pmod(7 * ({' + '.join(place[:9:2])}) - ({' + '.join(place[1:9:2])}), 10)"
    return let("s", digits(value), "if(length(s) = 11, " + let("n", "cast(s AS bigint)", (
        f"(n >= {10 ** 10} AND {place[9]} = {tenth} AND {place[10]} = ({' + '.join(place[:10])}) % 10)")) + ", false)")


def is_vkn(value: str) -> str:
    """Each of nine digits is shifted by its place, weighted by a power of two and reduced modulo nine
    (a shifted digit other than zero counts nine instead of zero)."""
    weighted = "(x * shiftleft(1, 9 - i)) % 9"
    terms = ("transform(transform(slice(d, 1, 9), (c, i) -> (c + 9 - i) % 10), "
             f"(x, i) -> if(x <> 0 AND {weighted} = 0, 9, {weighted}))")
    return let("d", _digit_array(value), f"(size(d) = 10 AND (10 - {_total(terms)} % 10) % 10 = d[9])")


def is_tr_iban(value: str) -> str:
    compact = ascii_digits(f"upper(regexp_replace({value}, '(?U)\\\\s', ''))")
    remainder = "cast(concat(substr(s, 5, 22), '2927', substr(s, 3, 2)) AS decimal(38, 0)) % 97 = 1"
    return let("s", compact, f"(s rlike '^TR[0-9]{{24}}$' AND {remainder})")


def is_luhn(value: str) -> str:
    return let("s", digits(value), "(length(s) BETWEEN 13 AND 19 AND luhn_check(s))")


def looks_like_password(value: str) -> str:
    """Not a keyword, a code reference, one repeated character, a dotted name, a call or a placeholder."""
    bare = f"regexp_replace({value}, '^[\"\\'`]+|[\"\\'`]+$', '')"
    words = ", ".join(literal(w) for w in fixed.NOT_PASSWORDS)
    tests = [
        f"lower(v) NOT IN ({words})",
        f"NOT v rlike {literal('(?i)' + fixed.CODE_REFERENCE)}",
        "size(array_distinct(split(v, ''))) > 1",
        r"NOT v rlike '^[A-Za-z_]\\w*(?:\\.\\w+)+$'",
        "NOT contains(v, '(')",
        r"NOT v rlike '^[A-Z]\\w*\\[.*\\]$'",
        r"NOT v rlike '^\\[[A-Z_]+_\\d+\\]$'",
    ]
    return let("v", bare, "(" + " AND ".join(tests) + ")")


VALIDATORS = {"tckn": is_tckn, "vkn": is_vkn, "iban": is_tr_iban, "luhn": is_luhn, "password": looks_like_password}
