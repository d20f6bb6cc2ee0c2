"""Text as the recognizers see it: invisible characters dropped, compatibility characters folded.

Spark has no NFKC function, so the mapping is derived once from the character database:
characters that fold to one character go through `translate`; the few that vanish or expand need an
index back to the original positions. ASCII rows and rows of ordinary letters skip all of it.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from veilkit import fixed
from veilkit.functions.arrays import let
from veilkit.functions.globs import literal


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


def _escape(point: int) -> str:
    return f"\\x{{{point:X}}}"


def _char_class(points: list[int]) -> str:
    return "".join(_escape(a) if a == b else f"{_escape(a)}-{_escape(b)}" for a, b in _ranges(points))


def among(points: list[int]) -> str:
    """A pattern for one of these characters beyond ASCII; the intersection rejects ASCII on its first comparison."""
    return f"[{_escape(0x80)}-{_escape(sys.maxunicode)}&&[{_char_class(sorted(points))}]]"


@lru_cache(maxsize=1)
def _tables():
    invisible = {p for lo, hi in fixed.INVISIBLE_RANGES for p in range(lo, hi + 1)}
    single, expanding, stable = {}, {}, []
    for p in range(0x80, sys.maxunicode + 1):
        ch = chr(p)
        if p in invisible or 0xD800 <= p <= 0xDFFF:
            continue
        folded = unicodedata.normalize("NFKC", ch)
        if folded == ch:
            stable.append(p)
        elif len(folded) == 1:
            single[ch] = folded
        else:
            expanding[ch] = folded
    # common scripts, long runs only: a short character class keeps the gate cheap
    blocks = [(0xA1, 0x24F), (0x370, 0x52F), (0x5D0, 0x6FF), (0x2010, 0x20BF), (0x3041, 0x30FF), (0x4E00, 0x9FFF),
              (0xAC00, 0xD7A3)]
    runs = [(a, b) for a, b in _ranges([p for p in stable if any(lo <= p <= hi for lo, hi in blocks)]) if b - a >= 3]
    plain = "".join(f"{_escape(a)}-{_escape(b)}" for a, b in runs)
    return invisible, single, expanding, plain


def needs_normalizing(text: str) -> str:
    # the intersection rejects ASCII characters on its first comparison
    return f"{text} rlike {literal(f'[{_escape(0x80)}-{_escape(sys.maxunicode)}&&[^{_tables()[3]}]]')}"


def _is_irregular(text: str) -> str:
    invisible, _, expanding, _ = _tables()
    irregular = _char_class(sorted(invisible | {ord(c) for c in expanding}))
    return f"{text} rlike {literal(f'[{_escape(0x80)}-{_escape(sys.maxunicode)}&&[{irregular}]]')}"


def _folded(text: str) -> str:
    _, single, _, _ = _tables()
    return f"translate({text}, {literal(''.join(single))}, {literal(''.join(single.values()))})"


def _expansions() -> str:
    _, _, expanding, _ = _tables()
    return f"map_from_arrays(split({literal(chr(1).join(expanding))}, '\\u0001'), " \
           f"split({literal(chr(1).join(expanding.values()))}, '\\u0001'))"


def normalized(text: str) -> str:
    """struct<text string, index array<int>>: `index` (NULL when positions are unchanged) gives the
    original position of every character of `text`."""
    plain = f"named_struct('text', {text}, 'index', cast(NULL AS array<int>))"
    pieces = (f"transform(split(nt, ''), c -> if({_is_irregular('c')}, coalesce({_expansions()}[c], ''), c))")
    indexed = let("np", pieces, "named_struct('text', array_join(np, ''), 'index', "
                                "flatten(transform(np, (c, i) -> array_repeat(i, length(c)))))")
    changed = let("nt", _folded(text), f"if({_is_irregular('nt')}, {indexed}, "
                                       "named_struct('text', nt, 'index', cast(NULL AS array<int>)))")
    return f"if({needs_normalizing(text)}, {changed}, {plain})"


def normalized_text(text: str) -> str:
    """Only the text: what value comparisons use."""
    return normalized(text) + ".text"


def nfkc(text: str) -> str:
    """Compatibility folding that keeps invisible characters (the injection rules look for them)."""
    _, _, expanding, _ = _tables()
    klass = "[" + _char_class(sorted(ord(c) for c in expanding)) + "]"
    expanded = f"array_join(transform(split(nt, ''), c -> if(c rlike {literal(klass)}, {_expansions()}[c], c)), '')"
    changed = let("nt", _folded(text), f"if(nt rlike {literal(klass)}, {expanded}, nt)")
    return f"if({needs_normalizing(text)}, {changed}, {text})"
