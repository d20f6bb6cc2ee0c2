"""A brute-force scanner for the tests: Python's regex engine, one text at a time, pairwise overlaps."""

import re
import unicodedata

from veilkit import fixed


def digits(value):
    return [unicodedata.decimal(c) for c in value if unicodedata.decimal(c, None) is not None]


def tckn(value):
    d = digits(value)
    return (len(d) == 11 and d[0] != 0 and d[9] == (7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10
            and d[10] == sum(d[:10]) % 10)


def vkn(value):
    d = digits(value)
    if len(d) != 10:
        return False
    terms = []
    for place, digit in enumerate(d[:9]):
        x = (digit + 9 - place) % 10
        y = x * 2 ** (9 - place) % 9
        terms.append(9 if x and not y else y)
    return d[9] == -sum(terms) % 10


def iban(value):
    s = re.sub(r"\s", "", value).upper()
    return bool(re.fullmatch(r"TR\d{24}", s)) and int(s[4:] + "2927" + s[2:4]) % 97 == 1


def luhn(value):
    d = digits(value)
    doubled = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))]
    return 13 <= len(d) <= 19 and sum(doubled) % 10 == 0


def password(value):
    v = value.strip("\"'`")
    return not (v.lower() in fixed.NOT_PASSWORDS or re.match(fixed.CODE_REFERENCE, v, re.I) or len(set(v)) == 1
                or re.fullmatch(r"[A-Za-z_]\w*(?:\.\w+)+", v, re.A) or "(" in v or re.fullmatch(r"[A-Z]\w*\[.*\]", v, re.A)
                or re.fullmatch(r"\[[A-Z_]+_\d+\]", v, re.A))


CHECKS = {"tckn": tckn, "vkn": vkn, "iban": iban, "luhn": luhn, "password": password, None: lambda v: True}
INVISIBLE = {chr(c) for lo, hi in fixed.INVISIBLE_RANGES for c in range(lo, hi + 1)}


def normalized(text):
    out, index = [], []
    for i, ch in enumerate(text):
        piece = "" if ch in INVISIBLE else unicodedata.normalize("NFKC", ch)
        out.append(piece)
        index += [i] * len(piece)
    return "".join(out), index


def scan(text, extra=()):
    """extra: (entity, compiled pattern) recognizers of score 1."""
    seen, index = normalized(text)
    found = []
    for order, (entity, pattern, ignore, score, check, group) in enumerate(fixed.RECOGNIZERS):
        for no, m in enumerate(re.finditer(pattern, seen, re.I if ignore else 0)):
            if CHECKS[check](m.group(group)):
                found.append((-score, m.start(group) - m.end(group), order, no, entity, m.start(group), m.end(group)))
    for order, (entity, pattern) in enumerate(extra, 100):
        for no, m in enumerate(pattern.finditer(seen)):
            found.append((-1.0, m.start() - m.end(), order, no, entity, m.start(), m.end()))
    kept = []
    for f in sorted(found):
        if all(f[6] <= k[5] or f[5] >= k[6] for k in kept):
            kept.append(f)
    return sorted((index[f[5]], index[f[6] - 1] + 1, f[4]) for f in kept)


def scan_parts(parts, extra=()):
    """Each part on its own, then 128 characters around every boundary for what the parts cannot show."""
    starts = [sum(len(p) + 1 for p in parts[:i]) for i in range(len(parts))]
    placed = [(a + at, b + at, e) for p, at in zip(parts, starts) for a, b, e in scan(p, extra)]
    for left, right, at in zip(parts, parts[1:], starts[1:]):
        if not (left and right):
            continue
        tail, head = left[-128:], right[:128]
        low, high = 8 * (len(left) > 128), len(tail) + 1 + len(head) - 8 * (len(right) > 128)
        for a, b, e in scan(tail + "\n" + head, extra):
            inside = a <= len(tail) < b or (a >= low and b <= high)
            a, b = a + at - 1 - len(tail), b + at - 1 - len(tail)
            if inside and all(b <= x or a >= y for x, y, _ in placed):
                placed.append((a, b, e))
    return sorted(placed)
