"""Shell-style name patterns (`*`, `?`, `[...]`) as anchored Java regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable


def literal(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def glob_regex(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1:end]
            negated = body.startswith("!")
            body = re.sub(r"([\\\[\]^&])", r"\\\1", body[1:] if negated else body)
            out.append("[" + ("^" if negated else "") + body + "]")
            i = end
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", ch))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def any_glob(column: str, patterns: Iterable[str]) -> str:
    """SQL: the column matches one of the patterns. Patterns without wildcards become equality."""
    exact = [p for p in patterns if not set(p) & set("*?[")]
    tests = [f"{column} IN ({', '.join(map(literal, exact))})"] if exact else []
    tests += [f"{column} rlike {literal(glob_regex(p))}" for p in patterns if p not in exact]
    return "(" + " OR ".join(tests) + ")" if tests else "false"
