"""Request and response bodies (JSON) to their text parts.

One small Arrow UDF lists the leaves of a JSON value; everything format-specific is Spark SQL over that
list. A leaf carries its pointer and its `shape`, the pointer with each object's type noted, so the
rules of a format are patterns on shapes. Bodies stay in their row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilkit import fixed
from veilkit.functions.arrays import let, pinned
from veilkit.functions.globs import literal

LEAF_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "shape", "role", "kind", "value")])
PARTS_TYPE = "array<struct<role:string,path:string,text:string>>"


def _note(obj: dict) -> str:
    """The type of an object, followed by the type of its source, as noted in shapes."""
    kind, source = obj.get("type"), obj.get("source")
    names = [kind if isinstance(kind, str) else ""]
    if isinstance(source, dict) and isinstance(source.get("type"), str):
        names.append(source["type"])
    return "{" + ":".join(names) + "}" if names != [""] else "{}"


def _escaped(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def leaves(value) -> Iterator[tuple[str, str, str, str, str]]:
    """(pointer, shape, role of the enclosing message, kind, value) of every scalar, in document order."""
    held: list[tuple] = []  # the objects and lists around the current place: what is left of each, path, shape, role

    def enter(node, path: str, shape: str, role: str) -> None:
        if type(node) is list:
            held.append((enumerate(node), path, shape, role))
            return
        if len(held) <= 2 and isinstance(node.get("role"), str):
            role = node["role"]
        if path:
            shape += _note(node) if "type" in node or "source" in node else "{}"
        held.append((iter(node.items()), path, shape, role))

    if type(value) in (dict, list):
        enter(value, "", "", "")
    elif type(value) in (str, int):
        yield "", "", "", "string" if type(value) is str else "int", str(value)
    while held:
        rest, path, shape, role = held[-1]
        for k, node in rest:
            if type(k) is str and ("~" in k or "/" in k):
                k = _escaped(k)
            kind = type(node)
            if kind is str:
                yield f"{path}/{k}", f"{shape}/{k}", role, "string", node
            elif kind is dict or kind is list:
                enter(node, f"{path}/{k}", f"{shape}/{k}", role)
                break
            elif kind is int:
                yield f"{path}/{k}", f"{shape}/{k}", role, "int", str(node)
        else:
            held.pop()


def _parsed(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except (ValueError, RecursionError):  # no JSON, or nested beyond what the parser takes
        return None


_LEAF_NAMES = [field.name for field in LEAF_TYPE]


@F.arrow_udf(T.ArrayType(T.ArrayType(LEAF_TYPE)))
def _json_leaves(texts: pa.Array) -> pa.Array:
    """Per row an array of texts; per text its leaves, or NULL when it is no JSON object or list. The result is put together
    from flat columns: nested rows would be turned one by one."""
    rows, ends, columns = [0], [0], [[] for _ in _LEAF_NAMES]
    no_row, no_leaves, cells = [], [], [x.append for x in columns]
    for row in texts.to_pylist():
        no_row.append(row is None)
        for text in row or ():
            value = _parsed(text)
            found = isinstance(value, (dict, list))
            no_leaves.append(not found)
            for leaf in leaves(value) if found else ():
                for cell, x in zip(cells, leaf):
                    cell(x)
            ends.append(len(columns[0]))
        rows.append(len(no_leaves))
    flat = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in columns], _LEAF_NAMES)
    each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array(no_leaves, pa.bool_()))
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), each, mask=pa.array(no_row, pa.bool_()))


def json_leaves(body: str) -> Column:
    """All leaves of a JSON text column; NULL where it is not JSON."""
    return _json_leaves(F.array(F.col(body)))[0]


def json_string_leaves(column: str) -> Column:
    """Texts of a field that may hold JSON: its string leaves, else the text itself."""
    found = json_leaves(column)
    return F.when(F.col(column).isNull(), F.array().cast("array<string>")).when(found.isNull(), F.array(F.col(column))).otherwise(
        F.transform(F.filter(found, lambda x: x["kind"] == "string"), lambda x: x["value"]))


# --- what each format says about a leaf: (shape pattern, role, holds JSON text) -------------------------
_TYPE = r"\{[^/]*\}"
_MESSAGE = rf"^/messages/\d+{_TYPE}"
_ITEM = r"^/input/\d+\{[^/]*\}"
_CHAT_ROLE = "CASE WHEN l.role IN ('tool', 'function') THEN 'tool' WHEN l.role = '' THEN 'user' ELSE l.role END"
_ITEM_ROLE = "CASE l.role WHEN '' THEN 'user' WHEN 'developer' THEN 'system' ELSE l.role END"
_PLAIN_ROLE = "if(l.role = '', 'user', l.role)"
# a block inside message content or system, possibly nested in tool results and content documents
_NEST = r"(?:/\d+\{tool_result[^/]*\}/content|/\d+\{document:content\}/source\{content\}/content)*"
_BLOCKS = rf"^(?:/system|/messages/\d+{_TYPE}/content){_NEST}/\d+"
_BLOCK_ROLE = (r"CASE WHEN l.shape rlike '\\{tool_result[^/]*\\}' THEN 'tool' WHEN startswith(l.shape, '/system') THEN 'system' "
               f"ELSE {_PLAIN_ROLE} END")
FORMATS = {
    "chat": [
        (_MESSAGE + r"/content$", _CHAT_ROLE, False),
        (_MESSAGE + r"/content/\d+\{text[^/]*\}/text$", _CHAT_ROLE, False),
        (_MESSAGE + rf"/tool_calls/\d+{_TYPE}/function{_TYPE}/arguments$", _CHAT_ROLE, True),
    ],
    "responses": [
        (r"^/instructions$", "'system'", False),
        (r"^/input$", "'user'", False),
        (r"^/input/\d+\{(?:message)?\}/content$", _ITEM_ROLE, False),
        (r"^/input/\d+\{(?:message)?\}/content/\d+\{(?:input_text|output_text|text)[^/]*\}/text$", _ITEM_ROLE, False),
        (r"^/input/\d+\{function_call\}/arguments$", "'assistant'", True),
        (r"^/input/\d+\{function_call_output\}/output$", "'tool'", False),
        (r"^/input/\d+\{function_call_output\}/output/\d+(?!\{input_image|\{input_file).*$", "'tool'", False),
    ],
    "messages": [
        (r"^/system$", "'system'", False),
        (_MESSAGE + r"/content$", _PLAIN_ROLE, False),
        (_BLOCKS + r"\{text[^/]*\}/text$", _BLOCK_ROLE, False),
        (_BLOCKS + r"\{tool_result[^/]*\}/content$", "'tool'", False),
        (_BLOCKS + r"\{tool_use[^/]*\}/input.*$", "'assistant'", False),
        (_BLOCKS + r"\{document:text\}/source\{text\}/data$", _BLOCK_ROLE, False),
    ],
    "embeddings": [
        (r"^/input$", "'user'", False),
        (r"^/input/\d+$", "'user'", False),
    ],
}
RESPONSES = {
    "chat": [
        (rf"^/choices/\d+{_TYPE}/message{_TYPE}/content$", "'assistant'", False),
        (rf"^/choices/\d+{_TYPE}/message{_TYPE}/tool_calls/\d+{_TYPE}/function{_TYPE}/arguments$", "'assistant'", True),
    ],
    "responses": [
        (r"^/output/\d+\{message\}/content/\d+\{output_text[^/]*\}/text$", "'assistant'", False),
        (r"^/output/\d+\{function_call\}/arguments$", "'assistant'", True),
    ],
    "messages": [
        (r"^/content/\d+\{text[^/]*\}/text$", "'assistant'", False),
        (r"^/content/\d+\{tool_use[^/]*\}/input.*$", "'assistant'", False),
    ],
    "embeddings": [],
}


def _known(table: dict, api_format: str) -> str:
    """struct<role, json> of a known text leaf, NULL for any other leaf."""
    by_format = "CASE"
    for name, rules in table.items():
        if not rules:
            continue
        cases = " ".join(f"WHEN l.shape rlike {literal(p)} THEN named_struct('role', {role}, 'json', {str(js).lower()})"
                         for p, role, js in rules)
        by_format += f" WHEN {api_format} = {literal(name)} THEN CASE {cases} END"
    return f"if(l.kind = 'string', {by_format} END, NULL)"


def _unlisted() -> str:
    """Condition: a leaf outside the known fields that goes to the model all the same."""
    keys = "|".join(fixed.UNSCANNED_KEYS)
    blocks = "|".join(fixed.SIGNED_BLOCKS + fixed.ATTACHMENT_BLOCKS)
    pieces = [
        rf"NOT l.path rlike {literal(rf'/(?:{keys})(?:/|$)')}",
        rf"NOT l.shape rlike {literal(rf'{chr(92)}{{(?:{blocks})(?::[^/}}]*)?{chr(92)}}}')}",
        # a document other than text or content is an attachment
        r"NOT l.shape rlike '\\{document(?!:text\\}|:content\\})[^/]*\\}'",
        "NOT (l.kind = 'string' AND startswith(l.value, 'data:'))",
        r"NOT l.shape rlike '\\{base64[^/]*\\}/data$'",
        f"(l.kind = 'string' OR abs(cast(l.value AS decimal(38, 0))) >= {fixed.INT_SCAN_MIN})",
    ]
    return " AND ".join(pieces)


_ROOT_KEYS = "|".join(fixed.MESSAGE_KEYS)


def _parts(df: DataFrame, body: str, table: dict, *, rest: bool, api_format: str, into: str) -> DataFrame:
    known = _known(table, "if(`" + api_format + "` = '', 'chat', `" + api_format + "`)")
    staged = (
        df.withColumn("_leaves", json_leaves(body))
        .withColumn("_tagged", F.expr(pinned(
            f"transform(coalesce(_leaves, array()), l -> named_struct('l', l, 'known', {known}))")))
        .withColumn("_texts", F.expr("transform(filter(_tagged, t -> t.known.json), t -> t.l.value)"))
        .withColumn("_inner", _json_leaves(F.col("_texts")))
    )
    one = "named_struct('role', t.known.role, 'path', t.l.path, 'text', t.l.value)"
    inner = ("transform(filter(_inner[array_position(_at, i) - 1], x -> x.kind = 'string'), "
             "x -> named_struct('role', t.known.role, 'path', concat(t.l.path, '#', x.path), 'text', x.value))")
    listed = (f"flatten(transform(_tagged, (t, i) -> CASE WHEN t.known IS NULL THEN cast(array() AS {PARTS_TYPE}) "
              f"WHEN t.known.json AND _inner[array_position(_at, i) - 1] IS NOT NULL THEN {inner} ELSE array({one}) END))")
    at = "transform(filter(transform(_tagged, (t, i) -> named_struct('i', i, 'json', coalesce(t.known.json, false))), x -> x.json), x -> x.i)"
    parts = let("_at", at, listed)
    if rest:
        role = f"if(t.l.path rlike '^/(?:{_ROOT_KEYS})(?:/|$)', 'user', 'system')"
        others = (f"transform(filter(_tagged, t -> t.known IS NULL AND {_unlisted().replace('l.', 't.l.')}), "
                  f"t -> named_struct('role', {role}, 'path', t.l.path, 'text', t.l.value))")
        parts = f"concat({others}, {parts})"
    # pinned, so that later Python stages read the parts instead of repeating how they were made
    return staged.withColumn(into, F.expr(pinned(parts))).drop("_leaves", "_tagged", "_texts", "_inner")


def request_parts(df: DataFrame, body: str = "body", api_format: str = "api_format", into: str = "parts") -> DataFrame:
    """Adds the texts of a request: every leaf outside the known fields first (tool definitions, metadata
    and whatever else reaches the model), then the known texts in document order."""
    return _parts(df, body, FORMATS, rest=True, api_format=api_format, into=into)


def known_parts(df: DataFrame, body: str = "body", api_format: str = "api_format", into: str = "parts") -> DataFrame:
    return _parts(df, body, FORMATS, rest=False, api_format=api_format, into=into)


def response_parts(df: DataFrame, body: str = "body", api_format: str = "api_format", into: str = "parts") -> DataFrame:
    """Adds the texts and tool arguments of a response."""
    return _parts(df, body, RESPONSES, rest=False, api_format=api_format, into=into)


def token_input(body: str = "body") -> Column:
    """True where an embeddings request sends token numbers, which cannot be scanned as text."""
    first = F.expr(f"coalesce(get_json_object(`{body}`, '$.input[0][0]'), get_json_object(`{body}`, '$.input[0]'))")
    is_list = F.expr(f"startswith(ltrim(get_json_object(`{body}`, '$.input')), '[')")
    return F.coalesce(is_list & (first.isNull() | first.rlike(r"^-?\d+$"))
                      & ~F.coalesce(F.expr(f"`{body}` rlike '\"input\"\\\\s*:\\\\s*\\\\[\\\\s*\"'"), F.lit(False)), F.lit(False))


def usage_tokens(df: DataFrame, body: str = "response", api_format: str = "api_format") -> DataFrame:
    """Adds prompt_tokens, completion_tokens, priced_prompt_tokens and usage_known."""
    def count(path: str) -> str:
        return f"coalesce(try_cast(get_json_object(`{body}`, '$.usage.{path}') AS bigint), 0L)"

    written, read = count("cache_creation_input_tokens"), count("cache_read_input_tokens")
    fmt = f"if(`{api_format}` = '', 'chat', `{api_format}`)"
    known = f"coalesce(get_json_object(`{body}`, '$.usage') NOT IN ('{{}}', 'null'), false)"
    embedded = f"coalesce(nullif({count('prompt_tokens')}, 0L), {count('total_tokens')})"
    return (
        df.withColumn("prompt_tokens", F.expr(
            f"CASE {fmt} WHEN 'chat' THEN {count('prompt_tokens')} WHEN 'responses' THEN {count('input_tokens')} "
            f"WHEN 'embeddings' THEN {embedded} ELSE {count('input_tokens')} + {written} + {read} END"))
        .withColumn("completion_tokens", F.expr(
            f"CASE {fmt} WHEN 'chat' THEN {count('completion_tokens')} WHEN 'embeddings' THEN 0L ELSE {count('output_tokens')} END"))
        .withColumn("priced_prompt_tokens", F.expr(
            f"if({fmt} = 'messages', {count('input_tokens')} + {fixed.CACHE_WRITE_FACTOR}D * {written} + "
            f"{fixed.CACHE_READ_FACTOR}D * {read}, cast(prompt_tokens AS double))"))
        .withColumn("usage_known", F.expr(known))
    )


def _put(value, pointer: str, text: str):
    *way, last = [step.replace("~1", "/").replace("~0", "~") for step in pointer.split("/")[1:]]
    for step in way:
        value = value[int(step)] if isinstance(value, list) else value[step]
    value[int(last) if isinstance(value, list) else last] = text


@F.arrow_udf(T.StringType())
def _rebuild(bodies: pa.Array, paths: pa.Array, texts: pa.Array) -> pa.Array:
    """The body with the texts put back at their pointers (`outer#inner` reaches into JSON text)."""
    def one(body, pointers, values):
        value = _parsed(body)
        if value is None:
            return body
        nested: dict[str, list[tuple[str, str]]] = {}
        for pointer, text in zip(pointers, values):
            outer, _, inner = pointer.partition("#")
            if inner:
                nested.setdefault(outer, []).append((inner, text))
            else:
                _put(value, outer, text)
        known = {path: text for path, _, _, _, text in leaves(value)} if nested else {}
        for outer, changes in nested.items():
            inside = _parsed(known[outer])
            for inner, text in changes:
                _put(inside, inner, text)
            _put(value, outer, json.dumps(inside, ensure_ascii=False))
        return json.dumps(value, ensure_ascii=False)

    return pa.array([one(*row) for row in zip(bodies.to_pylist(), paths.to_pylist(), texts.to_pylist())], pa.string())


def rebuild(body: str, parts: str, texts: str) -> Column:
    """JSON text with changed parts written back; unchanged parts are not touched."""
    packed = f"transform(arrays_zip(transform(`{parts}`, p -> p.path), transform(`{parts}`, p -> p.text), `{texts}`), " \
             f"z -> named_struct('p', z['0'], 'a', z['1'], 'b', z['{texts}']))"
    kept = f"filter({packed}, z -> z.a <> z.b)"
    return _rebuild(F.col(body), F.expr(f"transform({kept}, z -> z.p)"), F.expr(f"transform({kept}, z -> z.b)"))
