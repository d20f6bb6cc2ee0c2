"""Human text in arbitrary HTTP bodies, by content type.

Plain, form, line and JSON bodies are split by Spark SQL around the shared leaf lister; only what needs a
byte-level library (compression, multipart) is unpacked in a small Arrow stage first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from email.parser import BytesParser
from email.policy import HTTP

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilkit import fixed
from veilkit.operators.flatten import _parsed, leaves
from veilkit.session import bounded_batches

_SECTION = T.StructType([T.StructField("content_type", T.StringType()), T.StructField("body", T.BinaryType()),
                         T.StructField("bad", T.BooleanType())])
_WINDOW_BITS = {"gzip": 31, "x-gzip": 31, "deflate": 15}
_PIECE = 16384


def _inflated(data: bytes, encoding: str, limit: int | None) -> tuple[bytes | None, bool]:
    """(decoded bytes, whether they are all); no bytes where the encoding is unknown or broken."""
    if encoding in _WINDOW_BITS:
        out, size, at, reader = [], 0, 0, None
        while at < len(data):  # a gzip body may have several members, each in pieces
            if reader is None:
                if at and not data[at: at + 1].strip(b"\0") and not data[at:].strip(b"\0"):  # padding after a member
                    break
                reader = zlib.decompressobj(wbits=_WINDOW_BITS[encoding])
            piece = data[at: at + _PIECE]
            try:
                # one byte over the limit tells whether there is more
                out.append(reader.decompress(piece, 0 if limit is None else limit - size + 1))
            except zlib.error:  # what came before is text all the same
                return (b"".join(out), False) if size else (None, False)
            size += len(out[-1])
            if limit is not None and size > limit:
                return b"".join(out)[:limit], False
            at += len(piece) - len(reader.unused_data)
            if reader.eof:
                reader = None
        return b"".join(out), reader is None
    if encoding not in ("", "identity"):
        return None, False
    return (data, True) if limit is None else (data[:limit], len(data) <= limit)


def is_text(content_type: str) -> bool:
    return any(t in content_type for t in fixed.TEXT_CONTENT_TYPES)


def _sections(body: bytes, content_type: str, encoding: str, limit: int | None) -> Iterator[tuple[str, bytes, bool]]:
    """(content type, bytes, unreadable) of a compressed or multipart body's parts, at any depth."""
    data, whole = _inflated(body, encoding.strip().lower(), limit)
    if data is None or not whole:
        yield "", b"", True
    if data is None:
        return
    if "multipart/" not in content_type.lower():
        yield content_type.lower(), data, False
        return
    header = f"content-type: {content_type}\r\n\r\n".encode("latin-1", "replace")
    for part in BytesParser(policy=HTTP).parsebytes(header + data).walk():
        if not part.is_multipart():
            kind, payload = part.get_content_type(), part.get_payload(decode=True) or b""
            opaque = part.get_filename() is not None and not is_text(kind)
            yield ("", b"", bool(payload)) if opaque else (kind, payload, False)


def _body_sections(limit: int | None):
    @F.pandas_udf(T.ArrayType(_SECTION))
    def unpack(body: pd.Series, content_type: pd.Series, encoding: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else list(_sections(bytes(b), c or "", e or "", limit))
                          for b, c, e in zip(body, content_type, encoding)], dtype=object)

    return unpack


def _texts(value) -> Iterator[str]:
    """The trimmed strings of a JSON value, whatever its depth; a string that is itself JSON is opened in place."""
    open_ = [leaves(value)]
    while open_:
        leaf = next(open_[-1], None)
        if leaf is None:
            open_.pop()
            continue
        kind, text = leaf[3], leaf[4]
        if kind != "string":
            continue
        text = text.strip()
        inner = _parsed(text) if text[:1] in ("{", "[") and text[-1:] in ("}", "]") else None
        if isinstance(inner, (dict, list)):
            open_.append(leaves(inner))
        elif len(text) >= fixed.MIN_BODY_STRING:
            yield text


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _json_texts(candidates: pd.Series) -> pd.Series:
    """Per candidate the texts inside, or NULL when it is no JSON object or list."""
    def one(text):
        value = _parsed(text)
        return list(_texts(value)) if isinstance(value, (dict, list)) else None

    return candidates.map(lambda row: [one(t) for t in row])


_IS_TEXT = "(" + " OR ".join(f"contains(s.content_type, '{t}')" for t in fixed.TEXT_CONTENT_TYPES) + ")"
_FORM = "contains(s.content_type, 'x-www-form-urlencoded')"
_JSON = "(contains(s.content_type, 'json') OR ltrim(s.text) rlike '^[{\\\\[]')"
# JSON scalars on a line of their own: numbers and words carry no text, strings their value
_SCALAR = ("CASE WHEN c.json rlike '^(-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?|true|false|null)$' THEN '' "
           "WHEN c.json rlike '^\"([^\"\\\\\\\\]|\\\\\\\\.)*\"$' THEN trim(get_json_object(concat('{\"v\":', c.json, '}'), '$.v')) ELSE c.raw END")
_NONE = "cast(NULL AS array<string>)"


def extract_text(df: DataFrame, *, body: str = "body", content_type: str = "content_type",
                 encoding: str = "content_encoding", limit: int | None = None) -> DataFrame:
    """Adds text and unscannable. A JSON-typed body that is no single value is read line by line.

    Bodies are read whole. A caller that fears small compressed bodies of enormous content gives a `limit` in
    decoded bytes; what a body holds beyond it is not read, and the row is unscannable.
    """
    bounded_batches(df.sparkSession)
    data, kind = F.col(body).cast("binary"), F.lower(F.coalesce(F.col(content_type), F.lit("")))
    packing = F.lower(F.trim(F.coalesce(F.col(encoding), F.lit(""))))
    plain = packing.isin("", "identity") & ~kind.contains("multipart/")
    length = F.coalesce(F.octet_length(data), F.lit(0))
    over = F.lit(False) if limit is None else length > limit
    given = F.coalesce(data if limit is None else F.substring(data, 1, limit), F.lit(b""))
    # plain bodies are one section as they stand: only packed ones go through Python
    own = F.array(F.struct(kind.alias("content_type"), given.alias("body"), over.alias("bad")))
    packed = F.when(~plain, F.coalesce(data, F.lit(b"")))
    staged = (
        df.withColumn("_packed", _body_sections(limit)(packed, F.col(content_type), F.col(encoding)))
        .withColumn("_sections", F.coalesce("_packed", own)).drop("_packed")
        .withColumn("_sections", F.expr("transform(_sections, s -> named_struct('content_type', s.content_type, 'bad', s.bad, "
                                        "'empty', octet_length(s.body) = 0, 'text', make_valid_utf8(cast(s.body AS string))))"))
        .withColumn("_whole", _json_texts(F.expr(f"transform(_sections, s -> if(NOT {_FORM} AND {_JSON}, s.text, NULL))")))
        # candidates in order: the JSON text to open and what stands for it when it is none, or the texts of a section opened above
        .withColumn("_cand", F.expr(f"""flatten(transform(_sections, (s, i) -> CASE
            WHEN {_FORM} THEN transform(filter(split(s.text, '&'), p -> contains(p, '=') AND substr(p, instr(p, '=') + 1) <> ''),
                p -> transform(array(replace(substr(p, instr(p, '=') + 1), '+', ' ')),
                    v -> named_struct('json', trim(coalesce(try_url_decode(v), v)), 'raw', trim(coalesce(try_url_decode(v), v)), 'form', true, 'texts', {_NONE}))[0])
            WHEN {_JSON} AND _whole[i] IS NOT NULL THEN array(named_struct('json', cast(NULL AS string), 'raw', '', 'form', false, 'texts', _whole[i]))
            WHEN {_JSON} THEN transform(filter(split(s.text, '\\r\\n|\\n|\\r'), x -> trim(x) <> ''),
                x -> named_struct('json', trim(if(startswith(x, 'data:'), substr(x, 6), x)), 'raw', trim(x), 'form', false, 'texts', {_NONE}))
            WHEN s.content_type = '' OR {_IS_TEXT} THEN array(named_struct('json', cast(NULL AS string), 'raw', s.text, 'form', true, 'texts', {_NONE}))
            ELSE cast(array() AS array<struct<json:string,raw:string,form:boolean,texts:array<string>>>) END))"""))
        .withColumn("_open", _json_texts(F.col("_cand.json")))
    )
    texts = (f"flatten(transform(_cand, (c, i) -> CASE WHEN c.texts IS NOT NULL THEN c.texts WHEN _open[i] IS NOT NULL THEN _open[i] WHEN c.form THEN array(c.raw) "
             f"ELSE array({_SCALAR}) END))")
    short = f"(x <> '' AND (length(x) >= {fixed.MIN_BODY_STRING} OR size(_cand) = 1))"
    broken = "length(s.text) - length(replace(s.text, '\ufffd', '')) > length(s.text) div 10"
    binary = f"(NOT {_FORM} AND NOT {_JSON} AND s.content_type <> '' AND NOT {_IS_TEXT} AND NOT s.empty)"
    return (
        staged.withColumn("text", F.expr(f"array_join(filter({texts}, x -> {short}), '\n')"))
        .withColumn("unscannable", F.expr(f"exists(_sections, s -> s.bad OR {binary} OR (NOT {_FORM} AND NOT {_JSON} AND {broken}))"))
        .drop("_sections", "_whole", "_cand", "_open")
    )
