import gzip
import json
import zlib

from pyspark.sql import functions as F

from veilkit.operators import bodies as B
from veilkit.operators import flatten as FL

CHAT = {"model": "gpt-4o", "messages": [
    {"role": "system", "content": "S"}, {"role": "user", "content": [{"type": "text", "text": "U"}, {"type": "image_url", "image_url": {"url": "x"}}, {"type": "yeni", "alan": "Y"}]},
    {"role": "assistant", "content": None, "tool_calls": [{"id": "c", "type": "function", "function": {"name": "f", "arguments": "{\"a\": \"A\", \"b\": [\"B\", 3]}"}}]},
    {"role": "function", "content": "F"}, {"role": "tool", "tool_calls": [{"function": {"arguments": "düz"}}]}, "metin değil"],
    "tools": [{"type": "function", "function": {"name": "f", "description": "D"}}], "metadata": {"tc": 10000000146, "kisa": 5, "a/b~c": "yol"}}
RESPONSES = {"instructions": "I", "input": [
    {"role": "developer", "content": "D"}, {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "T"}, {"type": "input_image", "image_url": "x"}]},
    {"type": "function_call", "arguments": "[1, \"X\"]"}, {"type": "function_call_output", "output": "O"},
    {"type": "function_call_output", "output": [{"type": "text", "text": "L"}, {"type": "input_file", "file_url": "x"}]}, {"type": "reasoning", "summary": [{"text": "gizli"}]}]}
MESSAGES = {"system": [{"type": "text", "text": "S"}], "tools": [{"name": "n", "description": "D"}], "messages": [
    {"role": "user", "content": [{"type": "text", "text": "U"}, {"type": "tool_result", "content": "R"}, {"type": "tool_result", "content": [{"type": "text", "text": "N"}]},
                                 {"type": "document", "title": "B", "source": {"type": "text", "data": "DOC"}}, {"type": "document", "title": "yok", "source": {"type": "base64", "data": "qq"}},
                                 {"type": "document", "source": {"type": "content", "content": [{"type": "text", "text": "DC"}]}}]},
    {"role": "assistant", "content": [{"type": "thinking", "thinking": "t", "signature": "s"}, {"type": "tool_use", "name": "n", "input": {"p": {"q": "TU"}}}]}]}


def parts(spark, rows):
    df = spark.createDataFrame([(f, json.dumps(b) if not isinstance(b, str) else b) for f, b in rows], "api_format string, body string")
    return [[(p.role, p.text) for p in r.parts] for r in FL.request_parts(df.coalesce(1)).collect()]


def test_request_formats(spark):
    chat, responses, messages, embedded, tokens, broken = parts(spark, [
        ("", CHAT), ("responses", RESPONSES), ("messages", MESSAGES), ("embeddings", {"input": ["a1", "a2"]}), ("embeddings", {"input": [[1, 2]]}), ("chat", "{")])
    assert chat == [("user", "Y"), ("user", "metin değil"), ("system", "D"), ("system", "10000000146"), ("system", "yol"), ("system", "S"), ("user", "U"), ("assistant", "A"),
                    ("assistant", "B"), ("tool", "F"), ("tool", "düz")]
    assert responses == [("system", "I"), ("system", "D"), ("user", "T"), ("assistant", "X"), ("tool", "O"), ("tool", "text"), ("tool", "L")]
    assert messages == [("system", "D"), ("user", "B"), ("system", "S"), ("user", "U"), ("tool", "R"), ("tool", "N"), ("user", "DOC"), ("user", "DC"), ("assistant", "TU")]
    assert embedded == [("user", "a1"), ("user", "a2")] and tokens == [] and broken == []
    df = spark.createDataFrame([(json.dumps(b),) for b in ({"input": [1, 2]}, {"input": [[1], [2]]}, {"input": "x"}, {"input": ["1"]})], "body string")
    assert [r[0] for r in df.coalesce(1).select(FL.token_input()).collect()] == [True, True, False, False]


def test_rebuild_writes_only_what_changed(spark):
    df = FL.request_parts(spark.createDataFrame([("chat", json.dumps(CHAT))], "api_format string, body string"))
    df = df.withColumn("m", F.expr("transform(parts, p -> if(p.text IN ('U', 'B', '10000000146', 'yol'), concat('<', p.text, '>'), p.text))"))
    got = json.loads(df.select(FL.rebuild("body", "parts", "m")).first()[0])
    want = json.loads(json.dumps(CHAT))
    want["messages"][1]["content"][0]["text"] = "<U>"
    want["messages"][2]["tool_calls"][0]["function"]["arguments"] = json.dumps({"a": "A", "b": ["<B>", 3]})
    want["metadata"]["tc"], want["metadata"]["a/b~c"] = "<10000000146>", "<yol>"
    assert got == want


def test_json_string_field(spark):
    df = spark.createDataFrame([('{"a": ["x", {"b": "y"}]}',), ("düz",), ('"tek"',), (None,)], "v string").coalesce(1)
    assert [r[0] for r in df.select(FL.json_string_leaves("v")).collect()] == [["x", "y"], ["düz"], ['"tek"'], []]


def test_usage(spark):
    rows = [("chat", {"usage": {"prompt_tokens": 3, "completion_tokens": 4}}), ("messages", {"usage": {"input_tokens": 10, "cache_creation_input_tokens": 4, "cache_read_input_tokens": 20, "output_tokens": 2}}),
            ("embeddings", {"usage": {"total_tokens": 7}}), ("chat", {}), ("responses", {"usage": {}})]
    df = spark.createDataFrame([(f, json.dumps(b)) for f, b in rows], "api_format string, response string").coalesce(1)
    got = [(r.prompt_tokens, r.completion_tokens, r.priced_prompt_tokens, r.usage_known) for r in FL.usage_tokens(df).collect()]
    assert got == [(3, 4, 3.0, True), (34, 2, 17.0, True), (7, 0, 7.0, True), (0, 0, 0.0, False), (0, 0, 0.0, False)]


MULTIPART = (b'--B\r\nContent-Disposition: form-data; name="a"\r\n\r\nmerhaba\r\n--B\r\nContent-Disposition: form-data; name="j"\r\nContent-Type: application/json\r\n\r\n{"x":"iki"}\r\n'
             b'--B\r\nContent-Disposition: form-data; name="f"; filename="x.png"\r\nContent-Type: image/png\r\n\r\n\x89PNG\r\n--B--\r\n')


def test_body_text(spark):
    cases = [
        (b'{"a":"merhaba","b":["x","yy","{\\"c\\":\\"ic [[]] metin\\"}"],"n":5}', "application/json", "", "merhaba\nyy\nic [[]] metin", False),
        (gzip.compress('{"a":"sıkı"}'.encode()), "application/json", "gzip", "sıkı", False), (zlib.compress(b"duz metin"), "text/plain", "deflate", "duz metin", False),
        (b"q=a+b%20c&f.req=%5B%5B%22derin%22%5D%5D&e=", "application/x-www-form-urlencoded", "", "a b c\nderin", False),
        (b'{"a":"bir"}\ndata: {"b":"iki"}\nson satir\n42\n', "application/json", "", "bir\niki\nson satir", False),
        (b'data: {"a":"bir"}\n', "text/event-stream", "", 'data: {"a":"bir"}\n', False), (MULTIPART, "multipart/form-data; boundary=B", "", "merhaba\niki", True),
        (b"\x89PNG", "image/png", "", "", True), (b"x", "text/plain", "br", "", True), (b"bozuk", "text/plain", "gzip", "", True), (b"duz", None, None, "duz", False),
        (b"\xff\xfe\xff\xfe", "text/plain", "", None, True)]
    df = spark.createDataFrame([(i, bytearray(b), t, e) for i, (b, t, e, _, _) in enumerate(cases)], "i int, body binary, content_type string, content_encoding string")
    for (_, _, _, text, bad), r in zip(cases, B.extract_text(df).orderBy("i").collect()):
        assert (text is None or r.text == text) and r.unscannable == bad, (r.i, r.text)


def deep(value, levels):
    for _ in range(levels):
        value = [value]
    return json.dumps(value).encode()


def test_nothing_of_a_body_is_cut(spark):
    """Bodies beyond any usual size or depth, as they are, compressed and in nested parts."""
    tail = "kimlik 10000000146"
    large = "satir metni\n" * 600_000 + tail
    inner = b'--I\r\nContent-Type: text/plain\r\n\r\nic parca\r\n--I--\r\n'
    nested = b'--O\r\nContent-Type: multipart/mixed; boundary=I\r\n\r\n' + inner + b'--O\r\nContent-Type: text/plain\r\n\r\ndis parca\r\n--O--\r\n'
    cases = [(large.encode(), "text/plain", ""), (gzip.compress(large.encode()), "text/plain", "gzip"), (json.dumps({"a": large}).encode(), "application/json", ""),
             (deep(tail, 45), "application/json", ""), (deep(deep(tail, 60).decode(), 50), "application/json", ""), (nested, "multipart/mixed; boundary=O", "")]
    df = spark.createDataFrame([(i, bytearray(b), t, e) for i, (b, t, e) in enumerate(cases)], "i int, body binary, content_type string, content_encoding string")
    got = B.extract_text(df).orderBy("i").collect()
    assert not any(r.unscannable for r in got)
    assert [r.text for r in got] == [large, large, large, tail, tail, "ic parca\ndis parca"]


def test_gzip_bodies_are_read_to_their_end_or_marked(spark):
    whole = gzip.compress(b"birinci ") + gzip.compress(b"ikinci")
    many = b"".join(gzip.compress(b"%07d " % i) for i in range(20_000))
    noise = "".join(f"{i * 7919 % 10007} " for i in range(30_000)).strip()
    cases = [(whole, "birinci ikinci", False), (whole + b"\0" * 9, "birinci ikinci", False), (whole[:-9], "birinci ikinci", True), (whole + b"artik", "birinci ikinci", True),
             (gzip.compress(noise.encode()), noise, False), (many, "".join("%07d " % i for i in range(20_000)).strip(), False), (b"", "", False)]
    df = spark.createDataFrame([(i, b, "text/plain", "gzip") for i, (b, _, _) in enumerate(cases)], "i int, body binary, content_type string, content_encoding string")
    got = B.extract_text(df).orderBy("i").collect()
    assert [r.unscannable for r in got] == [bad for _, _, bad in cases]
    assert all(r.text.strip() == text if not bad else text.startswith(r.text.strip()) for r, (_, text, bad) in zip(got, cases))


def test_a_given_limit_is_marked(spark):
    cases = [(b"x" * 100, ""), (b"x" * 10, ""), (gzip.compress(b"x" * 100), "gzip"), (gzip.compress(b"x" * 10), "gzip")]
    df = spark.createDataFrame([(i, bytearray(b), "text/plain", e) for i, (b, e) in enumerate(cases)], "i int, body binary, content_type string, content_encoding string")
    got = B.extract_text(df, limit=10).orderBy("i").collect()
    assert [(r.text, r.unscannable) for r in got] == [("x" * 10, True), ("x" * 10, False)] * 2


def test_python_gets_batches_of_limited_bytes_and_a_json_body_once(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    rows = spark.createDataFrame([(1, b'{"a": "ilk metin", "b": "[\\"ikinci metin\\"]"}', "application/json"), (2, b"duz metin", "text/plain"), (3, b"f=%7B%22x%22%3A%22form+metni%22%7D", "application/x-www-form-urlencoded"),
                                  (4, b'{"t": "satir bir"}\n{"t": "satir iki"}', "application/json")], "id int, body binary, content_type string")
    out = B.extract_text(rows.withColumn("content_encoding", F.lit("")))
    assert int(spark.conf.get(name)) <= 1 << 24
    assert {r.id: r.text for r in out.collect()} == {1: "ilk metin\nikinci metin", 2: "duz metin", 3: "form metni", 4: "satir bir\nsatir iki"}
    spark.conf.set(name, "1000")
    B.extract_text(rows.withColumn("content_encoding", F.lit("")))
    assert spark.conf.get(name) == "1000"
    spark.conf.unset(name)


def test_windows_are_scanned_only_where_their_findings_are_read(spark):
    from veilkit import defaults
    from veilkit.operators import parts as PT
    rows = spark.createDataFrame([(1, ["no 100000001", "46 x"], "u"), (2, [], "u"), (3, ["TC 10000000146", None], "u")], "id int, t array<string>, role string")
    rows = PT.analyze_parts(rows.selectExpr("id", "transform(t, x -> named_struct('role', role, 'text', x)) AS parts"), defaults.SCAN)

    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString().count("aws_secret_access_key")

    assert scans(rows) == 2 * scans(rows.drop("findings")) > 0
    got = {r.id: ([[f.start for f in x] for x in r.part_findings], [(f.entity, f.start, f.end) for f in r.findings]) for r in rows.collect()}
    assert got == {1: ([[], []], []), 2: ([], []), 3: ([[3], []], [("TCKN", 3, 14)])}
    assert {r.id: [[f.start for f in x] for x in r.part_findings] for r in rows.drop("findings").collect()} == {i: p for i, (p, _) in got.items()}


def test_leaves_of_deep_and_odd_json(spark):
    deep = "[" * 400 + '"son"' + "]" * 400
    rows = [(1, deep), (2, '{"a/b": {"~": [1, true, null, 1.5, "x"]}, "": "y"}'), (3, "7"), (4, "{"), (5, None), (6, "[]")]
    got = {r.id: r.l for r in spark.createDataFrame(rows, "id int, body string").select("id", FL.json_leaves("body").alias("l")).collect()}
    assert [(x.path, x.value) for x in got[1]] == [("/0" * 400, "son")] and got[6] == []
    assert [(x.path, x.kind, x.value) for x in got[2]] == [("/a~1b/~0/0", "int", "1"), ("/a~1b/~0/4", "string", "x"), ("/", "string", "y")]
    assert got[3] is None and got[4] is None and got[5] is None
