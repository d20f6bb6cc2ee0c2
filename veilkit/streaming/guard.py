"""Guarding a model's answer while it streams: what is safe goes out, the rest waits for more text.

One step is a DataFrame function over (waiting text, new text): scan natively, find a cut that no value
or placeholder crosses, render what lies before it, keep the rest. The stream runs a step per
micro-batch over the blocks it has text for and keeps the waiting texts in a table whose parts are
versioned by batch, so a replayed batch starts from the same state and gives the same output. For any
chunking the pieces add up to the one-shot result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilkit import fixed
from veilkit.functions.arrays import let, pinned
from veilkit.functions.globs import literal
from veilkit.functions.values import alnum
from veilkit.operators.mask import apply_spans
from veilkit.operators.policy import Context, Policy, decision_sql, evaluate_output
from veilkit.operators.scan import ScanConfig, findings_sql
from veilkit.streaming.ingest import each_batch

KEYS = ["request_id", "block"]
PENDING = "request_id string, block string, pending string, sent_chars int"
STATE = PENDING + ", seen timestamp"
BUCKETS, KEEP_HOURS = 64, 24.0


def incremental_allowed(policy: Policy) -> bool:
    """Streaming out text cannot be undone: an enforced blocking output rule needs the whole answer."""
    return not any(r["action"] == "block" and r.get("mode", policy.mode) != "monitor" for r in policy.output_rules)


_SURROGATES = "filter(map_keys(vault), p -> NOT startswith(p, '['))"


def _behind(value: str) -> str:
    """The real value that a surrogate, or a respelled surrogate number, stands for; else NULL."""
    same = f"p = {value} OR (NOT contains(p, '@') AND {alnum('p')} = {alnum(value)})"
    return f"vault[get(filter({_SURROGATES}, p -> {same}), 0)]"


def _known(value: str) -> str:
    """The one test of what is no leak: sent by the user, or real or surrogate value of the vault."""
    return f"(contains(coalesce(all_text, ''), {value}) OR array_contains(map_values(vault), {value}) OR {_behind(value)} IS NOT NULL)"


def _hidden_alone(policy: Policy) -> str:
    """Whether the output rules hide entity f.entity, judged by itself."""
    decision = decision_sql(policy.output_rules, policy.mode, "allow", Context(entities="array(f.entity)", score="0D"))
    return let("d", decision, "(d.action = 'mask' AND array_contains(d.mask_entities, f.entity))")


def _render(hidden: str) -> str:
    """Text of `seg` with its findings `own`: leaks hidden where `hidden` says so, surrogates and placeholders
    turned back into what they stand for."""
    value = "substr(seg, f.start + 1, f.end - f.start)"
    before, after = fixed.REDACTED_FORMAT.split("{}")
    judged = (f"transform(own, f -> named_struct('start', f.start, 'end', f.end, 'replacement', coalesce({_behind(value)}, "
              f"if(NOT {_known(value)} AND {hidden}, concat({literal(before)}, f.entity, {literal(after)}), NULL))))")
    spans = f"filter({judged}, f -> f.replacement IS NOT NULL)"
    tokens = f"split(regexp_replace(red, {literal(fixed.PLACEHOLDER_PATTERN)}, '\\u0001$0\\u0001'), '\\u0001', -1)"
    opened = f"array_join(transform({tokens}, (p, i) -> if(i % 2 = 1, coalesce(vault[p], p), p)), '')"
    return let("red", apply_spans("seg", spans), opened)


def _leaks() -> str:
    return f"transform(filter(_own, f -> NOT {_known('substr(_text, f.start + 1, f.end - f.start)')}), f -> f.entity)"


def _cut(holdback: int) -> str:
    """Where the text may be cut: before the last word, the last `holdback` characters, an unfinished
    placeholder and anything that would straddle the cut."""
    placeholders = (let("pp", f"split(regexp_replace(_text, {literal(fixed.PLACEHOLDER_PATTERN)}, '\\u0001$0\\u0001'), '\\u0001', -1)",
                        "transform(filter(sequence(0, size(pp) - 1), i -> i % 2 = 1), i -> named_struct('start', "
                        "aggregate(slice(pp, 1, i), 0, (t, x) -> t + length(x)), 'end', aggregate(slice(pp, 1, i + 1), 0, (t, x) -> t + length(x))))"))
    spans = f"sort_array(concat(transform(_found, f -> named_struct('start', f.start, 'end', f.end)), {placeholders}), false)"
    word = "length(regexp_extract(_text, '(?s)^(.*[ \\\\n\\\\t\\\\r])', 1))"
    first = f"least(length(_text) - {holdback}, {word})"
    bracket = "if(b > 0 AND instr(substr(_text, b, e - b + 1), ']') = 0 AND b - 1 >= sent_chars AND b - 1 >= e - 64, b - 1, e)"
    opened = let("e", first, let("b", "if(e > 0, e - instr(reverse(substr(_text, 1, e)), '[') + 1, 0)",
                                 f"if(e > 0 AND instr(substr(_text, 1, e), '[') > 0, {bracket}, e)"))
    settled = f"aggregate({spans}, {opened}, (e, s) -> if(s.start < e AND e < s.end, s.start, e))"
    return f"if(closed, length(_text), greatest({settled}, sent_chars))"


def step(pending: DataFrame, chunks: DataFrame, requests: DataFrame, policy: Policy, config: ScanConfig = ScanConfig(), *,
         holdback: int = fixed.STREAM_HOLDBACK) -> DataFrame:
    """One round: rows (request_id, block, out, leaked, closed, pending, sent_chars).

    `chunks` has (request_id, block, seq, delta, closed); `requests` (request_id, all_text, vault map and
    the rule columns team, teams, model, destination). A block's chunks of one round are one text, so
    gathering them is bounded by the answer.
    """
    if not incremental_allowed(policy):
        raise ValueError("a blocking output rule needs the whole answer: see guard_buffered")
    fresh = chunks.groupBy(*KEYS).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("delta")))),
                                 lambda c: c["delta"]), "").alias("_fresh"),
        F.max("closed").alias("closed"))
    rows = (pending.join(fresh, KEYS, "full_outer").join(requests, "request_id", "left")
            .withColumn("closed", F.coalesce("closed", F.lit(False))).withColumn("sent_chars", F.coalesce("sent_chars", F.lit(0)))
            .withColumn("vault", F.coalesce("vault", F.expr("cast(map() AS map<string,string>)")))
            .withColumn("_text", F.concat(F.coalesce("pending", F.lit("")), F.coalesce("_fresh", F.lit("")))))
    rows = (rows.withColumn("_found", F.expr(pinned(findings_sql("_text", config))))
            .withColumn("_end", F.expr(pinned(_cut(holdback))))
            .withColumn("_own", F.expr("filter(_found, f -> f.start >= sent_chars AND f.end <= _end)"))
            .withColumn("leaked", F.expr(f"array_sort(array_distinct({_leaks()}))"))
            .withColumn("out", F.expr(let("seg", "substr(_text, sent_chars + 1, _end - sent_chars)", let(
                "own", "transform(_own, f -> named_struct('entity', f.entity, 'start', f.start - sent_chars, 'end', f.end - sent_chars, 'score', f.score))",
                _render(_hidden_alone(policy)))))))
    keep = f"greatest(0, _end - {fixed.STREAM_CONTEXT})"
    return rows.select(*KEYS, "out", "leaked", "closed", F.expr(f"substr(_text, {keep} + 1)").alias("pending"),
                       F.expr(f"cast(_end - {keep} AS int)").alias("sent_chars"))


def guard_whole(answers: DataFrame, requests: DataFrame, policy: Policy, config: ScanConfig = ScanConfig()) -> DataFrame:
    """The one-shot result for complete answers (request_id, block, text)."""
    if not incremental_allowed(policy):
        return guard_buffered(answers, requests, policy, config).select(*KEYS, "out", "leaked")
    chunks = answers.select(*KEYS, F.lit(0).alias("seq"), F.col("text").alias("delta"), F.lit(True).alias("closed"))
    empty = answers.sparkSession.createDataFrame([], PENDING)
    return step(empty, chunks, requests, policy, config).select(*KEYS, "out", "leaked")


def guard_buffered(answers: DataFrame, requests: DataFrame, policy: Policy, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Complete answers (request_id, block, text) judged as wholes: what leaks in any block of an answer decides
    for all of them. Rows (request_id, block, out, leaked, action, reason, rules); a blocked answer has no out."""
    rows = (answers.withColumnRenamed("text", "_text").join(requests, "request_id", "left")
            .withColumn("vault", F.coalesce("vault", F.expr("cast(map() AS map<string,string>)")))
            .withColumn("_own", F.expr(pinned(findings_sql("_text", config))))
            .withColumn("leaked", F.expr(f"array_sort(array_distinct({_leaks()}))")))
    whole = Window.partitionBy("request_id")  # the blocks of one answer
    rows = rows.withColumn("output_leaked", F.array_sort(F.array_distinct(F.flatten(F.collect_list("leaked").over(whole)))))
    hidden = "(output.action = 'mask' AND array_contains(output.mask_entities, f.entity))"
    text = let("seg", "_text", let("own", "_own", _render(hidden)))
    return (evaluate_output(rows, policy)
            .select(*KEYS, F.expr(f"if(output.action = 'block', NULL, {text})").alias("out"), "leaked",
                    F.col("output.action").alias("action"), F.col("output.reason").alias("reason"), F.col("output.rules").alias("rules")))


class Waiting:
    """Waiting texts between micro-batches: a table in BUCKETS parts by key. A batch reads and writes anew only the parts
    that its own blocks fall in; a small list per batch names the version that holds each part. A replayed batch starts
    from the list before it and writes the same versions again, so versions that neither of the last two lists names,
    and older lists, are removed."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, keep_hours: float = KEEP_HOURS):
        self.spark, self.path, self.buckets, self.keep_hours = spark, path, buckets, keep_hours
        self.jvm = spark._jvm
        root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.files = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self):
        return F.pmod(F.xxhash64(*KEYS), F.lit(self.buckets)).cast("int").alias("bucket")

    def _names(self, folder: str, prefix: str) -> list[int]:
        at = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in self.files.listStatus(at)] if self.files.exists(at) else []
        return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix))

    def versions(self, number: int) -> dict[int, int]:
        """Which version holds each part after a batch."""
        if number < 0 or number not in self._names("lists", "batch="):
            return {}
        return dict(self.spark.read.schema("bucket int, version int").parquet(f"{self.path}/lists/batch={number}").select("bucket", "version").collect())

    def read(self, buckets: Sequence[int], number: int) -> DataFrame:
        """What waits in these parts before batch `number`."""
        held = self.versions(number - 1)
        paths = [f"{self.path}/texts/version={held[b]}/bucket={b}" for b in buckets if b in held]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def write(self, rows: DataFrame, buckets: Sequence[int], number: int) -> None:
        """These parts as they are after batch `number`, without what no text came for in `keep_hours`."""
        fresh = rows.filter(F.col("seen") >= F.current_timestamp() - F.expr(f"INTERVAL {int(self.keep_hours * 3600)} SECONDS"))
        fresh.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/texts/version={number}")
        held = {b: v for b, v in self.versions(number - 1).items() if b not in set(buckets)}
        held |= {b: number for b in self._names(f"texts/version={number}", "bucket=")}
        (self.spark.createDataFrame(sorted(held.items()), "bucket int, version int").coalesce(1)  # at most `buckets` rows
         .write.mode("overwrite").parquet(f"{self.path}/lists/batch={number}"))
        named = {*held.values(), *self.versions(number - 1).values(), number}
        for folder, prefix, keep in (("texts", "version=", named), ("lists", "batch=", {number - 1, number}), ("steps", "batch=", {number})):
            for old in set(self._names(folder, prefix)) - keep:
                if old < number:
                    self.files.delete(self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/{prefix}{old}"), True)


def guard_stream(chunks: DataFrame, requests: DataFrame, policy: Policy, config: ScanConfig, *, out_path: str, state_path: str,
                 checkpoint: str, once: bool = True, buckets: int = BUCKETS, keep_hours: float = KEEP_HOURS) -> StreamingQuery:
    """Run a step per micro-batch over the blocks that it has text for: their waiting texts, and their requests, are all
    that is read besides the batch."""
    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        waiting = Waiting(spark, state_path, buckets, keep_hours)
        own = batch.select(*KEYS).distinct()
        touched = sorted(r.bucket for r in own.select(waiting.bucket()).distinct().collect())  # at most `buckets` numbers
        held = waiting.read(touched, number)
        asked = requests.join(own.select("request_id").distinct(), "request_id", "left_semi")
        result = f"{state_path}/steps/batch={number}"
        step(held.join(own, KEYS, "left_semi").drop("seen"), batch, asked, policy, config).write.mode("overwrite").parquet(result)
        done = spark.read.parquet(result)
        kept = done.filter("NOT closed").select(*KEYS, "pending", "sent_chars", F.current_timestamp().alias("seen"))
        waiting.write(kept.unionByName(held.join(own, KEYS, "left_anti")), touched, number)
        (done.filter("out <> ''").select(*KEYS, F.lit(number).alias("batch"), "out", "leaked")
         .write.mode("overwrite").parquet(f"{out_path}/batch={number}"))

    return each_batch(chunks, checkpoint, work, once=once)


# --- server-sent events to deltas ---------------------------------------------------------------------
_CHAT = ("choices array<struct<index:int,delta:struct<content:string,tool_calls:array<struct<index:int,function:struct<arguments:string>>>>,"
         "finish_reason:string>>")


def deltas(events: DataFrame) -> DataFrame:
    """(request_id, block, kind, seq, delta) from event rows (request_id, api_format, seq, data). Text and
    tool arguments are separate blocks; other events carry no text."""
    def field(path: str) -> str:
        return f"get_json_object(data, '$.{path}')"

    rows = events.withColumn("_c", F.from_json("data", _CHAT))
    chat = ("flatten(transform(coalesce(_c.choices, array()), c -> concat("
            "if(c.delta.content IS NULL, array(), array(named_struct('block', concat('text-', coalesce(c.index, 0)), 'kind', 'text', 'delta', c.delta.content))), "
            "transform(filter(coalesce(c.delta.tool_calls, array()), t -> t.function.arguments IS NOT NULL), t -> named_struct('block', "
            "concat('args-', coalesce(c.index, 0), '-', coalesce(t.index, 0)), 'kind', 'args', 'delta', t.function.arguments)))))")
    one = "array(named_struct('block', concat({name}, {at}), 'kind', {kind}, 'delta', {delta}))"
    place = f"concat_ws('-', coalesce({field('output_index')}, '0'), {field('content_index')})"
    responses = (f"CASE {field('type')} WHEN 'response.output_text.delta' THEN "
                 + one.format(name="'text-'", at=place, kind="'text'", delta=field("delta"))
                 + " WHEN 'response.function_call_arguments.delta' THEN "
                 + one.format(name="'args-'", at=f"coalesce({field('output_index')}, '0')", kind="'args'", delta=field("delta")) + " END")
    messages = (f"CASE {field('delta.type')} WHEN 'text_delta' THEN "
                + one.format(name="'text-'", at=field("index"), kind="'text'", delta=field("delta.text"))
                + " WHEN 'input_json_delta' THEN "
                + one.format(name="'args-'", at=field("index"), kind="'args'", delta=field("delta.partial_json")) + " END")
    found = f"CASE api_format WHEN 'responses' THEN {responses} WHEN 'messages' THEN {messages} ELSE {chat} END"
    return rows.select("request_id", "seq", F.inline(F.expr(found)))


def sse_lines(lines: DataFrame) -> DataFrame:
    """Event rows from raw lines (request_id, api_format, seq, line): data lines only, end mark dropped."""
    data = F.ltrim(F.substring("line", 6, 1_000_000_000))
    return (lines.filter(F.col("line").startswith("data:")).withColumn("data", data).filter("data <> '[DONE]'").drop("line"))


def assemble(delta_rows: DataFrame, keys: Sequence[str] = ("request_id", "block", "kind")) -> DataFrame:
    """Each block's text in order; a block is one answer's text, so it is bounded by that answer."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    return delta_rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda d: d["delta"]), "").alias("text"))
