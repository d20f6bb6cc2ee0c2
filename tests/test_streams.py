import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tests import corpus
from tests.test_state import CHANNELS, EVENT, cooldown_loop, event
from veilkit import defaults
from veilkit.operators import anomaly as AN
from veilkit.operators import quota as Q
from veilkit.operators import sessions as SE
from veilkit.session import materialize
from veilkit.sources import audit as SA
from veilkit.streaming import alerts as AL
from veilkit.streaming import guard as G
from veilkit.streaming import ingest as IN
from veilkit.streaming import quotas as QS
from veilkit.streaming import sessions as SS


def in_files(spark, rows, schema, folder, files):
    """The rows as files that arrive one after the other."""
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(rows, spark, folder):
    IN.append(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out").collect()


def test_ingest_restarts_without_duplicates(spark, tmp_path):
    line = '{"event_id":"%s","ts":%d,"user":"u","team":"a","model":"m","action":"allow","rules":["x"],"yeni":1}'
    def write(n, start):
        rows = [(line % (uuid.UUID(int=start + i), 1706648400000 + i),) for i in range(n)] + [("bozuk",), (line % ("kötü-id", 1),)]
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/queue")
    for start, n in ((1, 5), (100, 7)):
        write(n, start)
        IN.ingest_audit(IN.folder_lines(spark, f"{tmp_path}/queue"), f"{tmp_path}/audit", f"{tmp_path}/checkpoint").awaitTermination()
    rows = SA.read_audit(spark, f"{tmp_path}/audit").orderBy("event_id").collect()
    assert len(rows) == 12 and rows[0].month == 202401 and str(rows[0].event_time) == "2024-01-31 00:00:00"
    assert rows[0].rules == ["x"] and rows[0].entities == [] and rows[0].reason == "" and rows[0].est_cost_usd is None


def test_anomaly_stream_equals_batch_over_several_batches(spark, tmp_path):
    rnd = random.Random(6)
    config = {"window_minutes": 30, "thresholds": {"blocked": 3, "subjects": 4}}
    events = [event(i, i * 30, user=rnd.choice(["ali", "veli", "anonymous"]), action=rnd.choice(["block", "allow"]), subject_hashes=rnd.sample("abcdefgh", 2)) for i in range(300)]
    stream = in_files(spark, events, EVENT, f"{tmp_path}/in", 5)
    got = {(int(r.event_id), r.user, r.signal, r["count"]) for r in drained(AL.anomaly_stream(stream, config), spark, tmp_path)}
    want = {(r.event_id, r.user, r.signal, r["count"]) for r in AN.alerts(spark.createDataFrame(events, EVENT), config).collect()}
    assert got == want and len(want) > 10


def test_users_that_share_a_part_of_the_state_are_counted_apart(spark, tmp_path):
    rnd = random.Random(8)
    config = {"window_minutes": 60, "thresholds": {"blocked": 2, "subjects": 3}}
    events = [event(i, i * 30, user=f"u{rnd.randint(0, 9)}", action=rnd.choice(["block", "allow"]), subject_hashes=rnd.sample("abcdefgh", 2)) for i in range(300)]
    want = {(r.event_id, r.user, r.signal, r["count"]) for r in AN.alerts(spark.createDataFrame(events, EVENT), config).collect()}
    rows = AL.anomaly_stream(in_files(spark, events, EVENT, f"{tmp_path}/in", 5), config, parts=1)
    assert {(int(r.event_id), r.user, r.signal, r["count"]) for r in drained(rows, spark, tmp_path)} == want and len(want) > 10


def test_cooldown_stream_equals_one_event_after_another(spark, tmp_path):
    rnd = random.Random(9)
    events = [event(i, i * 45, action="block", team=rnd.choice("ab"), rules=rnd.choice([[], ["x"]])) for i in range(200)]
    stream = in_files(spark, events, EVENT, f"{tmp_path}/in", 4)
    got = {int(r.event_id): (r.sent, r.suppressed) for r in drained(AL.cooldown_stream(stream, CHANNELS), spark, tmp_path)}
    assert got == cooldown_loop(events, 300)


def test_sessions_join_within_their_time_to_live(spark, tmp_path):
    schema = "event_id bigint, event_time timestamp_ntz, source string, session_id string"
    def rows(pairs):
        return [(i, event(0, s)["event_time"], "proxy", k) for i, s, k in pairs]
    asked, answered = rows([(1, 0, "a"), (2, 500, "a"), (3, 0, "b")]), rows([(10, 30, "a"), (11, 1000, "a"), (12, 1200, "a"), (13, 20, "b"), (14, 700, "b"), (15, 5, "c")])
    batch = {r.event_id: r.request_id for r in SE.join_sessions(spark.createDataFrame(asked, schema), spark.createDataFrame(answered, schema)).collect()}
    assert batch == {10: 1, 11: 2, 12: None, 13: 3, 14: None, 15: None}
    end = [(99, event(0, 90_000)["event_time"], "proxy", "end")]  # a later event on both sides lets the watermark pass all others
    one, two = in_files(spark, asked + end, schema, f"{tmp_path}/q", 1), in_files(spark, answered + end, schema, f"{tmp_path}/r", 2)
    got = {r.event_id: r.request_id for r in drained(SS.join_stream(one, two), spark, tmp_path) if r.event_id != 99}
    assert got == batch


def test_a_leak_is_reported_once_per_time_to_live(spark, tmp_path):
    schema = "event_id bigint, event_time timestamp_ntz, source string, session_id string"
    rnd = random.Random(4)
    rows = [(i, event(0, s)["event_time"], "proxy", k) for i, (s, k) in enumerate(sorted((rnd.randrange(40_000), rnd.choice("abcd")) for _ in range(150)))]
    rows.append((500, event(0, 172_800)["event_time"], "proxy", "a"))  # two days later
    want, last = set(), {}
    for i, at, _, k in rows:
        if k not in last or (at - last[k]).total_seconds() > 600:
            want.add(i)
        last[k] = at
    assert {r.event_id for r in SE.report_once(spark.createDataFrame(rows, schema)).collect()} == want
    assert 500 in want and len(want) < 150
    got = drained(SS.report_once_stream(in_files(spark, rows, schema, f"{tmp_path}/o", 3)), spark, f"{tmp_path}/once")
    assert {r.event_id for r in got} == want


REQUEST = ("request_id string, all_text string, vault map<string,string>, team string, teams array<string>, model string, destination string")


def test_guard_is_independent_of_chunking(spark):
    rnd = random.Random(12)
    answers = {f"r{i}": "Cevap [TCKN_1] " + corpus.text(rnd, 25).replace("[TCKN_1]", "") + " [PHONE_TR_1], [TCKN_9] son [TCKN_" for i in range(40)}
    requests = spark.createDataFrame([(k, "Soru " + t[30:60], {"[TCKN_1]": "10000000146", "[PHONE_TR_1]": "0532 000 00 00"}, "a", ["a"], "gpt-4o", "external") for k, t in answers.items()], REQUEST)
    policy, config = defaults.policy(), defaults.SCAN
    whole = {r.request_id: r.out for r in G.guard_whole(spark.createDataFrame([(k, "b", t) for k, t in answers.items()], "request_id string, block string, text string"), requests, policy, config).collect()}
    assert any("[GİZLENDİ:" in t for t in whole.values()) and all("10000000146" in t for t in whole.values())
    pending, got, at = spark.createDataFrame([], G.PENDING), dict.fromkeys(answers, ""), dict.fromkeys(answers, 0)
    for number in range(4):
        chunks = []
        for k, t in answers.items():
            end = len(t) if number == 3 else min(len(t), at[k] + rnd.randint(0, len(t) // 2))
            cut = rnd.randint(at[k], end)
            chunks += [(k, "b", 0, t[at[k]:cut], False), (k, "b", 1, t[cut:end], number == 3)]
            at[k] = end
        rows = materialize(G.step(pending, spark.createDataFrame(chunks, "request_id string, block string, seq int, delta string, closed boolean"), requests, policy, config))
        for r in rows.collect():
            got[r.request_id] += r.out
        pending = rows.filter("NOT closed").select("request_id", "block", "pending", "sent_chars")
    assert got == whole


def test_blocking_output_rules_need_the_whole_answer(spark):
    policy = defaults.policy(output_rules=[{"name": "dur", "when": {"entity_in": ["SECRET_*"]}, "action": "block"}])
    with pytest.raises(ValueError):
        G.step(spark.createDataFrame([], G.PENDING), None, None, policy)


def test_server_sent_events(spark):
    lines = [("c", "chat", 'data: {"choices":[{"index":0,"delta":{"content":"Mer"}}]}'), ("c", "chat", 'data: {"choices":[{"index":0,"delta":{"content":"haba","tool_calls":[{"index":0,"function":{"arguments":"{\\"a\\""}}]}}]}'),
             ("c", "chat", 'data: {"choices":[{"index":0,"delta":{"tool_calls":[{"index":0,"function":{"arguments":":1}"}}]}}]}'), ("c", "chat", "data: [DONE]"), ("c", "chat", ": yorum"),
             ("m", "messages", "event: content_block_delta"), ("m", "messages", 'data: {"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"sel"}}'),
             ("m", "messages", 'data: {"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"am"}}'), ("m", "messages", 'data: {"type":"content_block_delta","index":1,"delta":{"type":"input_json_delta","partial_json":"{}"}}'),
             ("r", "responses", 'data: {"type":"response.output_text.delta","output_index":1,"content_index":0,"delta":"ok"}'), ("r", "responses", 'data: {"type":"response.completed"}')]
    df = spark.createDataFrame([(k, f, i, t) for i, (k, f, t) in enumerate(lines)], "request_id string, api_format string, seq int, line string")
    got = {(r.request_id, r.kind): r.text for r in G.assemble(G.deltas(G.sse_lines(df))).collect()}
    assert got == {("c", "text"): "Merhaba", ("c", "args"): '{"a":1}', ("m", "text"): "selam", ("m", "args"): "{}", ("r", "text"): "ok"}


def test_invalid_browser_lines_are_kept_with_their_reason(spark):
    good = '{"event_id":"1","event_time":"2024-01-05T10:00:00","site":"chatgpt.com","action":"visit"}'
    lines = spark.createDataFrame([(good,), ("bozuk",), (good.replace("visit", "yok"),), (good.replace("chatgpt.com", "a b"),)], "value string")
    got = {r.value: r.problem for r in IN.browser_rejects(lines).collect()}
    assert sorted(got.values()) == ["action", "site", "site"] and good not in got
    assert IN.browser_stream(lines).count() == 1


def test_a_blocked_answer_stops_all_its_blocks(spark):
    answers = spark.createDataFrame([("a", "x", "yaz@ornek.com"), ("a", "y", "4111 1111 1111 1111"), ("b", "x", "[TCKN_1] kisi.abcdef@example.com")],
                                    "request_id string, block string, text string")
    requests = spark.createDataFrame([(r, "", {"[TCKN_1]": "10000000146", "kisi.abcdef@example.com": "ali@x.com"}, "t", ["t"], "gpt-4o", "external") for r in "ab"],
                                     "request_id string, all_text string, vault map<string,string>, team string, teams array<string>, model string, destination string")
    rules = [{"name": "kart", "when": {"entity_in": ["CREDIT_CARD"]}, "action": "block", "message": "kart"}]
    policy = defaults.policy(output_rules=rules)
    rows = {(r.request_id, r.block): r for r in G.guard_buffered(answers, requests, policy).collect()}
    assert [rows[k].out for k in sorted(rows)] == [None, None, "10000000146 ali@x.com"]
    assert rows["a", "x"].leaked == ["EMAIL_ADDRESS"] and rows["b", "x"].leaked == [] and rows["a", "y"].action == "block"
    assert {r.out for r in G.guard_whole(answers, requests, policy).collect()} == {None, "10000000146 ali@x.com"}


QUOTAS = {"default": {"requests_per_minute": 3, "monthly_tokens": 9_000}, "teams": {"b": {"monthly_cost_usd": 2.0, "requests_per_minute": 5}, "c": {"monthly_tokens": 500}}}


def quota_requests(n, seed=11):
    rnd = random.Random(seed)
    return sorted((event(i, (i // 9) * 3600 + i % 9 if i % 3 else rnd.randint(0, 45 * 86_400), team=rnd.choice(["a", "a", "b", "c"]), prompt_tokens=rnd.randint(0, 60),
                         completion_tokens=rnd.randint(0, 40), est_cost_usd=rnd.choice([None, 0.01, 0.031])) for i in range(n)), key=lambda e: (e["event_time"], e["event_id"]))


def test_live_quotas_equal_the_replay(spark, tmp_path):
    """In many micro-batches and over restarts from the checkpoint; two months, limits of all kinds."""
    QS.keep_state_in_rocksdb(spark)
    events = quota_requests(900)
    columns = ["event_id", "event_time", "team", "prompt_tokens", "completion_tokens", "est_cost_usd"]
    schema = spark.createDataFrame(events[:1], EVENT).select(*columns).schema
    for part in range(3):
        for i in range(2):
            lo = (part * 2 + i) * 150
            spark.createDataFrame(events[lo:lo + 150], EVENT).select(*columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        IN.append(QS.quota_stream(stream, QUOTAS), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    out = {int(r.event_id): (r.minute_count, r.retry_after, r.quota_kind, r.quota_limit, r.quota_used) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r.event_id: (r.minute_count, r.retry_after, r.quota_kind, r.quota_limit, r.quota_used) for r in Q.replay(spark.createDataFrame(events, EVENT), QUOTAS).collect()}
    assert out == want and {k for _, _, k, _, _ in out.values()} == {None, *Q.LIMITS}


def test_quota_state_is_let_go(spark, tmp_path):
    """After the watermark has passed them, no minute and no earlier month is kept."""
    QS.keep_state_in_rocksdb(spark)
    columns = ["event_id", "event_time", "team", "prompt_tokens", "completion_tokens", "est_cost_usd"]
    events = [event(i, i * 61, team="a") for i in range(50)] + [event(99, 70 * 86_400, team="a"), event(100, 70 * 86_400 + 9000, team="a")]
    schema = spark.createDataFrame(events[:1], EVENT).select(*columns).schema
    for part in (events[:50], events[50:51], events[51:]):
        spark.createDataFrame(part, EVENT).select(*columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        IN.append(QS.quota_stream(stream, QUOTAS), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    state = lambda name: spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", name).load().count()
    assert state("minutes") <= 2 and state("months") == 1


CHUNK = "request_id string, block string, seq int, delta string, closed boolean"


def guard_round(spark, folder, rows, **options):
    """One more round of chunks through the guard; (request, out) of all rounds so far."""
    spark.createDataFrame(rows, CHUNK).write.mode("append").parquet(f"{folder}/chunks")
    stream = spark.readStream.schema(CHUNK).parquet(f"{folder}/chunks")
    asked = spark.range(400).select(F.concat(F.lit("r"), F.col("id")).alias("request_id"), F.lit("soru").alias("all_text"), F.expr("cast(map() AS map<string,string>)").alias("vault"),
                                    F.lit("a").alias("team"), F.array(F.lit("a")).alias("teams"), F.lit("gpt-4o").alias("model"), F.lit("external").alias("destination"))
    G.guard_stream(stream, asked, defaults.policy(), defaults.SCAN, out_path=f"{folder}/out", state_path=f"{folder}/state", checkpoint=f"{folder}/checkpoint",
                   buckets=16, **options).awaitTermination()
    return G.assemble(spark.read.parquet(f"{folder}/out").select("request_id", "block", F.col("batch").alias("seq"), F.col("out").alias("delta")), ("request_id", "block")).collect()


def test_a_batch_of_the_guard_touches_its_own_blocks(spark, tmp_path):
    card = "4111 1111 1111 1111"
    guard_round(spark, tmp_path, [(f"r{i}", "text-0", 0, f"Kart {card[:9]}", False) for i in range(300)])
    waiting = G.Waiting(spark, f"{tmp_path}/state", 16)
    first = waiting.versions(0)
    assert set(first) == set(range(16)) and set(first.values()) == {0}
    mine = spark.createDataFrame([("r5", "text-0")], "request_id string, block string").select(waiting.bucket()).first().bucket
    assert waiting.read([mine], 1).count() < 60 and waiting.read(list(first), 1).count() == 300
    out = {r.request_id: r.text for r in guard_round(spark, tmp_path, [("r5", "text-0", 1, f"{card[9:]} tamam", True), ("r6", "text-1", 0, "kısa", True)])}
    assert out["r5"] == "Kart [GİZLENDİ:CREDIT_CARD] tamam" and out["r6"] == "kısa"
    second = waiting.versions(1)
    changed = {b for b in range(16) if second.get(b) != 0}
    assert mine in changed and len(changed) <= 2 and waiting.read(list(range(16)), 2).count() == 299
    for n in range(2, 5):
        guard_round(spark, tmp_path, [(f"r{i}", "text-0", n, " söz" * 40, False) for i in range(300) if i != 5])
    assert waiting._names("lists", "batch=") == [3, 4] and waiting._names("steps", "batch=") == [4] and waiting._names("texts", "version=")[0] >= 2
    assert waiting.read(list(range(16)), 5).agg(F.max(F.length("pending"))).first()[0] < 400


def test_blocks_without_text_are_forgotten(spark, tmp_path):
    guard_round(spark, tmp_path, [(f"r{i}", "text-0", 0, "söz verdim ki", False) for i in range(300)], keep_hours=1e-3)
    time.sleep(5)
    guard_round(spark, tmp_path, [(f"r{i}", "text-1", 0, "yeni söz", False) for i in range(300)], keep_hours=1e-3)
    assert G.Waiting(spark, f"{tmp_path}/state", 16).read(list(range(16)), 2).select("block").distinct().count() == 1
