import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilkit.operators import anomaly as AN
from veilkit.operators import notify as N
from veilkit.operators import ordered as O
from veilkit.operators import quota as Q
from veilkit.operators import shadow as SH
from veilkit.plans import evaluation as E
from veilkit.plans import recommendations as R
from veilkit.plans import risk as K

START = datetime(2026, 3, 30, 23, 0, 0)
EVENT = ("event_id bigint, event_time timestamp_ntz, user string, team string, teams array<string>, model string, destination string, action string, "
         "output_action string, rules array<string>, output_rules array<string>, entities array<string>, output_leaked array<string>, injection_score double, "
         "api_format string, subject_hashes array<string>, prompt_tokens bigint, completion_tokens bigint, est_cost_usd double, quota string, reason string")


def event(i, seconds, **change):
    base = dict(event_id=i, event_time=START + timedelta(seconds=seconds), user="ali", team="a", teams=["a"], model="gpt-4o", destination="external", action="allow",
                output_action="", rules=[], output_rules=[], entities=[], output_leaked=[], injection_score=0.0, api_format="chat", subject_hashes=[],
                prompt_tokens=10, completion_tokens=5, est_cost_usd=0.01, quota="", reason="")
    return {**base, **change}


def frame(spark, events):
    return spark.createDataFrame(events, EVENT)


def test_ordered_helpers_equal_plain_loops(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 2), i * 13 + rnd.randint(0, 12), rnd.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, t bigint, v int")
    bucket = F.floor(F.col("t") / 100)
    lead = {(r.k, r.t): (r.nxt.t if r.nxt else None) for r in O.lead_struct(df, ["k"], ["t"], bucket, ["t"], "nxt").collect()}
    sums = {(r.k, r.t): (r.s, r.n) for r in O.row_numbers(O.running_totals(df, ["k"], ["t"], bucket, {"s": F.col("v")}, inclusive=False), ["k"], ["t"], bucket, "n").collect()}
    for key in range(3):
        mine = sorted(r for r in rows if r[0] == key)
        for i, (k, t, _) in enumerate(mine):
            assert lead[(k, t)] == (mine[i + 1][1] if i + 1 < len(mine) else None)
            assert sums[(k, t)] == (sum(r[2] for r in mine[:i]), i + 1)


def test_anomaly_once_per_window(spark):
    config = {"window_minutes": 60, "thresholds": {"blocked": 2, "subjects": 3, "secrets": 1}}
    events = [event(1, 0, action="block"), event(2, 10, output_action="block"), event(3, 20, action="block"), event(4, 4000, action="block"),
              event(5, 30, user="anonymous", action="block"), event(6, 40, user="", action="block"), event(7, 50, user="veli", subject_hashes=["a", "b"]),
              event(8, 60, user="veli", subject_hashes=["b"]), event(9, 70, user="veli", subject_hashes=["c", "d"]), event(10, 80, user="veli", subject_hashes=["e"]),
              event(11, 90, user="can", output_leaked=["SECRET_JWT"]), event(12, 95, user="can", entities=["SECRET_JWT"])]
    got = sorted((r.event_id, r.user, r.signal, r["count"]) for r in AN.alerts(frame(spark, events), config).collect())
    assert got == [(2, "ali", "blocked", 2), (9, "veli", "subjects", 4), (11, "can", "secrets", 1)]
    reasons = [r.reason for r in AN.alert_events(AN.alerts(frame(spark, events), config), config).orderBy("event_id").collect()]
    assert reasons[0] == "Anomali: son 60 dakikada 2 kez istek engellendi (eşik 2)"
    with pytest.raises(ValueError):
        AN.check_config({"window_minutes": 0, "thresholds": {"blocked": 1}})


def quota_loop(events, limits):
    """One request after another, as a counter service would see them."""
    minutes, used, out = {}, {}, {}
    for e in sorted(events, key=lambda e: (e["event_time"], e["event_id"])):
        minute, month = (e["team"], e["event_time"].replace(second=0, microsecond=0)), (e["team"], e["event_time"].strftime("%Y-%m"))
        minutes[minute] = minutes.get(minute, 0) + 1
        tokens, micro = used.get(month, (0, 0))
        if minutes[minute] > limits["requests_per_minute"]:
            out[e["event_id"]] = ("requests_per_minute", minutes[minute])
        elif tokens >= limits["monthly_tokens"]:
            out[e["event_id"]] = ("monthly_tokens", tokens)
        elif micro / 1e6 >= limits["monthly_cost_usd"]:
            out[e["event_id"]] = ("monthly_cost_usd", round(micro / 1e6, 4))
        else:
            used[month] = (tokens + e["prompt_tokens"] + e["completion_tokens"], micro + round((e["est_cost_usd"] or 0) * 1e6))
            out[e["event_id"]] = (None, None)
    return out


def test_quota_replay_equals_a_counter_service(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        events = [event(i, rnd.randint(0, 6000) * 1.5, team=rnd.choice("ab"), prompt_tokens=rnd.randint(0, 40), est_cost_usd=rnd.choice([None, 0.0, rnd.random() / 20])) for i in range(300)]
        limits = {"requests_per_minute": 3, "monthly_tokens": rnd.choice([900, 99999]), "monthly_cost_usd": rnd.choice([0.9, 999])}
        got = {r.event_id: (r.quota_kind, r.quota_used) for r in Q.replay(frame(spark, events), {"default": limits}).collect()}
        assert got == quota_loop(events, limits)


def test_quota_limits_and_rejections(spark):
    quotas = {"default": {"requests_per_minute": 1}, "teams": {"b": {"requests_per_minute": 5}}}
    rows = Q.with_quotas(frame(spark, [event(1, 0), event(2, 1), event(3, 2, team="b"), event(4, 3, action="block")]), quotas)
    by = {r.event_id: r for r in rows.collect()}
    assert by[2].action == "block" and by[2].rules == ["kota:requests_per_minute"] and by[2].est_cost_usd == 0.0
    assert by[2].reason == "Ekip dakikalık istek kotası aşıldı (2 / 1)." and by[2].quota == "requests_per_minute"
    assert by[1].quota == by[3].quota == by[4].quota == ""
    with pytest.raises(ValueError):
        Q.check_quotas({"default": {"rpm": 3}})


CHANNELS = [{"name": "k", "when": {"actions": ["block"]}, "cooldown_seconds": 300}, {"name": "hepsi", "when": {"sources": ["browser"]}, "cooldown_seconds": 0, "include_user": False}]


def cooldown_loop(events, seconds):
    until, waiting, out = {}, {}, {}
    for e in sorted(events, key=lambda e: (e["event_time"], e["event_id"])):
        key = (e["team"], ",".join(e["rules"]) or "block")
        if e["event_time"] < until.get(key, datetime.min):
            waiting[key] = waiting.get(key, 0) + 1
            out[e["event_id"]] = (False, 0)
        else:
            out[e["event_id"]] = (True, waiting.pop(key, 0))
            until[key] = e["event_time"] + timedelta(seconds=seconds)
    return out


def test_cooldown_equals_one_event_after_another(spark):
    rnd = random.Random(4)
    events = [event(i, rnd.randint(0, 40_000), action="block", team=rnd.choice("aab"), rules=rnd.choice([[], ["x"], ["x", "y"]])) for i in range(1500)]
    got = {r.event_id: (r.sent, r.suppressed) for r in N.cooldown(N.match_channels(frame(spark, events), CHANNELS)).collect()}
    assert got == cooldown_loop(events, 300)


def test_cooldown_of_one_key_with_a_million_events(spark):
    """One key, bursts and gaps: the sent rows follow from the times alone, and no task holds the key."""
    at = F.expr("timestampadd(SECOND, cast(id + 40 * floor(id / 1000) as int), TIMESTAMP_NTZ'2026-01-01 00:00:00')")
    rows = spark.range(1_000_000).select(F.col("id").alias("event_id"), at.alias("event_time"), F.lit("k").alias("channel"), F.lit("a").alias("team"),
                                         F.lit("x").alias("repeat_key"), F.lit(300).alias("cooldown"))
    got = N.cooldown(rows).groupBy("sent").agg(F.count(F.lit(1)).alias("n"), F.sum("suppressed").alias("held"), F.sum("event_id").alias("ids")).collect()
    sent, until, ids = 0, -1, 0
    for i in range(1_000_000):
        second = i + 40 * (i // 1000)
        if second >= until:
            sent, until, ids, last = sent + 1, second + 300, ids + i, i
    by = {r.sent: r for r in got}
    assert (by[True].n, by[True].ids, by[True].held) == (sent, ids, last - (sent - 1))
    slim = rows.select(F.to_json(F.struct("channel", "team", "repeat_key")).alias("key"), "event_id", F.col("event_id").alias("at"), F.lit(300).alias("cooldown"))
    placed = O.numbered(slim, ["key", "at", "event_id"], "row", ranges=8)
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
    assert placed.filter(F.col("row") != F.col("event_id")).isEmpty()


def test_channels_and_payload(spark):
    events = [event(1, 0, action="block", api_format="browser", rules=["r"], entities=["TCKN"], reason="neden", injection_score=0.9), event(2, 1), event(3, 2, action="mask", output_action="block", output_leaked=["SECRET_JWT"])]
    rows = N.payloads(N.cooldown(N.match_channels(frame(spark, events), CHANNELS)), console="https://konsol").orderBy("event_id", "channel").collect()
    assert [(r.event_id, r.channel) for r in rows] == [(1, "hepsi"), (1, "k"), (3, "k")]
    assert rows[0].summary == "Engellendi: neden" and "Kullanıcı" not in [f.title for f in rows[0].facts] and "Kullanıcı" in [f.title for f in rows[1].facts]
    assert rows[2].summary == "Engellendi (model cevabında sızıntı)" and rows[2].link == "https://konsol/xray#olaylar?event=3"
    assert '"severity":"block"' in rows[2].payload


def test_shadow_admission_is_all_or_nothing(spark):
    at = datetime(2026, 1, 1, 10, 0, 0)
    rows = [("b1", at, {"u": 2}), ("b2", at + timedelta(seconds=1), {"u": 2}), ("b3", at + timedelta(seconds=2), {"u": 1, "v": 1}), ("b4", at + timedelta(seconds=3), {"v": 2}), ("b5", at + timedelta(seconds=70), {"u": 3})]
    df = spark.createDataFrame(rows, "batch_id string, at timestamp_ntz, users map<string,int>")
    got = {r.batch_id: r.admitted for r in SH.admit_batches(df, per_user=3, total=5).collect()}
    assert got == {"b1": True, "b2": False, "b3": True, "b4": False, "b5": True}


def admitted(rows, per_user, total):
    """One batch after the other."""
    out, minute, used, seen = {}, None, 0, {}
    for batch, at, users in sorted(rows, key=lambda r: (r[1], r[0])):
        if at.replace(second=0) != minute:
            minute, used, seen = at.replace(second=0), 0, {}
        n = sum(users.values())
        out[batch] = used + n <= total and all(seen.get(u, 0) + c <= per_user for u, c in users.items())
        if out[batch]:
            used += n
            for u, c in users.items():
                seen[u] = seen.get(u, 0) + c
    return out


def test_shadow_admission_equals_one_batch_after_another(spark):
    rnd = random.Random(12)
    start = datetime(2026, 1, 1, 10, 0, 0)
    rows = [(f"b{i:04}", start + timedelta(seconds=rnd.randint(0, 400)), {u: rnd.randint(0, 6) for u in rnd.sample("uvwxyz", rnd.randint(0, 3))}) for i in range(900)]
    df = spark.createDataFrame(rows, "batch_id string, at timestamp_ntz, users map<string,int>")
    got = {r.batch_id: r.admitted for r in SH.admit_batches(df.repartition(7), per_user=5, total=25).collect()}
    assert got == admitted(rows, 5, 25) and 100 < sum(got.values()) < 800


def test_one_minute_of_many_batches_is_judged_in_blocks(spark):
    """A million batches in one minute, a hundred users with ten events each admitted."""
    users = F.create_map(F.concat(F.lit("u"), F.col("id") % 1000), F.lit(1))
    at = F.expr("timestampadd(MICROSECOND, cast(id * 50 as int), TIMESTAMP_NTZ'2026-01-01 00:00:00')")
    batches = spark.range(1_000_000).select(F.col("id").alias("batch_id"), at.alias("at"), users.alias("users"))
    got = SH.admit_batches(batches, per_user=10, total=1000).filter("admitted").agg(F.count(F.lit(1)), F.max("batch_id")).first()
    assert tuple(got) == (1000, 999)


def test_risk_score_numbers(spark):
    base = dict(user="ayse", team="analitik", requests=120, injection=2, secrets=1, output_leaks=0, overrides=3, blocked=4, unmasked_pii_external=6, subjects=30,
                after_hours=5, risky_24h=2, risky_before=20)
    quiet = {**base, **{k: 0 for k in list(base)[3:11]}, "user": "u", "risky_24h": 6, "risky_before": 29}
    rows = [base, quiet, {**quiet, "user": "v", "risky_24h": 4}, {**quiet, "user": "w", "risky_before": 290}]
    schema = "user string, team string, " + ", ".join(f"{k} bigint" for k in list(base)[2:])
    a, u, v, w = K.score(spark.createDataFrame(rows, schema), 30).orderBy("user").collect()
    assert a.score == round(100 * (1 - 2.718281828459045 ** (-41 / 20))) and a.reasons[0].signal == "injection" and a.reasons[0].points == 10.0
    assert (a.spike, a.daily_avg, len(a.reasons)) == (False, 0.7, 7)
    assert u.spike and not v.spike and not w.spike and u.score > v.score == 0


SUMMARY = {"requests": 100, "risky_total": 30, "risky_exposed": 6, "risky_would": 14, "pii_external_total": 20, "pii_external_protected": 5, "pii_external_would": 12,
           "secrets_total": 4, "secrets_protected": 4, "secrets_would": 0, "corporate_external_total": 0, "corporate_external_protected": 0, "corporate_external_would": 0,
           "injection_total": 5, "injection_protected": 1, "injection_would": 2, "output_leak_total": 0, "output_leak_protected": 0, "output_leak_would": 0}
ENTITY_ROWS = [("TCKN", "gpt-4o", "external", 10, 2, 6), ("TCKN", "gpt-4o-mini", "external", 2, 0, 0), ("TCKN", "vllm/qwen3", "internal", 50, 0, 0),
               ("PHONE_TR", "gemini-2.5-pro", "external", 3, 0, 0), ("SECRET_AWS_KEY", "vllm/qwen3", "internal", 2, 0, 0), ("KURUM_PROJE", "gpt-4o", "external", 4, 4, 0)]


def test_evaluation_tables_and_advice(spark):
    summary = spark.createDataFrame([SUMMARY], ", ".join(f"{k} bigint" for k in SUMMARY))
    outcomes = {r.risk: (r.total, r.protected, r.would, r.exposed) for r in E.outcomes(summary).collect()}
    assert outcomes["risky"] == (30, 10, 14, 6) and outcomes["pii_external"] == (20, 5, 12, 3) and outcomes["injection"][3] == 2
    rows = spark.createDataFrame(ENTITY_ROWS, "entity string, model string, destination string, requests bigint, protected bigint, would bigint")
    abroad = {(r.entity, r.provider): r for r in E.cross_border(rows, labels={"KURUM_PROJE": "Proje"}).collect()}
    r = abroad[("TCKN", "OpenAI")]
    assert (r.label, r.country, r.total, r.protected, r.would, r.exposed) == ("T.C. kimlik no", "ABD", 12, 2, 6, 4)
    assert not any(e == "SECRET_AWS_KEY" for e, _ in abroad)
    totals = E.entity_totals(rows, {"KURUM_PROJE": "Proje"})
    by = {r.entity: r for r in totals.collect()}
    assert by["TCKN"].total == 12 and by["SECRET_AWS_KEY"].exposed == 2 and by["KURUM_PROJE"].label == "Proje" and totals.first().entity == "TCKN"
    empty_sites = spark.createDataFrame([], "site string, users bigint, visits bigint, with_data bigint, masked bigint, cancelled bigint, blocked bigint, overridden bigint, redirected bigint")
    noisy = spark.createDataFrame([("PHONE_TR", "Telefon", 20, 0, 5), ("TCKN", "T.C. kimlik no", 5, 0, 5)], "entity string, label string, events bigint, overridden bigint, false_positives bigint")
    rules = spark.createDataFrame([("telefon-gozlem", "monitor", 7)], "rule string, mode string, hits bigint")
    undeclared = spark.createDataFrame([(3,)], "unclassified bigint")
    advice = R.recommend(E.outcomes(summary), totals, rules, empty_sites, E.shadow_totals(empty_sites), noisy, undeclared).collect()
    assert [a.priority for a in advice] == ["high", "high", "high", "medium", "medium", "medium", "low"]
    assert "entity_in: [TCKN, PHONE_TR]" in advice[0].policy and advice[0].detail.startswith("7 istekte T.C. kimlik no, Telefon")
    assert "telefon-gozlem (7)" in advice[3].detail and "eklentisini dağıtın" in advice[4].title and "Telefon (%25)" in advice[5].detail


def test_approximate_subjects_are_close(spark):
    rnd = random.Random(1)
    events = [event(i, i, user=f"u{i % 40}", subject_hashes=[f"h{rnd.randint(0, 10_000)}" for _ in range(i % 40)]) for i in range(800)]
    exact = {}
    for e in events:
        exact.setdefault(e["user"], set()).update(e["subject_hashes"])
    config = {"window_minutes": 1440, "thresholds": {"subjects": 300}}
    got = {r.user: r.subjects for r in AN.approximate_subjects(frame(spark, events).withColumn("event_time", F.lit("2026-03-31 10:00:00").cast("timestamp_ntz")), config).collect()}
    assert set(got) >= {u for u, h in exact.items() if len(h) >= 320} and not set(got) & {u for u, h in exact.items() if len(h) < 280}
    assert all(abs(n - len(exact[u])) <= 0.05 * len(exact[u]) for u, n in got.items())
