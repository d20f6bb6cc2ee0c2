"""What is kept between runs: daily states, scan results, Bloom filters, versions at a time, prefix tables."""

import bisect
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_state import EVENT, event
from veilkit.operators import policy as P
from veilkit.operators import policy_log as L
from veilkit.operators import prefix_table as PX
from veilkit.operators import scan as S
from veilkit.operators import scan_store as ST
from veilkit.plans import daily_states as DS
from veilkit.plans import usage as U
from veilkit.sources import audit as SA

START = datetime(2026, 3, 1)


def rows_read(df):
    """Rows that the file scans of a query gave out, after it ran."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if node.nodeName().startswith("Scan parquet"):
            out.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return sum(out)


# --- daily states ---------------------------------------------------------------------------------------

EXTRA = ", would_action string, latency_ms double, masked_entities array<string>, monitored_rules array<string>"


def traffic(spark, n, seed=2):
    rnd = random.Random(seed)
    rows = [event(i, rnd.randint(0, 12 * 86_400), user=f"u{rnd.randint(0, 60)}", team=rnd.choice("abc"), action=rnd.choice(["allow", "mask", "block", "alert"]),
                  destination=rnd.choice(["external", "internal"]), model=rnd.choice(["m1", "m2"]), entities=rnd.sample(["TCKN", "SECRET_JWT", "IBAN_TR"], rnd.randint(0, 2)),
                  rules=rnd.sample(["x", "y"], rnd.randint(0, 2)), injection_score=rnd.choice([0.0, 0.7]), est_cost_usd=rnd.choice([None, 0.25, 0.5]),
                  event_time=START + timedelta(seconds=rnd.randint(0, 12 * 86_400))) for i in range(n)]
    extra = {"would_action": "allow", "latency_ms": 4.0, "masked_entities": ["TCKN"], "monitored_rules": ["z"]}
    return spark.createDataFrame([{**r, **extra} for r in rows], EVENT + EXTRA)


@pytest.fixture(scope="module")
def stored_days(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("days"))
    traffic(spark, 3000).write.parquet(f"{folder}/audit")
    audit, users = spark.read.parquet(f"{folder}/audit"), None
    for lo, hi in ((1, 5), (5, 9)):
        part = audit.filter((F.dayofmonth("event_time") >= lo) & (F.dayofmonth("event_time") < hi))
        DS.number_users(part, users).write.mode("append").parquet(f"{folder}/numbers")
        users = spark.read.parquet(f"{folder}/numbers")
        DS.write_days(part, users, f"{folder}/states")
    DS.number_users(audit, users).write.mode("append").parquet(f"{folder}/numbers")
    return folder, audit, spark.read.parquet(f"{folder}/numbers")


@pytest.mark.parametrize("as_of, days, team", [("2026-03-13 00:00:00", 12, ""), ("2026-03-13 00:00:00", 7, "a"), ("2026-03-12 15:30:00", 9, ""), ("2026-03-20 00:00:00", 2, "")])
def test_reports_from_days_equal_those_from_the_audit(spark, stored_days, as_of, days, team):
    folder, audit, users = stored_days
    states = DS.States(spark, f"{folder}/states", audit, users, as_of, days, team)
    for name in ("summary", "daily", "by_team", "by_model", "by_format", "entities", "rules", "top_users"):
        want = getattr(U, name)(audit, as_of, days, team)
        got = getattr(states, name)().select(*want.columns)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()], name


def test_numbers_have_no_gaps(stored_days):
    folder, audit, users = stored_days
    numbers = sorted(r.number for r in users.collect())
    assert numbers == list(range(audit.select("user").distinct().count()))


def test_closed_days_are_not_read_from_the_audit(spark, stored_days):
    folder, audit, users = stored_days
    states = DS.States(spark, f"{folder}/states", audit, users, "2026-03-13 00:00:00", 12)
    assert states.rest.agg(F.min("event_time")).first()[0] >= datetime(2026, 3, 9)
    assert states.rest.count() == audit.filter("event_time >= TIMESTAMP_NTZ'2026-03-09 00:00:00'").count()


# --- scan results ---------------------------------------------------------------------------------------

def test_second_run_scans_nothing(spark, tmp_path):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["TC 10000000146", "boş", "TC 10000000146", None, "", "ara 0532 123 45 67"] * 5)], "id int, text string")
    path = str(tmp_path / "scans")
    assert ST.unseen(texts, path).count() == 4
    first = {r.id: r.findings for r in ST.scan_stored(texts.filter("id < 12"), path).collect()}
    assert ST.unseen(texts, path).count() == 0
    again = {r.id: r.findings for r in ST.scan_stored(texts, path).collect()}
    whole = {r.id: r.findings for r in S.with_findings(texts).collect()}
    assert again == whole and all(first[i] == whole[i] for i in first)
    assert S.ScanConfig() != (other := S.ScanConfig(min_score=0.9)) and ST.unseen(texts, path, other).count() == 4
    assert {r.id: r.findings for r in ST.scan_stored(texts, path, other).collect()} == {r.id: r.findings for r in S.with_findings(texts, other).collect()}
    assert ST.unseen(texts, path).count() == 0 and ST.unseen(texts, path, other).count() == 0


# --- Bloom filters --------------------------------------------------------------------------------------

def test_looking_up_one_value_reads_few_row_groups(spark, tmp_path):
    """Of 40 row groups in no order of the value, one is read, and now and then another by chance: at most a tenth."""
    n = 40_000
    ids = F.sha2(F.col("id").cast("string"), 256)
    audit = spark.range(n).select(ids.alias("event_id"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("event_time"), F.lit("a").alias("team"),
                                  F.lit("allow").alias("action"), F.lit(197001).alias("month"), F.array(F.substring(ids, 1, 32)).alias("subject_hashes"))
    options = {"parquet.block.size": "65536", "parquet.page.size": "8192"}
    for k, v in options.items():
        spark._jsc.hadoopConfiguration().set(k, v)
    try:
        SA.write_audit(audit, f"{tmp_path}/audit", files_per_month=4, rows_expected=2000)
        SA.write_subject_index(SA.subject_index(audit), f"{tmp_path}/index", files_per_month=4, hashes_expected=2000)
    finally:
        for k in options:
            spark._jsc.hadoopConfiguration().unset(k)
    stored, index = SA.read_audit(spark, f"{tmp_path}/audit"), spark.read.parquet(f"{tmp_path}/index")
    for wanted in (7, 31_234):
        one = SA.find_events(stored, [audit.filter(F.col("event_id") == F.sha2(F.lit(str(wanted)), 256)).first().event_id])
        assert one.count() == 1 and 0 < rows_read(one) <= n / 10
        hit = SA.find_hashes(index, [audit.filter(F.col("event_id") == F.sha2(F.lit(str(wanted)), 256)).first().subject_hashes[0]])
        assert hit.count() == 1 and 0 < rows_read(hit) <= n / 10
    assert rows_read(SA.find_events(stored, ["not there"])) <= n / 10


# --- versions -------------------------------------------------------------------------------------------

def test_version_at_equals_plain_search(spark):
    rnd = random.Random(4)
    log = [(rnd.randint(1, 9), START + timedelta(minutes=rnd.randint(0, 3000)), f"e{i:03}", rnd.choice(["approved", "applied", "emergency", "created", "rejected"])) for i in range(60)]
    rows = [(i, START + timedelta(minutes=rnd.choice([rnd.randint(-50, 3100), 1500]))) for i in range(900)]
    events = spark.createDataFrame(log, "version bigint, ts timestamp_ntz, event_id string, event string")
    got = L.version_at(spark.createDataFrame(rows, "id int, event_time timestamp_ntz").repartition(5), events).collect()
    active = sorted((t, e, v) for v, t, e, kind in log if kind in L.ACTIVATING)
    at = [t for t, _, _ in active]
    assert len(got) == len(rows)
    for r in got:
        place = bisect.bisect_right(at, r.event_time)
        assert r.policy_version == (active[place - 1][2] if place else None)


def test_version_without_a_log(spark):
    none = spark.createDataFrame([], "version bigint, ts timestamp_ntz, event_id string, event string")
    rows = spark.createDataFrame([(1, START)], "id int, event_time timestamp_ntz")
    assert L.version_at(rows, none).first().policy_version is None


def test_each_row_is_judged_by_its_version(spark):
    rules = {1: [{"name": "a", "when": {"entity_in": ["TCKN"]}, "action": "block"}], 2: [{"name": "b", "action": "alert"}]}
    rows = spark.createDataFrame([{**event(i, i, entities=["TCKN"] if i % 2 else []), "policy_version": v} for i, v in enumerate([1, 1, 2, 2, None, 7])], EVENT + ", policy_version int")
    got = [r.decision and r.decision.action for r in L.evaluate_at(rows, {v: P.Policy(rules=r) for v, r in rules.items()}).orderBy("event_id").collect()]
    assert got == ["allow", "block", "alert", "alert", None, None]


# --- prefixes -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("ordered", [False, True])
def test_prefixes_equal_plain_search(spark, ordered):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("ab-") for _ in range(n))
    table = [(word(rnd.randint(0, 5)), f"v{i}", i) for i in range(40)] + [(None, "x", 0)]
    rows = [(i, rnd.choice([None, "", *(word(rnd.randint(1, 8)) for _ in range(6))])) for i in range(300)]
    prefixes = spark.createDataFrame(table, "prefix string, value string, place int")
    got = {r.id: r.hit for r in PX.longest_prefix(spark.createDataFrame(rows, "id int, model string"), "model", prefixes, into="hit", ordered=ordered).collect()}
    for i, model in rows:
        hits = [(p, v, n) for p, v, n in table if model is not None and p is not None and model.startswith(p)]
        best = min(hits, key=lambda h: (h[2], h[1]), default=None) if ordered else min(hits, key=lambda h: (-len(h[0]), h[1]), default=None)
        assert got[i] == (best[1] if best else None)


def test_globs_equal_plain_search(spark):
    import fnmatch

    globs = ["gpt-*", "gpt-4?", "*", "*-mini", "claude-[ab]*", "exact", "gpt-4o"]
    table = spark.createDataFrame([(g, h, p) for g, (h, p) in zip(globs, PX.glob_rows(globs))], "id string, head string, pattern string")
    models = ["gpt-4o", "gpt-4", "gpt-4o-mini", "claude-a1", "claude-c", "exact", "exactly", "gpt-"]
    df = spark.createDataFrame([(m,) for m in models] + [(None,)], "model string")
    got = {(r.value, r.id) for r in PX.glob_matches(df, "model", table).collect()}
    assert got == {(m, g) for m in models for g in globs if fnmatch.fnmatchcase(m, g)}
