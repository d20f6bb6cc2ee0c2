"""Plan shapes that matter at scale."""

import re

from pyspark.sql import functions as F

from catalog.common import AS_OF, DAYS, audit, table
from catalog.prompts import prompts
from veilkit import defaults
from veilkit.operators import scan as S
from veilkit.plans import requests as RQ
from veilkit.plans import usage as U
from veilkit.sources import audit as SA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_runs_once_and_shuffles_nothing(spark, sf):
    docs = table(spark, sf, "documents")
    found = S.exploded(S.with_findings(docs.select("doc_id", "text"), defaults.SCAN)).filter("entity = 'EMAIL_ADDRESS'")
    text = plan(found)
    assert "Exchange" not in text and "Python" not in text
    assert text.count("aws_secret_access_key") == 2  # the gate and the recognizer, once each
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_request_decisions_stay_in_their_row(spark, sf):
    rows = RQ.analyze_texts(prompts(spark, sf), defaults.policy(), defaults.SCAN).filter("decision.action = 'mask'")
    text = plan(rows)  # the only exchange spreads the small test file over the cores
    assert text.count("Exchange") == text.count("Exchange RoundRobinPartitioning") and "Python" not in text


def test_reports_aggregate_before_the_shuffle(spark, sf):
    text = plan(U.by_team(audit(spark, sf), AS_OF, DAYS, limit=50))
    assert len(re.findall("Exchange hashpartitioning", text)) == 1 and "partial_count" in text
    assert "TakeOrderedAndProject" in text and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text


def test_stored_audit_prunes_months(spark, sf, tmp_path):
    rows = audit(spark, sf).withColumn("month", F.date_format("event_time", "yyyyMM").cast("int")).drop("k")
    SA.write_audit(rows, str(tmp_path / "a"), files_per_month=3)
    stored = SA.read_audit(spark, str(tmp_path / "a"))
    assert "PartitionFilters: [isnotnull(month" in plan(U.summary(stored, AS_OF, DAYS))
    assert U.summary(stored, AS_OF, DAYS).first().requests == rows.count()
    assert SA.retained(stored, "2026-01-30 00:00:00").count() < rows.count()
    assert SA.expired_months(stored, "2027-01-01 00:00:00").count() == 1


def test_a_busy_month_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(60_000).repartition(6).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS event_time", "concat('t', id % 7) AS team", "sha2(cast(id AS string), 256) AS action", "202401 AS month")
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(name, "200kb")
    try:
        SA.write_audit(rows, f"{tmp_path}/a")
    finally:
        spark.conf.unset(name)
    files = [[(r.team, r.action) for r in spark.read.parquet(str(f)).collect()] for f in sorted((tmp_path / "a" / "month=202401").glob("*.parquet"))]
    assert len(files) > 2 and sum(map(len, files)) == 60_000 and all(f == sorted(f) for f in files)


def _events(spark, path, n):
    spark.range(n).coalesce(1).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 10) AS ts", "id % 90 AS user_id", "'view' AS event_type",
                                          "1.5D AS value", "concat('{\"k\": ', id % 100, '}') AS props").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_texts_are_dealt_by_rows(spark, tmp_path):
    from catalog import prompts as CP
    n = (spark.sparkContext.defaultParallelism + 2) * CP.TASK_ROWS
    rows = CP.prompts(spark, _events(spark, tmp_path, n))
    assert rows.rdd.getNumPartitions() == n // CP.TASK_ROWS and rows.count() == n


def test_states_are_made_from_events_in_files_of_like_size(spark, tmp_path):
    from catalog import usage as CU
    d = _events(spark, tmp_path, 5_000)
    found = {(r.team, r.model): r.users for r in CU.QUERIES["e9_users_from_days"](spark, d).collect()}
    want = audit(spark, d).groupBy("team", "model").agg(F.countDistinct("user").alias("users")).collect()
    assert found == {(r.team, r.model): r.users for r in want}
    stored = spark.read.parquet(f"{CU._STORED[spark.sparkContext.applicationId, d]}/events")
    assert len(stored.inputFiles()) >= spark.sparkContext.defaultParallelism


def test_examples_limit_groups_before_the_shuffle(spark, sf):
    from veilkit.plans import evaluation as E
    assert "WindowGroupLimit" in plan(E.examples(audit(spark, sf), AS_OF, DAYS))


def test_synthetic_traffic_is_seeded(spark):
    from veilkit.sources.traffic import traffic
    a, b = (traffic(spark, 2000, seed=s).agg(F.bit_xor(F.xxhash64("event_id", "team", "model", "event_time", "action"))).first()[0] for s in (1, 1))
    c = traffic(spark, 2000, seed=2).agg(F.bit_xor(F.xxhash64("event_id", "team", "model", "event_time", "action"))).first()[0]
    assert a == b != c
    rows = traffic(spark, 5000)
    assert rows.filter("weekday(event_time) < 5").count() > 4000 and rows.filter("hour(event_time) BETWEEN 8 AND 18").count() > 4500
    assert set(rows.columns) >= {"event_id", "user", "team", "rules", "entities", "masked_entities"}
