"""Terms from a table against the same terms as configuration, and against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilkit.functions.globs import literal
from veilkit.operators import dictionary as D
from veilkit.operators import scan as S
from veilkit.operators import term_table as TT

WORDS = ["Proje", "anka", "ANKA", "İstanbul", "ıstanbul", "ISTANBUL", "kod", "x-1", "Mavi'nin", "mavi", "kartal", "ofisi", "ΣΟΦΟΣ", "σοφος", "ſafe", "a_b", "42", "é", "."]
TERMS = ["proje anka", "Proje  Anka kod", "istanbul ofisi", "istanbul", "mavi", "mavi kartal ofisi", "kartal ofisi", "x-1", "x-1 anka", "σοφοσ", "safe kod", "42 42", "é mavi", "anka anka"]
TABLE = "entity string, term string, case_sensitive boolean"


def texts(spark, n, seed=3):
    rnd = random.Random(seed)
    rows = [(i, "".join(rnd.choice(WORDS) + rnd.choice([" ", "  ", "\n", " ", "\u200b ", "-", ""]) for _ in range(rnd.randint(0, 14)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "anka " * 4000), (n + 3, "Proje\tAnka")]
    return spark.createDataFrame(rows, "id bigint, text string").repartition(3)


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r.id, []).append((r.entity, r.start, r.end))
    return {i: sorted(v) for i, v in out.items()}


def as_configuration(df, entity, terms, case_sensitive):
    entry = D.Entry(entity, tuple(terms), case_sensitive=case_sensitive)
    found = S.exploded(S.with_findings(df, S.ScanConfig(dictionary=(entry,), builtin=False)))
    return by_id(found.select("id", "entity", "start", "end").collect())


@pytest.mark.parametrize("case_sensitive", [False, True])
def test_same_spans_as_configured_terms(spark, case_sensitive):
    df = texts(spark, 700)
    table = TT.prepared(spark.createDataFrame([("KURUM_A", t, case_sensitive) for t in TERMS], TABLE))
    got = by_id(TT.term_findings(df, table, id_col="id").collect())
    assert got == as_configuration(df, "KURUM_A", TERMS, case_sensitive)
    assert len(got) > 100 and len(got[702]) == 2000 + (0 if case_sensitive else 0)


def test_lists_are_taken_for_themselves(spark):
    """Two entities and both kinds of case in one table, with repeated and blank terms."""
    df = texts(spark, 300, seed=8)
    rows = [("KURUM_A", t, False) for t in TERMS] + [("KURUM_B", t, True) for t in ("anka", "mavi kartal", "anka")] + [("KURUM_B", "  ", True), ("KURUM_C", "Kartal Ofisi", None)]
    got = by_id(TT.term_findings(df, TT.prepared(spark.createDataFrame(rows, TABLE)), id_col="id").collect())
    want = {}
    for entity, terms, case in (("KURUM_A", TERMS, False), ("KURUM_B", ["anka", "mavi kartal"], True), ("KURUM_C", ["Kartal Ofisi"], False)):
        for i, spans in as_configuration(df, entity, terms, case).items():
            want[i] = sorted(want.get(i, []) + spans)
    assert got == want


def test_hashed_terms(spark):
    df = texts(spark, 300, seed=5)
    terms = spark.createDataFrame([("KURUM_A", t, False) for t in TERMS], TABLE)
    got = by_id(TT.term_findings(df, TT.hashed(D.term_hashes(terms, "tuz")), id_col="id", salt="tuz").collect())
    rows = D.term_hashes(terms, "tuz").collect()
    found = df.withColumn("findings", D.hashed_term_findings("KURUM_A", [r.hash for r in rows], [r.units for r in rows], "tuz", "text"))
    assert got == by_id(S.exploded(found).select("id", "entity", "start", "end").collect())


def test_wrong_bits_change_nothing(spark, monkeypatch):
    df, terms = texts(spark, 150), spark.createDataFrame([("KURUM_A", t, False) for t in TERMS], TABLE)
    want = by_id(TT.term_findings(df, TT.prepared(terms), id_col="id").collect())
    monkeypatch.setattr(TT, "PLACES", 64)
    assert by_id(TT.term_findings(df, TT.prepared(terms), id_col="id").collect()) == want


def test_empty_tables(spark):
    none = TT.prepared(spark.createDataFrame([], TABLE))
    assert TT.term_findings(texts(spark, 5), none, id_col="id").count() == 0
    some = TT.prepared(spark.createDataFrame([("KURUM_A", "anka", False)], TABLE))
    assert TT.term_findings(texts(spark, 5).limit(0), some, id_col="id").count() == 0


def test_plan_of_a_hundred_thousand_terms(spark):
    """No term is in the plan, none comes to the driver, and planning takes no longer than for one."""
    import time

    terms = spark.range(100_000).select(F.lit("KURUM_A").alias("entity"), F.concat(F.lit("gizli kod "), F.col("id")).alias("term"), F.lit(False).alias("case_sensitive"))
    df = spark.createDataFrame([(1, "gizli kod 99999 ve gizli kod 100000"), (2, "gizli")], "id bigint, text string")
    began = time.perf_counter()
    found = TT.term_findings(df, TT.prepared(terms), id_col="id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert time.perf_counter() - began < 20 and "gizli kod 777" not in plan and "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, r.start, r.end) for r in found.collect()] == [(1, 0, 15)]


def test_letters_that_patterns_take_for_equal(spark):
    """The gate before the table of letters changes no letter."""
    letters = [chr(c) for c in range(0x20, 0x10000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c,) for c in letters], "c string")
    plain = f"lower(translate(c, {literal(D._SAME_FROM)}, {literal(D._SAME_TO)}))"
    assert rows.filter(f"NOT ({D.match_sql('c')} <=> {plain})").isEmpty()
    assert re.search(r"\\x", D._SPECIAL)
