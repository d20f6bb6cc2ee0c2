import random
import re

import pytest
from pyspark.sql import functions as F

from tests import corpus, plain_scan
from veilkit import defaults
from veilkit.operators import leaks as LK
from veilkit.operators import mask as M
from veilkit.operators import scan as S
from veilkit.operators import surrogate as SG

KEY = b"test-key-of-thirty-two-bytes-long!"


def rows(spark, texts, scope=1):
    return S.with_findings(spark.createDataFrame([(scope, i, t) for i, t in enumerate(texts)], "scope int, part bigint, text string"))


def test_one_vault_per_scope(spark):
    df = rows(spark, ["TC 391 417 776 94 ve 10000000146", "yine 39141777694, kart 4111 1111 1111 1111"])
    masked, vault = M.mask_scope(df, ["scope"], "part")
    assert [r.masked for r in masked.orderBy("part").collect()] == ["TC [TCKN_1] ve [TCKN_2]", "yine [TCKN_1], kart [CREDIT_CARD_1]"]
    back = M.unmask(masked, vault, ["scope"], ["scope", "part"], text="masked").orderBy("part").collect()
    assert back[1].unmasked == "yine 391 417 776 94, kart 4111 1111 1111 1111"


def test_row_and_scope_masking_agree_and_restore(spark):
    rnd = random.Random(3)
    texts = [corpus.text(rnd).replace("[TCKN_1]", "") for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "scope int, text string").withColumn("part", F.lit(0).cast("bigint"))
    df = S.with_findings(df)
    masked, vault = M.mask_scope(df, ["scope"], "part")
    by_scope = {r.scope: r.masked for r in masked.collect()}
    inside = df.select("scope", "text", F.expr(M.mask_row("array(text)", "array(findings)", "true")).alias("m")).collect()
    for r in inside:
        assert r.m.masked[0] == by_scope[r.scope]
        first = {}
        text = r.text
        for a, b, e in reversed(plain_scan.scan(r.text.replace("\x01", "\x03"))):
            text = text[:a] + "#" + text[b:]
        for v in r.m.vault:
            first[v.placeholder] = v.original
        assert len(first) == len(r.m.vault)
        assert r.m.masked[0].count("[") >= text.count("#") - texts[r.scope].count("[")


def test_dense_replacement_uses_the_same_result(spark):
    text = " ".join(f"kisi{i}@ornek.com" for i in range(500))
    (r,) = rows(spark, [text]).select(F.expr(M.mask_row("array(text)", "array(findings)", "true")).alias("m")).collect()
    assert r.m.masked[0] == " ".join(f"[EMAIL_ADDRESS_{i + 1}]" for i in range(500))


def test_longer_placeholders_are_not_cut(spark):
    vault = spark.createDataFrame([(1, "[TCKN_1]", "bir"), (1, "[TCKN_10]", "on")], "scope int, placeholder string, original string")
    df = spark.createDataFrame([(1, 0, "[TCKN_10] [TCKN_1] [TCKN_2] [X")], "scope int, part int, text string")
    assert M.unmask(df, vault, ["scope"], ["part"]).first().unmasked == "on bir [TCKN_2] [X"


def test_surrogates_are_valid_stable_and_come_back(spark):
    rnd = random.Random(8)
    texts = [f"TC {corpus.make_tckn(rnd)} kart {corpus.grouped(corpus.make_card(rnd), 4)} {corpus.make_iban(rnd)} 0532 {rnd.randint(100, 999)} 45 67 "
             f"kisi{i}@ornek.com 34 ABC {rnd.randint(100, 999)}" for i in range(40)]
    df = rows(spark, texts)
    values = M.finding_values(df, ["scope"], "part")
    vault = M.assign_placeholders(values, ["scope"])
    first, again = SG.assign_surrogates(vault, ["scope"], KEY), SG.assign_surrogates(vault, ["scope"], KEY)
    table = {(r.entity, r.canon): r.placeholder for r in first.collect()}
    assert table == {(r.entity, r.canon): r.placeholder for r in again.collect()}
    assert len(set(table.values())) == len(table)
    masked = M.mask_texts(df.drop("findings"), M.replacements(values, first, ["scope"]), ["scope"], "part")
    for r in S.with_findings(masked.drop("text"), text="masked", into="found").collect():
        assert [f.entity for f in r.found] == ["TCKN", "CREDIT_CARD", "IBAN_TR", "PHONE_TR", "EMAIL_ADDRESS", "PLATE_TR"]
        assert r.masked != texts[r.part] and r.masked.split()[0] == "TC"
    respelled = masked.select("scope", "part", F.regexp_replace("masked", r"kart (\d{4}) (\d{4})", "kart $1-$2").alias("reply"))
    back = M.unmask_surrogates(respelled, first, ["scope"], ["part"], text="reply").orderBy("part").collect()
    assert [r.unmasked for r in back] == texts


def test_leaks_ignore_what_was_sent_and_known_values(spark):
    asked = spark.createDataFrame([(1, "TC 10000000146 ve 0532 123 45 67")], "id int, all_text string")
    vault = spark.createDataFrame([(1, "34 ABC 999", "06 DEF 111"), (1, "[TCKN_1]", "10000000146")], "id int, placeholder string, original string")
    answer = spark.createDataFrame([(1, "10000000146, 0532 123 45 67, 06 DEF 111, 34 ABC 999, 34ABC999, 4111111111111111 yaz@ornek.com")], "id int, text string")
    got = LK.leak_entities(LK.output_leaks(S.with_findings(answer), asked, "id", vault=vault)).first()
    assert got.output_leaked == ["CREDIT_CARD", "EMAIL_ADDRESS"]


def test_redaction(spark):
    df = rows(spark, ["kart 4111111111111111 ve yaz@ornek.com"]).withColumn("wanted", F.array(F.lit("CREDIT_CARD")))
    assert df.select(M.redact("text", "findings", "wanted")).first()[0] == "kart [GİZLENDİ:CREDIT_CARD] ve yaz@ornek.com"


@pytest.mark.parametrize("text, held", [("yaz [TCKN_", 6), ("TC 1000000", 7), ("TR33 0006 10", 12), ("ali@orn", 7), ("tamam ", 0), ("x" * 90, 64)])
def test_holdback(spark, text, held):
    assert spark.createDataFrame([(text,)], "text string").select(M.partial_holdback("text")).first()[0] == held


def test_numbering_spreads_a_hot_scope_over_buckets(spark):
    df = spark.range(5000).select(F.lit(1).alias("scope"), (F.col("id") * 3).alias("part"), F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("TCKN").alias("entity"),
                                  F.concat(F.lit("v"), F.col("id") % 3000).alias("value")).withColumn("canon", F.col("value"))
    got = {r.canon: r.n for r in M.assign_placeholders(df, ["scope"], ranges=30).collect()}
    assert got == {f"v{i}": i + 1 for i in range(3000)}
    assert defaults.policy().mask_style == "placeholder"


def test_parts_may_have_any_id(spark):
    """UUID parts are numbered in their order, like the numbers they stand for."""
    df = spark.range(300).select(F.lit(1).alias("scope"), (F.col("id") * 7919 % 300).alias("at"), F.lit(0).alias("start"), F.lit(5).alias("end"),
                                 F.lit("TCKN").alias("entity"), F.concat(F.lit("v"), F.col("id") % 120).alias("value")).withColumn("canon", F.col("value"))
    plain = {r.canon: r.n for r in M.assign_placeholders(df.withColumnRenamed("at", "part"), ["scope"]).collect()}
    uuids = df.withColumn("part", F.format_string("00000000-0000-4000-8000-%012d", "at"))
    assert {r.canon: r.n for r in M.assign_placeholders(uuids, ["scope"], ranges=5).collect()} == plain


def _numbers_back(text, numbers):
    """Plain form: from the left, the longest group of runs joined by single separators that is a known number."""
    units, out, i = re.findall("[0-9A-Za-z]+|[^0-9A-Za-z]", text), [], 0
    while i < len(units):
        best = None
        if re.match("[0-9A-Za-z]", units[i]):
            group = ""
            for j in range(i, len(units), 2):
                if not re.match("[0-9A-Za-z]", units[j]) or (j > i and units[j - 1] not in " .-"):
                    break
                group += units[j].upper()
                if 5 <= len(group) <= 26 and group in numbers:
                    best = j, numbers[group]
        out.append(best[1] if best else units[i])
        i = best[0] + 1 if best else i + 1
    return "".join(out)


def test_numbers_in_any_spelling_come_back_and_few_groups_are_joined(spark):
    rnd = random.Random(11)
    numbers = {"".join(rnd.choices("ABC123", k=n)): f"<{i}-{n}>" for i in range(6) for n in (5, 6, 11, 25, 26)} | {"A" * 26: "<a>", "12345": "<n>"}
    texts = ["", " ", "x" * 5000, " ".join("A" * 26), " ".join("A" * 25) + " AB", "-".join("A" * 27)]
    for _ in range(300):
        words = []
        for _ in range(rnd.randint(1, 12)):
            w = rnd.choice([*numbers, "12345", "söz", "kayıt", "A" * rnd.randint(1, 30), str(rnd.randint(0, 99999))])
            w = "".join(c + (rnd.choice(" .-") if rnd.random() < 0.3 else "") for c in w) if rnd.random() < 0.6 else w
            words.append(w.lower() if rnd.random() < 0.3 else w)
        texts.append("".join(w + rnd.choice([" ", ".", "-", "  ", ", ", "\n", "ş"]) for w in words))
    vault = spark.createDataFrame([(1, k, v) for k, v in numbers.items()] + [(1, "[TCKN_1]", "x"), (2, "ABABA", "other scope")], "scope int, placeholder string, original string")
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "scope int, part int, text string")
    got = {r.part: r.unmasked for r in M.unmask_surrogates(df, vault, ["scope"], ["part"]).collect()}
    assert got == {i: _numbers_back(t, numbers) for i, t in enumerate(texts)}
    known = vault.filter("scope = 1 AND placeholder <> '[TCKN_1]'").selectExpr("placeholder AS canon")
    groups = M._number_groups(df.select("part", "text"), "text", known).collect()
    assert groups and {g.canon for g in groups} <= set(numbers)


def test_rows_that_share_a_key_get_their_own_numbers_back(spark):
    vault = spark.createDataFrame([(1, "11111", "bir"), (1, "22222", "iki")], "scope int, placeholder string, original string")
    df = spark.createDataFrame([(1, 7, "a 11111 22222"), (1, 7, "b c 22-222"), (1, None, "11111")], "scope int, part int, text string")
    assert {r.unmasked for r in M.unmask_surrogates(df, vault, ["scope"], ["part"]).collect()} == {"a bir iki", "b c iki", "11111"}


def test_a_vault_is_dealt_by_rows_before_its_surrogates_are_laid_out(spark, monkeypatch):
    monkeypatch.setattr(SG, "TASK_VALUES", 20)
    dealt, spread = [], SG.spread
    monkeypatch.setattr(SG, "spread", lambda *a: dealt.append(spread(*a)) or dealt[-1])
    vault = spark.range(1_000).coalesce(1).selectExpr("1 AS scope", "'PHONE_TR' AS entity", "cast(5320000000 + id AS string) AS canon", "cast(5320000000 + id AS string) AS original",
                                                      "id AS n", "concat('[PHONE_TR_', id, ']') AS placeholder")
    table = SG.assign_surrogates(vault, ["scope"], KEY)
    assert dealt[0].rdd.getNumPartitions() == 50 and table.filter("startswith(placeholder, '5')").count() > 900
