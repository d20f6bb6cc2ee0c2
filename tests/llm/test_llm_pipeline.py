"""The corpus pipeline: contracts of the stages, and each stage's effect."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline as C
from odd_rows import odd_documents, with_clashes
from test_llm_near_dups import brute
from veilkit.llm import registry
from veilkit.llm.near_dups import near_duplicates
from veilkit.llm.quality import weigh
from veilkit.llm.secrets import secret_report


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        stage(spark, docs, sf).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_order_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "encoding"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_quality_stage(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert ids(stages[1]) == ids(weigh(stages[0], labels).filter("kept"))


def test_near_dedup_stage(stages):
    assert ids(stages[2]) == ids(near_duplicates(stages[1], percent=C.NEAR_PERCENT).filter("kept"))
    after = near_duplicates(stages[2], percent=C.NEAR_PERCENT)
    assert after.filter("not kept").count() == 0


def test_near_dedup_stage_links_from_80_per_cent(spark, sf):
    """One shingle set in 100 words: 5, 10 and 13 words changed at one end give similarities of 0.90, 0.81 and 0.76."""
    words = [f"w{i}" for i in range(100)]
    rows = [(10 * n, " ".join([f"{n}x{w}" for w in words])) for n in (1, 2, 3)]
    rows += [(10 * n + 1, " ".join([f"{n}x{w}" for w in words[:-cut]] + [f"{n}y{i}" for i in range(cut)])) for n, cut in ((1, 5), (2, 10), (3, 13))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted({c for _, _, c in brute(rows, 80)}) == [10, 20, 30, 31]
    assert ids(C.near_dedup(spark, docs, sf)) == [10, 20, 30, 31]
    table = spark.read.parquet(f"{sf}/documents.parquet")
    want = {c for _, _, c in brute([(r["doc_id"], r["text"]) for r in table.collect()], 80)}
    assert ids(C.near_dedup(spark, table, sf)) == sorted(want)


def test_secret_stage(stages):
    assert ids(stages[3]) == ids(stages[2])
    left = secret_report(stages[3])
    assert left.filter("n_assign + n_access + n_hex > 0").count() == 0
    assert stages[3].filter("n_chars <> length(text)").count() == 0


def test_mixing_and_encoding_stages(stages):
    assert set(ids(stages[4])) <= set(ids(stages[3]))
    assert ids(stages[5]) == ids(stages[4])
    assert stages[5].filter("not round_trip").count() == 0


def test_run(spark, sf, stages):
    assert sorted(map(str, C.run(spark, sf).collect())) == sorted(map(str, stages[-1].collect()))


def test_stages_take_odd_rows(spark, sf):
    docs = with_clashes(odd_documents(spark))
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns or name == "encoding"
        out.collect()
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(registry.ORACLES) <= set(entry.oracle_sql())
