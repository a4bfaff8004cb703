"""The corpus pipeline, stage by stage against what each should keep."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from trackloom.llm import decontam, quality, simhash
from trackloom.llm.common import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    scratch = Scratch(spark, "test-pipeline")
    for name, f in pipe.STAGES:
        new = scratch.keep(f(spark, docs, SF), name)
        out.append((name, docs, new))
        docs = new
    return {name: (a, b) for name, a, b in out}


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    for name, (a, b) in stages.items():
        assert b.columns == (a.columns + ["copy"] if name == "mixing" else a.columns)


def test_quality_drops_what_it_rejects(stages):
    a, b = stages["quality"]
    verdict = quality.assess(a.select(F.col("doc_id").alias("id"), "lang", "text"))
    assert ids(b) == sorted(r.id for r in verdict.where("kept").collect())


def test_one_document_of_each_group_stays(stages):
    a, b = stages["near_dedup"]
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(a).collect()}
    assert ids(b) == sorted(set(groups.values())) and len(ids(b)) < len(groups)


def test_no_leak_stays_and_nothing_else_goes(spark, stages):
    a, b = stages["decontamination"]
    found = {r.doc_id for r in decontam.leaks(a, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids(b) == sorted(set(ids(a)) - found)


def test_personal_data_is_masked(stages):
    a, b = stages["personal_data"]
    assert ids(a) == ids(b)
    assert b.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+|\+\d \(\d{3}\) \d{3}-\d{4}")).count() == 0
    assert b.where("n_chars <> length(text)").count() == 0 and b.where("text like '%[EMAIL]%' or text like '%[PHONE]%' or text like '%[IP]%'").count() > 0


def test_mix_takes_whole_copies(stages):
    a, b = stages["mixing"]
    assert set(ids(b)) <= set(ids(a)) and b.agg(F.max("copy")).first()[0] <= 3
    assert b.groupBy("doc_id").agg((F.max("copy") == F.count("*")).alias("ok")).where("not ok").count() == 0


def test_odd_tables(spark):
    rows = [(1, "a text of some length that says nothing at all really", "en", "s", 10, "x"), (1, "a text of some length that says nothing at all really", "en", "s", 10, "x"), (None, None, None, None, None, None), (2, "", "en", None, 0, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, component_id string")
    for name, f in pipe.STAGES:
        for part in (df, df.limit(0)):
            got = f(spark, part, SF)
            assert got.columns[: len(df.columns)] == df.columns and got.count() <= 3 * len(rows), name
    assert pipe.keep_one_of_near_copies(spark, df, SF).count() == 2
