"""Queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import decontam, htmltext, langid, mixing, pii, quality, simhash, substrings, suffixes, warc
from trackloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id as id", "lang", "text")
    return quality.assess(docs).withColumnRenamed("id", "doc_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id as id", "text")
    return pii.detect(docs, with_text=False).withColumnRenamed("id", "doc_id").drop("masked")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op8_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_decontam": op3_decontam,
    "op4_langid": op4_langid,
    "op5_quality": op5_quality,
    "op6_pii": op6_pii,
    "op7_substrings": op7_substrings,
    "op8_htmltext": op8_htmltext,
    "op9_warc": op9_warc,
    "op10_suffixes": op10_suffixes,
}

#: The others score, learn or hash in ways that SQL has not; they are tested against brute force.
ORACLE: dict[str, str] = {"op2_mixing": mixing.ORACLE, "op7_substrings": substrings.ORACLE, "op9_warc": warc.ORACLE}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
