"""The corpus pipeline: quality rules, near-dedup, decontamination, personal data, mixing.

``STAGES`` lists its steps. A step takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them to the
documents table, each written as Parquet in the shared folder and read again as the next one's docs. All but the
last return the columns that they were given.

Rows are told apart by a 64-bit hash of their id, source, language and text, so null or repeated ids and
columns of any other name do no harm. Where a step drops rows, it joins with the rows it drops or keeps, by that hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontam, mixing, pii, quality, simhash
from trackloom.llm.common import Scratch, table

_MARK = "__row_mark"


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn(_MARK, F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("doc_id", "source", "lang", "text"))))


def _distinct_rows(docs: DataFrame) -> DataFrame:
    """Marked rows, exact repeats once; the shuffle is made only if there are any."""
    docs = _marked(docs)
    if docs.groupBy(_MARK).count().where("count > 1").limit(1).count():
        docs = docs.dropDuplicates([_MARK])
    return docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    docs = _marked(docs)
    found = quality.assess(docs.select(F.col(_MARK).alias("id"), "lang", "text"))
    gone = found.where("not kept").select(F.col("id").alias(_MARK)).distinct()
    return docs.join(gone, _MARK, "left_anti").drop(_MARK)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest doc_id, or the smallest row hash where ids are null or repeated."""
    columns = docs.columns
    odd = docs.select("doc_id").groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if odd:
        docs = _distinct_rows(docs)
    name = _MARK if odd else "doc_id"
    groups = simhash.similar_groups(docs.select(F.col(name).alias("doc_id"), "text"))
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias(name))
    return docs.join(stay, name, "left_semi").select(*columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    docs = _marked(docs)
    found = decontam.leaks(docs.select(F.col(_MARK).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = found.select(F.col("doc_id").alias(_MARK)).distinct()
    return docs.join(gone, _MARK, "left_anti").drop(_MARK)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked by its kind; n_chars follows the text."""
    out = pii.mask(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document: its columns, and ``copy`` (1, 2, 3)."""
    columns = docs.columns
    docs = _marked(docs)
    copies = mixing.mix(docs.select(F.col(_MARK).alias("doc_id"), "source", "text")).groupBy(F.col("doc_id").alias(_MARK)).agg(F.sum("copies").cast("int").alias("__copies"))
    rows = _distinct_rows(docs.drop(_MARK)).join(copies.where("__copies > 0"), _MARK)
    return rows.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("copy"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]

#: No stage but the mix has a form in SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    scratch.clear(docs)
    return docs
