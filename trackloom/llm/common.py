"""Shared storage, batching and row identity for the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in every contract: runs of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, local mode) a temporary one is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="trackloom-")
        spark.conf.set("spark.checkpoint.dir", named) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Written tables of one run, below the shared folder.

    ``keep`` cuts lineage: rows are written as Parquet and read back, so a lost executor costs
    no recomputation. ``clear`` removes all tables but those named.
    """

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made: list[str] = []
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        at = f"{self.root}/{self.count:03d}-{name}"
        self.made.append(at)
        return at

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(at := self.path(name))
        return self.spark.read.schema(df.schema).parquet(at)

    def free(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps now, not at some later collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _of(self, *dfs: DataFrame) -> set[str]:
        """Tables made here that the rows of ``dfs`` are read from."""
        files = {f for df in dfs for f in df.inputFiles()}
        return {at for at in self.made if any(at.removeprefix(self.root) + "/" in f for f in files)}

    def remove(self, *paths: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for at in paths:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.made.remove(at)

    def discard(self, *dfs: DataFrame) -> None:
        """Delete written tables that nothing will read again."""
        self.remove(*self._of(*dfs))

    def clear(self, *but: DataFrame) -> None:
        self.remove(*set(self.made) - self._of(*but))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column | str) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of ``column``; one larger value stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(column)
        sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def with_uid(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, uid, text``: uid orders documents as doc_id does and is unique and not null.

    Where doc_id is an integer, unique and not null, uid is doc_id. Otherwise rows are numbered by
    (doc_id, text hash), null ids last; rows equal in both share one uid, that is, they count as one
    document listed more than once.
    """
    docs = docs.select("doc_id", "text")
    whole = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    odd = not whole or docs.select("doc_id").groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.select("doc_id", F.col("doc_id").cast("long").alias("uid"), "text")
    rows = docs.withColumn("rid", F.sha2(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")), 256))
    n = partitions(docs.sparkSession)
    ids = scratch.keep(
        rows.select("doc_id", "rid").distinct()
        .repartitionByRange(n, F.col("doc_id").asc_nulls_last(), "rid")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "rid")
        .select("doc_id", "rid", F.monotonically_increasing_id().alias("uid")),
        "uids",
    )
    same = rows.doc_id.eqNullSafe(ids.doc_id) & (rows.rid == ids.rid)
    return scratch.keep(rows.join(ids, same).select(rows.doc_id, "uid", "text"), "docs")
