"""Versioned documents: an append-only history, the current version of each key, optimistic saves.

History rows are ``key, version, body, editor, saved_at``. Each version is claimed by a file that must not exist yet, so of
two savers of one version exactly one succeeds, on any store that creates files exclusively.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HISTORY = "key string, version long, body string, editor string, note string, saved_at timestamp"
SNAPSHOT_EVERY = 25


class Conflict(Exception):
    """The base version of a save is not the current one."""


def latest(history: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The row of the highest version of each key: one partial aggregation, no sort."""
    others = [c for c in history.columns if c not in (*keys, version)]
    best = history.groupBy(*keys).agg(F.max(F.struct(version, *others)).alias("__row"))
    return best.select(*keys, F.col(f"__row.{version}").alias(version), *[F.col(f"__row.{c}").alias(c) for c in others])


def live_answers(log: DataFrame, keys: list[str], version: str = "version", value: str = "label") -> DataFrame:
    """Latest answers; a null value deletes."""
    return latest(log, keys, version).where(F.col(value).isNotNull())


def snapshots(history: DataFrame, every: int = SNAPSHOT_EVERY) -> DataFrame:
    return history.where(F.col("version") % every == 0)


def recent(history: DataFrame, keys: list[str], most: int = 300) -> DataFrame:
    """The last versions of each key, newest first."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("version")))
    return history.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


@dataclass
class Store:
    spark: SparkSession
    path: str

    def history(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at) or not any(x.getPath().getName().startswith("part-") for x in fs.listStatus(at)):
            return self.spark.createDataFrame([], HISTORY)
        return self.spark.read.schema(HISTORY).parquet(self.path)

    def current(self) -> DataFrame:
        return latest(self.history(), ["key"])

    def save(self, key: str, body: str, base: int, editor: str = "", note: str = "", force: bool = False) -> int:
        """Append a version and return its number; an unchanged body saves nothing; a wrong base raises unless forced."""
        now = self.current().where(F.col("key") == key).select("version", "body").first()
        version = now.version if now else 0
        if base != version and not force:
            raise Conflict(f"{key}: base {base}, current {version}")
        if now and now.body == body:
            return version
        claim = self._claim(key, version + 1)
        row = self.spark.createDataFrame([(key, version + 1, body, editor, note)], "key string, version long, body string, editor string, note string")
        try:
            row.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(self.path)
        except Exception:
            claim()  # nothing was saved under it
            raise
        return version + 1

    def _claim(self, key: str, version: int) -> Callable[[], None]:
        """Create the version's claim, or raise Conflict if another saver has; what is returned gives it up."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_claims/{hashlib.sha256(key.encode()).hexdigest()}-{version}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            if fs.getScheme() == "file":  # Hadoop's local files are not created exclusively, Java's are
                fs.mkdirs(at.getParent())
                file = jvm.java.io.File(at.toUri().getPath())
                if not file.createNewFile():
                    raise Conflict(f"{key}: version {version} is being saved by another")
            else:
                fs.create(at, False).close()
        except Py4JJavaError as e:
            if fs.exists(at):
                raise Conflict(f"{key}: version {version} is being saved by another") from e
            raise
        return lambda: fs.delete(at, False)

    def editors(self) -> DataFrame:
        """Who ever saved each key, in order of name."""
        return self.history().where("editor <> ''").groupBy("key").agg(F.array_sort(F.collect_set("editor")).alias("editors"))

    def export(self, keys: DataFrame) -> DataFrame:
        """Every key of ``keys`` with its current body; keys never saved have version 0 and an empty body."""
        return keys.join(self.current(), "key", "left").select("key", F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("body", F.lit("")).alias("body"))
