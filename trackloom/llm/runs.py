"""Sorted runs of window fingerprints: written once, bucketed by anchor, merge-joined without a shuffle.

A run row is ``anchor, context, twin, uid, at`` (see ``anchors``); ``at`` packs first window, number of windows and the
anchor's place, first window highest, so (uid, at) orders occurrences as (document, start) does. A run is a
table of ``buckets`` sorted files; joins and groups by anchor read two runs bucket by bucket.

The anchor of a passage that very many texts share would fill one bucket. Which ones do is estimated from a sample of the documents of
a run (the sample decides where rows lie, never what is found): an anchor of more than a quarter of a bucket's rows is *hot* and
split over as many salted anchors as it fills buckets. Hot anchors repeat, so all their rows are matched, in every run; ``occurrences``
gives them their own anchor back. Of hot anchors there are four a bucket at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.anchors import PIECE, anchors
from trackloom.llm.common import Scratch, partitions, small_batches

ROW = "anchor long, context long, twin long, uid long, at long"
BITS = 10
#: One document of so many tells which anchors are hot; the least number of its rows that an estimate rests on.
SAMPLE, LEAST = 64, 8
HOT = "anchor long, salts int"


def pack(first: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (first << (2 * BITS)) | (size << BITS) | place


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = (1 << BITS) - 1
    return at >> (2 * BITS), (at >> BITS) & low, at & low


def one_window(start: Column) -> Column:
    """``at`` of a single window."""
    return F.shiftleft(start, 2 * BITS).bitwiseOR(F.lit(1 << BITS))


def fingerprint_rows(docs: DataFrame, units: Callable[[bytes], np.ndarray], length: int, gram: int) -> DataFrame:
    """Run rows of ``docs(uid, text)``; ``units`` turns a text's bytes into mixed 64-bit units."""
    if length - gram >= 1 << BITS:
        raise ValueError(f"a window may have {(1 << BITS) - 1} units more than a gram at most")

    def rows(values: list[np.ndarray], uids: list[int]) -> pa.RecordBatch:
        parts, uid, base = [], [], []
        for own, u in zip(values, uids):
            for at in range(0, max(1, len(own) - length + 1), PIECE):  # each window lies in one piece
                parts.append(own[at : at + PIECE + length - 1])
                uid.append(u)
                base.append(at)
        found = anchors(np.concatenate(parts), np.cumsum([len(x) for x in parts]), length, gram)
        at = pack(found.first + np.array(base, np.int64)[found.piece], found.size, found.place)
        cols = [found.anchor.view(np.int64), found.context.view(np.int64), found.twin.view(np.int64), np.array(uid, np.int64)[found.piece], at]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "context", "twin", "uid", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts, uids = batch.column("text").cast(pa.binary()), batch.column("uid").to_pylist()
            held = [(u, units(t.as_py())) for u, t in zip(uids, texts) if t.is_valid]
            held = [(u, x) for u, x in held if len(x) >= length]
            if held:
                yield rows([x for _, x in held], [u for u, _ in held])

    return docs.select("uid", "text").mapInArrow(run, ROW)


class Runs:
    """The log: immutable sorted runs, oldest first. When there are ``fanout``, they are merged into one before the next is written."""

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int | None = None, fanout: int = 4):
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self.buckets = buckets or partitions(spark)
        self.names: list[str] = []
        self.paths: dict[str, str] = {}
        self.hot: list[DataFrame] = []  # written tables (anchor, salts), a row a hot anchor

    def _heavy(self, sample: DataFrame) -> DataFrame | None:
        """Hot anchors by a sample of a run's rows, and how many salts they take; None if there are none."""
        n = self.scratch.keep(sample.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST), "sampled")
        total = sample.count()
        share = F.col("n") * F.lit(4 * self.buckets) / F.lit(max(total, 1))
        hot = self.scratch.keep(n.where(share > 1).select("anchor", F.least(F.ceil(share / 4) + 1, F.lit(self.buckets)).cast("int").alias("salts")), "hot")
        self.scratch.discard(n)
        return hot if hot.limit(1).count() else None

    def _write(self, rows: DataFrame, hot: DataFrame | None = None) -> str:
        name = f"run_{uuid.uuid4().hex}"
        if hot is not None:
            known = F.broadcast(hot.select(F.col("anchor").alias("of"), "salts"))  # at most four a bucket
            rows = rows.join(known, F.col("anchor") == F.col("of"), "left")
            rows = rows.withColumn("anchor", F.when(F.col("salts").isNull(), F.col("anchor")).otherwise(_salted(F.col("anchor"), F.pmod(F.xxhash64("uid"), F.col("salts"))))).drop("of", "salts")
        dealt = rows.repartition(self.buckets, "anchor").sortWithinPartitions("anchor", "uid", "at")
        dealt.write.bucketBy(self.buckets, "anchor").sortBy("anchor", "uid", "at").option("path", self.scratch.path(name)).saveAsTable(name)
        self.paths[name] = self.scratch.made[-1]
        self.scratch.free()
        return name

    def _salts(self) -> DataFrame | None:
        """``salted, own`` of every hot anchor of any run, itself included."""
        if not self.hot:
            return None
        every = reduce(DataFrame.unionByName, self.hot).groupBy("anchor").agg(F.max("salts").alias("salts"))
        own = F.explode(F.sequence(F.lit(-1), F.col("salts") - 1)).alias("k")
        return every.select("anchor", own).select(F.when(F.col("k") < 0, F.col("anchor")).otherwise(_salted(F.col("anchor"), F.col("k"))).alias("salted"), F.col("anchor").alias("own"))

    def append(self, rows: DataFrame, sample: DataFrame | None = None) -> DataFrame:
        """Write ``rows`` as a run; return the (salted) anchors in it that occur elsewhere, in it or in older runs. ``sample``: rows of some of its documents."""
        if len(self.names) >= self.fanout:
            self.compact()
        history = [self.spark.table(x) for x in self.names]
        hot = self._heavy(sample) if sample is not None else None
        new = self.spark.table(name := self._write(rows, hot))
        if hot is not None:
            self.hot.append(hot)
        where = F.struct("uid", "at")
        own = new.groupBy("anchor").agg(F.min(where).alias("a"), F.max(where).alias("b")).where("a <> b").select("anchor")
        seen = [own, *(new.join(old.select("anchor"), "anchor", "left_semi").select("anchor") for old in history)]
        matched = self.scratch.keep(reduce(DataFrame.unionByName, seen).distinct(), "matched")
        self.names.append(name)
        return matched

    def compact(self) -> None:
        """Merge all runs into one. Rows keep the anchors that they were written with."""
        if len(self.names) > 1:
            merged = self._write(self.rows())
            self.drop()
            self.names = [merged]

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.table(x) for x in self.names])

    def occurrences(self, matched: DataFrame) -> DataFrame:
        """All rows, of all runs, whose anchor is matched or hot, under their own anchors."""
        salts = self._salts()
        if salts is not None:
            salts = self.scratch.keep(salts, "salts")
            matched = self.scratch.keep(matched.select("anchor").unionByName(salts.select(F.col("salted").alias("anchor"))).distinct(), "matched")
        rows = reduce(DataFrame.unionByName, [self.spark.table(x).join(matched, "anchor", "left_semi") for x in self.names])
        if salts is not None:
            rows = rows.join(F.broadcast(salts), F.col("anchor") == F.col("salted"), "left").withColumn("anchor", F.coalesce("own", "anchor")).drop("salted", "own")
        return self.scratch.keep(rows, "occurrences")

    def drop(self) -> None:
        """Forget all runs and delete their files."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.scratch.remove(self.paths.pop(name))
        self.names = []

    def state(self) -> DataFrame:
        """What ``load`` needs to find the runs again: ``name, path, buckets, anchor, salts``."""
        spark = self.spark
        runs = spark.createDataFrame([(n, self.paths[n], self.buckets) for n in self.names], "name string, path string, buckets int")
        runs = runs.withColumns({"anchor": F.lit(None).cast("long"), "salts": F.lit(None).cast("int")})
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self.hot, runs)

    def load(self, state: DataFrame) -> None:
        """Take up the runs of an earlier session."""
        for r in state.where("name is not null").collect():
            self.buckets = r.buckets
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {r.name} ({ROW}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor, uid, at) INTO {r.buckets} BUCKETS LOCATION '{r.path}'")
            self.names.append(r.name)
            self.paths[r.name] = r.path
            self.scratch.made.append(r.path)
        hot = state.where("name is null").select("anchor", "salts")
        if hot.limit(1).count():
            self.hot.append(hot)


def _salted(anchor: Column, salt: Column) -> Column:
    return F.xxhash64(anchor, salt.cast("int"))


def contexts(occurrences: DataFrame, scratch: Scratch) -> DataFrame:
    """``anchor, context, twin, first, single, n, lone``: one row a context, its first occurrence, whether it is the only one, and whether the anchor has other contexts.

    Occurrences are pre-aggregated by (anchor, context), so a passage in a third of all texts is few rows.
    """
    where = F.struct("uid", "at")
    by = scratch.keep(occurrences.groupBy("anchor", "context", "twin").agg(F.min(where).alias("first"), F.max(where).alias("last")), "contexts")
    several = by.groupBy("anchor").agg(F.count("*").alias("n"), F.count(F.when(F.col("first") == F.col("last"), 1)).alias("lone"))
    out = by.join(several, "anchor").select("anchor", "context", "twin", "first", (F.col("first") == F.col("last")).alias("single"), "n", "lone")
    out = scratch.keep(out, "by-context")
    scratch.discard(by)
    return out
