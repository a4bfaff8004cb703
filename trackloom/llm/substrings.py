"""Substring dedup by a log-structured index of window fingerprints.

A window is 20 consecutive words of one document. Batches of documents, in the order of doc_id, are
fingerprinted (``anchors``: a sixth of all windows is indexed, and the search stays exact) and
appended as sorted immutable runs; each new run is merge-joined with itself and the runs before it; runs are
compacted as they become many. ``Index`` keeps the runs in a folder, so that later batches, in later sessions too, are held against all
earlier ones. Matches are verified:

* occurrences with equal anchor and equal context (128 bits of all words under their windows) own equal windows; all but the first repeat it;
* where an anchor has several contexts, the first occurrence of each is re-read, and single windows are compared
  by a 128-bit hash of their words.

A word goes if a window that covers it also starts earlier (smaller doc_id, or the same and an earlier
start). Null texts have no words. Rows that share a doc_id are ordered by their text's hash; exact
repeats of a row count as one document. Null doc_ids come last. Texts of under 20 words lose nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.anchors import cover, mix
from trackloom.llm.common import Scratch, small_batches, with_uid
from trackloom.llm.runs import SAMPLE, Runs, contexts, fingerprint_rows, one_window, unpack

LENGTH = 20
GRAM = 6
BATCHES, FANOUT = 3, 2


def _units(text: bytes) -> np.ndarray:
    words = text.split()
    return mix(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            out_h, out_u, out_s = [], [], []
            for uid, text, at in zip(batch.column("uid").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("at")):
                words = text.as_py().split()
                first, size, _ = unpack(at.values.to_numpy())
                for s, n in zip(first.tolist(), size.tolist()):
                    for w in range(s, s + n):
                        out_h.append(xxhash.xxh3_128_digest(b" ".join(words[w : w + length])))
                        out_s.append(w)
                    out_u += [uid] * n
            pairs = np.frombuffer(b"".join(out_h), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(out_u, pa.int64()), pa.array(out_s, pa.int64())], names=["h", "k", "uid", "start"])

    return run


def _removed(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows = []
            for text, at in zip(batch.column("text").cast(pa.binary()), batch.column("at")):
                words = (text.as_py() or b"").split()
                n = len(words)
                if at.is_valid:
                    first, size, _ = unpack(at.values.to_numpy())
                    words = list(compress(words, ~cover(first, size, length, n)))
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def repeated_windows(docs: DataFrame, occurrences: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """``uid, at`` of runs of windows that also start earlier; ``docs(uid, text)`` holds the texts of all occurrences."""
    by = contexts(occurrences, scratch)
    later = by.where("not single").select("anchor", "context", "twin", "first")
    later = occurrences.join(later, ["anchor", "context", "twin"]).where(F.struct("uid", "at") > F.col("first")).select("uid", "at")
    later = scratch.keep(later, "later")
    scratch.discard(occurrences)
    scratch.free()
    unsure = by.where("n > 1").select("first.uid", "first.at").groupBy("uid").agg(F.collect_list("at").alias("at"))
    windows = docs.select("uid", "text").join(unsure, "uid").mapInArrow(_windows(length), "h long, k long, uid long, start long")
    windows = scratch.keep(windows, "windows")
    scratch.discard(by)
    scratch.free()
    where = F.struct("uid", "start")
    firsts = windows.groupBy("h", "k").agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first <> last").drop("last")
    single = windows.join(firsts, ["h", "k"]).where(where > F.col("first")).select("uid", one_window(F.col("start")).alias("at"))
    out = scratch.keep(later.unionByName(single), "ranges")
    scratch.discard(later, windows)
    return out


def sampled(docs: DataFrame) -> DataFrame:
    """Documents whose rows tell which anchors are hot."""
    return docs.where(F.pmod(F.xxhash64("uid"), F.lit(SAMPLE)) == 0)


class Index:
    """A lasting index in the folder ``path``: each batch is held against itself and all batches before it.

    doc_ids are integers, unique, not null, and larger in each batch than in those before (ValueError otherwise). A batch that fails leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, gram: int = GRAM, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.path, self.length, self.gram = spark, path.rstrip("/"), length, gram
        self.runs = Runs(spark, Scratch(spark, "index", f"{self.path}/runs-{uuid.uuid4().hex}"), buckets, fanout)
        self.last = None
        if found := self._states():
            held = spark.read.parquet(f"{self.path}/{found[-1]}")
            self.last = held.agg(F.max("last")).first()[0]
            self.runs.load(held)

    def _states(self) -> list[str]:
        """Names of the states written whole, oldest first."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in names if n.startswith("state-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def add(self, batch: DataFrame, history: DataFrame | None = None, with_text: bool = True) -> DataFrame:
        """As ``dedup`` for ``batch(doc_id, text)``. ``history(doc_id, text)``: all earlier documents; only those whose windows must be compared are read."""
        scratch = Scratch(self.spark, "batch")
        n, distinct, low, high = batch.agg(F.count("*"), F.countDistinct("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
        if n != distinct or (n and self.last is not None and low <= self.last):
            raise ValueError("doc_ids of a batch must be unique, not null and larger than those of earlier ones")
        docs = batch.select("doc_id", F.col("doc_id").cast("long").alias("uid"), "text")
        texts = docs if history is None else docs.unionByName(history.select("doc_id", F.col("doc_id").cast("long").alias("uid"), "text"))
        matched = self.runs.append(fingerprint_rows(docs, _units, self.length, self.gram), fingerprint_rows(sampled(docs), _units, self.length, self.gram))
        occurrences = self.runs.occurrences(matched)
        ranges = repeated_windows(texts, occurrences, scratch, self.length).where(F.col("uid") >= F.lit(low))
        ranges = ranges.groupBy("uid").agg(F.collect_list("at").alias("at"))
        kind = docs.schema["doc_id"].dataType.simpleString()
        out = docs.join(ranges, "uid", "left").select("doc_id", "text", "at").mapInArrow(_removed(self.length, with_text), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
        out = scratch.keep(out, "out")
        self.last = high if high is not None else self.last
        self.runs.state().withColumn("last", F.lit(self.last).cast("long")).coalesce(1).write.parquet(f"{self.path}/state-{len(self._states()):08d}")
        scratch.clear(out)
        return out


def dedup(docs: DataFrame, batches: int = BATCHES, length: int = LENGTH, gram: int = GRAM, fanout: int = FANOUT, with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of every row of ``docs(doc_id, text)``; kept is null without ``with_text``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    docs = with_uid(docs, scratch)
    low, high = docs.agg(F.min("uid"), F.max("uid")).first()
    runs, matched = Runs(spark, scratch, fanout=fanout), None
    if low is not None:
        cuts = [low + (high + 1 - low) * b // batches for b in range(batches + 1)]
        for a, b in zip(cuts, cuts[1:]):
            part = docs.where((F.col("uid") >= a) & (F.col("uid") < b))
            new = runs.append(fingerprint_rows(part, _units, length, gram), fingerprint_rows(sampled(part), _units, length, gram))
            matched = new if matched is None else matched.unionByName(new)
        occurrences = runs.occurrences(matched.distinct())
        runs.drop()  # ``Index`` keeps them
        ranges = repeated_windows(docs, occurrences, scratch, length)
        ranges = ranges.groupBy("uid").agg(F.collect_list("at").alias("at"))
        scratch.free()
        rows = docs.join(ranges, "uid", "left")
    else:
        rows = docs.withColumn("at", F.lit(None).cast("array<long>"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.select("doc_id", "text", "at").mapInArrow(_removed(length, with_text), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    return _finish(out, runs, scratch)


def _finish(out: DataFrame, runs: Runs, scratch: Scratch) -> DataFrame:
    out = scratch.keep(out, "out")
    runs.drop()
    scratch.free()
    scratch.clear(out)
    return out


#: DuckDB's form of ``dedup`` over documents, for unique ids.
ORACLE = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 win AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 18, 1))) AS s, w FROM d), g AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g FROM win),
 later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS rn FROM g) WHERE rn > 1),
 gone AS (SELECT DISTINCT doc_id, s + o.range AS p FROM later, range(20) o), gl AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
 r AS (SELECT d.doc_id, len(w) AS n, coalesce(len(ps), 0) AS k, CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END AS kept FROM d LEFT JOIN gl USING (doc_id))
 SELECT doc_id, n::BIGINT AS n_words, k::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM r"""
