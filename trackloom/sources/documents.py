"""Readers and writers: label and prediction documents, track files, JSON logs, exports.

Schemas are declared, never inferred. JSON documents have videos as keys, so they are read whole and exploded.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRUTH = "map<string, struct<duration: double, fps: double, events: array<array<string>>>>"
PREDICTIONS = "struct<team: string, videos: map<string, struct<events: array<array<string>>, risk: array<array<double>>>>, log: map<string, struct<duration: double, budget_sec: double, errors: array<string>, part_a_sec: double, part_b_sec: double, total_sec: double>>>"
RUNTIME_TRACKS = "t_sec double, track_id int, coco_class int, confidence double, x1 double, y1 double, x2 double, y2 double, speed_norm_per_sec double"
SURVEY_TRACKS = "frame int, t_sec double, track_id int, cls string, conf double, x1 double, y1 double, x2 double, y2 double"
INTERVALS = "start_frame int, end_frame int, start_t double, end_t double, duration_s double, state string, n_samples int, n_observed int, n_imputed int, n_unobserved int, imputed boolean, start_uncertainty_frames int"
PHASES = "state string, start double, end double, duration double"


def _whole(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("doc"))


def _events(video: Column, events: Column) -> list[Column]:
    return [video.alias("video"), F.posexplode_outer(events).alias("ordinal", "e")]


def _typed(df: DataFrame) -> DataFrame:
    get = lambda i: F.get(F.col("e"), F.lit(i))
    rows = df.where("e is not null")
    return rows.select("video", "ordinal", get(0).try_cast("double").alias("start_s"), get(1).try_cast("double").alias("end_s"), get(2).alias("label"), F.size("e").alias("arity"))


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(videos, events) of a label document."""
    doc = _whole(spark, path, TRUTH).select(F.explode("doc").alias("video", "v"))
    return doc.select("video", "v.duration", "v.fps"), _typed(doc.select(*_events(F.col("video"), F.col("v.events"))))


def read_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(videos, events, risk) of a prediction document."""
    doc = _whole(spark, path, PREDICTIONS).select("doc.team", F.explode("doc.videos").alias("video", "v"))
    risk = doc.select("video", F.posexplode("v.risk").alias("pos", "r")).select("video", "pos", F.get("r", F.lit(0)).alias("t"), F.get("r", F.lit(1)).alias("score"))
    return doc.select("team", "video"), _typed(doc.select(*_events(F.col("video"), F.col("v.events")))), risk


def event_document(videos: DataFrame, events: DataFrame) -> DataFrame:
    """One row, one JSON text: ``{video: {duration, fps, events}}``, events sorted by (start, end, label)."""
    item = F.struct(F.col("start_s"), F.col("end_s"), F.col("label"))
    lists = events.groupBy("video").agg(F.array_sort(F.collect_list(item)).alias("all"))
    text = F.transform("all", lambda e: F.array(e["start_s"].cast("string"), e["end_s"].cast("string"), e["label"]))
    own = videos.join(lists, "video", "left").select("video", F.struct("duration", "fps", F.coalesce(text, F.array().cast("array<array<string>>")).alias("events")).alias("body"))
    return own.groupBy().agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("video", "body"))))).alias("value"))


def write_document(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").text(path)  # one row


def read_tracks(spark: SparkSession, paths: str | list[str], schema: str = SURVEY_TRACKS, until: float | None = None) -> DataFrame:
    """Track files; ``stem`` is the file's name without suffix, or its folder's if the file is called tracks_kaggle or the folder says ``stem=``."""
    df = spark.read.schema(schema).csv(paths, header=True)
    name = F.input_file_name()
    own, folder = F.regexp_extract(name, r"([^/]+?)\.[^./]*$", 1), F.regexp_extract(name, r"([^/]+)/[^/]+$", 1)
    if "stem" not in df.columns:  # else the folders name it
        df = df.withColumn("stem", F.when(own == "tracks_kaggle", folder).otherwise(own))
    return df if until is None else df.where(F.col("t_sec") < until)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """State interval files ``<stem>_<head>_intervals_v4.csv`` with stem and head as columns."""
    df = spark.read.schema(INTERVALS).csv(path, header=True)
    part = lambda k: F.regexp_extract(F.input_file_name(), r"([^/_]+)_([^/_]+)_intervals[^/]*$", k)
    return df.withColumns({"stem": part(1), "head": part(2)})


def read_phases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PHASES).csv(path, header=True)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path, sorted, with size and time; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime").orderBy("path")


#: Files of more bytes are not taken as one value.
LARGE = 1 << 27


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of each file below a path. Tasks take files of up to ``LARGE`` bytes; larger ones, of any size, are read by the driver as streams, four at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    most = min(LARGE, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(LARGE))))
    small = files.where(F.col("length") <= most).select("path", F.sha2("content", 256).alias("sha256"))  # the reader takes this filter: contents of others are not read
    large = [r.path for r in files.where(F.col("length") > most).select("path").collect()]
    if not large:
        return small
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def digest(name: str) -> tuple[str, str]:
        at = jvm.org.apache.hadoop.fs.Path(name)
        stream = at.getFileSystem(conf).open(at)
        try:
            return name, jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    with ThreadPoolExecutor(4) as pool:
        return small.unionByName(spark.createDataFrame(list(pool.map(digest, large)), "path string, sha256 string"))


def entries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``name, n_files, sha256`` of a folder's files and folders whose name fits, sorted.

    A folder (as a table of several part files is) counts as one: its sum is taken over lines of name and sum of all files in it, in order. Folders
    without files, and files that Spark's readers pass over (``_`` or ``.`` first, or empty), are left out.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, pattern)):  # None or no entries: Spark would raise
        return spark.createDataFrame([], "name string, n_files long, sha256 string")
    own = fs.makeQualified(root).depth() + 2
    parts = F.split(F.regexp_replace("path", r"^[A-Za-z][\w+.-]*:(//[^/]*)?", ""), "/")
    inner = F.array_join(F.slice(parts, own + 1, F.size(parts)), "/")
    rows = checksums(spark, f"{path.rstrip('/')}/{pattern}").select(F.element_at(parts, own).alias("name"), F.struct(inner.alias("inner"), "sha256").alias("file"))
    lists = rows.groupBy("name").agg(F.count("*").alias("n_files"), F.array_sort(F.collect_list("file")).alias("files"))
    lines = F.array_join(F.transform("files", lambda f: F.concat_ws(" ", f["inner"], f["sha256"])), "\n")
    whole = F.when(F.get("files", F.lit(0))["inner"] == "", F.get("files", F.lit(0))["sha256"]).otherwise(F.sha2(lines, 256))
    return lists.select("name", "n_files", whole.alias("sha256")).orderBy("name")


def frame_ranges(spark: SparkSession, spec: str) -> DataFrame:
    """``start:stop:step,...`` -> distinct frames (stop excluded); a lone number is a frame."""
    parts = [tuple(map(int, p.split(":"))) for p in spec.split(",") if p.strip()]
    rows = [(p[0], p[1] if len(p) > 1 else p[0] + 1, p[2] if len(p) > 2 else 1) for p in parts]
    df = spark.createDataFrame(rows, "a long, b long, s long").where("b > a")
    return df.select(F.explode(F.sequence("a", F.col("b") - 1, "s")).alias("frame")).distinct()


def even_frames(spark: SparkSession, last: int, n: int) -> DataFrame:
    """Distinct whole frames of n evenly spaced positions from 0 to last."""
    step = last / max(n - 1, 1)
    return spark.range(n).select(F.floor(F.col("id") * F.lit(step)).cast("long").alias("frame")).distinct()


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append only rows whose key is not there yet; returns how many."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        df = df.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    df = df.persist()
    n = df.count()
    if n:
        df.write.mode("append").parquet(path)
    df.unpersist()
    return n


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with doubled quotes."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_tracks(df: DataFrame, path: str) -> None:
    """Track files by ``stem``: one folder a stem, so a reader prunes to the videos that it wants."""
    df.write.mode("overwrite").partitionBy("stem").option("header", True).csv(path)


def strided(df: DataFrame, frame: str, stride: int) -> DataFrame:
    """Every ``stride``-th frame."""
    return df.where(F.col(frame) % stride == 0)


def sought(df: DataFrame, frame: str, at: int) -> DataFrame:
    """One frame."""
    return df.where(F.col(frame) == at)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A saved dump of embedded metadata: one JSON object of ``DocN:Tag`` keys, as ``tags``."""
    return _whole(spark, path, "map<string, string>").withColumnRenamed("doc", "tags")


def read_npz(spark: SparkSession, path: str, pattern: str = "*.npz") -> DataFrame:
    """Arrays of npz stacks: ``path, name, shape, data`` (flattened doubles), a row an array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as stack:
                    out += [(name, k, list(stack[k].shape), stack[k].astype(float).ravel()) for k in stack.files]
            yield pd.DataFrame(out, columns=["path", "name", "shape", "data"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, "path string, name string, shape array<long>, data array<double>")


def temporal_median(pixels: DataFrame, at: Sequence[str] = ("x", "y"), value: str = "value") -> DataFrame:
    """Background of a fixed camera: the median of each pixel over its frames, and how far the middle half of them spreads."""
    return pixels.groupBy(*at).agg(F.median(value).alias("median"), (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))).alias("activity"))


def unpack_tags(df: DataFrame, column: str = "tags") -> DataFrame:
    """``map<'DocN:Tag', value>`` rows to one row a document and tag: ``row`` is N - 1."""
    rows = df.select(*[c for c in df.columns if c != column], F.explode(column).alias("key", "value"))
    return rows.withColumns({"row": F.regexp_extract("key", r"^Doc(\d+):", 1).try_cast("int") - 1, "tag": F.regexp_extract("key", r":(.+)$", 1)}).where("row is not null").drop("key")


def zipped_notes(events: Column, notes: Column) -> Column:
    """Events with their notes; missing notes are empty."""
    return F.transform(F.arrays_zip(events.alias("event"), notes.alias("note")), lambda x: F.struct(x["event"].alias("event"), F.coalesce(x["note"], F.lit("")).alias("note")))


class VideoSource:
    """Boundary to pixels: decoding, detection and tracking are not part of this library; give their tables instead."""

    def detections(self, path: str) -> DataFrame:
        raise NotImplementedError("decode and track outside, then read the track table with read_tracks")
