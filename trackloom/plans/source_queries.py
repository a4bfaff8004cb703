"""Queries of sources, sinks and small functions: what is written is read back and held against the tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from trackloom.functions import scalars
from trackloom.plans.common import EV, Catalog, events, r6, read
from trackloom.sources import documents, store

catalog = Catalog()


def _folder(spark, name: str) -> str:
    """A folder that driver and executors share; in local mode without one, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="trackloom-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@catalog.add(EV + " SELECT 'V' || video AS stem, count(*) AS n, round(sum(value), 4) AS conf, min(event_id) AS first FROM ev WHERE t < 2000000.0 GROUP BY 1")
def track_files(spark, sf_dir):
    """Tracks written as CSV by video, read with their stem up to a time."""
    path = _folder(spark, "tracks")
    ev = events(spark, sf_dir).select(F.concat(F.lit("V"), F.col("video").cast("string")).alias("stem"), F.col("event_id").cast("int").alias("frame"), F.col("t").alias("t_sec"), F.col("user_id").cast("int").alias("track_id"), F.col("event_type").alias("cls"), F.col("value").alias("conf"), *(F.lit(1.0).alias(c) for c in ("x1", "y1", "x2", "y2")))
    documents.write_tracks(ev, path)
    rows = documents.read_tracks(spark, path, until=2_000_000.0)
    return rows.groupBy("stem").agg(F.count("*").alias("n"), F.round(F.sum("conf"), 4).alias("conf"), F.min("frame").cast("long").alias("first"))


@catalog.add(EV + " SELECT 'v' || video AS video, count(*) AS n, round(sum(start_s), 3) AS starts, round(sum(end_s), 3) AS ends, count(DISTINCT label) AS labels FROM (SELECT video, t AS start_s, t + value AS end_s, event_type AS label FROM ev WHERE event_type IN ('signup', 'purchase')) GROUP BY 1")
def label_documents(spark, sf_dir):
    """A label document written and read back."""
    path = _folder(spark, "labels")
    ev = events(spark, sf_dir).where("event_type in ('signup', 'purchase')").select(F.concat(F.lit("v"), "video").alias("video"), F.col("t").alias("start_s"), (F.col("t") + F.col("value")).alias("end_s"), F.col("event_type").alias("label"))
    videos = ev.select("video").distinct().select("video", F.lit(2592000.0).alias("duration"), F.lit(25.0).alias("fps"))
    documents.write_document(documents.event_document(videos, ev), path)
    _, back = documents.read_truth(spark, path)
    return back.groupBy("video").agg(F.count("*").alias("n"), F.round(F.sum("start_s"), 3).alias("starts"), F.round(F.sum("end_s"), 3).alias("ends"), F.countDistinct("label").alias("labels"))


@catalog.add("SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS stem, 64 AS digits")
def file_listing(spark, sf_dir):
    """Tables of a folder by suffix, in order, with their checksums; a table may be a file or a folder of part files."""
    return documents.entries(spark, sf_dir, "*.parquet").select(scalars.stem(F.col("name")).alias("stem"), F.length("sha256").alias("digits"))


@catalog.add(EV + ", f AS (SELECT DISTINCT unnest(list_concat(list_concat(range(0, 2000, 7), [2500]), range(3000, 3100))) AS frame) SELECT frame, count(*) AS n FROM ev JOIN f ON f.frame = CAST(floor(t / 600.0) AS BIGINT) GROUP BY 1")
def chosen_frames(spark, sf_dir):
    """Samples of the frames of a range spec."""
    ev = events(spark, sf_dir).withColumn("frame", F.floor(F.col("t") / 600.0))
    return ev.join(documents.frame_ranges(spark, "0:2000:7,2500,3000:3100"), "frame", "left_semi").groupBy("frame").agg(F.count("*").alias("n"))


@catalog.add(EV + ", f AS (SELECT DISTINCT CAST(floor(range * (4319.0 / 24.0)) AS BIGINT) AS frame FROM range(25)) SELECT frame, count(*) AS n FROM ev JOIN f ON f.frame = CAST(floor(t / 600.0) AS BIGINT) GROUP BY 1")
def even_frames(spark, sf_dir):
    """Samples of evenly spaced frames."""
    ev = events(spark, sf_dir).withColumn("frame", F.floor(F.col("t") / 600.0))
    return ev.join(documents.even_frames(spark, 4319, 25), "frame", "left_semi").groupBy("frame").agg(F.count("*").alias("n"))


@catalog.add("SELECT 'strided' AS kind, event_id, value FROM events WHERE event_id % 15 = 0 UNION ALL SELECT 'sought', event_id, value FROM events WHERE event_id = 77 UNION ALL SELECT 'every', max(event_id), round(sum(value), 4) FROM events")
def strided_frames(spark, sf_dir):
    """S7, S8, S9, S13, P12 over tables: every frame, each n-th, one; filter and columns reach the scan."""
    ev = read(spark, sf_dir, "events").select("event_id", "value")
    parts = [documents.strided(ev, "event_id", 15).withColumn("kind", F.lit("strided")), documents.sought(ev, "event_id", 77).withColumn("kind", F.lit("sought"))]
    whole = ev.agg(F.max("event_id").alias("event_id"), F.round(F.sum("value"), 4).alias("value")).withColumn("kind", F.lit("every"))
    return parts[0].unionByName(parts[1]).unionByName(whole).select("kind", "event_id", "value")


@catalog.add("SELECT o_orderkey, round(CASE WHEN o_orderkey % 11 = 0 OR o_custkey = 0 THEN 25.0 ELSE o_custkey / (o_orderkey % 11)::DOUBLE END, 6) AS fps FROM orders")
def frame_rates(spark, sf_dir):
    """Rates of a probe's fractions."""
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", r6(scalars.frame_rate(F.concat_ws("/", F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 11).cast("string")))).alias("fps"))


@catalog.add(EV + """, r AS (SELECT event_id % 50 AS row, value, k FROM ev), w AS (SELECT row::INT AS row, max(value) AS iso, max(k)::DOUBLE AS f FROM r GROUP BY 1) SELECT row, iso, f, round(log2((f + 1) * (f + 1) * 60.0) - log2((iso + 1) / 100.0), 6) AS ev100 FROM w""")
def camera_tags(spark, sf_dir):
    """Tags of embedded documents, written as JSON, unpacked and turned wide."""
    path = _folder(spark, "tags")
    ev = events(spark, sf_dir).groupBy((F.col("event_id") % 50).alias("row")).agg(F.max("value").alias("Iso"), F.max("k").alias("F"))
    pairs = ev.select(F.explode(F.array(*[F.struct(F.format_string(f"Doc%d:{c}", F.col("row") + 1).alias("key"), F.col(c).cast("string").alias("value")) for c in ("Iso", "F")])).alias("p"))
    dump = pairs.agg(F.to_json(F.map_from_entries(F.collect_list("p"))).alias("value"))
    dump.write.text(path)
    wide = documents.unpack_tags(documents.read_dump(spark, path)).groupBy("row").pivot("tag", ["Iso", "F"]).agg(F.max("value").cast("double"))
    out = wide.select("row", F.col("Iso").alias("iso"), F.col("F").alias("f"))
    return out.withColumn("ev100", r6(scalars.exposure_value(F.col("f") + 1, F.lit(1 / 60.0), F.col("iso") + 1)))


@catalog.add("SELECT doc_id, round((doc_id % 7 - 3 + (doc_id % 5) - 2 + 1.5) / 3.0, 6) AS mean, round((abs(doc_id % 7 - 3) + abs(doc_id % 5 - 2) + 1.5) / 3.0, 6) AS size FROM documents")
def sensor_lists(spark, sf_dir):
    """Means of lists of numbers in a text."""
    text = F.concat_ws(" ", (F.col("doc_id") % 7 - 3).cast("string"), (F.col("doc_id") % 5 - 2).cast("string"), F.lit("1.5"))
    mean, size = scalars.list_mean(text)
    return read(spark, sf_dir, "documents").select("doc_id", r6(mean).alias("mean"), r6(size).alias("size"))


@catalog.add("SELECT vec_id, round((embedding[1] + embedding[4]) / 2.0, 4) AS x, round((embedding[2] + embedding[5]) / 2.0, 4) AS y, round((embedding[3] + embedding[6]) / 2.0, 4) AS z FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS embedding FROM embeddings)")
def axis_means(spark, sf_dir):
    """Means of the three axes of a flat list."""
    e = read(spark, sf_dir, "embeddings")
    mean = scalars.triples_mean(F.slice(F.col("embedding").cast("array<double>"), 1, 6))
    return e.select("vec_id", *(F.round(F.get(mean, F.lit(k)), 4).alias(c) for k, c in enumerate("xyz")))


@catalog.add(EV + " SELECT event_id, event_type || '_' || user_id || '_' || lpad((k % 20)::VARCHAR, 2, '0') AS id, strftime(epoch_ms((1704067200 + floor(t)::BIGINT) * 1000), '%Y%m%dT%H%M%SZ') AS stamp FROM ev")
def item_ids(spark, sf_dir):
    """Padded ids and compact stamps."""
    ev = events(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.floor(F.col("t")) + 1704067200))
    return ev.select("event_id", scalars.padded_id(F.col("event_type"), F.col("user_id").cast("string"), (F.col("k") % 20).cast("int")).alias("id"), scalars.compact_stamp(F.col("at")).alias("stamp"))


@catalog.add(EV + ", g AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS a FROM ev GROUP BY 1) SELECT user_id, array_to_string(CASE WHEN list_contains(a, 'click') THEN a ELSE list_append(a, 'click') END, ',') AS items, array_to_string(list_transform(a, lambda x, i: x || '=' || CASE WHEN i = 1 THEN 'n' ELSE '' END), ',') AS notes FROM g")
def list_items(spark, sf_dir):
    """A value appended if absent; events zipped with shorter notes."""
    own = events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("a"))
    zipped = F.transform(documents.zipped_notes(F.col("a"), F.array(F.lit("n"))), lambda z: F.concat_ws("=", z["event"], z["note"]))
    return own.select("user_id", F.array_join(scalars.appended(F.col("a"), F.lit("click")), ",").alias("items"), F.array_join(zipped, ",").alias("notes"))


@catalog.add("SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
def skipped_existing(spark, sf_dir):
    """K3: only what is not there yet is appended."""
    path = _folder(spark, "done")
    keys = ["user_id", "event_type"]
    rows = read(spark, sf_dir, "events").select(*keys).distinct()
    documents.append_new(rows.where("user_id % 3 = 0"), path, keys)
    documents.append_new(rows, path, keys)
    documents.append_new(rows.where("user_id % 2 = 0"), path, keys)
    return spark.read.parquet(path).groupBy("user_id").agg(F.count("*").alias("n"))


@catalog.add(EV + " SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 25 = 0) AS snapshots, max(event_id) AS version FROM ev GROUP BY 1")
def change_log(spark, sf_dir):
    """K6, K7, V3: a JSON log appended to in parts, its snapshots and last versions."""
    path = _folder(spark, "log")
    rows = events(spark, sf_dir).select("user_id", F.col("event_id").alias("version"), "event_type")
    for k in range(2):
        documents.append_log(rows.where(F.col("version") % 2 == k), path)
    back = spark.read.schema("user_id long, version long, event_type string").json(path)
    last = store.latest(back, ["user_id"]).select("user_id", "version")
    snaps = store.snapshots(back).groupBy("user_id").agg(F.count("*").alias("snapshots"))
    return back.groupBy("user_id").agg(F.count("*").alias("n")).join(last, "user_id").join(snaps, "user_id", "left").na.fill(0, ["snapshots"])


@catalog.add("SELECT p_partkey, 'say \"' || p_name || '\", twice' AS name FROM part")
def csv_export(spark, sf_dir):
    """K8: quotes and commas survive an export."""
    path = _folder(spark, "export")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('say "'), "p_name", F.lit('", twice')).alias("name"))
    documents.write_csv(rows, path)
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').schema("p_partkey long, name string").csv(path)


@catalog.add("SELECT * FROM (VALUES ('a', 3::BIGINT, 'three'), ('b', 1, 'one')) v(key, version, body)")
def saved_versions(spark, sf_dir):
    """V1, V2: saves with a base; an unchanged body and a wrong base save nothing."""
    s = store.Store(spark, _folder(spark, "store"))
    for key, body, base in (("a", "one", 0), ("a", "one", 1), ("b", "one", 0), ("a", "two", 1), ("a", "lost", 1), ("a", "three", 2)):
        try:
            s.save(key, body, base)
        except store.Conflict:
            pass
    return s.current().select("key", "version", "body")
