"""Validation of documents: rules give rows ``(severity, video, ordinal, message)``, never exceptions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.scalars import LABELS, number
from trackloom.operators.intervals import drop_overlaps
from trackloom.operators.windows import ordered

SLACK = 0.5
#: Geometry, least points and allowed values of the attribute of each zone type (fixed values).
ZONES = {
    "stop_line": ("polyline", 2, {"approach": ["", "near_carriageway", "far_carriageway", "side_road"]}),
    "zebra_crossing": ("polygon", 3, {}),
    "parking_bay": ("polygon", 3, {}),
    "live_lane": ("polygon", 3, {"direction": ["", "near_carriageway", "far_carriageway", "turn"]}),
    "bus_stop": ("polygon", 3, {}),
    "non_carriageway": ("polygon", 3, {"kind": ["", "median", "island", "sidewalk", "other"]}),
}


def finding(df: DataFrame, when: Column, message: str, severity: str = "error", ordinal: str | None = None) -> DataFrame:
    return df.where(F.coalesce(when, F.lit(False))).select(F.lit(severity).alias("severity"), F.col("video").cast("string").alias("video"), (F.col(ordinal).cast("long") if ordinal else F.lit(None).cast("long")).alias("ordinal"), F.lit(message).alias("message"))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def event_findings(events: DataFrame, videos: DataFrame, labels: Sequence[str] = LABELS, slack: float = SLACK) -> DataFrame:
    """``events(video, ordinal, start_s, end_s, label)`` against ``videos(video, duration)``: times, labels, ends, overlaps. An event of bad times still takes part in the overlap test."""
    times = number(F.col("start_s")) & number(F.col("end_s"))
    rows = events.join(videos.select("video", "duration"), "video", "left")
    w = Window.partitionBy("video", "label").orderBy("start_s", "end_s", "ordinal")
    pairs = events.where(times & F.col("label").isin(*labels)).withColumn("before", F.lag("end_s").over(w))
    return union([
        finding(rows, F.col("video").rlike(r"[/\\]"), "video is a path", ordinal="ordinal"),
        finding(rows, ~times | (F.col("start_s") < 0) | (F.col("start_s") >= F.col("end_s")), "bad times", ordinal="ordinal"),
        finding(rows, ~F.col("label").isin(*labels), "unknown label", ordinal="ordinal"),
        finding(rows, times & (F.col("end_s") > F.coalesce(F.col("duration"), F.lit(float("inf"))) + slack), "ends after the video", ordinal="ordinal"),
        finding(pairs, F.col("start_s") < F.col("before"), "overlaps its predecessor", ordinal="ordinal"),
    ])


def risk_findings(risk: DataFrame) -> DataFrame:
    """``risk(video, pos, t, score)``: the first bad row of each video (times fall, scores outside [0, 1], no numbers)."""
    w = ordered(["video"], "pos")
    good = number(F.col("t")) & number(F.col("score"))
    bad = ~good | (F.col("t") < F.coalesce(F.lag("t").over(w), F.lit(-1.0))) | ~F.col("score").between(0, 1)
    first = risk.withColumn("bad", F.coalesce(bad, F.lit(True))).where("bad").groupBy("video").agg(F.min("pos").alias("pos"))
    return finding(first, F.lit(True), "bad risk row", ordinal="pos")


def coverage_findings(truth: DataFrame, predicted: DataFrame, with_risk: DataFrame) -> DataFrame:
    """Videos of one side only, and predictions without a curve."""
    missing = truth.select("video").distinct().join(predicted.select("video"), "video", "left_anti")
    extra = predicted.select("video").distinct().join(truth.select("video"), "video", "left_anti")
    bare = predicted.select("video").distinct().join(with_risk.select("video"), "video", "left_anti")
    return union([finding(missing, F.lit(True), "missing video"), finding(extra, F.lit(True), "unknown video", "warning"), finding(bare, F.lit(True), "no risk curve", "warning")])


def clean_events(events: DataFrame, videos: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Events fit for scoring: known labels, ends clipped to the video, sound times, rounded, same-class overlaps dropped, sorted by (start, end, label)."""
    rows = events.join(videos.select("video", "duration"), "video", "left").where(F.col("label").isin(*labels))
    rows = rows.withColumn("end_s", F.least("end_s", F.coalesce("duration", "end_s")))
    rows = rows.where(number(F.col("start_s")) & number(F.col("end_s")) & (F.col("start_s") >= 0) & (F.col("start_s") < F.col("end_s")))
    rows = rows.withColumns({"start_s": F.round("start_s", 3), "end_s": F.round("end_s", 3)})
    return drop_overlaps(rows, ["video", "label"])


def label_body(rows: DataFrame, duration: Column, labels: Sequence[str] = LABELS) -> DataFrame:
    """Labels as saved: rounded, an end within a millisecond of the clip's snapped to it, notes of 2000 characters at most; unknown labels and bad times are left out."""
    rows = rows.where(F.col("label").isin(*labels) & number(F.col("start_s")) & number(F.col("end_s")) & (F.col("start_s") < F.col("end_s")))
    end = F.when(F.abs(F.col("end_s") - duration) <= 0.001, duration).otherwise(F.round("end_s", 3))
    return rows.withColumns({"start_s": F.round("start_s", 3), "end_s": end, "note": F.substring(F.coalesce("note", F.lit("")), 1, 2000)})


def label_bodies(rows: DataFrame, keys: Sequence[str], duration: Column, labels: Sequence[str] = LABELS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a body (rows of one key) with an unknown label or bad times is rejected whole, with the reason of its first bad row.

    Accepted rows are as ``label_body`` leaves them; sort them by (start_s, end_s, label) where they are written.
    """
    times = number(F.col("start_s")) & number(F.col("end_s")) & (F.col("start_s") < F.col("end_s"))
    why = F.when(F.coalesce(~F.col("label").isin(*labels), F.lit(True)), "unknown label").when(F.coalesce(~times, F.lit(True)), "bad times")
    rejected = rows.withColumn("__why", why).where("__why is not null").groupBy(*keys).agg(F.min_by("__why", F.struct("start_s", "end_s", "label")).alias("why"))
    return label_body(rows.join(rejected.drop("why"), list(keys), "left_anti"), duration, labels), rejected


def optional(df: DataFrame, t: str = "t", until: float | None = None, **chosen: Sequence | None) -> DataFrame:
    """Only the chosen values of each named column and times before ``until``; None filters nothing."""
    for name, values in chosen.items():
        if values is not None:
            df = df.where(F.col(name).isin(*values))
    return df if until is None else df.where(F.col(t) < until)


def emptied(log: DataFrame, lists: Sequence[str], factor: float = 3.0) -> DataFrame:
    """``within_budget`` with the lists of videos over their time made empty."""
    out = within_budget(log, factor)
    return out.withColumns({c: F.when(F.col("kept"), F.col(c)).otherwise(F.filter(c, lambda x: F.lit(False))) for c in lists})


def zone_findings(zones_: DataFrame, width: float, height: float, zones: int = 500, points: int = 1000) -> DataFrame:
    """``zones_(video, id, type, points array<struct<x, y>>, attrs map)``: ids, duplicates, types, points, frame, attributes; at most ``zones`` a video, of ``points`` each."""
    kinds = [(t, least, k, v) for t, (_, least, attrs) in ZONES.items() for k, v in (attrs or {"": []}).items()]
    table = zones_.sparkSession.createDataFrame([(t, least) for t, least in {t: n for t, n, _, _ in kinds}.items()], "type string, least int")
    rows = zones_.join(F.broadcast(table), "type", "left").withColumn("same", F.count("*").over(Window.partitionBy("video", "id")))
    outside = ~F.forall("points", lambda p: p["x"].between(0, width) & p["y"].between(0, height))
    def fits(kind: str, name: str, values: list[str]) -> Column:
        own = F.forall(F.map_entries("attrs"), lambda e: (e["key"] == name) & e["value"].isin(*values)) if name else F.size(F.map_keys("attrs")) == 0
        return (F.col("type") == kind) & own

    allowed = reduce(lambda a, b: a | b, [fits(t, k, v) for t, _, k, v in kinds], F.size(F.map_keys("attrs")) == 0)
    return union([
        finding(rows, ~F.col("id").rlike("^[A-Za-z0-9_-]{1,64}$"), "bad id"), finding(rows, F.col("same") > 1, "id used twice"), finding(rows, F.col("least").isNull(), "unknown type"),
        finding(rows, F.size("points") < F.col("least"), "too few points"), finding(rows, outside, "outside the frame"), finding(rows, F.size("points") > points, "too many points"), finding(zones_.groupBy("video").count().where(F.col("count") > zones), F.lit(True), "too many zones"), finding(rows, F.col("least").isNotNull() & ~allowed, "bad attribute"),
    ])


def within_budget(log: DataFrame, factor: float = 3.0) -> DataFrame:
    """Videos whose total time keeps to ``factor`` times their duration; the entries of others are emptied."""
    return log.withColumn("kept", F.col("total_sec") <= factor * F.col("duration"))


def exactly_one(df: DataFrame, keys: Sequence[str], when: Column) -> DataFrame:
    """Keys for which the condition does not hold exactly once, with the count."""
    return df.groupBy(*keys).agg(F.sum(F.when(when, 1).otherwise(0)).alias("n")).where("n <> 1")


def mismatches(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys of both sides whose values differ."""
    other = b.select(*keys, F.col(value).alias("other"))
    return a.select(*keys, value).join(other, list(keys)).where(~F.col(value).eqNullSafe(F.col("other")))


def good_registration(inliers: Column, spread: Column, p90: Column, matrix: Column) -> Column:
    """A registration may be used: finite matrix, 30 inliers, a quarter of the frame covered, 90 % of residuals within 10 px."""
    return F.forall(matrix, lambda v: number(v)) & (inliers >= 30) & (spread >= 0.25) & (p90 <= 10)
