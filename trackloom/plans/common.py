"""Inputs of the queries: the events table read as tracks, segments and curves.

A user is a track, ``user_id % 4`` a video, seconds since 2024 the time, value and k the two coordinates. ``EV`` is the same
view for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = 1704067200.0
Query = Callable[[SparkSession, str], DataFrame]

EV = """WITH ev AS (SELECT event_id, user_id, user_id % 4 AS video, epoch_us(ts) / 1e6 - 1704067200.0 AS t, event_type, value,
  CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"""

SEGMENTS = EV + """, seg AS (SELECT video, 'c' || CAST(k % 3 AS VARCHAR) AS label, t AS start_s, t + value * 60.0 AS end_s, event_type FROM ev WHERE event_type IN ('purchase', 'view')),
 flagged AS (SELECT *, CASE WHEN start_s > max(end_s) OVER (PARTITION BY event_type, video, label ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1
   WHEN row_number() OVER (PARTITION BY event_type, video, label ORDER BY start_s, end_s) = 1 THEN 1 ELSE 0 END AS opens FROM seg),
 numbered AS (SELECT *, sum(opens) OVER (PARTITION BY event_type, video, label ORDER BY start_s, end_s) AS island FROM flagged),
 merged AS (SELECT event_type, video, label, island, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n FROM numbered GROUP BY ALL)"""


class Catalog:
    """Queries and their SQL, by name."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if sql:
                self.oracle[fn.__name__] = sql
            return fn

        return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - ORIGIN
    return read(spark, sf_dir, "events").select(
        "event_id", "user_id", (F.col("user_id") % 4).alias("video"), seconds.alias("t"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def segments(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    ev = events(spark, sf_dir).where(F.col("event_type") == kind)
    return ev.select("video", F.concat(F.lit("c"), (F.col("k") % 3).cast("string")).alias("label"), F.col("t").alias("start_s"), (F.col("t") + F.col("value") * 60.0).alias("end_s"))


def r6(c: Column | str) -> Column:
    return F.round(c if not isinstance(c, str) else F.col(c), 6)
