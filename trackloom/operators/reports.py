"""Report tables: flows and their queues, lighting, sizes, blocks, detectors compared, settling, exposure."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import circular
from trackloom.operators.windows import ordered


def region(x: Column, y: Column, width: float, height: float) -> Column:
    """Name of the ninth of the frame that a point lies in."""
    col = F.element_at(F.array(*map(F.lit, ("left", "centre", "right"))), F.least(F.lit(3), F.floor(3 * x / width) + 1).cast("int"))
    row = F.element_at(F.array(*map(F.lit, ("top", "middle", "bottom"))), F.least(F.lit(3), F.floor(3 * y / height) + 1).cast("int"))
    return F.when((row == "middle") & (col == "centre"), "centre").otherwise(F.concat_ws("-", row, col))


def direction_words(dx: Column, dy: Column) -> Column:
    """What a motion in the image looks like from an elevated camera; empty without motion."""
    size = 0.35 * F.hypot(dx, dy)
    depth = F.when(F.abs(dy) > size, F.when(dy > 0, "towards camera").otherwise("away from camera"))
    side = F.when(F.abs(dx) > size, F.when(dx > 0, "left to right").otherwise("right to left"))
    return F.concat_ws(", ", depth, side)


def ranked_names(df: DataFrame, by: str, prefix: str = "F") -> DataFrame:
    """``by, n, name``: names by falling frequency, the lowest value first of equals. A row a value."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), by))
    return n.withColumn("name", F.concat(F.lit(prefix), rank.cast("string")))


def flow_table(tracks: DataFrame, stops: DataFrame, flow: str, track: str, kind: str, width: float, height: float) -> DataFrame:
    """A row a flow: name, count, median ends, direction, class mix, median speed, share of tracks that stopped, stops and their median length.

    ``tracks(flow, track, kind, x0, y0, x1, y1, med_speed_moving)``, ``stops(track, dur)``.
    """
    ends = [F.median(c).alias(c) for c in ("x0", "y0", "x1", "y1")]
    own = tracks.groupBy(flow).agg(F.count("*").alias("n"), *ends, F.median("med_speed_moving").alias("speed"))
    mix = tracks.groupBy(flow, kind).agg(F.count("*").alias("k")).groupBy(flow).agg(F.array_sort(F.collect_list(F.concat_ws(":", kind, "k"))).alias("m")).select(flow, F.array_join("m", ",").alias("classes"))
    held = stops.join(tracks.select(flow, track), track).groupBy(flow).agg(F.countDistinct(track).alias("stopped"), F.count("*").alias("stops"), F.median("dur").alias("median_stop"))
    out = own.join(mix, flow).join(ranked_names(tracks, flow).select(flow, "name"), flow).join(held, flow, "left").na.fill(0, ["stopped", "stops"])
    a, b = region(F.col("x0"), F.col("y0"), width, height), region(F.col("x1"), F.col("y1"), width, height)
    name = F.when(a == b, F.concat_ws(" ", "name", F.lit("within"), a)).otherwise(F.concat_ws(" ", "name", a, F.lit("to"), b))
    words = direction_words(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return out.withColumns({"name": name, "direction": words, "heading": circular.heading(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), "share_stopped": F.col("stopped") / F.col("n")}).drop("stopped")


def furthest_queue(stops: DataFrame, ends: DataFrame, flow: str, reach: float = 400.0, least: int = 3) -> DataFrame:
    """The stop furthest along each flow's axis that has ``least`` stops, itself included, within ``reach`` behind it.

    ``stops(flow, x, y)``, ``ends(flow, x0, y0, x1, y1)``. A range frame over the projection.
    """
    length = F.greatest(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), F.lit(1e-6))
    along = ((F.col("x") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y") - F.col("y0")) * (F.col("y1") - F.col("y0"))) / length
    rows = stops.join(ends.select(flow, "x0", "y0", "x1", "y1"), flow).withColumn("p", along)
    behind = F.expr(f"count(*) OVER (PARTITION BY {flow} ORDER BY p RANGE BETWEEN {float(reach)!r}D PRECEDING AND CURRENT ROW)")
    rows = rows.withColumns({"behind": behind, "used": F.count("*").over(Window.partitionBy(flow))}).where(F.col("behind") >= least)
    best = rows.groupBy(flow).agg(F.max(F.struct("p", "x", "y", "used")).alias("b"))
    return best.select(flow, "b.x", "b.y", "b.used")


def lighting(df: DataFrame, keys: Sequence[str], order: str, mean: str, high: str, ends: int = 10) -> DataFrame:
    """Mean of the first and last ``ends`` samples, least and greatest, change in percent, median of the high percentile."""
    up, down = F.row_number().over(ordered(keys, order)), F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    rows = df.withColumns({"__u": up, "__d": down})
    out = rows.groupBy(*keys).agg(
        F.avg(F.when(F.col("__u") <= ends, F.col(mean))).alias("first"), F.avg(F.when(F.col("__d") <= ends, F.col(mean))).alias("last"),
        F.min(mean).alias("least"), F.max(mean).alias("greatest"), F.median(high).alias("median_high"),
    )
    return out.withColumn("change_pct", F.try_divide(100.0 * (F.col("last") - F.col("first")), F.col("first")))


def size_stats(df: DataFrame, keys: Sequence[str], size: str, limits: Sequence[float]) -> DataFrame:
    """Median, tenth percentile and the share below each limit."""
    shares = [F.avg(F.when(F.col(size) < v, 1.0).otherwise(0.0)).alias(f"below_{v:g}".replace(".", "_")) for v in limits]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.median(size).alias("median"), F.percentile(size, F.lit(0.1)).alias("p10"), *shares)


def blocks(df: DataFrame, x: str, y: str, track: str, width: float, height: float, nx: int = 6, ny: int = 4) -> DataFrame:
    """Distinct tracks and median position by block of the frame, the fullest first."""
    i, j = (F.least(F.floor(F.col(c) * n / size), F.lit(n - 1)).cast("int") for c, n, size in ((x, nx, width), (y, ny, height)))
    out = df.groupBy(i.alias("i"), j.alias("j")).agg(F.countDistinct(track).alias("tracks"), F.median(x).alias("x"), F.median(y).alias("y"))
    return out.orderBy(F.desc("tracks"), "i", "j")


def compared(a: DataFrame, b: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """``keys, measure, a, b, ratio``: the same summary of two detectors side by side."""
    long = lambda d, n: d.select(*keys, F.explode(F.create_map(*[x for m in measures for x in (F.lit(m), F.col(m).cast("double"))])).alias("measure", n))
    return long(a, "a").join(long(b, "b"), [*keys, "measure"], "full").withColumn("ratio", F.try_divide("b", "a"))


def residuals(df: DataFrame, keys: Sequence[str], error: str, x: str, y: str, width: float, height: float, cells: int = 4, least: int = 3) -> DataFrame:
    """Median and ninetieth percentile of residuals, and the share of a square grid's cells that hold ``least`` points."""
    i, j = (F.least(F.floor(F.col(c) * cells / size), F.lit(cells - 1)) for c, size in ((x, width), (y, height)))
    full = df.groupBy(*keys, i.alias("__i"), j.alias("__j")).agg(F.count("*").alias("__n")).groupBy(*keys).agg((F.count_if(F.col("__n") >= least) / cells**2).alias("spread"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.median(error).alias("median"), F.percentile(error, F.lit(0.9)).alias("p90")).join(full, list(keys))


def settled(df: DataFrame, keys: Sequence[str], order: str, drift: str, most: float) -> DataFrame:
    """The first sample from which all later drifts stay under ``most``; keys that never settle are left out."""
    later = F.max(drift).over(Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))  # grows from the far end
    return df.withColumn("__worst", later).where(F.col("__worst") < most).groupBy(*keys).agg(F.min(order).alias(order))


def state_shares(points: DataFrame, intervals: DataFrame, keys: Sequence[str], duration: float) -> DataFrame:
    """``keys, state, crossings, time``: share of points by the state they fall in, beside that state's share of time. ``points(keys, state)``, ``intervals(keys, state, span)``."""
    p = points.groupBy(*keys, "state").agg(F.count("*").alias("k")).withColumn("crossings", F.col("k") / F.sum("k").over(Window.partitionBy(*keys))).drop("k")
    t = intervals.groupBy(*keys, "state").agg((F.sum("span") / duration).alias("time"))
    return p.join(t, [*keys, "state"], "full").na.fill(0.0, ["crossings", "time"])


def exposure(spark, start: float, cycle: float, bins: int, duration: float) -> DataFrame:
    """``bin, seconds``: how long the clip [0, duration) spends in each phase bin; in closed form, a row a bin."""
    low = F.col("id") * F.lit(cycle / bins)

    def upto(t: float, edge: Column) -> Column:
        """Seconds before t with a phase under ``edge``, counted from the cycle's start."""
        return F.lit(float(math.floor((t - start) / cycle))) * edge + F.least(F.lit((t - start) % cycle), edge)

    span = lambda t: upto(t, low + F.lit(cycle / bins)) - upto(t, low)
    return spark.range(bins).select(F.col("id").cast("int").alias("bin"), (span(duration) - span(0.0)).alias("seconds"))


def shift_correlations(df: DataFrame, keys: Sequence[str], at: str, x: str, y: str, size: int, shifts: Sequence[int]) -> DataFrame:
    """``keys, shift, r``: correlation of x with y moved around a circle of ``size`` samples; shift 0 is the observed one."""
    moved = df.select(*keys, F.explode(F.array(*map(F.lit, shifts))).alias("shift"), F.col(at), F.col(y).alias("__y"))
    moved = moved.withColumn(at, F.pmod(F.col(at) + F.col("shift"), F.lit(size)))
    return df.select(*keys, at, x).join(moved, [*keys, at]).groupBy(*keys, "shift").agg(F.corr(x, "__y").alias("r"))


def outline(edges: DataFrame) -> DataFrame:
    """Edges of a union of polygons that meet edge to edge: those that no two polygons share. ``edges(x0, y0, x1, y1)``, in any direction."""
    a, b = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 1").select("a.x", "a.y", F.col("b.x").alias("u"), F.col("b.y").alias("v"))
