"""Track analytics: enrichment, summaries, stops, episodes, gates, density.

A track table has key columns (``TRACK`` by default), time ``t`` and ground point ``x, y``. All windows of a track share one
partitioning and order, so Spark sorts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import circular
from trackloom.operators.intervals import coalesce_intervals, islands, sessions
from trackloom.operators.windows import movement, ordered, rolling_median_padded, step_speed, velocity, within

TRACK = ("video", "track_id")


def ground_points(df: DataFrame) -> DataFrame:
    """Boxes to ground point (bottom centre) and height."""
    return df.withColumns({"x": (F.col("x1") + F.col("x2")) / 2, "y": F.col("y2"), "h": F.col("y2") - F.col("y1")})


def enrich(df: DataFrame, keys: Sequence[str] = TRACK, order: Sequence[str] = ("t",), k: int = 5, reach: int = 5) -> DataFrame:
    """Smoothed position (padded median), velocity, speed and heading of every sample."""
    w = ordered(keys, *order)
    out = df.withColumns({"sx": rolling_median_padded(w, keys, "x", k), "sy": rolling_median_padded(w, keys, "y", k)})
    out = out.withColumns({"vx": velocity(w, "sx", "t", reach), "vy": velocity(w, "sy", "t", reach)})
    return out.withColumns({"speed": F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")), "heading": circular.heading(F.col("vx"), F.col("vy"))})


def long_enough(df: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Samples of tracks with at least ``least`` of them."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("__n") >= least).drop("__n")


def majority(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value by key, the lowest of equals; two partial aggregations, no window."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")).select(*keys, F.col("b.v").alias(value), (-F.col("b.m")).alias("votes"))


def summaries(df: DataFrame, keys: Sequence[str] = TRACK, order: Sequence[str] = ("t",), still: float = 1.0) -> DataFrame:
    """One row a track: span, mean of the first and last three points, speeds while moving, share stopped, displacement."""
    up, down = F.row_number().over(ordered(keys, *order)), F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    rows = df.withColumns({"__up": up, "__down": down})
    first, last = F.col("__up") <= 3, F.col("__down") <= 3
    moving = F.when(F.col("speed") > still, F.col("speed"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"),
        F.avg(F.when(first, F.col("x"))).alias("x0"), F.avg(F.when(first, F.col("y"))).alias("y0"), F.avg(F.when(last, F.col("x"))).alias("x1"), F.avg(F.when(last, F.col("y"))).alias("y1"),
        F.median(moving).alias("med_speed_moving"), F.percentile("speed", F.lit(0.85)).alias("p85_speed"), F.avg(F.when(F.col("speed") <= still, 1.0).otherwise(0.0)).alias("frac_stopped"),
    )
    return out.withColumns({"dur": F.col("t1") - F.col("t0"), "disp": F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))})


def stop_runs(df: DataFrame, keys: Sequence[str], speed: str, most: float, least_s: float, order: Sequence[str] = ("t",)) -> DataFrame:
    """Runs of samples at or under a speed that last long enough, with their median point."""
    w = ordered(keys, *order)
    rows = df.withColumn("__still", F.col(speed) <= most)
    rows = islands(rows, keys, order, ~F.col("__still").eqNullSafe(F.lag("__still").over(w)), "__run").where("__still")
    out = rows.groupBy(*keys, "__run").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.median("x").alias("x"), F.median("y").alias("y"), F.count("*").alias("n"))
    return out.withColumn("dur", F.col("t1") - F.col("t0")).where(F.col("dur") >= least_s).drop("__run")


def dwells(df: DataFrame, keys: Sequence[str], period: float, spread: float, least_s: float, limit: float, gap: float = 1.0) -> DataFrame:
    """Stays: from some sample on, all samples up to the first at or after ``least_s - period`` later keep within ``spread`` on both axes.

    Every sample of such a window counts; counted samples become segments, which are merged across tracks of a video.
    """
    w = ordered(keys, "t")
    split = F.greatest(F.lit(1.0), F.lit(2 * period))
    rows = df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("__n") >= least_s / period)
    rows = islands(rows, keys, ["t"], F.coalesce(F.col("t") - F.lag("t").over(w) > split, F.lit(True)), "__chunk")
    # samples up to start + need, and the first one from there on: its time ends the window
    need, own = max(0.0, least_s - period), [*keys, "__chunk"]
    rows = rows.withColumn("__end", within("first(t)", own, "t", need, None))
    rows = rows.withColumns({f"__{f}{c}": within(f"{fn}({c})", own, "t", 0, need) for c in ("x", "y") for f, fn in (("lo", "min"), ("hi", "max"))})
    starts = rows.where("__end is not null").select(*keys, "__chunk", F.col("t").alias("__s"), "__end", "__lox", "__hix", "__loy", "__hiy")
    ends = rows.select(*keys, "__chunk", F.col("t").alias("__end"), F.col("x").alias("__ex"), F.col("y").alias("__ey"))
    still = starts.join(ends, [*keys, "__chunk", "__end"]).where(
        (F.greatest("__hix", "__ex") - F.least("__lox", "__ex") <= spread) & (F.greatest("__hiy", "__ey") - F.least("__loy", "__ey") <= spread)
    )
    spans = coalesce_intervals(still.select(*keys, "__chunk", F.col("__s").alias("start_s"), F.col("__end").alias("end_s")), [*keys, "__chunk"])
    marked = rows.select(*keys, "__chunk", "t").join(spans.select(*keys, "__chunk", "start_s", "end_s"), [*keys, "__chunk"]).where("t between start_s and end_s")
    return sessions(marked, keys, "t", max(1.0, 2 * period), period, least_s, limit)


def road_episodes(df: DataFrame, keys: Sequence[str], period: float, limit: Column | float, reach: float = 1.01) -> DataFrame:
    """Supported episodes of ``(t, x, y, h, eligible)`` samples.

    A sample counts while it is eligible and the track moves at 0.1 of its height a second around it; an episode ends at a
    sample that does not count, a gap, or a jump, and needs 3 samples, 0.75 s and 0.3 of the median height of extent.
    """
    w = ordered(keys, "t")
    moved, elapsed = movement(keys, ["x", "y"], "t", reach)
    rows = df.withColumns({"__moved": moved, "__elapsed": elapsed})
    rows = rows.withColumn("__ok", F.col("eligible") & (F.col("__elapsed") > 0) & (F.col("__moved") >= 0.1 * F.col("h") * F.col("__elapsed")))
    gap = F.col("t") - F.lag("t").over(w)
    jump = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) > F.greatest(F.col("h"), F.lag("h").over(w)) * (0.5 + 1.5 * gap)
    breaks = F.coalesce(~F.col("__ok") | ~F.lag("__ok").over(w) | (gap > max(1.01, period * 2.01)) | jump, F.lit(True))
    rows = islands(rows, keys, ["t"], breaks, "__episode").where("__ok")
    out = rows.groupBy(*keys, "__episode").agg(
        F.min("t").alias("start_s"), F.max("t").alias("last_s"), F.count("*").alias("n"), F.median("h").alias("h"),
        F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("extent"),
    )
    end = F.least(F.col("last_s") + period, limit if isinstance(limit, Column) else F.lit(float(limit)))
    kept = out.where("n >= 3 and last_s - start_s >= 0.75 and extent >= 0.3 * h")
    return kept.select(*keys, F.round("start_s", 3).alias("start_s"), F.round(end, 3).alias("end_s"), "n")


def flagged_episodes(df: DataFrame, keys: Sequence[str], on: str, conflict: str, period: float, limit: float, gap: float = 1.1, longest: float = 15.0) -> DataFrame:
    """Episodes of samples with ``on``: at least two of them and one conflict, not longer than 15 s, with 0.35 of the median extent travelled."""
    w = ordered(keys, "t")
    far = F.col("t") - F.lag("t").over(w) > gap
    rows = islands(df, keys, ["t"], F.coalesce(~F.col(on) | ~F.lag(on).over(w) | far, F.lit(True)), "__e").where(F.col(on))
    ends = F.struct("t", "x", "y")
    out = rows.groupBy(*keys, "__e").agg(F.min(ends).alias("a"), F.max(ends).alias("b"), F.count("*").alias("n"), F.median("extent").alias("extent"), F.max(F.col(conflict)).alias("any"))
    travel = F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    kept = out.where(F.col("any") & (F.col("n") >= 2) & (F.col("b.t") - F.col("a.t") + period <= longest) & (travel >= 0.35 * F.col("extent")))
    return kept.select(*keys, F.round("a.t", 3).alias("start_s"), F.round(F.least(F.col("b.t") + period, F.lit(float(limit))), 3).alias("end_s"))


def gate_crossings(df: DataFrame, keys: Sequence[str], gate: tuple[tuple[float, float], tuple[float, float]], direction: tuple[float, float], order: Sequence[str] = ("t",)) -> DataFrame:
    """First directed crossing of a gate by each track: the side changes sign between samples, at a point on the segment, along the direction."""
    (ax, ay), (bx, by) = gate
    gx, gy = bx - ax, by - ay
    w = ordered(keys, *order)
    side = gx * (F.col("y") - ay) - gy * (F.col("x") - ax)
    place = ((F.col("x") - ax) * gx + (F.col("y") - ay) * gy) / (gx * gx + gy * gy)
    rows = df.withColumns({"__side": side, "__place": place}).withColumns({f"__n{c}": F.lead(c).over(w) for c in ("__side", "__place", "x", "y", "t")})
    on = F.col("__place").between(0, 1) | F.col("__n__place").between(0, 1)
    along = (F.col("__nx") - F.col("x")) * direction[0] + (F.col("__ny") - F.col("y")) * direction[1] > 0
    hits = rows.where((F.col("__side") * F.col("__n__side") < 0) & on & along)
    return hits.groupBy(*keys).agg(F.min("__nt").alias("t"))


def riders(people: DataFrame, cycles: DataFrame, frame: Sequence[str], person: Sequence[str], share: float = 0.5) -> DataFrame:
    """People whose ground point lies in a two-wheeler's box (a quarter longer downwards) in at least half of their samples."""
    box = cycles.select(*frame, *[F.col(c).alias(f"c_{c}") for c in ("x1", "y1", "x2", "y2")])
    low = F.col("c_y2") + 0.25 * (F.col("c_y2") - F.col("c_y1"))
    on = people.join(box, list(frame)).where(F.col("x").between(F.col("c_x1"), F.col("c_x2")) & (F.col("y") >= F.col("c_y1")) & (F.col("y") <= low))
    hits = on.select(*person, *frame).distinct().groupBy(*person).agg(F.count("*").alias("hits"))
    total = people.groupBy(*person).agg(F.count("*").alias("n"))
    return total.join(hits, list(person)).where(F.col("hits") >= share * F.col("n"))


def counts_per_bin(df: DataFrame, t: str, width: float, bins: int, kind: str, kinds: Sequence[str], track: str) -> DataFrame:
    """Distinct tracks by time bin and class, pivoted, with empty bins as 0."""
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    rows = df.select(F.floor(F.col(t) / width).cast("int").alias("bin"), kind, track).distinct()
    wide = rows.groupBy("bin").pivot(kind, list(kinds)).agg(F.count(track))
    return spine.join(wide, "bin", "left").na.fill(0, list(kinds))


def direction_field(df: DataFrame, track: Sequence[str], cell: Sequence[str], least_n: int = 8, least_tracks: int = 3) -> DataFrame:
    """Mean unit direction by cell: averaged over each track first, then over tracks; coherence is its length."""
    per = df.groupBy(*cell, *track).agg(F.avg(F.cos(F.radians("heading"))).alias("c"), F.avg(F.sin(F.radians("heading"))).alias("s"), F.count("*").alias("n"))
    out = per.groupBy(*cell).agg(F.avg("c").alias("ux"), F.avg("s").alias("uy"), F.sum("n").alias("n"), F.count("*").alias("tracks"))
    out = out.where((F.col("n") >= least_n) & (F.col("tracks") >= least_tracks))
    return out.withColumns({"coherence": F.hypot("ux", "uy"), "heading": circular.heading(F.col("ux"), F.col("uy"))})


def histogram2d(df: DataFrame, x: str, y: str, size: float, width: float, height: float) -> DataFrame:
    """Counts by square cell; the far edges belong to the last cell, points outside are dropped."""
    inside = F.col(x).between(0, width) & F.col(y).between(0, height)
    nx, ny = int(-(-width // size)), int(-(-height // size))
    i = F.least(F.floor(F.col(x) / size), F.lit(nx - 1)).cast("int")
    j = F.least(F.floor(F.col(y) / size), F.lit(ny - 1)).cast("int")
    return df.where(inside).groupBy(i.alias("i"), j.alias("j")).agg(F.count("*").alias("n"))


def turns(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("t",), still: float = 1.0, ends: int = 5) -> DataFrame:
    """Change of direction between the first and last five moving samples, and its kind; tracks with fewer than ten are left out."""
    rows = df.where(F.col("speed") > still)
    up, down = F.row_number().over(ordered(keys, *order)), F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    rows = rows.withColumns({"__up": up, "__down": down})
    pick = lambda c, side: F.avg(F.when(F.col(side) <= ends, F.col(c)))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(pick(c, s).alias(f"{c}{s}") for c in ("vx", "vy") for s in ("__up", "__down"))).where(F.col("n") >= 2 * ends)
    change = circular.signed_difference(circular.heading(F.col("vx__down"), F.col("vy__down")), circular.heading(F.col("vx__up"), F.col("vy__up")))
    return out.select(*keys, "n", change.alias("change")).withColumn("kind", circular.turn(F.col("change")))


def recent_speed(df: DataFrame, keys: Sequence[str], most: float = 2.0, order: Sequence[str] = ("t",)) -> DataFrame:
    return df.withColumn("step_speed", step_speed(ordered(keys, *order), ["x", "y"], "t", most))
