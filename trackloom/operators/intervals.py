"""Interval algebra and ordered folds.

Every operator takes the key columns that separate independent sequences. Windows are partitioned by them,
folds collect one array per key and fold it with ``aggregate``, in the JVM; matchings scan their arrays in numpy, where a fold would copy its
state at each step. Endpoint conventions are stated with each.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import interval_iou, overlap


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, name: str = "island") -> DataFrame:
    """Number of the run that a row belongs to; ``starts`` says (over the same window) whether a row opens one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__starts", F.when(starts, 1).otherwise(0)).withColumn(name, F.sum("__starts").over(w)).drop("__starts")


def value_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "run") -> DataFrame:
    """Runs of equal value (nulls equal each other)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    return islands(df, keys, order, first | ~F.col(value).eqNullSafe(F.lag(value).over(w)), name)


def sessions(df: DataFrame, keys: Sequence[str], t: str, gap: float, period: float, least: float, end_limit: Column | float) -> DataFrame:
    """Positive samples -> segments: a new one after a gap of more than ``gap``; end is last + period, at most the limit."""
    w = Window.partitionBy(*keys).orderBy(t)
    parts = islands(df.select(*keys, t).distinct(), keys, [t], F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(True)))
    limit = end_limit if isinstance(end_limit, Column) else F.lit(float(end_limit))
    out = parts.groupBy(*keys, "island").agg(F.min(t).alias("start_s"), F.least(F.max(t) + period, F.max(limit)).alias("end_s"), F.count("*").alias("n"))
    return out.where(F.col("end_s") - F.col("start_s") >= least).drop("island")


def coalesce_intervals(df: DataFrame, keys: Sequence[str], start: str = "start_s", end: str = "end_s", gap: float = 0.0, strict: bool = False) -> DataFrame:
    """Merge intervals whose start is within ``gap`` of the furthest end so far (``strict``: less than ``gap`` after it)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    far = (F.col(start) - reach >= gap) if strict else (F.col(start) > reach + gap)
    parts = islands(df, keys, [start, end], F.coalesce(far, F.lit(True)))
    return parts.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("island")


def adjacent_overlaps(df: DataFrame, keys: Sequence[str], start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Rows that start before their predecessor's end; touching is legal."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    return df.withColumn("previous_end", F.lag(end).over(w)).where(F.col(start) < F.col("previous_end"))


def drop_overlaps(df: DataFrame, keys: Sequence[str], start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Keep the earlier of overlapping segments. Dropped ones do not hide later ones, so this is a fold, not a lag."""
    item = "struct<s:double,e:double>"
    start_state = F.from_json(F.lit('{"last": -1e300, "kept": []}'), f"last double, kept array<{item}>")

    def step(acc: Column, x: Column) -> Column:
        grown = F.struct(x["e"].alias("last"), F.array_append(acc["kept"], x).alias("kept"))
        return F.when(x["s"] >= acc["last"], grown).otherwise(acc)

    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e")))).alias("all"))
    kept = lists.select(*keys, F.explode(F.aggregate("all", start_state, step)["kept"]).alias("x"))
    return kept.select(*keys, F.col("x.s").alias(start), F.col("x.e").alias(end))


def pairs_by_iou(gt: DataFrame, pred: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """Pairs of segments of one key that overlap with IoU of at least ``least``; i and j are their ordinals.

    The overlap predicate is part of the join, so pairs that do not meet are never made. Segments get the
    buckets of ``BUCKET`` seconds that they touch as a second key, and a pair is taken in the bucket of its later
    start only, so one hot key is split by time.
    """
    a = _bucketed(gt, "start_s", "end_s", BUCKET).select(*keys, "bucket", F.col("ordinal").alias("i"), F.col("start_s").alias("a0"), F.col("end_s").alias("a1"))
    b = _bucketed(pred, "start_s", "end_s", BUCKET).select(*keys, "bucket", F.col("ordinal").alias("j"), F.col("start_s").alias("b0"), F.col("end_s").alias("b1"))
    joined = a.join(b, [*keys, "bucket"]).where((F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1")))
    joined = joined.where(F.col("bucket") == F.floor(F.greatest("a0", "b0") / BUCKET))
    iou = interval_iou(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))
    return joined.select(*keys, "i", "j", iou.alias("iou")).where(F.col("iou") >= least)


BUCKET = 86_400.0


def _bucketed(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    return df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def greedy_matches(gt: DataFrame, pred: DataFrame, keys: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """``keys, thr, tp``: one-to-one matches by descending (iou, i, j) with an IoU of at least ``thr`` (above 0); i and j are ordinals by (start_s, end_s), so larger ones win ties.

    The matches of a threshold are the first of a lower one's, so a single pass counts for all. Equal segments are one with a count, and pairs are
    made in each key's task, from segments that are still free (``_count_matches``). Segments that do not end after their start match nothing.
    """
    levels = [float(t) for t in thresholds]
    if min(levels) <= 0:
        raise ValueError("thresholds must be above 0")

    def lists(df: DataFrame, side: str) -> DataFrame:
        alike = df.where("end_s > start_s").groupBy(*keys, F.col("start_s").cast("double").alias("s"), F.col("end_s").cast("double").alias("e")).agg(F.count("*").alias("n"))
        own = alike.groupBy(*keys).agg(F.collect_list(F.struct("s", "e", "n")).alias("all"))
        return own.select(*keys, *(F.col(f"all.{c}").alias(f"{side}_{c}") for c in ("s", "e", "n")))

    @F.pandas_udf("array<bigint>")
    def count(g0: pd.Series, g1: pd.Series, gn: pd.Series, p0: pd.Series, p1: pd.Series, pn: pd.Series) -> pd.Series:
        return pd.Series([_count_matches(*x, levels) for x in zip(g0, g1, gn, p0, p1, pn)], dtype=object)

    both = lists(gt, "g").join(lists(pred, "p"), list(keys)).select(*keys, count("g_s", "g_e", "g_n", "p_s", "p_e", "p_n").alias("tps"))
    return both.select(*keys, F.explode(F.arrays_zip(F.array(*map(F.lit, levels)).alias("thr"), F.col("tps").alias("tp"))).alias("x")).select(*keys, "x.thr", "x.tp")


#: Candidates looked at together, and pairs of one band of IoU held together, within a task.
BLOCK, PAIRS = 1 << 21, 1 << 22


def _count_matches(g0, g1, gn, p0, p1, pn, levels: list[float]) -> list[int]:
    """Greedy matches of one key at each level; ``n`` counts equal segments.

    The IoU goes down in bands: the pairs of a band are made from segments that are still free, and taken in order. Bands become narrower where a
    band holds more than ``PAIRS``. Of equal segments any is as good, so a pair of them takes as many as both have left.
    """

    def side(s, e, n):
        s, e, n = np.asarray(s, float), np.asarray(e, float), np.asarray(n, int)
        order = np.lexsort((e, s))
        return s[order], e[order], n[order].tolist()

    (g0, g1, gn), (p0, p1, pn) = side(g0, g1, gn), side(p0, p1, pn)
    least, high, step, tp = min(levels), 1.0, 1 / 16, [0] * len(levels)
    while True:
        low = max(least, high - step)
        i, j = np.flatnonzero(gn), np.flatnonzero(pn)
        found = _pairs_from(g0[i], g1[i], p0[j], p1[j], low, PAIRS if step > 1e-6 else None)
        if found is None:
            step /= 4
            continue
        iou, i, j = found[0], i[found[1]], j[found[2]]
        order = np.lexsort((-j, -i, -iou))
        for at in range(0, len(order), BLOCK):
            now = order[at : at + BLOCK]
            for o, a, b in zip(iou[now].tolist(), i[now].tolist(), j[now].tolist()):
                if m := min(gn[a], pn[b]):
                    gn[a] -= m
                    pn[b] -= m
                    tp = [t + m if o >= level else t for t, level in zip(tp, levels)]
        if low <= least:
            return tp
        high, step = low, min(1 / 16, step * 2)


def _pairs_from(g0, g1, p0, p1, low: float, most: int | None):
    """IoU and positions of all pairs of at least ``low``; None if they are more than ``most``. Both sides are ordered by start.

    A pair with that IoU starts at most ``length (1 - low) / low`` before and ``length (1 - low)`` after the first segment's start; the slack covers rounding.
    """
    size, slack = g1 - g0, 1e-9 * (g1 - g0) + 1e-12 * np.abs(g0)
    first = np.searchsorted(p0, g0 - size * ((1 - low) / low) - slack, "left") if low < 1 else np.searchsorted(p0, g0 - slack, "left")
    n = np.searchsorted(p0, g0 + size * max(0.0, 1 - low) + slack, "right") - first
    upto, out, held, at = np.cumsum(n), [], 0, 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, "right")))
        i = np.repeat(np.arange(at, end), n[at:end])
        j = np.arange(len(i)) - np.repeat(upto[at:end] - n[at:end] - (upto[at - 1] if at else 0), n[at:end]) + np.repeat(first[at:end], n[at:end])
        both = np.minimum(g1[i], p1[j]) - np.maximum(g0[i], p0[j])
        iou = both / (size[i] + (p1[j] - p0[j]) - both)
        keep = np.flatnonzero(iou >= low)
        out.append((iou[keep], i[keep], j[keep]))
        held, at = held + len(keep), end
        if most and held > most:
            return None
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0), np.empty(0, int), np.empty(0, int))


def match_windows(targets: DataFrame, marks: DataFrame, keys: Sequence[str], before: float) -> DataFrame:
    """Targets in time order take the earliest mark not yet taken in ``[start - before, start)``.

    ``targets(keys, start_s)``, ``marks(keys, t)`` -> every target with ``mark`` (null if none). Windows only move on, so marks are gone through once.
    """
    own = targets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("start_s").cast("double"))).alias("targets"))
    other = marks.groupBy(*keys).agg(F.collect_list(F.col("t").cast("double")).alias("marks"))

    def scan(starts: np.ndarray, free: np.ndarray) -> list[float | None]:
        free, at, out = np.sort(free).tolist(), 0, []
        for s in starts:
            while at < len(free) and free[at] < s - before:
                at += 1
            taken = at < len(free) and free[at] < s
            out.append(free[at] if taken else None)
            at += taken
        return out

    @F.pandas_udf("array<double>")
    def take(starts: pd.Series, free: pd.Series) -> pd.Series:
        return pd.Series([scan(*x) for x in zip(starts, free)], dtype=object)

    none = F.array().cast("array<double>")
    taken = own.join(other, list(keys), "left").select(*keys, "targets", take("targets", F.coalesce("marks", none)).alias("marks"))
    return taken.select(*keys, F.explode(F.arrays_zip("targets", "marks")).alias("x")).select(*keys, F.col("x.targets").alias("start_s"), F.col("x.marks").alias("mark"))


def interval_lookup(points: DataFrame, intervals: DataFrame, keys: Sequence[str], t: str, start: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """Points with every half-open interval ``[start, end)`` of their key that holds them.

    Buckets of ``width`` make it an equi-join: a point has one bucket, an interval all that it touches.
    """
    spread = _bucketed(intervals, start, end, width)
    own = points.withColumn("bucket", F.floor(F.col(t) / width))
    found = own.join(spread, [*keys, "bucket"], "inner").where((F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))).drop("bucket")
    if how == "inner":
        return found
    extra = [c for c in intervals.columns if c not in keys]
    return points.join(found.select(*points.columns, *extra), points.columns, "left")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], tolerance: float | None = None) -> DataFrame:
    """Each left row with the values of the last right row at or before it: a union and one window, no join.

    Of right rows at equal times, the one of the largest values counts. ``right_t`` is its time.
    """
    state = F.struct(F.col(t).alias("right_t"), *values)
    extra = [c for c in left.columns if c not in (*keys, t)]
    a = left.select(*keys, t, F.lit(1).alias("__side"), F.lit(None).cast(right.select(state).schema[0].dataType).alias("__state"), F.struct(*extra).alias("__row") if extra else F.struct(F.lit(1)).alias("__row"))
    b = right.select(*keys, t, F.lit(0).alias("__side"), state.alias("__state"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"))
    w = Window.partitionBy(*keys).orderBy(t, "__side", "__state").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__seen", F.last("__state", ignorenulls=True).over(w)).where("__side = 1")
    if tolerance is not None:
        both = both.withColumn("__seen", F.when(F.col(t) - F.col("__seen.right_t") <= tolerance, F.col("__seen")))
    return both.select(*keys, t, *([F.col(f"__row.{c}").alias(c) for c in extra]), F.col("__seen.right_t").alias("right_t"), *[F.col(f"__seen.{v}").alias(v) for v in values])


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, tolerance: float | None = None) -> DataFrame:
    """Each left row with the time of the nearest right row of its key (the earlier of two equally near)."""
    w, back = Window.partitionBy(*keys).orderBy(t, "__side"), Window.partitionBy(*keys).orderBy(F.desc(t), F.desc("__side"))
    a = left.withColumn("__side", F.lit(1)).withColumn("__t", F.lit(None).cast("double"))
    b = right.select(*keys, t).withColumn("__side", F.lit(0)).withColumn("__t", F.col(t))
    both = a.unionByName(b, allowMissingColumns=True)
    before = F.last("__t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("__t", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))  # a growing frame from the far end: linear
    both = both.withColumn("__b", before).withColumn("__a", after).where("__side = 1")
    near = F.when(F.col("__a").isNull() | (F.col(t) - F.col("__b") <= F.col("__a") - F.col(t)), F.col("__b")).otherwise(F.col("__a"))
    out = both.withColumn("nearest_t", near)
    if tolerance is not None:
        out = out.withColumn("nearest_t", F.when(F.abs(F.col("nearest_t") - F.col(t)) <= tolerance, F.col("nearest_t")))
    return out.drop("__side", "__t", "__a", "__b")


def largest_overlap(spans: DataFrame, intervals: DataFrame, keys: Sequence[str], value: str, unknown: str, width: float) -> DataFrame:
    """Each span (start_s, end_s) with the value of the interval that it shares most time with, the earliest of equals, or ``unknown``."""
    a = _bucketed(spans, "start_s", "end_s", width)
    b = _bucketed(intervals.select(*keys, F.col("start_s").alias("i0"), F.col("end_s").alias("i1"), value), "i0", "i1", width)
    shared = overlap(F.col("start_s"), F.col("end_s"), F.col("i0"), F.col("i1"))
    hits = a.join(b, [*keys, "bucket"]).where("start_s < i1 and i0 < end_s")
    best = hits.groupBy(*keys, "start_s", "end_s").agg(F.max(F.struct(shared.alias("o"), (-F.col("i0")).alias("s"), F.col(value).alias("v"))).alias("m"))
    out = spans.join(best, [*keys, "start_s", "end_s"], "left")
    return out.withColumn(value, F.coalesce(F.col("m.v"), F.lit(unknown))).withColumn("shared", F.coalesce(F.col("m.o"), F.lit(0.0))).drop("m")


def tiling_violations(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Intervals that do not begin where the one before ends."""
    w = Window.partitionBy(*keys).orderBy(start)
    return df.withColumn("expected", F.lag(end).over(w)).where(F.col("expected").isNotNull() & (F.col(start) != F.col("expected")))
