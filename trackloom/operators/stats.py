"""Correlation, resampling tests, sampling. Random draws are arithmetic or hashed from seeds, so reruns and engines agree."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.intervals import interval_lookup


def drawn(seed: int, *of: str) -> Column:
    """A hashed non-negative number of a seed and some columns: the first 60 bits of an MD5, the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in of])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def masked_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str, mask: Column) -> DataFrame:
    """Pearson correlation of the rows in the mask; null without variance on either side."""
    rows = df.where(mask & F.col(x).isNotNull() & F.col(y).isNotNull())
    out = rows.groupBy(*keys).agg(F.corr(x, y).alias("r"), F.stddev_pop(x).alias("__a"), F.stddev_pop(y).alias("__b"), F.count("*").alias("n"))
    return out.withColumn("r", F.when((F.col("__a") > 0) & (F.col("__b") > 0) & ~F.isnan("r"), F.col("r"))).drop("__a", "__b")


def window_rates(onsets: DataFrame, events: DataFrame, keys: Sequence[str], before: float, after: float, duration: float) -> DataFrame:
    """Events a second in the windows before and after each onset, and their contrast. Onsets whose windows leave the clip are unused.

    ``onsets(keys, t)``, ``events(keys, t)``.
    """
    used = onsets.where((F.col("t") - before >= 0) & (F.col("t") + after <= duration)).withColumn("onset", F.col("t"))
    spans = used.select(*keys, "onset", (F.col("t") - before).alias("a"), (F.col("t") + after).alias("b"))
    hit = interval_lookup(events.select(*keys, "t"), spans, keys, "t", "a", "b", before + after)
    side = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = hit.groupBy(*keys, "onset").agg(side(F.col("t") < F.col("onset")).alias("pre"), side(F.col("t") >= F.col("onset")).alias("post"))
    out = used.select(*keys, "onset").join(counts, [*keys, "onset"], "left").na.fill(0, ["pre", "post"])
    return out.withColumn("effect", F.col("post") / after - F.col("pre") / before)


def pooled(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean over keys."""
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("pooled"))


def circular_shift_null(onsets: DataFrame, events: DataFrame, keys: Sequence[str], window: float, duration: float, draws: int, shift: Column) -> DataFrame:
    """``draw, hits``: events within ``window`` after an onset when all events of a key are shifted around the clip by ``shift(draw, keys)``; draw 0 is unshifted.

    The onsets are shifted back instead, so events are never multiplied; a window that wraps is two.
    """
    size = F.lit(float(duration))
    rows = onsets.select(*keys, "t", F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw"))
    rows = rows.withColumn("length", F.least(F.lit(float(window)), size - F.col("t"))).withColumn("a", F.when(F.col("draw") == 0, F.col("t")).otherwise(F.pmod(F.col("t") - shift, size)))
    over = F.col("a") + F.col("length") - size
    parts = F.array(F.struct(F.col("a").alias("a"), F.least(F.col("a") + F.col("length"), size).alias("b")), F.struct(F.lit(0.0).alias("a"), F.greatest(over, F.lit(0.0)).alias("b")))
    spans = rows.select(*keys, "draw", F.explode(F.filter(parts, lambda p: p["b"] > p["a"])).alias("p")).select(*keys, "draw", "p.a", "p.b")
    counts = _between(spans, events, keys, "draw", float(window))
    every = onsets.sparkSession.range(draws + 1).select(F.col("id").cast("int").alias("draw"))
    return every.join(counts, "draw", "left").na.fill(0, ["hits"])


def _between(spans: DataFrame, events: DataFrame, keys: Sequence[str], group: str, width: float) -> DataFrame:
    """``group, hits``: events in ``[a, b)`` of spans, by running counts (see ``hits_after``); buckets of ``width`` seconds."""
    bucket = lambda c: F.floor(F.col(c) / width).cast("long").alias("bucket")
    ends = spans.select(*keys, group, F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(-1).alias("sign")), F.struct(F.col("b").alias("x"), F.lit(1).alias("sign")))).alias("e"))
    ends = ends.select(*keys, group, "e.x", "e.sign").select("*", bucket("x"), F.lit(0).alias("side"))
    own = events.select(*keys, F.col("t").alias("x")).select("*", bucket("x"), F.lit(1).alias("side"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("x", "side")  # an end counts the events before it
    rows = ends.unionByName(own, allowMissingColumns=True).withColumn("upto", F.sum("side").over(inside)).where("side = 0")
    counts = own.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    every = ends.select(*keys, "bucket").distinct().join(counts, [*keys, "bucket"], "full").na.fill(0, ["n"])
    ahead = every.withColumn("before", F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket")) - F.col("n")).drop("n")
    return rows.join(ahead, [*keys, "bucket"]).groupBy(group).agg(F.sum(F.col("sign") * (F.col("upto") + F.col("before"))).alias("hits"))


def random_onset_null(onsets: DataFrame, events: DataFrame, keys: Sequence[str], window: float, duration: int, draws: int, seed: int) -> DataFrame:
    """``draw, hits`` with as many onsets in each key as there are, at hashed whole seconds of the clip."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("t"))
    rows = onsets.withColumn("__n", at).select(*keys, "__n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    rows = rows.withColumn("a", (drawn(seed, "draw", *keys, "__n") % duration).cast("double"))
    return _between(rows.select(*keys, "draw", "a", (F.col("a") + window).alias("b")), events, keys, "draw", float(window))


def rates_by_window(onsets: DataFrame, events: DataFrame, keys: Sequence[str], group: str, windows: Sequence[tuple[float, float]], unit: float = 1.0) -> DataFrame:
    """``group, a, b, rate``: events a second in each window (in units after an onset), over all onsets of a group."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in windows])).alias("w")
    rows = onsets.select(*keys, group, "t", each).withColumn("of", F.struct(group, "w.a", "w.b"))
    spans = rows.select(*keys, "of", (F.col("t") + F.col("w.a") * unit).alias("a"), (F.col("t") + F.col("w.b") * unit).alias("b"))
    hits = _between(spans, events, keys, "of", unit * max(b - a for a, b in windows))
    n = rows.groupBy("of").agg(F.count("*").alias("n"))
    out = n.join(hits, "of", "left").withColumn("rate", F.coalesce("hits", F.lit(0)) / (F.col("n") * (F.col("of.b") - F.col("of.a")) * unit))
    return out.select(f"of.{group}", "of.a", "of.b", "rate")


def best_by_group(rates: DataFrame, group: str) -> DataFrame:
    """For each of two groups its best window (the first of equals) and that window's rate in the other."""
    first = F.struct((-F.round("rate", 12)).alias("m"), "a", "b", "rate")
    best = rates.groupBy(F.col(group).alias("trained_on")).agg(F.min(first).alias("x")).select("trained_on", "x.a", "x.b", F.col("x.rate").alias("train_rate"))
    other = rates.select(F.col(group).alias("tested_on"), "a", "b", F.col("rate").alias("test_rate"))
    return best.join(other, ["a", "b"]).where("tested_on <> trained_on").drop("tested_on")


def one_sided_p(null: DataFrame) -> DataFrame:
    """Observed value (draw 0) and the share of draws that reach it."""
    seen = null.where("draw = 0").select(F.col("hits").alias("observed"))
    return null.where("draw > 0").crossJoin(F.broadcast(seen)).groupBy("observed").agg(F.avg(F.when(F.col("hits") >= F.col("observed"), 1.0).otherwise(0.0)).alias("p"))  # one row


def best_window(train: DataFrame, test: DataFrame, window: str, value: str) -> DataFrame:
    """The window of the largest value in training (the first of equals), and its value in the test group."""
    best = train.agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(window)).alias("w"))).alias("b")).select((-F.col("b.w")).alias(window), F.col("b.v").alias("train_value"))
    return best.join(test.select(window, F.col(value).alias("test_value")), window, "left")


def block_bootstrap(blocks: DataFrame, value: str, block: str, n_blocks: int, resamples: int, seed: int = 0) -> DataFrame:
    """``draw, mean``: means of values over blocks drawn with replacement; draws come from a seeded hash."""
    draws = blocks.sparkSession.range(resamples).select(F.col("id").cast("int").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("slot"))
    draws = draws.withColumn(block, (drawn(seed, "draw", "slot") % n_blocks).cast("int"))
    sums = blocks.groupBy(F.col(block).cast("int").alias(block)).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    return draws.join(sums, block).groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("mean"))


def interval(draws: DataFrame, value: str = "mean", level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return draws.agg(F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"))


def phase_interval(df: DataFrame, t: str, cycle: float, block: str, n_blocks: int, resamples: int, level: float = 0.95, seed: int = 0) -> DataFrame:
    """``phase, low, high``: circular mean phase, and percentiles of its wrapped deviations over blocks drawn with replacement."""
    turn = 2 * math.pi / cycle
    sums = df.groupBy(F.col(block).cast("int").alias(block)).agg(F.sum(F.cos(F.col(t) * turn)).alias("c"), F.sum(F.sin(F.col(t) * turn)).alias("s"))
    angle = lambda: F.atan2(F.sum("s"), F.sum("c")) / turn
    draws = df.sparkSession.range(resamples).select(F.col("id").cast("int").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("slot"))
    draws = draws.withColumn(block, (drawn(seed, "draw", "slot") % n_blocks).cast("int")).join(sums, block).groupBy("draw").agg(angle().alias("p"))
    one = sums.agg(angle().alias("e"))
    size, half, tail = F.lit(float(cycle)), cycle / 2, (1 - level) / 2
    off = draws.crossJoin(F.broadcast(one)).withColumn("v", F.pmod(F.col("p") - F.col("e") + half, size) - half)  # one row
    out = off.agg(F.max("e").alias("e"), F.percentile("v", F.lit(tail)).alias("a"), F.percentile("v", F.lit(1 - tail)).alias("z"))
    return out.select(F.pmod(F.col("e"), size).alias("phase"), F.pmod(F.col("e") + F.col("a"), size).alias("low"), F.pmod(F.col("e") + F.col("z"), size).alias("high"))


def seeded_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int, identity: Sequence[str]) -> DataFrame:
    """Exactly n rows of each key (or all), by the least seeded hash: no replacement, no dependence on partitions."""
    w = Window.partitionBy(*keys).orderBy(drawn(seed, *identity), *identity)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")
