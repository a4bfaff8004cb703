"""Score report: temporal-IoU F1 by class, average precision, alarms, time to event.

Inputs are three tables: ``gt(video, label, start_s, end_s)``, ``pred`` alike, ``risk(video, t, score)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.scalars import f1, ratio
from trackloom.operators.intervals import coalesce_intervals, greedy_matches, match_windows
from trackloom.operators.windows import ordered

THRESHOLDS = (0.3, 0.5, 0.7)
#: Horizon before an accident (s), window in which an alarm counts, alarm threshold, merge gap; weights of the parts (fixed values).
HORIZON, ALARM_WINDOW, THETA, MERGE_GAP = 5.0, 10.0, 0.5, 2.0
PART_WEIGHTS, B_WEIGHTS = (0.7, 0.3), {"ap": 0.4, "f1_alarm": 0.4, "mtta": 0.2}


def ordinals(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("ordinal", F.row_number().over(ordered(keys, "start_s", "end_s")) - 1)


def match_counts(gt: DataFrame, pred: DataFrame, keys: list[str], thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """``keys, thr, tp, fp, fn`` of every key of either side."""
    levels = F.explode(F.array(*map(F.lit, thresholds))).alias("thr")
    matched = greedy_matches(gt, pred, keys, thresholds)
    counts = gt.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("p")))
    counts = counts.groupBy(*keys).agg(F.sum("g").alias("n_gt"), F.sum("p").alias("n_pred")).select("*", levels)
    out = counts.join(matched, [*keys, "thr"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)).cast("long"))
    return out.select(*keys, "thr", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))


def pooled(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts summed over all other columns, with precision, recall and F1."""
    out = counts.groupBy(*keys, "thr").agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    p, r, f = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select(*keys, "thr", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def class_scores(per_class: DataFrame) -> DataFrame:
    """Mean F1 over thresholds by label."""
    return per_class.groupBy("label").agg(F.avg("f1").alias("f1_mean"))


def sample_labels(risk: DataFrame, gt: DataFrame, horizon: float = HORIZON) -> DataFrame:
    """Label of each risk sample: 1 before an accident, 0 elsewhere; samples inside an accident or around a near miss are null.

    Accidents are closed intervals, the window before is half-open. One union and one window: of the spans that have begun at a sample, only the
    furthest end counts, so samples and spans are never paired.
    """
    accident, well = F.col("label") == "accident", F.col("end_s") >= F.col("start_s")
    spans = gt.where(F.col("label").isin("accident", "near_miss")).where("video is not null").withColumn("from_s", F.col("start_s") - horizon)
    opened = spans.select("video", F.col("from_s").alias("__t"), F.when(accident & well, F.col("start_s")).alias("__before"), F.when(accident & ~well, F.col("end_s")).alias("__short"), F.when(~accident, F.col("end_s")).alias("__near"))
    during = spans.where(accident).select("video", F.col("start_s").alias("__t"), F.col("end_s").alias("__during"))
    ends = ["__before", "__short", "__near", "__during"]
    marks = opened.unionByName(during, allowMissingColumns=True).where("__t is not null").groupBy("video", "__t").agg(*(F.max(c).alias(c) for c in ends))
    rows = risk.select("video", F.col("t").alias("__t"), F.lit(1).alias("__side"), F.struct(*risk.columns).alias("__row"))
    both = rows.unionByName(marks.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    w = ordered(["video"], "__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.select("*", *(F.max(c).over(w).alias(f"{c}_upto") for c in ends)).where("__side = 1")
    t = F.col("__t")
    before = (F.col("__before_upto") > t) | (F.col("__short_upto") >= t)
    label = F.when(F.col("__during_upto") >= t, F.lit(None)).when(before, 1).when(F.col("__near_upto") >= t, F.lit(None)).otherwise(0)
    return both.select("__row.*", label.alias("label"))


def average_precision(samples: DataFrame) -> DataFrame:
    """One row: ap_raw, positive_rate, ap over ``samples(score, label)``.

    Tied scores are one step. Samples are pre-aggregated by score; the cumulative sums run over distinct scores,
    in ranges: totals of each range are summed ahead, so no task holds all scores.
    """
    steps = samples.where("label is not null").groupBy("score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    steps = cumulative_desc(steps, "score", ["pos", "n"])
    total = steps.agg(F.max("pos_upto").alias("all_pos"), F.max("n_upto").alias("all_n"))
    rows = steps.crossJoin(F.broadcast(total))  # one row
    part = ratio(F.col("pos"), F.col("all_pos")) * ratio(F.col("pos_upto"), F.col("n_upto"))
    out = rows.agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("ap_raw"), F.coalesce(ratio(F.max("all_pos"), F.max("all_n")), F.lit(0.0)).alias("positive_rate"))
    return out.withColumn("ap", chance_normalised(F.col("ap_raw"), F.col("positive_rate")))


def cumulative_desc(df: DataFrame, by: str, values: list[str], ranges: int = 64) -> DataFrame:
    """Running totals ``<value>_upto`` from the largest ``by`` down, as a two-level prefix sum over ``ranges`` equal stretches of [0, 1]."""
    df = df.withColumn("__range", F.greatest(F.lit(0), F.least(F.lit(ranges - 1), F.floor(F.col(by) * ranges))).cast("int"))
    w = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows
    ahead = df.groupBy("__range").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    ahead = ahead.select("__range", *(F.coalesce(F.sum(f"__{v}").over(w), F.lit(0)).alias(f"__{v}") for v in values))
    within = Window.partitionBy("__range").orderBy(F.desc(by))
    out = df.join(F.broadcast(ahead), "__range")
    return out.select(*[c for c in df.columns if c != "__range"], *((F.sum(v).over(within) + F.col(f"__{v}")).alias(f"{v}_upto") for v in values))


def chance_normalised(ap: Column, rate: Column) -> Column:
    return F.when(rate < 1, F.greatest(F.lit(0.0), (ap - rate) / (1 - rate))).otherwise(0.0)


def alarms(risk: DataFrame, theta: float = THETA, gap: float = MERGE_GAP) -> DataFrame:
    """``video, start_s, end_s`` of runs of scores of at least theta, merged if the next starts less than ``gap`` after."""
    w = ordered(["video"], "t")
    high = F.col("score") >= theta
    rows = risk.withColumn("high", high)
    rows = rows.withColumn("opens", F.when(F.col("high") & ~F.coalesce(F.lag("high").over(w), F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("opens").over(w)).where("high")
    runs = rows.groupBy("video", "run").agg(F.min("t").alias("start_s"), F.max("t").alias("end_s")).drop("run")
    return coalesce_intervals(runs, ["video"], gap=gap, strict=True).select("video", "start_s", "end_s")


def alarm_matches(gt: DataFrame, starts: DataFrame, window: float = ALARM_WINDOW) -> DataFrame:
    """``video, start_s, mark, tta`` of every accident; ``starts(video, t)`` are alarms."""
    out = match_windows(gt.where(F.col("label") == "accident"), starts, ["video"], window)
    return out.withColumn("tta", F.coalesce(F.col("start_s") - F.col("mark"), F.lit(0.0)))


def part_b(gt: DataFrame, risk: DataFrame) -> DataFrame:
    """One row: average precision, alarm F1, mean time to accident and their weighted score."""
    labelled = sample_labels(risk, gt)
    ap = average_precision(labelled)
    first = alarms(risk).select("video", F.col("start_s").alias("t"))
    kept = sample_labels(first, gt).where("label is not null").select("video", "t")
    matched = alarm_matches(gt, kept)
    sums = matched.agg(F.count("*").alias("n_accidents"), F.count("mark").alias("n_matched"), F.coalesce(F.sum("tta"), F.lit(0.0)).alias("tta"))
    one = ap.crossJoin(sums).crossJoin(kept.agg(F.count("*").alias("n_alarms")))  # one row each
    p, r = ratio(F.col("n_matched"), F.col("n_alarms")), ratio(F.col("n_matched"), F.col("n_accidents"))
    one = one.withColumn("f1_alarm", ratio(2 * p * r, p + r)).withColumn("mtta", ratio(F.col("tta"), F.col("n_accidents")))
    score = B_WEIGHTS["ap"] * F.col("ap") + B_WEIGHTS["f1_alarm"] * F.col("f1_alarm") + B_WEIGHTS["mtta"] * F.least(F.lit(1.0), F.col("mtta") / ALARM_WINDOW)
    return one.withColumn("score_b", score).drop("tta")


def model_score(gt: DataFrame, pred: DataFrame, risk: DataFrame) -> DataFrame:
    """One row: score_a (macro F1), score_b and the model's score; without accidents the model's score is score_a."""
    per_class = pooled(match_counts(gt, pred, ["video", "label"]), ["label"])
    a = class_scores(per_class).agg(F.coalesce(F.avg("f1_mean"), F.lit(0.0)).alias("score_a"))
    both = a.crossJoin(part_b(gt, risk).select("score_b", "n_accidents"))  # one row each
    total = PART_WEIGHTS[0] * F.col("score_a") + PART_WEIGHTS[1] * F.col("score_b")
    return both.select("score_a", "score_b", F.when(F.col("n_accidents") > 0, total).otherwise(F.col("score_a")).alias("model_score"))


def missing_and_extra(gt_videos: DataFrame, pred_videos: DataFrame) -> DataFrame:
    """``video, kind``: videos of one side only."""
    missing = gt_videos.select("video").distinct().join(pred_videos.select("video"), "video", "left_anti").withColumn("kind", F.lit("missing"))
    extra = pred_videos.select("video").distinct().join(gt_videos.select("video"), "video", "left_anti").withColumn("kind", F.lit("extra"))
    return missing.unionByName(extra)


def per_video(counts: DataFrame, labels: list[str], thr: float = 0.5) -> DataFrame:
    """A row a video, ``tp/fp/fn`` of each label."""
    cell = F.concat_ws("/", "tp", "fp", "fn")
    return counts.where(F.col("thr") == thr).groupBy("video").pivot("label", labels).agg(F.first(cell)).na.fill("0/0/0", labels)
