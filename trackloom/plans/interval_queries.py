"""Queries of interval algebra, matching and the score report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import intervals as iv
from trackloom.operators import metrics
from trackloom.operators.windows import ordered
from trackloom.plans.common import EV, SEGMENTS, Catalog, events, r6, segments

catalog = Catalog()


def merged(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return iv.coalesce_intervals(segments(spark, sf_dir, kind), ["video", "label"]).select("video", "label", "start_s", "end_s")


def risk_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).where("event_type in ('click', 'error')")
    return ev.groupBy("video", "t").agg(F.least(F.lit(1.0), F.max("value") / 200.0).alias("score"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as accidents and near misses of a curve in seconds."""
    ev = events(spark, sf_dir).where("event_type = 'purchase'")
    return ev.select("video", F.when(F.col("k") < 30, "accident").otherwise("near_miss").alias("label"), F.col("t").alias("start_s"), (F.col("t") + F.col("value") * 5.0).alias("end_s"))


MATCHED = SEGMENTS + """, g AS (SELECT video, label, start_s, end_s, row_number() OVER (PARTITION BY video, label ORDER BY start_s, end_s) - 1 AS i FROM merged WHERE event_type = 'purchase'),
 p AS (SELECT video, label, start_s, end_s, row_number() OVER (PARTITION BY video, label ORDER BY start_s, end_s) - 1 AS j FROM merged WHERE event_type = 'view'),
 thr AS (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS thr),
 raw AS (SELECT g.video, g.label, i, j, least(g.end_s, p.end_s) - greatest(g.start_s, p.start_s) AS o, (g.end_s - g.start_s) + (p.end_s - p.start_s) AS s
   FROM g JOIN p ON g.video = p.video AND g.label = p.label AND g.start_s < p.end_s AND p.start_s < g.end_s),
 pairs AS (SELECT video, label, thr, i, j, o / (s - o) AS iou, row_number() OVER (PARTITION BY video, label, thr ORDER BY o / (s - o) DESC, i DESC, j DESC) AS rn FROM raw, thr WHERE o / (s - o) >= thr),
 fold AS (SELECT video, label, thr, 0::BIGINT AS rn, []::BIGINT[] AS gs, []::BIGINT[] AS ps FROM (SELECT DISTINCT video, label, thr FROM pairs)
   UNION ALL SELECT f.video, f.label, f.thr, q.rn,
     CASE WHEN list_contains(f.gs, q.i) OR list_contains(f.ps, q.j) THEN f.gs ELSE list_append(f.gs, q.i) END,
     CASE WHEN list_contains(f.gs, q.i) OR list_contains(f.ps, q.j) THEN f.ps ELSE list_append(f.ps, q.j) END
   FROM fold f JOIN pairs q ON f.video = q.video AND f.label = q.label AND f.thr = q.thr AND q.rn = f.rn + 1),
 tps AS (SELECT video, label, thr, max(len(gs)) AS tp FROM fold GROUP BY ALL),
 sizes AS (SELECT video, label, thr, count(*) FILTER (event_type = 'purchase') AS n_gt, count(*) FILTER (event_type = 'view') AS n_pred FROM merged, thr GROUP BY ALL),
 counts AS (SELECT video, label, thr, coalesce(tp, 0) AS tp, n_pred - coalesce(tp, 0) AS fp, n_gt - coalesce(tp, 0) AS fn FROM sizes LEFT JOIN tps USING (video, label, thr))"""
MATCHED = MATCHED.replace("WITH ev", "WITH RECURSIVE ev", 1)

POOL = """ SELECT {keys} thr, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
 round(CASE WHEN sum(tp) + sum(fp) = 0 THEN 0 ELSE sum(tp) / (sum(tp) + sum(fp)) END, 6) AS precision, round(CASE WHEN sum(tp) + sum(fn) = 0 THEN 0 ELSE sum(tp) / (sum(tp) + sum(fn)) END, 6) AS recall,
 round(CASE WHEN sum(tp) = 0 THEN 0 ELSE 2 * (sum(tp) / (sum(tp) + sum(fp))) * (sum(tp) / (sum(tp) + sum(fn))) / ((sum(tp) / (sum(tp) + sum(fp))) + (sum(tp) / (sum(tp) + sum(fn)))) END, 6) AS f1 FROM counts GROUP BY {keys} thr"""


def _pooled(counts: DataFrame, keys: list[str]) -> DataFrame:
    out = metrics.pooled(counts, keys)
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@catalog.add(SEGMENTS + " SELECT event_type, video, label, start_s, end_s, n FROM merged")
def merge_intervals(spark, sf_dir):
    """W7."""
    out = [iv.coalesce_intervals(segments(spark, sf_dir, k), ["video", "label"]).withColumn("event_type", F.lit(k)) for k in ("purchase", "view")]
    return out[0].unionByName(out[1]).select("event_type", "video", "label", "start_s", "end_s", "n")


@catalog.add(EV + """, s AS (SELECT DISTINCT user_id, t FROM ev WHERE event_type <> 'error'), b AS (SELECT *, CASE WHEN t - lag(t) OVER w > 7200 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
 n AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY t) AS island FROM b), g AS (SELECT user_id, min(t) AS start_s, least(max(t) + 600.0, 2592000.0) AS end_s, count(*) AS n FROM n GROUP BY user_id, island)
 SELECT user_id, start_s, end_s, n FROM g WHERE end_s - start_s >= 900.0""")
def sample_sessions(spark, sf_dir):
    """Positive samples to segments."""
    ev = events(spark, sf_dir).where("event_type <> 'error'")
    return iv.sessions(ev, ["user_id"], "t", 7200.0, 600.0, 900.0, 2592000.0)


@catalog.add(EV + """, b AS (SELECT *, CASE WHEN t - lag(t) OVER w > 7200 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
 n AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY t, event_id) AS island FROM b)
 SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM n GROUP BY user_id, island""")
def session_window(spark, sf_dir):
    """W6 by Spark's own session window."""
    from trackloom.plans.common import read

    ev = read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return ev.groupBy("user_id", F.session_window("at", "2 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).drop("w")


@catalog.add(SEGMENTS + """, w AS (SELECT *, lag(end_s) OVER (PARTITION BY event_type, video, label ORDER BY start_s, end_s) AS previous_end FROM seg WHERE event_type = 'view')
 SELECT video, label, start_s, end_s, previous_end FROM w WHERE start_s < previous_end""")
def interval_overlaps(spark, sf_dir):
    """P2d, V5."""
    return iv.adjacent_overlaps(segments(spark, sf_dir, "view"), ["video", "label"])


@catalog.add(SEGMENTS.replace("WITH ev", "WITH RECURSIVE ev", 1) + """, o AS (SELECT video, label, start_s, end_s, row_number() OVER (PARTITION BY video, label ORDER BY start_s, end_s) AS rn FROM seg WHERE event_type = 'view'),
 f AS (SELECT video, label, start_s, end_s, rn, true AS kept, end_s AS last_end FROM o WHERE rn = 1 UNION ALL
   SELECT o.video, o.label, o.start_s, o.end_s, o.rn, o.start_s >= f.last_end, CASE WHEN o.start_s >= f.last_end THEN o.end_s ELSE f.last_end END FROM f JOIN o ON o.video = f.video AND o.label = f.label AND o.rn = f.rn + 1)
 SELECT video, label, start_s, end_s FROM f WHERE kept""")
def clean_events(spark, sf_dir):
    """P3, F3."""
    return iv.drop_overlaps(segments(spark, sf_dir, "view"), ["video", "label"])


@catalog.add(MATCHED + " SELECT video, label, thr, tp, fp, fn FROM counts")
def match_segments(spark, sf_dir):
    """J1, J3, F1."""
    return metrics.match_counts(merged(spark, sf_dir, "purchase"), merged(spark, sf_dir, "view"), ["video", "label"])


@catalog.add(MATCHED + POOL.format(keys="label,"))
def score_by_class(spark, sf_dir):
    """A1, A2."""
    return _pooled(match_segments(spark, sf_dir), ["label"])


@catalog.add(MATCHED + POOL.format(keys=""))
def score_micro(spark, sf_dir):
    """A1, pooled over classes."""
    return _pooled(match_segments(spark, sf_dir), [])


AGNOSTIC = MATCHED.replace("'c' || CAST(k % 3 AS VARCHAR) AS label", "'any' AS label")


@catalog.add(AGNOSTIC + POOL.format(keys=""))
def score_class_agnostic(spark, sf_dir):
    """Segments merged and matched whatever their class."""
    sides = [iv.coalesce_intervals(segments(spark, sf_dir, k), ["video"]) for k in ("purchase", "view")]
    return _pooled(metrics.match_counts(*sides, ["video"]), [])


@catalog.add(MATCHED + ", q AS (" + POOL.format(keys="label,").replace(", 6) AS", ", 16) AS") + """)
 SELECT label, round(avg(f1), 6) AS f1_mean, (SELECT round(avg(m), 6) FROM (SELECT avg(f1) AS m FROM q GROUP BY label)) AS score_a FROM q GROUP BY label""")
def score_report(spark, sf_dir):
    """A3: mean F1 by class and their macro average."""
    per_class = metrics.class_scores(metrics.pooled(match_segments(spark, sf_dir), ["label"]))
    total = per_class.agg(r6(F.avg("f1_mean")).alias("score_a"))
    return per_class.select("label", r6("f1_mean").alias("f1_mean")).crossJoin(F.broadcast(total))


@catalog.add(MATCHED + """ SELECT video, max(CASE WHEN label = 'c0' THEN tp || '/' || fp || '/' || fn END) AS c0, max(CASE WHEN label = 'c1' THEN tp || '/' || fp || '/' || fn END) AS c1,
 max(CASE WHEN label = 'c2' THEN tp || '/' || fp || '/' || fn END) AS c2 FROM counts WHERE thr = 0.5 GROUP BY video""")
def score_per_video(spark, sf_dir):
    """A8."""
    return metrics.per_video(match_segments(spark, sf_dir), ["c0", "c1", "c2"])


TRUTH = EV + """, gt AS (SELECT video, CASE WHEN k < 30 THEN 'accident' ELSE 'near_miss' END AS label, t AS start_s, t + value * 5.0 AS end_s FROM ev WHERE event_type = 'purchase'),
 risk AS (SELECT video, t, least(1.0, max(value) / 200.0) AS score FROM ev WHERE event_type IN ('click', 'error') GROUP BY video, t),
 lab AS (SELECT r.video, r.t, r.score, CASE WHEN EXISTS (SELECT 1 FROM gt WHERE gt.video = r.video AND label = 'accident' AND r.t >= start_s AND r.t <= end_s) THEN NULL
   WHEN EXISTS (SELECT 1 FROM gt WHERE gt.video = r.video AND label = 'accident' AND r.t >= start_s - 1800.0 AND r.t < start_s) THEN 1
   WHEN EXISTS (SELECT 1 FROM gt WHERE gt.video = r.video AND label = 'near_miss' AND r.t >= start_s - 1800.0 AND r.t <= end_s) THEN NULL ELSE 0 END AS label FROM risk r)"""


@catalog.add(TRUTH + " SELECT video, t, score, label FROM lab")
def frame_labels(spark, sf_dir):
    """Tri-state labels of samples, by a range join."""
    return metrics.sample_labels(risk_curve(spark, sf_dir), truth(spark, sf_dir), horizon=1800.0)


@catalog.add(TRUTH + """, s AS (SELECT score, sum(label) AS pos, count(*) AS n FROM lab WHERE label IS NOT NULL GROUP BY score),
 c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn, sum(pos) OVER () AS ap, sum(n) OVER () AS an FROM s),
 z AS (SELECT sum((pos / ap) * (cp / cn)) AS ap_raw, max(ap) / max(an) AS rate FROM c)
 SELECT round(ap_raw, 6) AS ap_raw, round(rate, 6) AS positive_rate, round(greatest(0, (ap_raw - rate) / (1 - rate)), 6) AS ap FROM z""")
def average_precision(spark, sf_dir):
    """A4, A5."""
    return metrics.average_precision(frame_labels(spark, sf_dir)).select(r6("ap_raw").alias("ap_raw"), r6("positive_rate").alias("positive_rate"), r6("ap").alias("ap"))


ALARMS = TRUTH.replace("WITH ev", "WITH RECURSIVE ev", 1) + """, h AS (SELECT *, score >= 0.5 AS high FROM risk), o AS (SELECT *, CASE WHEN high AND NOT coalesce(lag(high) OVER (PARTITION BY video ORDER BY t), false) THEN 1 ELSE 0 END AS opens FROM h),
 rn AS (SELECT *, sum(opens) OVER (PARTITION BY video ORDER BY t) AS run FROM o), runs AS (SELECT video, min(t) AS s, max(t) AS e FROM rn WHERE high GROUP BY video, run),
 fl AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY video ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 900.0 THEN 0 ELSE 1 END AS opens FROM runs),
 nb AS (SELECT *, sum(opens) OVER (PARTITION BY video ORDER BY s, e) AS g FROM fl), al AS (SELECT video, min(s) AS start_s, max(e) AS end_s FROM nb GROUP BY video, g)"""


@catalog.add(ALARMS + " SELECT video, start_s, end_s FROM al")
def alarm_runs(spark, sf_dir):
    """W14."""
    return metrics.alarms(risk_curve(spark, sf_dir), 0.5, 900.0)


@catalog.add(ALARMS + """, acc AS (SELECT video, start_s, row_number() OVER (PARTITION BY video ORDER BY start_s) AS rn FROM gt WHERE label = 'accident'),
 av AS (SELECT video, list(start_s ORDER BY start_s) AS l FROM al GROUP BY video),
 fo AS (SELECT a.video, 0::BIGINT AS rn, coalesce(av.l, []::DOUBLE[]) AS l, NULL::DOUBLE AS start_s, NULL::DOUBLE AS mark FROM (SELECT DISTINCT video FROM acc) a LEFT JOIN av USING (video)
  UNION ALL SELECT f.video, a.rn, list_filter(f.l, lambda x: x <> coalesce(list_filter(f.l, lambda y: y >= a.start_s - 3600.0 AND y < a.start_s)[1], -1.0)), a.start_s, list_filter(f.l, lambda y: y >= a.start_s - 3600.0 AND y < a.start_s)[1]
  FROM fo f JOIN acc a ON a.video = f.video AND a.rn = f.rn + 1)
 SELECT video, start_s, mark, coalesce(start_s - mark, 0.0) AS tta FROM fo WHERE rn > 0""")
def alarm_match(spark, sf_dir):
    """J6, F2."""
    starts = alarm_runs(spark, sf_dir).select("video", F.col("start_s").alias("t"))
    return metrics.alarm_matches(truth(spark, sf_dir), starts, 3600.0)


@catalog.add(EV + """, a AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'purchase' AND value > 40), b AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'signup' AND value > 40)
 SELECT user_id AS video, 'missing' AS kind FROM a WHERE user_id NOT IN (SELECT user_id FROM b) UNION ALL SELECT user_id, 'extra' FROM b WHERE user_id NOT IN (SELECT user_id FROM a)""")
def missing_extra(spark, sf_dir):
    """J2, O7."""
    ev = events(spark, sf_dir).where("value > 40").select("event_type", F.col("user_id").alias("video"))
    return metrics.missing_and_extra(ev.where("event_type = 'purchase'"), ev.where("event_type = 'signup'"))


STATES = """, st AS (SELECT user_id, t, event_type AS state, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS t1 FROM ev WHERE event_type IN ('click', 'error'))"""


@catalog.add(EV + """, l AS (SELECT * FROM ev WHERE event_type = 'purchase'), r AS (SELECT user_id, t, max(event_type) AS state FROM ev WHERE event_type IN ('click', 'error') GROUP BY user_id, t)
 SELECT l.event_id, l.user_id, l.t, r.t AS right_t, r.state FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.t""")
def asof_state(spark, sf_dir):
    """Union and one window."""
    ev = events(spark, sf_dir)
    left = ev.where("event_type = 'purchase'").select("user_id", "t", "event_id")
    right = ev.where("event_type in ('click', 'error')").select("user_id", "t", F.col("event_type").alias("state"))
    return iv.asof(left, right, ["user_id"], "t", ["state"])


@catalog.add(EV + STATES + """ SELECT l.event_id, l.user_id, l.t, s.state, s.t AS start_t FROM ev l JOIN st s ON l.user_id = s.user_id AND l.t >= s.t AND l.t < coalesce(s.t1, 2592000.0) WHERE l.event_type = 'purchase'""")
def interval_lookup(spark, sf_dir):
    """Half-open range join with time buckets."""
    ev = events(spark, sf_dir)
    w = ordered(["user_id"], "t", "event_id")
    st = ev.where("event_type in ('click', 'error')").select("user_id", F.col("t").alias("start_t"), F.col("event_type").alias("state"), F.coalesce(F.lead("t").over(w), F.lit(2592000.0)).alias("end_t"))
    out = iv.interval_lookup(ev.where("event_type = 'purchase'").select("event_id", "user_id", "t"), st, ["user_id"], "t", "start_t", "end_t", 86400.0)
    return out.select("event_id", "user_id", "t", "state", "start_t")


@catalog.add(EV + STATES + """, h AS (SELECT DISTINCT user_id, floor(t / 21600.0) * 21600.0 AS start_s, floor(t / 21600.0) * 21600.0 + 21600.0 AS end_s FROM ev),
 o AS (SELECT h.user_id, h.start_s, h.end_s, s.state, least(h.end_s, coalesce(s.t1, 2592000.0)) - greatest(h.start_s, s.t) AS sh, row_number() OVER (PARTITION BY h.user_id, h.start_s ORDER BY least(h.end_s, coalesce(s.t1, 2592000.0)) - greatest(h.start_s, s.t) DESC, s.t) AS rn
   FROM h JOIN st s ON s.user_id = h.user_id AND h.start_s < coalesce(s.t1, 2592000.0) AND s.t < h.end_s)
 SELECT h.user_id, h.start_s, h.end_s, coalesce(o.state, 'unknown') AS state, round(coalesce(o.sh, 0.0), 6) AS shared FROM h LEFT JOIN o ON o.user_id = h.user_id AND o.start_s = h.start_s AND o.rn = 1""")
def argmax_overlap(spark, sf_dir):
    """J17."""
    ev = events(spark, sf_dir)
    w = ordered(["user_id"], "t", "event_id")
    st = ev.where("event_type in ('click', 'error')").select("user_id", F.col("t").alias("start_s"), F.coalesce(F.lead("t").over(w), F.lit(2592000.0)).alias("end_s"), F.col("event_type").alias("state"))
    low = F.floor(F.col("t") / 21600.0) * 21600.0
    spans = ev.select("user_id", low.alias("start_s"), (low + 21600.0).alias("end_s")).distinct()
    return iv.largest_overlap(spans, st, ["user_id"], "state", "unknown", 21600.0).withColumn("shared", r6("shared"))


@catalog.add(EV + """, l AS (SELECT * FROM ev WHERE event_type = 'purchase'), r AS (SELECT DISTINCT user_id, t FROM ev WHERE event_type = 'signup'),
 z AS (SELECT l.event_id, l.user_id, l.t, r.t AS n, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.t - l.t), r.t) AS rn FROM l LEFT JOIN r ON l.user_id = r.user_id)
 SELECT event_id, user_id, t, CASE WHEN abs(n - t) <= 36000.0 THEN n END AS nearest_t FROM z WHERE rn = 1""")
def nearest_event(spark, sf_dir):
    """J19, J20, J21, J30."""
    ev = events(spark, sf_dir)
    return iv.nearest(ev.where("event_type = 'purchase'").select("event_id", "user_id", "t"), ev.where("event_type = 'signup'").select("user_id", "t"), ["user_id"], "t", 36000.0)


@catalog.add(EV + STATES + """, x AS (SELECT user_id, t, CASE WHEN mod(CAST(floor(t) AS BIGINT), 10) = 0 THEN coalesce(t1, 2592000.0) - 1.0 ELSE coalesce(t1, 2592000.0) END AS e FROM st), y AS (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY t) AS expected FROM x)
 SELECT user_id, t AS start_t, expected FROM y WHERE expected IS NOT NULL AND t <> expected""")
def tiling_violations(spark, sf_dir):
    """P20: intervals with planted gaps."""
    ev = events(spark, sf_dir).where("event_type in ('click', 'error')")
    end = F.coalesce(F.lead("t").over(ordered(["user_id"], "t", "event_id")), F.lit(2592000.0))
    rows = ev.withColumn("e", F.when(F.floor("t") % 10 == 0, end - 1.0).otherwise(end)).select("user_id", F.col("t").alias("start_t"), "e")
    return iv.tiling_violations(rows, ["user_id"], "start_t", "e").select("user_id", "start_t", "expected")
