"""Queries of report tables and of joins, projections and orders that the other plans do not hold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import geometry, scalars
from trackloom.operators import checks, metrics, reports, rules, scene, signal, tracks
from trackloom.operators import intervals as iv
from trackloom.operators import windows as win
from trackloom.plans.common import EV, Catalog, events, r6, read
from trackloom.plans.interval_queries import ALARMS, STATES
from trackloom.plans.scene_queries import SM, TL, samples, timeline
from trackloom.plans.track_queries import BOX, PT, VEL, ZONES, W, boxes, moving, points
from trackloom.streaming import risk

catalog = Catalog()
ORDER = ("t", "event_id")


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- the whole score

SCORE = ALARMS.replace("epoch_us(ts) / 1e6 - 1704067200.0", "(epoch_us(ts) / 1e6 - 1704067200.0) / 600.0").replace("value * 5.0", "value * 0.05").replace("1800.0", "5.0").replace("< 900.0 THEN 0", "< 2.0 THEN 0") + """, gs AS (SELECT video, label, start_s, end_s, row_number() OVER (PARTITION BY video, label ORDER BY start_s, end_s) - 1 AS i FROM gt),
 ps AS (SELECT video, label, start_s, end_s, row_number() OVER (PARTITION BY video, label ORDER BY start_s, end_s) - 1 AS j FROM (SELECT video, CASE WHEN k < 35 THEN 'accident' ELSE 'near_miss' END AS label, t + k % 7 * value * 0.005 AS start_s, t + value * 0.05 AS end_s FROM ev WHERE event_type = 'purchase' AND k % 4 <> 0)),
 raw AS (SELECT g.video, g.label, i, j, least(g.end_s, p.end_s) - greatest(g.start_s, p.start_s) AS o, (g.end_s - g.start_s) + (p.end_s - p.start_s) AS s FROM gs g JOIN ps p ON g.video = p.video AND g.label = p.label AND g.start_s < p.end_s AND p.start_s < g.end_s),
 pairs AS (SELECT video, label, thr, i, j, row_number() OVER (PARTITION BY video, label, thr ORDER BY o / (s - o) DESC, i DESC, j DESC) AS rn FROM raw, (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS thr) WHERE o / (s - o) >= thr),
 fold AS (SELECT video, label, thr, 0::BIGINT AS rn, []::BIGINT[] AS gl, []::BIGINT[] AS pl FROM (SELECT DISTINCT video, label, thr FROM pairs)
   UNION ALL SELECT f.video, f.label, f.thr, q.rn, CASE WHEN list_contains(f.gl, q.i) OR list_contains(f.pl, q.j) THEN f.gl ELSE list_append(f.gl, q.i) END, CASE WHEN list_contains(f.gl, q.i) OR list_contains(f.pl, q.j) THEN f.pl ELSE list_append(f.pl, q.j) END
   FROM fold f JOIN pairs q ON f.video = q.video AND f.label = q.label AND f.thr = q.thr AND q.rn = f.rn + 1),
 tps AS (SELECT label, thr, sum(m) AS tp FROM (SELECT video, label, thr, max(len(gl)) AS m FROM fold GROUP BY ALL) GROUP BY ALL),
 sz AS (SELECT label, thr, (SELECT count(*) FROM gs WHERE gs.label = l.label) AS ng, (SELECT count(*) FROM ps WHERE ps.label = l.label) AS np FROM (SELECT DISTINCT label FROM gs UNION SELECT DISTINCT label FROM ps) l, (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS thr)),
 pa AS (SELECT avg(f) AS score_a FROM (SELECT label, avg(2 * coalesce(tp, 0) / (ng + np)) AS f FROM sz LEFT JOIN tps USING (label, thr) GROUP BY label)),
 st AS (SELECT score, sum(label) AS pos, count(*) AS n FROM lab WHERE label IS NOT NULL GROUP BY score),
 cu AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn, sum(pos) OVER () AS ap, sum(n) OVER () AS an FROM st),
 ap AS (SELECT greatest(0, (coalesce(sum((pos / nullif(ap, 0)) * (cp / cn)), 0) - max(ap) / max(an)) / (1 - max(ap) / max(an))) AS ap FROM cu),
 ok AS (SELECT al.video, al.start_s AS t FROM al JOIN lab ON lab.video = al.video AND lab.t = al.start_s WHERE lab.label IS NOT NULL),
 acc AS (SELECT video, start_s, row_number() OVER (PARTITION BY video ORDER BY start_s) AS rn FROM gt WHERE label = 'accident'), av AS (SELECT video, list(t ORDER BY t) AS l FROM ok GROUP BY video),
 fo AS (SELECT a.video, 0::BIGINT AS rn, coalesce(av.l, []::DOUBLE[]) AS l, NULL::DOUBLE AS start_s, NULL::DOUBLE AS mark FROM (SELECT DISTINCT video FROM acc) a LEFT JOIN av USING (video)
  UNION ALL SELECT f.video, a.rn, list_filter(f.l, lambda x: x <> coalesce(list_filter(f.l, lambda y: y >= a.start_s - 10.0 AND y < a.start_s)[1], -1.0)), a.start_s, list_filter(f.l, lambda y: y >= a.start_s - 10.0 AND y < a.start_s)[1] FROM fo f JOIN acc a ON a.video = f.video AND a.rn = f.rn + 1),
 nm AS (SELECT count(*) AS na, count(mark) AS nm, sum(coalesce(start_s - mark, 0.0)) AS tta, (SELECT count(*) FROM ok) AS nal FROM fo WHERE rn > 0),
 pb AS (SELECT 0.4 * ap + 0.4 * CASE WHEN nm = 0 THEN 0 ELSE 2 * nm / (nal + na) END + 0.2 * least(1.0, tta / na / 10.0) AS score_b FROM ap, nm)"""


@catalog.add(SCORE + " SELECT round(score_a, 6) AS score_a, round(score_b, 6) AS score_b, round(0.7 * score_a + 0.3 * score_b, 6) AS model_score FROM pa, pb")
def model_score(spark, sf_dir):
    """Both parts and their weighted sum."""
    ev = events(spark, sf_dir).withColumn("t", F.col("t") / 600.0)
    end, kind = F.col("t") + F.col("value") * 0.05, lambda k: F.when(F.col("k") < k, "accident").otherwise("near_miss").alias("label")
    own = ev.where("event_type = 'purchase'")
    gt = own.select("video", kind(30), F.col("t").alias("start_s"), end.alias("end_s"))
    pred = own.where("k % 4 <> 0").select("video", kind(35), (F.col("t") + F.col("k") % 7 * F.col("value") * 0.005).alias("start_s"), end.alias("end_s"))
    curve = ev.where("event_type in ('click', 'error')").groupBy("video", "t").agg(F.least(F.lit(1.0), F.max("value") / 200.0).alias("score"))
    return _rounded(metrics.model_score(gt, pred, curve), "score_a", "score_b", "model_score")


# ---- flows

FLOWS = PT + VEL + f""", r AS (SELECT *, row_number() OVER {W} AS a, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS z FROM sp),
 tt AS (SELECT user_id, user_id % 7 * user_id % 5 AS flow, 'v' || user_id % 3 AS kind, avg(x) FILTER (a <= 3) AS x0, avg(y) FILTER (a <= 3) AS y0, avg(x) FILTER (z <= 3) AS x1, avg(y) FILTER (z <= 3) AS y1, median(speed) FILTER (speed > 2.0) AS sp FROM r GROUP BY user_id),
 b AS (SELECT *, speed <= 2.0 AS still FROM sp), o AS (SELECT *, CASE WHEN still IS DISTINCT FROM lag(still) OVER {W} THEN 1 ELSE 0 END AS ch FROM b), q AS (SELECT *, sum(ch) OVER {W} AS run FROM o),
 stp AS (SELECT user_id, median(x) AS x, median(y) AS y, max(t) - min(t) AS dur FROM q WHERE still GROUP BY user_id, run HAVING max(t) - min(t) >= 600.0)"""


def flow_tracks(spark, sf_dir):
    rows = tracks.summaries(moving(spark, sf_dir), ["user_id"], ORDER, 2.0)
    return rows.withColumns({"flow": F.col("user_id") % 7 * F.col("user_id") % 5, "kind": F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string"))})


def stops(spark, sf_dir):
    return tracks.stop_runs(moving(spark, sf_dir), ["user_id"], "speed", 2.0, 600.0, ORDER)


def _ninth(x, y):
    col = f"CASE least(2, floor(3 * {x} / 300)) WHEN 0 THEN 'left' WHEN 1 THEN 'centre' ELSE 'right' END"
    row = f"CASE least(2, floor(3 * {y} / 100)) WHEN 0 THEN 'top' WHEN 1 THEN 'middle' ELSE 'bottom' END"
    return f"CASE WHEN {row} = 'middle' AND {col} = 'centre' THEN 'centre' ELSE {row} || '-' || {col} END"


@catalog.add(FLOWS + f""", f AS (SELECT flow, count(*) AS n, median(x0) AS x0, median(y0) AS y0, median(x1) AS x1, median(y1) AS y1, median(sp) AS speed, row_number() OVER (ORDER BY count(*) DESC, flow) AS rk FROM tt GROUP BY flow),
 m AS (SELECT flow, string_agg(kind || ':' || k, ',' ORDER BY kind || ':' || k) AS classes FROM (SELECT flow, kind, count(*) AS k FROM tt GROUP BY ALL) GROUP BY flow),
 h AS (SELECT flow, count(DISTINCT user_id) AS st, count(*) AS stops, median(dur) AS ms FROM stp JOIN tt USING (user_id) GROUP BY flow),
 g AS (SELECT *, {_ninth('x0', 'y0')} AS ra, {_ninth('x1', 'y1')} AS rb, x1 - x0 AS dx, y1 - y0 AS dy, degrees(atan2(y1 - y0, x1 - x0)) AS ang FROM f)
 SELECT g.flow, n, 'F' || rk || CASE WHEN ra = rb THEN ' within ' || ra ELSE ' ' || ra || ' to ' || rb END AS name, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(speed, 6) AS speed, classes, coalesce(stops, 0) AS stops, round(ms, 6) AS median_stop,
  concat_ws(', ', CASE WHEN abs(dy) > 0.35 * sqrt(dx * dx + dy * dy) THEN CASE WHEN dy > 0 THEN 'towards camera' ELSE 'away from camera' END END, CASE WHEN abs(dx) > 0.35 * sqrt(dx * dx + dy * dy) THEN CASE WHEN dx > 0 THEN 'left to right' ELSE 'right to left' END END) AS direction,
  round(CASE WHEN ang < 0 THEN ang + 360 ELSE ang END, 4) AS heading, round(coalesce(st, 0) / n, 6) AS share_stopped FROM g JOIN m USING (flow) LEFT JOIN h USING (flow)""")
def flow_table(spark, sf_dir):
    """A16, W34, G10, J22."""
    out = reports.flow_table(flow_tracks(spark, sf_dir), stops(spark, sf_dir), "flow", "user_id", "kind", 300.0, 100.0)
    return _rounded(out, "x0", "y0", "x1", "y1", "speed", "median_stop", "share_stopped").withColumn("heading", F.round("heading", 4))


@catalog.add(FLOWS + """, f AS (SELECT flow, median(x0) AS x0, median(y0) AS y0, median(x1) AS x1, median(y1) AS y1 FROM tt GROUP BY flow),
 p AS (SELECT flow, stp.x, stp.y, ((stp.x - f.x0) * (f.x1 - f.x0) + (stp.y - f.y0) * (f.y1 - f.y0)) / greatest(sqrt(pow(f.x1 - f.x0, 2) + pow(f.y1 - f.y0, 2)), 1e-6) AS p FROM stp JOIN tt USING (user_id) JOIN f USING (flow)),
 w AS (SELECT *, count(*) OVER (PARTITION BY flow ORDER BY p RANGE BETWEEN 20.0 PRECEDING AND CURRENT ROW) AS c, count(*) OVER (PARTITION BY flow) AS used, row_number() OVER (PARTITION BY flow ORDER BY p DESC, x DESC, y DESC) AS z FROM p),
 k AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY p DESC, x DESC, y DESC) AS rn FROM w WHERE c >= 3) SELECT flow, round(x, 6) AS x, round(y, 6) AS y, used FROM k WHERE rn = 1""")
def furthest_queue(spark, sf_dir):
    """W30, J23."""
    own = flow_tracks(spark, sf_dir)
    ends = own.groupBy("flow").agg(*(F.median(c).alias(c) for c in ("x0", "y0", "x1", "y1")))
    held = stops(spark, sf_dir).join(own.select("user_id", "flow"), "user_id").select("flow", "x", "y")
    return _rounded(reports.furthest_queue(held, ends, "flow", 20.0, 3), "x", "y")


@catalog.add(FLOWS + " SELECT user_id, flow, round(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)), 6) AS disp FROM tt WHERE sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) >= 30 AND x0 >= 10 AND x0 <= 290 AND user_id IN (SELECT user_id FROM stp)")
def eligible_tracks(spark, sf_dir):
    """Filters on summaries, and members by semi-join."""
    rows = flow_tracks(spark, sf_dir).where("disp >= 30 and x0 between 10 and 290")
    return rows.join(stops(spark, sf_dir).select("user_id"), "user_id", "left_semi").select("user_id", "flow", r6("disp").alias("disp"))


# ---- light, sizes, blocks, detectors


@catalog.add(SM + """, b AS (SELECT video, frame // 60 AS hour, avg(value) AS luma, quantile_cont(value, 0.95) AS p95 FROM sm GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY hour) AS u, row_number() OVER (PARTITION BY video ORDER BY hour DESC) AS d FROM b),
 g AS (SELECT video, avg(luma) FILTER (u <= 10) AS f, avg(luma) FILTER (d <= 10) AS l, min(luma) AS lo, max(luma) AS hi, median(p95) AS m FROM r GROUP BY video)
 SELECT video, round(f, 6) AS first, round(l, 6) AS last, round(lo, 6) AS least, round(hi, 6) AS greatest, round(m, 6) AS median_high, round(100.0 * (l - f) / f, 5) AS change_pct FROM g""")
def lighting(spark, sf_dir):
    """Luma by bin, then its ends."""
    rows = samples(spark, sf_dir).groupBy("video", F.floor(F.col("frame") / 60).alias("hour")).agg(F.avg("value").alias("luma"), F.percentile("value", F.lit(0.95)).alias("p95"))
    out = reports.lighting(rows, ["video"], "hour", "luma", "p95")
    return _rounded(out, "first", "last", "least", "greatest", "median_high").withColumn("change_pct", F.round("change_pct", 5))


@catalog.add(BOX + " SELECT event_type, count(*) AS n, round(median(y2 - y1), 6) AS median, round(quantile_cont(y2 - y1, 0.1), 6) AS p10, round(avg(CASE WHEN y2 - y1 < 20 THEN 1.0 ELSE 0.0 END), 6) AS below_20, round(avg(CASE WHEN y2 - y1 < 60 THEN 1.0 ELSE 0.0 END), 6) AS below_60 FROM bx GROUP BY 1")
def size_stats(spark, sf_dir):
    """A21."""
    out = reports.size_stats(tracks.ground_points(boxes(spark, sf_dir)), ["event_type"], "h", [20, 60])
    return _rounded(out, "median", "p10", "below_20", "below_60")


@catalog.add(PT + " SELECT CAST(least(floor(x * 6 / 300), 5) AS INT) AS i, CAST(least(floor(y * 4 / 100), 3) AS INT) AS j, count(DISTINCT user_id) AS tracks, round(median(x), 6) AS x, median(y) AS y FROM pt WHERE x > 40 GROUP BY 1, 2")
def outside_blocks(spark, sf_dir):
    """A24, O3."""
    return reports.blocks(points(spark, sf_dir).where("x > 40"), "x", "y", "user_id", 300.0, 100.0).withColumn("x", r6("x"))


DETECT = BOX + """, dd AS (SELECT *, event_id % 2 AS side FROM bx), su AS (SELECT event_type, side, count(*)::DOUBLE AS n, count(DISTINCT frame)::DOUBLE AS frames, median(y2 - y1) AS h, avg(x2 - x1) AS w FROM dd GROUP BY ALL),
 lo AS (SELECT event_type, side, unnest(['n', 'frames', 'h', 'w']) AS measure, unnest([n, frames, h, w]) AS v FROM su)"""


@catalog.add(DETECT + " SELECT event_type, measure, round(max(v) FILTER (side = 0), 6) AS a, round(max(v) FILTER (side = 1), 6) AS b, round(max(v) FILTER (side = 1) / max(v) FILTER (side = 0), 6) AS ratio FROM lo GROUP BY ALL")
def detectors_compared(spark, sf_dir):
    """A26."""
    rows = tracks.ground_points(boxes(spark, sf_dir))
    side = lambda k: rows.where(F.col("event_id") % 2 == k).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("frame").alias("frames"), F.median("h").alias("h"), F.avg(F.col("x2") - F.col("x1")).alias("w"))
    return _rounded(reports.compared(side(0), side(1), ["event_type"], ["n", "frames", "h", "w"]), "a", "b", "ratio")


@catalog.add(PT + """, g AS (SELECT video, CAST(least(floor(x * 4 / 300), 3) AS INT) AS i, CAST(least(floor(y * 4 / 100), 3) AS INT) AS j, count(*) AS c FROM pt GROUP BY ALL), s AS (SELECT video, count(*) FILTER (c >= 300) / 16 AS spread FROM g GROUP BY video)
 SELECT video, count(*) AS n, round(median(abs(x - y)), 6) AS median, round(quantile_cont(abs(x - y), 0.9), 6) AS p90, any_value(spread) AS spread FROM pt JOIN s USING (video) GROUP BY video""")
def residual_stats(spark, sf_dir):
    """A42."""
    rows = points(spark, sf_dir).withColumn("e", F.abs(F.col("x") - F.col("y")))
    return _rounded(reports.residuals(rows, ["video"], "e", "x", "y", 300.0, 100.0, least=300), "median", "p90")


@catalog.add(PT + ", l AS (SELECT user_id, t, max(abs(x - y)) OVER (PARTITION BY user_id ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM pt) SELECT user_id, min(t) AS t FROM l WHERE w < 60 GROUP BY user_id")
def settling(spark, sf_dir):
    """A44."""
    rows = points(spark, sf_dir).withColumn("d", F.abs(F.col("x") - F.col("y")))
    return reports.settled(rows, ["user_id"], "t", "d", 60.0)


@catalog.add("SELECT c_custkey, c_custkey % 50 >= 30 AND c_custkey % 100 / 100.0 >= 0.25 AND abs(c_acctbal) / 500.0 <= 10 AND c_acctbal > -900 AS good FROM customer")
def registration_gate(spark, sf_dir):
    """Inliers, spread, residuals and a finite matrix."""
    c = read(spark, sf_dir, "customer")
    matrix = F.array(F.lit(1.0), F.when(F.col("c_acctbal") > -900, F.col("c_acctbal").cast("double")).otherwise(F.lit(float("nan"))))
    return c.select("c_custkey", checks.good_registration(F.col("c_custkey") % 50, F.col("c_custkey") % 100 / 100.0, F.abs("c_acctbal") / 500.0, matrix).alias("good"))


# ---- states, phases


@catalog.add(TL + """, cr AS (SELECT video, (floor(t / 60.0))::BIGINT AS f FROM ev WHERE event_type = 'click'), st AS (SELECT cr.video, tl.state, count(*) AS k FROM cr JOIN tl ON tl.video = cr.video AND cr.f >= tl.start_frame AND cr.f < tl.end_frame GROUP BY ALL),
 p AS (SELECT video, state, k / sum(k) OVER (PARTITION BY video) AS crossings FROM st), q AS (SELECT video, state, sum(end_frame - start_frame) / 43200.0 AS time FROM tl GROUP BY ALL)
 SELECT coalesce(p.video, q.video) AS video, coalesce(p.state, q.state) AS state, round(coalesce(crossings, 0), 6) AS crossings, round(coalesce(time, 0), 6) AS time FROM p FULL JOIN q ON p.video = q.video AND p.state = q.state""")
def crossing_states(spark, sf_dir):
    """Share of crossings by state beside the state's share of time."""
    tl = timeline(spark, sf_dir).withColumns({"a": F.col("start_frame").cast("double"), "b": F.col("end_frame").cast("double")})
    ev = events(spark, sf_dir).where("event_type = 'click'").select("video", "event_id", F.floor(F.col("t") / 60.0).cast("double").alias("f"))
    hit = iv.interval_lookup(ev, tl.select("video", "state", "a", "b"), ["video"], "f", "a", "b", 720.0)
    spans = tl.select("video", "state", (F.col("end_frame") - F.col("start_frame")).alias("span"))
    return _rounded(reports.state_shares(hit.select("video", "state"), spans, ["video"], 43200.0), "crossings", "time")


@catalog.add(EV + """, c AS (SELECT range AS i FROM range(-1, 721)), x AS (SELECT b.range AS bin, sum(greatest(0, least(100.0 + i * 3600.0 + (b.range + 1) * 300.0, 2591000.0) - greatest(100.0 + i * 3600.0 + b.range * 300.0, 0.0))) AS seconds FROM c, range(12) b GROUP BY 1),
 h AS (SELECT CAST(least(floor(((t - 100.0) - 3600.0 * floor((t - 100.0) / 3600.0)) / 300.0), 11) AS INT) AS bin, count(*) AS n FROM ev WHERE event_type = 'view' AND t < 2591000.0 GROUP BY 1) SELECT h.bin, n, round(seconds, 4) AS seconds, round(n / seconds, 8) AS rate FROM h JOIN x USING (bin)""")
def phase_rates(spark, sf_dir):
    """Counts by phase over the time that the clip spends in it."""
    h = signal.phase_histogram(events(spark, sf_dir).where("event_type = 'view' and t < 2591000.0"), "t", 100.0, 3600.0, 12)
    x = reports.exposure(spark, 100.0, 3600.0, 12, 2591000.0)
    return h.join(x, "bin").select("bin", "n", F.round("seconds", 4).alias("seconds"), F.round(F.col("n") / F.col("seconds"), 8).alias("rate"))


DEMOTE = SM + """, f0 AS (SELECT video, frame, state, observation, CASE WHEN state = 'green' THEN 'G' ELSE state END AS fam, row_number() OVER (PARTITION BY video ORDER BY frame) AS pos FROM sm),
 ob AS (SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(fam) OVER w = fam THEN 0 ELSE 1 END AS b FROM f0 WHERE observation = 'observed' WINDOW w AS (PARTITION BY video ORDER BY frame)), rn AS (SELECT *, sum(b) OVER (PARTITION BY video ORDER BY frame) AS r FROM ob),
 rs AS (SELECT video, r, min(pos) AS a, max(pos) AS z, min(fam) AS f, max(pos) - min(pos) + 1 >= 3 AS l FROM rn GROUP BY video, r),
 nb AS (SELECT *, lag(f) OVER w AS pf, lag(z) OVER w AS pz, lag(l) OVER w AS pl, lead(f) OVER w AS nf, lead(a) OVER w AS na, lead(l) OVER w AS nl FROM rs WINDOW w AS (PARTITION BY video ORDER BY r)),
 kp AS (SELECT *, l OR coalesce(pl AND CASE WHEN pf = f THEN (a - pz - 1) * 5 <= 30 ELSE a - pz = 1 AND (pf, f) IN (('G', 'amber'), ('amber', 'red'), ('red', 'red_amber'), ('red_amber', 'G'), ('red', 'G')) END, false)
   OR coalesce(nl AND CASE WHEN nf = f THEN (na - z - 1) * 5 <= 30 ELSE na - z = 1 AND (f, nf) IN (('G', 'amber'), ('amber', 'red'), ('red', 'red_amber'), ('red_amber', 'G'), ('red', 'G')) END, false) AS stays FROM nb)"""


@catalog.add(DEMOTE + " SELECT f0.video, f0.frame, CASE WHEN kp.stays = false THEN 'low_confidence' ELSE f0.observation END AS observation FROM f0 LEFT JOIN rn ON rn.video = f0.video AND rn.frame = f0.frame LEFT JOIN kp ON kp.video = rn.video AND kp.r = rn.r")
def demotion(spark, sf_dir):
    """Short runs without support."""
    rows = samples(spark, sf_dir).select("video", "frame", "state", "observation", F.when(F.col("state") == "green", "G").otherwise(F.col("state")).alias("family"))
    return signal.demoted(rows, ["video"], "family", 3, 5).select("video", "frame", "observation")


FLASH = SM + """, fl AS (SELECT video, frame, CASE WHEN state = 'green' AND value > 60 THEN 'green_flash' ELSE state END AS state, observation, row_number() OVER (PARTITION BY video ORDER BY frame) AS pos FROM sm)"""


@catalog.add(FLASH + """, o AS (SELECT *, CASE WHEN coalesce((pos - lag(pos) OVER w - 1) * 10 > 30, true) THEN 1 ELSE 0 END AS b FROM fl WHERE observation = 'observed' AND state IN ('green', 'green_flash') WINDOW w AS (PARTITION BY video ORDER BY frame)),
 s AS (SELECT *, sum(b) OVER (PARTITION BY video ORDER BY frame) AS st FROM o), e AS (SELECT *, max(pos) OVER (PARTITION BY video, st) AS z FROM s), t AS (SELECT video, st, min(pos) AS a, max(z) AS z FROM e WHERE state = 'green_flash' AND pos > z - 3 GROUP BY video, st)
 SELECT fl.video, fl.frame, CASE WHEN t.a IS NOT NULL AND state IN ('green', 'green_flash') THEN 'green_blink' WHEN state = 'green_flash' THEN 'dark' ELSE state END AS state,
  CASE WHEN state = 'green_flash' AND t.a IS NULL AND observation = 'observed' THEN 'low_confidence' ELSE observation END AS observation FROM fl LEFT JOIN t ON t.video = fl.video AND fl.pos BETWEEN t.a AND t.z""")
def blink_tails(spark, sf_dir):
    """Blinking ends, unexplained flashes."""
    state = F.when((F.col("state") == "green") & (F.col("value") > 60), "green_flash").otherwise(F.col("state"))
    rows = samples(spark, sf_dir).select("video", "frame", state.alias("state"), "observation")
    return signal.blink_tails(rows, ["video"], 3, 10)


RUNS = SM + """, o AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY video ORDER BY frame) THEN 1 ELSE 0 END AS c FROM sm), r AS (SELECT *, sum(c) OVER (PARTITION BY video ORDER BY frame) AS run FROM o),
 rr AS (SELECT video, run, min(frame)::DOUBLE AS s, max(frame)::DOUBLE + 1 AS e, min(state) AS state FROM r GROUP BY video, run)"""


def state_runs(spark, sf_dir):
    rows = iv.value_runs(samples(spark, sf_dir), ["video"], ["frame"], "state")
    return rows.groupBy("video", "run").agg(F.min("frame").cast("double").alias("start"), (F.max("frame") + 1).cast("double").alias("end"), F.min("state").alias("state"))


@catalog.add(RUNS.replace("WITH ev", "WITH RECURSIVE ev", 1) + """, fo AS (SELECT video, run, s, e, state, run AS phase FROM rr WHERE run = 1 UNION ALL SELECT rr.video, rr.run, CASE WHEN rr.e - rr.s < 5 OR rr.state = fo.state THEN fo.s ELSE rr.s END, rr.e,
  CASE WHEN rr.e - rr.s < 5 THEN fo.state ELSE rr.state END, CASE WHEN rr.e - rr.s < 5 OR rr.state = fo.state THEN fo.phase ELSE rr.run END FROM fo JOIN rr ON rr.video = fo.video AND rr.run = fo.run + 1)
 SELECT video, arg_max(state, run) AS state, max(s) AS start, max(e) AS "end", max(e) - max(s) AS duration FROM fo GROUP BY video, phase""")
def absorbed_runs(spark, sf_dir):
    """W17."""
    return signal.absorb_short_runs(state_runs(spark, sf_dir), ["video"], 5.0)


@catalog.add(RUNS + ", q AS (SELECT video, run, CASE state WHEN 'red' THEN 'green_flash' ELSE state END AS state FROM rr) SELECT video, run::BIGINT AS run, CASE WHEN state = 'green_flash' AND lag(state) OVER w = 'green' AND lead(state) OVER w = 'green' THEN 'green' ELSE state END AS state FROM q WINDOW w AS (PARTITION BY video ORDER BY run)")
def relabelled_flashes(spark, sf_dir):
    """W18."""
    rows = state_runs(spark, sf_dir).select("video", "run", F.when(F.col("state") == "red", "green_flash").otherwise(F.col("state")).alias("state"))
    return signal.relabel_flashes(rows, ["video"], "run")


@catalog.add(EV.replace("WITH ev", "WITH RECURSIVE ev", 1) + """, v AS (SELECT value AS x FROM ev), it AS (SELECT 0 AS n, quantile_cont(x, 0.3) AS lo, quantile_cont(x, 0.997) AS hi FROM v UNION ALL
  SELECT n + 1, (SELECT avg(x) FROM v WHERE x <= (lo + hi) / 2), (SELECT avg(x) FROM v WHERE x > (lo + hi) / 2) FROM it WHERE n < 20), l AS (SELECT lo, hi FROM it WHERE n = 20),
 s AS (SELECT sqrt((var_pop(x) FILTER (x <= (lo + hi) / 2) + var_pop(x) FILTER (x > (lo + hi) / 2)) / 2) + 1e-6 AS sd FROM v, l) SELECT round(lo, 5) AS low, round(hi, 5) AS high, round((hi - lo) / sd, 5) AS apart FROM l, s""")
def two_means(spark, sf_dir):
    """A34, A35."""
    low, high, apart = signal.two_means(events(spark, sf_dir), "value")
    return spark.createDataFrame([(round(low, 5), round(high, 5), round(apart, 5))], "low double, high double, apart double")


@catalog.add(SM + """, s AS (SELECT video, (frame // 30)::INT AS pos, avg(value) AS x, avg(CASE WHEN state = 'red' THEN 1.0 ELSE 0.0 END) AS y FROM sm GROUP BY ALL), h AS (SELECT unnest([0, 97, 211, 480]) AS shift),
 m AS (SELECT video, shift, (pos + shift) % 1440 AS pos, y FROM s, h) SELECT s.video, shift, round(corr(s.x, m.y), 6) AS r FROM s JOIN m ON m.video = s.video AND m.pos = s.pos GROUP BY ALL""")
def shift_correlations(spark, sf_dir):
    """R6 over series: correlation against circular shifts."""
    rows = samples(spark, sf_dir).groupBy("video", F.floor(F.col("frame") / 30).cast("int").alias("at")).agg(F.avg("value").alias("x"), F.avg(F.when(F.col("state") == "red", 1.0).otherwise(0.0)).alias("y"))
    return reports.shift_correlations(rows, ["video"], "at", "x", "y", 1440, [0, 97, 211, 480]).withColumn("r", r6("r"))


# ---- joins


@catalog.add(EV + STATES + " SELECT event_id FROM ev p WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM st WHERE st.user_id = p.user_id AND state = 'click' AND p.t >= st.t AND p.t < coalesce(st.t1, 2592000.0))")
def stops_in_red(spark, sf_dir):
    """Semi-join by half-open spans."""
    ev = events(spark, sf_dir)
    end = F.coalesce(F.lead("t").over(win.ordered(["user_id"], *ORDER)), F.lit(2592000.0))
    spans = ev.where("event_type in ('click', 'error')").select("user_id", F.col("t").alias("a"), end.alias("b"), "event_type").where("event_type = 'click'").drop("event_type")
    return iv.interval_lookup(ev.where("event_type = 'purchase'").select("user_id", "t", "event_id"), spans, ["user_id"], "t", "a", "b", 86400.0).select("event_id").distinct()


@catalog.add(PT + """, c AS (SELECT CAST(floor(x / 10) AS INT) AS i, CAST(floor(y / 10) AS INT) AS j, count(*) AS n FROM pt GROUP BY 1, 2 HAVING count(*) >= 5) SELECT event_id, c.n IS NOT NULL AS in_cell, coalesce(c.n, 0) AS n FROM pt LEFT JOIN c ON c.i = CAST(floor(x / 10) AS INT) AND c.j = CAST(floor(y / 10) AS INT)""")
def contribution_cells(spark, sf_dir):
    """Samples with the accepted cell that they fall in."""
    rows = points(spark, sf_dir).withColumns({"i": geometry.cell(F.col("x"), 10), "j": geometry.cell(F.col("y"), 10)})
    cells = rows.groupBy("i", "j").agg(F.count("*").alias("n")).where("n >= 5")
    return rows.join(cells, ["i", "j"], "left").select("event_id", F.col("n").isNotNull().alias("in_cell"), F.coalesce("n", F.lit(0)).alias("n"))


@catalog.add(SM + " SELECT v.video, g.range AS frame, coalesce(sm.state, 'unknown') AS state FROM (SELECT DISTINCT video FROM sm) v, range(0, 43200, 7) g LEFT JOIN sm ON sm.video = v.video AND sm.frame = g.range")
def reindexed(spark, sf_dir):
    """A frame list with the states there are, unknown elsewhere."""
    own = samples(spark, sf_dir).select("video", "frame", "state")
    spine = own.select("video").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(43199).cast("long"), F.lit(7).cast("long"))))
    return spine.join(own, ["video", "frame"], "left").na.fill("unknown", ["state"])


@catalog.add(BOX + " SELECT video, frame, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS items, lag(frame) OVER (PARTITION BY video ORDER BY frame) AS previous, lead(frame) OVER (PARTITION BY video ORDER BY frame) AS next FROM bx GROUP BY video, frame")
def items_by_frame(spark, sf_dir):
    """Items of a frame, with links to the frames before and after."""
    w = win.ordered(["video"], "frame")
    rows = boxes(spark, sf_dir).groupBy("video", "frame").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ",").alias("items"))
    return rows.withColumns({"previous": F.lag("frame").over(w), "next": F.lead("frame").over(w)})


@catalog.add(BOX + """, j AS (SELECT p.event_id, v.event_id AS box, greatest(0.0, least(p.x2, v.x2) - greatest(p.x1, v.x1)) * greatest(0.0, least(p.y2, v.y2) - greatest(p.y1, v.y1)) / ((p.x2 - p.x1) * (p.y2 - p.y1)) AS share FROM bx p JOIN bx v ON p.video = v.video AND p.frame = v.frame WHERE p.event_type = 'click' AND v.event_type = 'view'),
 k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY share DESC, box) AS rn FROM j) SELECT event_id, box, round(share, 6) AS share FROM k WHERE rn = 1 AND share >= 0.25""")
def best_overlap(spark, sf_dir):
    """The box that covers most of each person's, from a quarter on."""
    bx = boxes(spark, sf_dir)
    p, v = bx.where("event_type = 'click'").alias("p"), bx.where("event_type = 'view'").alias("v")
    cols = lambda a: [F.col(f"{a}.{c}") for c in ("x1", "y1", "x2", "y2")]
    pairs = p.join(v, (F.col("p.video") == F.col("v.video")) & (F.col("p.frame") == F.col("v.frame")))
    best = pairs.groupBy("p.event_id").agg(F.max(F.struct(geometry.coverage(cols("p"), cols("v")).alias("share"), (-F.col("v.event_id")).alias("b"))).alias("m"))
    return best.where("m.share >= 0.25").select("event_id", (-F.col("m.b")).alias("box"), r6("m.share").alias("share"))


@catalog.add(EV + """, a AS (SELECT DISTINCT video, t FROM ev WHERE event_type = 'signup'), b AS (SELECT DISTINCT video, t FROM ev WHERE event_type = 'purchase'), n AS (SELECT a.video, a.t, min(abs(a.t - b.t)) AS d FROM a JOIN b USING (video) GROUP BY ALL)
 SELECT video, count(*) FILTER (d <= 60.0) AS matched, count(*) FILTER (d > 60.0) AS unmatched, round(avg(d) FILTER (d <= 60.0), 6) AS mean_lag FROM n GROUP BY video""")
def onset_lags(spark, sf_dir):
    """Lag to the nearest onset, within a tolerance or not at all."""
    ev = events(spark, sf_dir)
    of = lambda kind: ev.where(F.col("event_type") == kind).select("video", "t").distinct()
    rows = iv.nearest(of("signup"), of("purchase"), ["video"], "t").withColumn("d", F.abs(F.col("t") - F.col("nearest_t")))
    near = F.col("d") <= 60.0
    return rows.groupBy("video").agg(F.count_if(near).alias("matched"), F.count_if(~near).alias("unmatched"), r6(F.avg(F.when(near, F.col("d")))).alias("mean_lag"))


@catalog.add(BOX + """, h AS (SELECT event_id, video, frame, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM bx WHERE event_type = 'signup'), d AS (SELECT h.event_id, b.event_id AS box, sqrt(pow(h.x - (b.x1 + b.x2) / 2, 2) + pow(h.y - (b.y1 + b.y2) / 2, 2)) AS d FROM h JOIN bx b ON b.video = h.video AND b.frame = h.frame AND b.event_type = 'view'),
 k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, box) AS rn FROM d) SELECT h.event_id, CASE WHEN k.d < 60 THEN k.box END AS box FROM h LEFT JOIN k ON k.event_id = h.event_id AND rn = 1""")
def nearest_box(spark, sf_dir):
    """Nearest box centre of the same frame, none from 60 pixels on."""
    bx = boxes(spark, sf_dir).withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})
    h, v = bx.where("event_type = 'signup'").select("event_id", "video", "frame", "cx", "cy"), bx.where("event_type = 'view'").select("video", "frame", F.col("event_id").alias("box"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    best = h.join(v, ["video", "frame"]).groupBy("event_id").agg(F.min(F.struct(F.hypot(F.col("cx") - F.col("bx"), F.col("cy") - F.col("by")).alias("d"), "box")).alias("m"))
    return h.join(best, "event_id", "left").select("event_id", F.when(F.col("m.d") < 60, F.col("m.box")).alias("box"))


@catalog.add("SELECT a.p_size, count(*) AS n FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1 AND list_has_any([a.p_size % 3, a.p_size % 5], [b.p_size % 3, b.p_size % 5]) GROUP BY 1")
def shared_sections(spark, sf_dir):
    """Pairs whose sets meet."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.array(F.col("p_size") % 3, F.col("p_size") % 5).alias("s"))
    pairs = p.alias("a").join(p.alias("b"), F.col("a.p_partkey") == F.col("b.p_partkey") + 1).where(F.arrays_overlap("a.s", "b.s"))
    return pairs.groupBy("a.p_size").agg(F.count("*").alias("n"))


# ---- projections, filters, orders


@catalog.add(BOX + " SELECT event_id, round(least(greatest(x1 * 2.5, 0), 400), 6) AS x1, round(least(greatest(x2 * 2.5, 0), 400), 6) AS x2, round((x1 + x2) / 2 * 2.5, 6) AS gx, round(y2 * 2.0, 6) AS gy, round((y2 - y1) * 2.0, 6) AS h FROM bx")
def scaled_boxes(spark, sf_dir):
    """Boxes in original pixels, clipped, with ground point and height."""
    rows = tracks.ground_points(boxes(spark, sf_dir).withColumns({c: F.col(c) * s for c, s in (("x1", 2.5), ("x2", 2.5), ("y1", 2.0), ("y2", 2.0))}))
    return rows.select("event_id", *(r6(scalars.clip(F.col(c), 0.0, 400.0)).alias(c) for c in ("x1", "x2")), r6("x").alias("gx"), r6("y").alias("gy"), r6("h").alias("h"))


@catalog.add(BOX + ", q AS (SELECT event_id, x1, y1, CASE WHEN event_id % 13 = 0 THEN x1 WHEN event_id % 17 = 0 THEN 'nan'::DOUBLE ELSE x2 END AS x2, y2, event_type FROM bx) SELECT event_id, y2 < 130 - 3 AS clear_bottom, x1 < 3 OR y1 < 3 OR x2 > 297 OR y2 > 127 AS at_edge, x1 > 2 AND x2 < 298 AND y2 < 128 AS foot FROM q WHERE event_type IN ('click', 'view', 'error') AND NOT isnan(x2) AND x2 > x1 AND y2 > y1")
def sane_boxes(spark, sf_dir):
    """P8, P9, P10."""
    x2 = F.when(F.col("event_id") % 13 == 0, F.col("x1")).when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("x2"))
    rows = boxes(spark, sf_dir).withColumn("x2", x2)
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    kept = rows.where(geometry.sane(box) & F.col("event_type").isin("click", "view", "error"))
    return kept.select("event_id", (F.col("y2") < 130 - 3).alias("clear_bottom"), geometry.at_edge(box, 300.0, 130.0).alias("at_edge"), geometry.reliable_foot(box, 300.0, 130.0).alias("foot"))


@catalog.add(EV + " SELECT event_id, user_id FROM ev WHERE user_id IN (SELECT user_id FROM ev GROUP BY user_id HAVING count(*) >= 20)")
def long_tracks(spark, sf_dir):
    """P11."""
    return tracks.long_enough(events(spark, sf_dir), ["user_id"], 20).select("event_id", "user_id")


@catalog.add(EV + " SELECT event_id, event_type, t FROM ev WHERE event_type IN ('click', 'view') AND video IN (1, 3) AND t < 1000000.0 AND (event_type LIKE 'cl%' OR event_type LIKE 'vi%')")
def optional_filters(spark, sf_dir):
    """Class list, chosen videos, time limit, prefixes; only the columns asked for."""
    ev = events(spark, sf_dir)
    official = spark.createDataFrame([("click",), ("view",)], "event_type string")  # a constant table
    kept = checks.optional(ev, video=[1, 3], event_type=None, until=1_000_000.0).join(F.broadcast(official), "event_type", "left_semi")
    return kept.where(scalars.has_prefix(F.col("event_type"), ["cl", "vi"])).select("event_id", "event_type", "t")


@catalog.add(EV + """, b AS (SELECT user_id AS key, k % 7 = 0 AS odd, count(*) AS n, bool_or(event_type NOT IN ('click', 'view', 'signup')) AS unknown, bool_or(value > 180) AS late FROM ev GROUP BY ALL), ok AS (SELECT key, odd FROM b WHERE NOT unknown AND NOT late)
 SELECT ev.user_id AS key, k % 7 = 0 AS odd, round(t, 3) AS start_s, CASE WHEN abs(t + value - 2592000.0) <= 0.001 THEN 2592000.0 ELSE round(t + value, 3) END AS end_s, event_type AS label, 'note' AS note FROM ev JOIN ok ON ok.key = ev.user_id AND ok.odd = (k % 7 = 0)""")
def label_bodies(spark, sf_dir):
    """P5, O1: a body with an unknown label or bad times is rejected whole."""
    ev = events(spark, sf_dir)
    end = F.when(F.col("value") > 180, F.col("t")).otherwise(F.col("t") + F.col("value"))
    rows = ev.select(F.col("user_id").alias("key"), (F.col("k") % 7 == 0).alias("odd"), F.col("t").alias("start_s"), end.alias("end_s"), F.col("event_type").alias("label"), F.lit("note").alias("note"))
    good, _ = checks.label_bodies(rows, ["key", "odd"], F.lit(2592000.0), ("click", "view", "signup"))
    return good


@catalog.add("SELECT 'error' AS severity, 'v' || c_nationkey AS video, NULL::BIGINT AS ordinal, m AS message FROM (SELECT *, 'z' || c_custkey % 400 AS id, count(*) OVER (PARTITION BY c_nationkey, c_custkey % 400) AS same, count(*) OVER (PARTITION BY c_nationkey) AS zs FROM customer), LATERAL (SELECT unnest(list_filter([CASE WHEN same > 1 THEN 'id used twice' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown type' END, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 50 <> 0 AND c_mktsegment <> 'BUILDING' THEN 'too few points' END, CASE WHEN c_acctbal < 0 THEN 'outside the frame' END, CASE WHEN c_custkey % 50 = 0 THEN 'too many points' END], lambda x: x IS NOT NULL)) AS m) UNION ALL SELECT 'error', 'v' || c_nationkey, NULL, 'too many zones' FROM customer GROUP BY c_nationkey HAVING count(*) > 50")
def zone_violations(spark, sf_dir):
    """Ids, repeats, types, points, frame, and limits of zones and points."""
    c = read(spark, sf_dir, "customer")
    x = F.abs("c_acctbal").cast("double") * F.when(F.col("c_acctbal") < 0, -1.0).otherwise(1.0)
    n = F.when(F.col("c_custkey") % 50 == 0, 1001).when(F.col("c_custkey") % 3 == 0, 2).otherwise(4)
    rows = c.select(
        F.concat(F.lit("v"), "c_nationkey").alias("video"), F.concat(F.lit("z"), F.col("c_custkey") % 400).alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "pond").otherwise("parking_bay").alias("type"),
        F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(x.alias("x"), F.lit(1.0).alias("y"))).alias("points"), F.create_map().cast("map<string,string>").alias("attrs"),
    )
    return checks.zone_findings(rows, 1e6, 1e6, zones=50, points=1000)


@catalog.add(EV + """, g AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'purchase'), p AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'view'), r AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'signup')
 SELECT 'error' AS severity, user_id::VARCHAR AS video, NULL::BIGINT AS ordinal, 'missing video' AS message FROM g WHERE user_id NOT IN (SELECT user_id FROM p) UNION ALL SELECT 'warning', user_id::VARCHAR, NULL, 'unknown video' FROM p WHERE user_id NOT IN (SELECT user_id FROM g) UNION ALL SELECT 'warning', user_id::VARCHAR, NULL, 'no risk curve' FROM p WHERE user_id NOT IN (SELECT user_id FROM r)""")
def coverage_violations(spark, sf_dir):
    """P2f."""
    ev = events(spark, sf_dir).withColumn("video", F.col("user_id"))
    return checks.coverage_findings(*(ev.where(F.col("event_type") == k) for k in ("purchase", "view", "signup")))


@catalog.add("SELECT o_custkey, sum(CASE WHEN l <= 3 * 4 THEN l ELSE 0 END)::BIGINT AS kept, count(*) FILTER (l > 12) AS emptied FROM (SELECT o_custkey, o_orderkey, len(list(l_linenumber)) * 3 AS l FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY 1")
def time_budget(spark, sf_dir):
    """Entries over their time are emptied, and counted."""
    o, li = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    log = o.join(li, "o_orderkey").groupBy("o_custkey", "o_orderkey").agg((F.count("*") * 3).alias("total_sec"), F.collect_list("l_linenumber").alias("events")).withColumn("duration", F.lit(4.0))
    out = checks.emptied(log, ["events"])
    return out.groupBy("o_custkey").agg(F.sum(F.size("events") * 3).cast("long").alias("kept"), F.count_if(~F.col("kept")).alias("emptied"))


@catalog.add("SELECT * FROM (SELECT label, row_number() OVER (ORDER BY n DESC, label) AS rank FROM (SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT p_type, count(*) FROM part GROUP BY 1)) WHERE rank <= 10")
def top_labels(spark, sf_dir):
    """The union of two label sets, the ten most frequent."""
    p = read(spark, sf_dir, "part")
    both = p.select(F.col("p_brand").alias("label")).unionByName(p.select(F.col("p_type").alias("label")))
    return both.groupBy("label").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "label"))).where("rank <= 10").select("label", "rank")  # a row a label


@catalog.add(EV + " SELECT event_id, row_number() OVER (PARTITION BY video ORDER BY coalesce(list_position(['error', 'signup', 'purchase'], event_type), 99), user_id, event_id) AS rank FROM ev")
def ranked_items(spark, sf_dir):
    """O2: rare kinds first, others last, then a fixed order."""
    order = [scalars.place(F.col("event_type"), ["error", "signup", "purchase"]), F.col("user_id"), F.col("event_id")]
    return events(spark, sf_dir).select("event_id", F.row_number().over(Window.partitionBy("video").orderBy(*order)).alias("rank"))


@catalog.add(EV + " SELECT user_id, coalesce(bool_or(event_type = 'error'), false) AS any_error, coalesce(arg_min(event_id, (t, event_id)) FILTER (event_type = 'purchase'), -1) AS first_purchase, coalesce(max(value) FILTER (event_type = 'signup'), 0.0) AS most FROM ev GROUP BY 1")
def first_any_max(spark, sf_dir):
    """First match, any, and greatest, with defaults."""
    of = lambda kind, c: F.when(F.col("event_type") == kind, c)
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.bool_or(F.col("event_type") == "error").alias("any_error"), F.coalesce(F.min(of("purchase", F.struct("t", "event_id"))).getField("event_id"), F.lit(-1).cast("long")).alias("first_purchase"), F.coalesce(F.max(of("signup", F.col("value"))), F.lit(0.0)).alias("most"))


@catalog.add(PT + VEL + ", c AS (SELECT event_id, heading, CAST(floor(x / 30) AS INT) % 2 = 0 AS safe FROM sp) SELECT event_id, CASE WHEN safe THEN abs((heading - 90.0 + 180.0) - 360.0 * floor((heading - 90.0 + 180.0) / 360.0) - 180.0) > 120.0 END AS against FROM c")
def against_flow(spark, sf_dir):
    """Against the expected heading, null outside safe cells."""
    rows = moving(spark, sf_dir)
    return rows.select("event_id", scene.against_flow(geometry.cell(F.col("x"), 30) % 2 == 0, F.col("heading"), F.lit(90.0)).alias("against"))


@catalog.add(TL + " SELECT video, start_frame, state IN ('red', 'red_amber') AND (n_observed > 0 OR imputed) AND start_uncertainty_frames = 1 - 1 AS red FROM tl")
def red_gate(spark, sf_dir):
    """Intervals in which a frame may be judged to be red."""
    return timeline(spark, sf_dir).select("video", "start_frame", rules.may_judge_red(F.col("state"), (F.col("n_observed") > 0) | F.col("imputed"), F.col("start_uncertainty_frames")).alias("red"))


def _edges():
    return [(float(x), float(y), float(x + dx), float(y + dy)) for p in (*ZONES, [(60.0, 0.0), (100.0, 0.0), (100.0, 40.0), (60.0, 40.0)]) for x, y, dx, dy in geometry.edges(p)]


@catalog.add("WITH e(x0, y0, x1, y1) AS (VALUES " + ", ".join(str(e) for e in _edges()) + "), n AS (SELECT least((x0, y0), (x1, y1)) AS a, greatest((x0, y0), (x1, y1)) AS b FROM e) SELECT a[1]::DOUBLE AS x, a[2]::DOUBLE AS y, b[1]::DOUBLE AS u, b[2]::DOUBLE AS v FROM n GROUP BY a, b HAVING count(*) = 1")
def road_outline(spark, sf_dir):
    """Edges of the union of polygons that share whole edges."""
    return reports.outline(spark.createDataFrame(_edges(), "x0 double, y0 double, x1 double, y1 double"))


@catalog.add(PT + VEL + """, u AS (SELECT CAST(floor(x / 40) AS INT) AS i, CAST(floor(y / 40) AS INT) AS j, video, user_id, atan2(avg(sin(radians(heading))), avg(cos(radians(heading)))) AS h FROM sp GROUP BY ALL),
 w AS (SELECT i, j, atan2(avg(sin(h)), avg(cos(h))) AS h, sqrt(pow(avg(sin(h)), 2) + pow(avg(cos(h)), 2)) AS coherence, count(*) AS tracks FROM u GROUP BY ALL), pv AS (SELECT i, j, video, atan2(avg(sin(h)), avg(cos(h))) AS vh, count(*) AS n FROM u GROUP BY ALL HAVING count(*) >= 3),
 a AS (SELECT pv.i, pv.j, count(*) AS videos, count(*) FILTER (degrees(acos(least(1.0, greatest(-1.0, cos(vh - h))))) <= 30) AS agreeing FROM pv JOIN w USING (i, j) GROUP BY pv.i, pv.j)
 SELECT w.i, w.j, tracks, round(coherence, 6) AS coherence, coalesce(videos, 0) AS videos, coalesce(agreeing, 0) AS agreeing, coalesce(nullif(concat_ws('+', CASE WHEN coherence < 0.8 THEN 'incoherent' END, CASE WHEN tracks < 5 THEN 'few_tracks' END, CASE WHEN coalesce(agreeing, 0) < coalesce(videos, 0) THEN 'videos_disagree' END), ''), 'ok') AS status FROM w LEFT JOIN a USING (i, j)""")
def direction_agreement(spark, sf_dir):
    """Merged direction by cell, and whether the videos agree with it."""
    rows = moving(spark, sf_dir).withColumns({"i": geometry.cell(F.col("x"), 40), "j": geometry.cell(F.col("y"), 40)})
    return scene.direction_cells(rows, ["i", "j"], ["user_id"]).select("i", "j", "tracks", r6("coherence").alias("coherence"), "videos", "agreeing", "status")


# ---- streams over tables


@catalog.add(EV.replace("WITH ev", "WITH RECURSIVE ev", 1) + """, f AS (SELECT DISTINCT user_id, floor(t / 3600.0) * 1.0 AS t FROM ev), s AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn FROM f),
 g AS (SELECT user_id, rn, t, true AS taken, CASE WHEN t BETWEEN 30 AND 65 THEN 1 ELSE 0 END AS n, t AS last FROM s WHERE rn = 1 UNION ALL SELECT s.user_id, s.rn, s.t, s.t BETWEEN 30 AND 65 AND n < 4 AND (n = 0 OR s.t - last >= 10),
  n + CASE WHEN s.t BETWEEN 30 AND 65 AND n < 4 AND (n = 0 OR s.t - last >= 10) THEN 1 ELSE 0 END, CASE WHEN s.t BETWEEN 30 AND 65 AND n < 4 AND (n = 0 OR s.t - last >= 10) THEN s.t ELSE last END FROM g JOIN s ON s.user_id = g.user_id AND s.rn = g.rn + 1)
 SELECT user_id::VARCHAR AS video, t FROM g WHERE taken""")
def observer_times(spark, sf_dir):
    """Frames to register by; an hour stands for a second."""
    frames = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("video"), F.floor(F.col("t") / 3600.0).cast("double").alias("t"))
    return risk.observer_times(frames)


@catalog.add(EV + """, c AS (SELECT user_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS frame FROM ev), x AS (SELECT DISTINCT user_id FROM c WHERE frame % 10 = 0 AND t > 3 * 300000.0) SELECT user_id AS video, t, value AS score FROM c WHERE user_id NOT IN (SELECT user_id FROM x)""")
def deadline(spark, sf_dir):
    """Curves of videos that were over their time at a check are discarded."""
    rows = events(spark, sf_dir).select(F.col("user_id").alias("video"), "t", F.col("value").alias("score"), F.row_number().over(win.ordered(["user_id"], *ORDER)).alias("frame"))
    spent = rows.select("video", "frame", F.col("t").alias("elapsed_sec"), F.lit(300000.0).alias("duration"))
    return risk.within_deadline(rows.drop("frame"), spent, 3.0, 10)
