"""Queries of validation, versioned documents, agreement, events rules and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import scalars
from trackloom.operators import checks, rules
from trackloom.plans.common import EV, SEGMENTS, Catalog, events, r6, read
from trackloom.plans.track_queries import BOX
from trackloom.sources import store
from trackloom.streaming import risk

catalog = Catalog()


@catalog.add(EV + " SELECT user_id, event_type, event_id AS version, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM ev) WHERE rn = 1")
def latest_version(spark, sf_dir):
    """V3, D25."""
    rows = events(spark, sf_dir).select("user_id", "event_type", F.col("event_id").alias("version"), "value")
    return store.latest(rows, ["user_id", "event_type"])


@catalog.add(EV + " SELECT user_id, version, label FROM (SELECT user_id, event_id AS version, CASE WHEN k % 5 <> 0 THEN event_type END AS label, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM ev) WHERE rn = 1 AND label IS NOT NULL")
def answer_upsert(spark, sf_dir):
    """V4: null deletes."""
    rows = events(spark, sf_dir).select("user_id", F.col("event_id").alias("version"), F.when(F.col("k") % 5 != 0, F.col("event_type")).alias("label"))
    return store.live_answers(rows, ["user_id"])


@catalog.add(EV + " SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM ev) WHERE rn <= 3")
def recent_versions(spark, sf_dir):
    """S16, O3."""
    rows = events(spark, sf_dir).select("user_id", F.col("event_id").alias("version"))
    return store.recent(rows, ["user_id"], 3).select("user_id", F.col("version").alias("event_id"))


@catalog.add("SELECT d.lang, count(*) AS n, count(*) FILTER (l.quality = 1) AS good, count(*) FILTER (l.quality = 0) AS poor, count(*) FILTER (l.quality IS NULL) AS unanswered, round(avg(CASE WHEN l.quality IS NOT NULL THEN CASE WHEN (d.n_chars > 1000) = (l.quality = 1) THEN 1.0 ELSE 0.0 END END), 6) AS agreement FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang")
def agreement_matrix(spark, sf_dir):
    """Items with their answers, unanswered ones left out of agreement."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    same = F.when(F.col("quality").isNotNull(), F.when((F.col("n_chars") > 1000) == (F.col("quality") == 1), 1.0).otherwise(0.0))
    return d.groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("poor"), F.count_if(F.col("quality").isNull()).alias("unanswered"), r6(F.avg(same)).alias("agreement"))


@catalog.add(EV + " SELECT k, count(*) AS n, round(avg(value), 6) AS mean FROM ev GROUP BY k")
def json_props(spark, sf_dir):
    """Nested access to JSON."""
    ev = read(spark, sf_dir, "events").select("value", F.from_json("props", "k int").alias("p"))
    return ev.groupBy("p.k").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


DQ = SEGMENTS + """, e AS (SELECT event_id, video, CASE WHEN k % 10 = 0 THEN 'other' ELSE 'c' || CAST(k % 3 AS VARCHAR) END AS label, t AS start_s, CASE WHEN k % 17 = 0 THEN t - 1.0 ELSE t + value * 60.0 END AS end_s FROM ev WHERE event_type = 'view'),
 p AS (SELECT *, lag(end_s) OVER (PARTITION BY video, label ORDER BY start_s, end_s, event_id) AS b FROM e WHERE label <> 'other')"""


@catalog.add(DQ + """ SELECT 'error' AS severity, CAST(video AS VARCHAR) AS video, event_id AS ordinal, 'bad times' AS message FROM e WHERE start_s < 0 OR start_s >= end_s
 UNION ALL SELECT 'error', CAST(video AS VARCHAR), event_id, 'unknown label' FROM e WHERE label = 'other' UNION ALL SELECT 'error', CAST(video AS VARCHAR), event_id, 'ends after the video' FROM e WHERE end_s > 2500000.0 + 0.5
 UNION ALL SELECT 'error', CAST(video AS VARCHAR), event_id, 'overlaps its predecessor' FROM p WHERE start_s < b""")
def dq_violations(spark, sf_dir):
    """P1, P2, P2a to P2d."""
    ev = events(spark, sf_dir).where("event_type = 'view'")
    label = F.when(F.col("k") % 10 == 0, "other").otherwise(F.concat(F.lit("c"), (F.col("k") % 3).cast("string")))
    rows = ev.select("video", F.col("event_id").alias("ordinal"), label.alias("label"), F.col("t").alias("start_s"), F.when(F.col("k") % 17 == 0, F.col("t") - 1.0).otherwise(F.col("t") + F.col("value") * 60.0).alias("end_s"))
    videos = ev.select("video").distinct().withColumn("duration", F.lit(2500000.0))
    return checks.event_findings(rows, videos, ["c0", "c1", "c2"])


@catalog.add(EV + """, r AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, t, value / 400.0 AS score FROM ev), b AS (SELECT *, score > 1 OR t < coalesce(lag(t) OVER (PARTITION BY video ORDER BY pos), -1.0) AS bad FROM r)
 SELECT 'error' AS severity, CAST(video AS VARCHAR) AS video, min(pos) AS ordinal, 'bad risk row' AS message FROM b WHERE bad GROUP BY video""")
def risk_violations(spark, sf_dir):
    """P2e: the first bad row of each curve."""
    from trackloom.operators.windows import ordered

    ev = events(spark, sf_dir)
    rows = ev.select(F.col("user_id").alias("video"), F.row_number().over(ordered(["user_id"], "event_id")).alias("pos"), "t", (F.col("value") / 400.0).alias("score"))
    return checks.risk_findings(rows)


@catalog.add("SELECT c_nationkey % 5 AS grp, count(*) AS n, count(*) FILTER (c_mktsegment = 'BUILDING') AS ones FROM customer GROUP BY 1 HAVING count(*) FILTER (c_mktsegment = 'BUILDING') <> 1")
def exactly_one(spark, sf_dir):
    """Groups where a condition does not hold exactly once."""
    c = read(spark, sf_dir, "customer").withColumn("grp", F.col("c_nationkey") % 5)
    bad = checks.exactly_one(c, ["grp"], F.col("c_mktsegment") == "BUILDING").withColumnRenamed("n", "ones")
    return c.groupBy("grp").agg(F.count("*").alias("n")).join(bad, "grp")


@catalog.add("SELECT o_orderkey, li, o_custkey % 7 AS other FROM (SELECT l_orderkey AS o_orderkey, count(*) AS li FROM lineitem GROUP BY 1) JOIN orders USING (o_orderkey) WHERE li <> o_custkey % 7")
def count_mismatches(spark, sf_dir):
    """Two sources that disagree."""
    a = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("li"))
    b = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("li"))
    return checks.mismatches(a, b, ["o_orderkey"], "li")


@catalog.add(BOX + """, m AS (SELECT event_id, value / 100.0 - 1.0 AS r, (k - 50) / 25.0 AS g FROM ev) SELECT event_id, CASE WHEN r > 0 AND g <= 0 THEN 'red' WHEN r <= 0 AND g > 0 THEN 'green' WHEN r <= 0 AND g <= 0 THEN 'green_flash' ELSE 'unclear' END AS state, round(least(1.0, least(abs(r), abs(g)) / 2.0), 6) AS confidence FROM m""")
def lamp_states(spark, sf_dir):
    """G17, G18."""
    r, g = F.col("value") / 100.0 - 1.0, (F.col("k") - 50) / 25.0
    return events(spark, sf_dir).select("event_id", scalars.pedestrian_lamp(r > 0, g > 0).alias("state"), r6(scalars.confidence([r, g])).alias("confidence"))


def _detections(spark, sf_dir):
    """Events as detections: half-second steps within short clips of a user."""
    from trackloom.operators.windows import ordered

    ev = events(spark, sf_dir)
    n = F.row_number().over(ordered(["user_id"], "t", "event_id")) - 1
    kind = F.when(F.col("event_type") == "click", 0).otherwise(2)
    rows = ev.withColumn("n", n)
    return rows.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("n") / 24).cast("string")).alias("video"), (F.floor(F.col("n") % 24 / 2) * 0.5).alias("t"), kind.cast("int").alias("cls"), (F.col("n") % 2).alias("track_id"),
        (F.col("n") % 24 * 4.0 * (1 - 2 * (F.col("n") % 2)) + 100.0 * (F.col("n") % 2)).alias("x1"), F.lit(80.0).alias("y1"), (F.col("n") % 24 * 4.0 * (1 - 2 * (F.col("n") % 2)) + 100.0 * (F.col("n") % 2) + 20.0).alias("x2"), F.lit(100.0).alias("y2"), (0.4 + F.col("k") / 200.0).alias("score"),
    )


DET = EV + """, nn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS n FROM ev),
 det AS (SELECT user_id || '-' || n // 24 AS video, floor(n % 24 / 2) * 0.5 AS t, CASE WHEN event_type = 'click' THEN 0 ELSE 2 END AS cls, n % 2 AS track_id, n % 24 * 4.0 * (1 - 2 * (n % 2)) + 100.0 * (n % 2) AS x1, 80.0 AS y1, n % 24 * 4.0 * (1 - 2 * (n % 2)) + 100.0 * (n % 2) + 20.0 AS x2, 100.0 AS y2, 0.4 + k / 200.0 AS score, 0.03 AS speed FROM nn)"""

RISK = DET.replace("WITH ev", "WITH RECURSIVE ev", 1) + """, fr AS (SELECT video, t, row_number() OVER w AS step, coalesce(t - lag(t) OVER w, 0.5) AS dt FROM (SELECT DISTINCT video, t FROM det) WINDOW w AS (PARTITION BY video ORDER BY t)),
 gp AS (SELECT video, t, cls, track_id, (x1 + x2) / 2 AS x, y2 AS y, greatest(2.0, (x2 - x1) * CASE cls WHEN 0 THEN 0.25 ELSE 0.45 END) AS rx, greatest(2.0, (y2 - y1) * CASE cls WHEN 0 THEN 0.06 ELSE 0.12 END) AS ry, score FROM det),
 br AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 1.1 AND sqrt(pow((x - lag(x) OVER w) / rx, 2) + pow((y - lag(y) OVER w) / ry, 2)) <= 8 * (t - lag(t) OVER w) THEN 0 ELSE 1 END AS b FROM gp WINDOW w AS (PARTITION BY video, cls, track_id ORDER BY t)),
 rn AS (SELECT *, sum(b) OVER (PARTITION BY video, cls, track_id ORDER BY t) AS run FROM br),
 ft AS (SELECT *, count(*) OVER w AS n, t - min(t) OVER w AS span, min(score) OVER w AS weakest, regr_sxx(x, t) OVER w AS tt, regr_sxy(x, t) OVER w AS tx, regr_sxy(y, t) OVER w AS ty, regr_syy(x, t) OVER w AS xx, regr_syy(y, t) OVER w AS yy FROM rn WINDOW w AS (PARTITION BY video, cls, track_id, run ORDER BY t RANGE BETWEEN 1.6 PRECEDING AND CURRENT ROW)),
 mo AS (SELECT *, tx / tt AS vx, ty / tt AS vy, exp(-2 * (greatest(0, xx - tx * tx / tt) / (rx * rx) + greatest(0, yy - ty * ty / tt) / (ry * ry)) / n) AS quality FROM ft WHERE n >= 3 AND span >= 0.75),
 pr AS (SELECT a.video, a.t, (a.cls, a.track_id) AS a, (b.cls, b.track_id) AS b, (b.x - a.x) / (a.rx + b.rx) AS px, (b.y - a.y) / (a.ry + b.ry) AS py, (b.vx - a.vx) / (a.rx + b.rx) AS ux, (b.vy - a.vy) / (a.ry + b.ry) AS uy,
   least(a.quality, b.quality) * least(1.0, least(a.weakest, b.weakest) / 0.5) AS trust FROM mo a JOIN mo b ON a.video = b.video AND a.t = b.t AND (a.cls, a.track_id) < (b.cls, b.track_id) AND a.cls + b.cls > 0 WHERE a.quality >= 0.5 AND b.quality >= 0.5),
 qd AS (SELECT *, ux * ux + uy * uy AS qa, 2 * (px * ux + py * uy) AS qb, px * px + py * py - 1 AS qc FROM pr),
 me AS (SELECT video, t, a, b, trust, CASE WHEN qa >= 0.04 AND qb < 0 AND qc > 0 AND qb * qb - 4 * qa * qc >= 0 THEN (-qb - sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) END AS ttc FROM qd),
 ps AS (SELECT me.*, step, dt, (0.6 + 0.35 * (1 - ttc / 5.0)) * trust AS value FROM me JOIN fr USING (video, t) WHERE ttc > 0 AND ttc <= 5),
 pc AS (SELECT *, CASE WHEN lag(step) OVER (PARTITION BY video, a, b ORDER BY step) = step - 1 AND dt <= 1.1 THEN value ELSE least(value, 0.35) END AS raw FROM ps),
 rw AS (SELECT video, step, max(raw) AS raw, min(ttc) FILTER (raw = best) AS ttc FROM (SELECT *, max(raw) OVER (PARTITION BY video, step) AS best FROM pc) GROUP BY video, step),
 al AS (SELECT fr.*, coalesce(raw, 0.0) AS raw, ttc FROM fr LEFT JOIN rw USING (video, step)),
 sc AS (SELECT video, step, t, ttc, CAST(raw * (1 - exp(-dt / 0.25)) AS DOUBLE) AS score FROM al WHERE step = 1 UNION ALL
   SELECT al.video, al.step, al.t, al.ttc, sc.score + (al.raw - sc.score) * (1 - exp(-al.dt / CASE WHEN al.raw > sc.score THEN 0.25 ELSE 0.6 END)) FROM sc JOIN al ON al.video = sc.video AND al.step = sc.step + 1)"""


@catalog.add(RISK + " SELECT video, t, round(score, 6) AS score, round(ttc, 6) AS ttc FROM sc")
def risk_replay(spark, sf_dir):
    """Ordered state per video."""
    return risk.replay(_detections(spark, sf_dir)).select("video", "t", r6("score").alias("score"), r6("ttc").alias("ttc"))


def _traffic(spark, sf_dir):
    """Events as scenes of 24 half-second frames: a person (track 0) on the road or a crossing, a car (1) that drives through it, a bus (2) near a stop."""
    from trackloom.operators.windows import ordered

    n = F.row_number().over(ordered(["user_id"], "t", "event_id")) - 1
    rows = events(spark, sf_dir).withColumn("n", n).withColumns({"f": F.floor(F.col("n") % 72 / 3), "track_id": F.col("n") % 3, "odd": F.floor(F.col("n") / 72) % 2 == 1, "c": F.floor(F.col("n") / 72)})
    one = lambda person, car, bus: F.when(F.col("track_id") == 0, person).when(F.col("track_id") == 1, car).otherwise(bus)
    f, k = F.col("f"), F.col("k")
    x = one(100.0 + f * 4.0 + k * 0.05, 140.0 + k * 0.1, 30.0 + k * 0.02 + F.when(f > 20, (f - 20) * 9.0).otherwise(0.0))
    y = one(F.when(F.col("odd"), 100.0).otherwise(50.0 + F.col("c") % 5 * 9.0), 60.0 + f * 4.0, 50.0 + k * 0.01)
    w, h = one(F.lit(6.0), F.lit(24.0), F.lit(60.0)), one(F.lit(20.0), F.lit(20.0), F.lit(40.0))
    return rows.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("c").cast("string")).alias("video"), (f * 0.5).alias("t"), one(F.lit(0), F.lit(2), F.lit(5)).alias("cls"), "track_id",
        (x - w / 2).alias("x1"), (y - h).alias("y1"), (x + w / 2).alias("x2"), y.alias("y2"), (k / 1000.0).alias("speed"),
    )


SCENE = rules.Scene(300.0, 200.0, crosswalks=[[(0, 0.45), (1, 0.45), (1, 0.55), (0, 0.55)]], roads=[[(0, 0), (1, 0), (1, 1), (0, 1)]], bus_stops=[[(0, 0), (0.2, 0), (0.2, 1), (0, 1)]])

TRAFFIC = EV + """, nn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS n FROM ev), tq AS (SELECT *, n % 72 // 3 AS f, n % 3 AS track_id, (n // 72) % 2 = 1 AS odd, n // 72 AS c FROM nn),
 tc AS (SELECT user_id || '-' || c AS video, f * 0.5 AS t, CASE track_id WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 5 END AS cls, track_id, k / 1000.0::DOUBLE AS speed, CASE track_id WHEN 0 THEN 6.0 WHEN 1 THEN 24.0 ELSE 60.0 END::DOUBLE AS w, CASE track_id WHEN 0 THEN 20.0 WHEN 1 THEN 20.0 ELSE 40.0 END::DOUBLE AS h,
   CASE track_id WHEN 0 THEN 100.0::DOUBLE + f * 4.0::DOUBLE + k * 0.05::DOUBLE WHEN 1 THEN 140.0::DOUBLE + k * 0.1::DOUBLE ELSE 30.0::DOUBLE + k * 0.02::DOUBLE + CASE WHEN f > 20 THEN (f - 20) * 9.0::DOUBLE ELSE 0.0 END END AS xc,
   CASE track_id WHEN 0 THEN CASE WHEN odd THEN 100.0::DOUBLE ELSE 50.0::DOUBLE + c % 5 * 9.0::DOUBLE END WHEN 1 THEN 60.0::DOUBLE + f * 4.0::DOUBLE ELSE 50.0::DOUBLE + k * 0.01::DOUBLE END AS y2 FROM tq),
 de AS (SELECT video, t, cls, track_id, speed, xc - w / 2 AS x1, y2 - h AS y1, xc + w / 2 AS x2, y2 FROM tc),
 pe AS (SELECT *, (x1 + x2) / 2 AS x, y2 AS y, y2 - y1 AS h, EXISTS (SELECT 1 FROM de v WHERE v.cls IN (2, 5, 7) AND v.video = p.video AND v.t = p.t AND (p.x1 + p.x2) / 2 BETWEEN v.x1 AND v.x2 AND (p.y1 + p.y2) / 2 BETWEEN v.y1 AND v.y2
   AND greatest(0.0, least(p.x2, v.x2) - greatest(p.x1, v.x1)) * greatest(0.0, least(p.y2, v.y2) - greatest(p.y1, v.y1)) / ((p.x2 - p.x1) * (p.y2 - p.y1)) >= 0.85 AND (p.y2 - v.y1) / (v.y2 - v.y1) <= 0.75) AS occupant FROM de p WHERE cls = 0)"""

MERGE = """SELECT video, round(min(s), 3) AS start_s, round(max(e), 3) AS end_s, '{label}' AS label FROM (SELECT *, sum(o) OVER (PARTITION BY video ORDER BY s, e) AS g FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY video ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS o FROM {src})) GROUP BY video, g"""


def _near(name, edges, margin):
    """SQL: whether motion (mx, my) at (x, y) runs along the nearest of some edges."""
    parts = [f"(sqrt(pow(x - ({x0} + greatest(0.0, least(1.0, ((x - {x0}) * {dx} + (y - {y0}) * {dy}) / {dx * dx + dy * dy})) * {dx}), 2) + pow(y - ({y0} + greatest(0.0, least(1.0, ((x - {x0}) * {dx} + (y - {y0}) * {dy}) / {dx * dx + dy * dy})) * {dy}), 2)), {i}, abs(mx * {dx} + my * {dy}) / {(dx * dx + dy * dy) ** 0.5})" for i, (x0, y0, dx, dy) in enumerate(edges)]
    return f"list_min([{', '.join(parts)}]) AS {name}, {margin} * h AS {name}_m"


def _rectangle(x0, y0, x1, y1):
    return [(x0, y0, x1 - x0, 0.0), (x1, y0, 0.0, y1 - y0), (x1, y1, x0 - x1, 0.0), (x0, y1, 0.0, y0 - y1)]


JAY = TRAFFIC + """, pm AS (SELECT a.video, a.track_id, a.t, list({'t': b.t, 'x': b.x, 'y': b.y} ORDER BY b.t) AS past FROM (SELECT *, row_number() OVER (PARTITION BY video, track_id ORDER BY t) AS r FROM pe) a
   JOIN (SELECT *, row_number() OVER (PARTITION BY video, track_id ORDER BY t) AS r FROM pe) b ON a.video = b.video AND a.track_id = b.track_id AND b.r BETWEEN a.r - 4 AND a.r - 1 GROUP BY ALL),
 mo AS (SELECT pe.*, x - list_filter(past, lambda q: pe.t - q.t > 0 AND pe.t - q.t <= 1.6)[1].x AS mx, y - list_filter(past, lambda q: pe.t - q.t > 0 AND pe.t - q.t <= 1.6)[1].y AS my FROM pe LEFT JOIN pm USING (video, track_id, t)),
 fe AS (SELECT *, """ + _near("cw", _rectangle(0.0, 90.0, 300.0, 110.0), 0.15) + ", " + _near("rd", _rectangle(0.0, 0.0, 300.0, 200.0), 0.3) + """ FROM mo),
 el AS (SELECT video, track_id, t, x, y, h, x / 300 BETWEEN 0 AND 1 AND y / 200 BETWEEN 0 AND 1 AND greatest(0.45 - y / 200, y / 200 - 0.55) > 0.01 AND NOT occupant AND x1 > 2 AND x2 < 298 AND y2 < 198
   AND NOT coalesce(sqrt(mx * mx + my * my) BETWEEN 0.1 * h AND 2 * h AND ((cw[1] <= cw_m AND cw[3] >= 0.866 * sqrt(mx * mx + my * my)) OR (rd[1] <= rd_m AND rd[3] >= 0.866 * sqrt(mx * mx + my * my))), false) AS eligible FROM fe),
 ok AS (SELECT *, eligible AND last_value(t) OVER w - first_value(t) OVER w > 0 AND sqrt(pow(last_value(x) OVER w - first_value(x) OVER w, 2) + pow(last_value(y) OVER w - first_value(y) OVER w, 2)) >= 0.1 * h * (last_value(t) OVER w - first_value(t) OVER w) AS ok
   FROM el WINDOW w AS (PARTITION BY video, track_id ORDER BY t RANGE BETWEEN 1.01 PRECEDING AND 1.01 FOLLOWING)),
 ep AS (SELECT *, sum(o) OVER (PARTITION BY video, track_id ORDER BY t) AS g FROM (SELECT *, CASE WHEN coalesce(NOT ok OR NOT lag(ok) OVER w OR t - lag(t) OVER w > 1.01 OR sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) > greatest(h, lag(h) OVER w) * (0.5 + 1.5 * (t - lag(t) OVER w)), true) THEN 1 ELSE 0 END AS o FROM ok WINDOW w AS (PARTITION BY video, track_id ORDER BY t))),
 ev1 AS (SELECT video, round(min(t), 3) AS s, round(least(max(t) + 0.5, 12.0), 3) AS e FROM ep WHERE ok GROUP BY video, track_id, g HAVING count(*) >= 3 AND max(t) - min(t) >= 0.75 AND sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) >= 0.3 * median(h))"""

YIELD = """, ve AS (SELECT *, (x1 + x2) / 2 AS x, y2 AS y, greatest(x2 - x1, y2 - y1) AS ext, y2 - 0.2 * (y2 - y1) AS yl FROM de WHERE cls IN (1, 2, 3, 5, 7)),
 vm AS (SELECT *, coalesce(CASE WHEN t - lag(t) OVER w > 0 AND t - lag(t) OVER w <= 1.1 THEN sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) / (t - lag(t) OVER w) END BETWEEN 0.15 * ext AND 4 * ext, false) AS moving,
   len(list_filter([{'a': x1, 'b': yl}, {'a': x2, 'b': yl}, {'a': x2, 'b': y2}, {'a': x1, 'b': y2}, {'a': x, 'b': (yl + y2) / 2}], lambda q: q.a BETWEEN 0 AND 300 AND q.b BETWEEN 90 AND 110)) > 0 AS onx FROM ve WINDOW w AS (PARTITION BY video, cls, track_id ORDER BY t)),
 vc AS (SELECT vm.*, onx AND moving AND x BETWEEN 0 AND 300 AND y BETWEEN 0 AND 200 AND EXISTS (SELECT 1 FROM pe WHERE pe.video = vm.video AND pe.t = vm.t AND NOT occupant AND pe.y2 < 197 AND pe.x BETWEEN 0 AND 300 AND pe.y BETWEEN 90 AND 110 AND sqrt(pow(vm.x - pe.x, 2) + pow(vm.y - pe.y, 2)) <= 1.5 * vm.ext) AS conflict FROM vm),
 vg AS (SELECT *, sum(o) OVER (PARTITION BY video, cls, track_id ORDER BY t) AS g FROM (SELECT *, CASE WHEN coalesce(NOT onx OR NOT lag(onx) OVER w OR t - lag(t) OVER w > 1.1, true) THEN 1 ELSE 0 END AS o FROM vc WINDOW w AS (PARTITION BY video, cls, track_id ORDER BY t))),
 ev2 AS (SELECT video, round(min(t), 3) AS s, round(least(max(t) + 0.5, 12.0), 3) AS e FROM vg WHERE onx GROUP BY video, cls, track_id, g HAVING bool_or(conflict) AND count(*) >= 2 AND max(t) - min(t) + 0.5 <= 15 AND sqrt(pow(arg_max(x, t) - arg_min(x, t), 2) + pow(arg_max(y, t) - arg_min(y, t), 2)) >= 0.35 * median(ext))"""

BUS = """, bu AS (SELECT video, track_id, t, (x1 + x2) / 600 AS x, y2 / 200 AS y FROM de WHERE cls = 5 AND y2 BETWEEN 0 AND 200 AND (greatest(-(x1 + x2) / 600, (x1 + x2) / 600 - 0.2) <= 0.005 OR greatest(-x1 / 300, x1 / 300 - 0.2) <= 0.005 OR greatest(-x2 / 300, x2 / 300 - 0.2) <= 0.005)),
 bl AS (SELECT *, sum(o) OVER (PARTITION BY video, track_id ORDER BY t) AS ch FROM (SELECT *, CASE WHEN coalesce(t - lag(t) OVER w > 1.0, true) THEN 1 ELSE 0 END AS o, count(*) OVER (PARTITION BY video, track_id) AS c FROM bu WINDOW w AS (PARTITION BY video, track_id ORDER BY t)) WHERE c >= 20),
 bw AS (SELECT a.video, a.track_id, a.ch, a.t AS s, (SELECT min(b.t) FROM bl b WHERE b.video = a.video AND b.track_id = a.track_id AND b.ch = a.ch AND b.t >= a.t + 9.5) AS e FROM bl a),
 bk AS (SELECT bw.video, bw.track_id, bw.ch, s, e FROM bw JOIN bl ON bl.video = bw.video AND bl.track_id = bw.track_id AND bl.ch = bw.ch AND bl.t BETWEEN s AND e GROUP BY ALL HAVING max(x) - min(x) <= 0.012 AND max(y) - min(y) <= 0.012),
 bm AS (SELECT DISTINCT bl.video, bl.track_id, bl.t FROM bl JOIN bk ON bl.video = bk.video AND bl.track_id = bk.track_id AND bl.ch = bk.ch AND bl.t BETWEEN s AND e),
 bs AS (SELECT *, sum(o) OVER (PARTITION BY video, track_id ORDER BY t) AS g FROM (SELECT *, CASE WHEN coalesce(t - lag(t) OVER w > 1.0, true) THEN 1 ELSE 0 END AS o FROM bm WINDOW w AS (PARTITION BY video, track_id ORDER BY t))),
 ev3 AS (SELECT video, min(t) AS s, least(max(t) + 0.5, 12.0) AS e FROM bs GROUP BY video, track_id, g HAVING least(max(t) + 0.5, 12.0) - min(t) >= 10.0)"""


@catalog.add(JAY + YIELD + BUS + " " + " UNION ALL ".join(MERGE.format(label=n, gap=g, src=s) for n, g, s in (("jaywalking", 1.1, "ev1"), ("failure_to_yield", 1.0, "ev2"), ("stopped_vehicle", 1.0, "ev3"))))
def rule_events(spark, sf_dir):
    """The rules by trajectory, over whole scenes."""
    return rules.all_events(_traffic(spark, sf_dir), SCENE, 0.5, 12.0)


SESSION = """, {n}b AS (SELECT *, sum(o) OVER (PARTITION BY {keys} ORDER BY t) AS g FROM (SELECT *, CASE WHEN coalesce(t - lag(t) OVER w > 1.0, true) THEN 1 ELSE 0 END AS o FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY t))),
 {n} AS (SELECT video, min(t) AS s, least(max(t) + 0.5, 12.0) AS e FROM {n}b GROUP BY {keys}, g HAVING least(max(t) + 0.5, 12.0) - min(t) >= {least})"""


@catalog.add(TRAFFIC + """, js AS (SELECT DISTINCT video, track_id, t FROM pe WHERE x / 300 BETWEEN 0 AND 1 AND y / 200 BETWEEN 0 AND 1 AND greatest(0.45 - y / 200, y / 200 - 0.55) > 0.025 AND NOT occupant AND speed >= 0.005),
 yv AS (SELECT video, t, (x1 + x2) / 600 AS ax, y2 / 200 AS ay FROM de WHERE cls IN (2, 3, 5, 7) AND speed >= 0.025 AND y2 / 200 BETWEEN 0.45 AND 0.55 AND (x1 + x2) / 600 BETWEEN 0 AND 1),
 ys AS (SELECT DISTINCT yv.video, yv.t FROM yv JOIN pe ON pe.video = yv.video AND pe.t = yv.t WHERE NOT occupant AND y / 200 BETWEEN 0.45 AND 0.55 AND y / 200 < 0.95 AND x / 300 BETWEEN 0 AND 1 AND sqrt(pow(ax - x / 300, 2) + pow(ay - y / 200, 2)) < 0.07)"""
 + SESSION.format(n="jv", keys="video, track_id", src="js", least=0.6) + SESSION.format(n="yw", keys="video", src="ys", least=0.3) + " " + MERGE.format(label="jaywalking", gap=1.1, src="jv") + " UNION ALL SELECT video, round(s, 3) AS start_s, round(e, 3) AS end_s, 'failure_to_yield' AS label FROM yw")
def rule_events_by_speed(spark, sf_dir):
    """The older rules."""
    rows = _traffic(spark, sf_dir)
    return rules.jaywalking_by_speed(rows, SCENE, 0.5, 12.0).unionByName(rules.failure_to_yield_by_distance(rows, SCENE, 0.5, 12.0))
