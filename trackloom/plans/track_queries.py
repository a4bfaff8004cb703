"""Queries of windows, tracks and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import circular, geometry
from trackloom.operators import tracks
from trackloom.operators import windows as win
from trackloom.plans.common import EV, Catalog, events, r6, read

catalog = Catalog()
ORDER = ("t", "event_id")
TRACK = ["user_id"]
ZONES = [[(0.0, 0.0), (60.0, 0.0), (60.0, 40.0), (0.0, 40.0)], [(20.0, 10.0), (120.0, 30.0), (90.0, 95.0), (10.0, 70.0)], [(100.0, 0.0), (300.0, 0.0), (200.0, 50.0), (300.0, 100.0), (100.0, 100.0)]]
H = [[1.1, 0.05, 3.0], [0.02, 0.9, -2.0], [0.0001, 0.0002, 1.0]]


def points(spark, sf_dir):
    """Events as track samples: x is value, y is k."""
    return events(spark, sf_dir).select("event_id", "user_id", "video", "event_type", "t", F.col("value").alias("x"), F.col("k").cast("double").alias("y"))


PT = EV + ", pt AS (SELECT event_id, user_id, video, event_type, t, value AS x, k::DOUBLE AS y FROM ev)"
W = "(PARTITION BY user_id ORDER BY t, event_id)"


@catalog.add(PT + f""", n AS (SELECT *, row_number() OVER {W} AS rn, count(*) OVER (PARTITION BY user_id) AS c FROM pt),
 j AS (SELECT a.event_id, a.user_id, a.x, a.c, median(b.x) AS m FROM n a JOIN (SELECT user_id, rn, x, c FROM n UNION ALL SELECT user_id, -r AS rn, x, c FROM n, (VALUES (0), (1)) v(r) WHERE rn = 1 UNION ALL SELECT user_id, c + 1 + r, x, c FROM n, (VALUES (0), (1)) v(r) WHERE rn = c) b
  ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - 2 AND a.rn + 2 GROUP BY ALL) SELECT event_id, user_id, CASE WHEN c < 5 THEN x ELSE m END AS smoothed FROM j""")
def rolling_median_pad(spark, sf_dir):
    """Ends repeated."""
    return points(spark, sf_dir).select("event_id", "user_id", win.rolling_median_padded(win.ordered(TRACK, *ORDER), TRACK, "x").alias("smoothed"))


@catalog.add(PT + f" SELECT event_id, user_id, quantile_cont(x, 0.5) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smoothed FROM pt")
def rolling_median_shrink(spark, sf_dir):
    """Windows shrink at the ends."""
    return points(spark, sf_dir).select("event_id", "user_id", win.rolling_median_shrinking(win.ordered(TRACK, *ORDER), "x").alias("smoothed"))


VEL = f""", v AS (SELECT *, (last_value(x) OVER w - first_value(x) OVER w) / greatest(last_value(t) OVER w - first_value(t) OVER w, 1e-6) AS vx, (last_value(y) OVER w - first_value(y) OVER w) / greatest(last_value(t) OVER w - first_value(t) OVER w, 1e-6) AS vy
 FROM pt WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
 sp AS (SELECT *, sqrt(vx * vx + vy * vy) * 3600.0 AS speed, degrees(atan2(vy, vx)) + CASE WHEN degrees(atan2(vy, vx)) < 0 THEN 360.0 ELSE 0.0 END AS heading FROM v)"""


def moving(spark, sf_dir):
    """Samples with velocity; speed is by the hour."""
    w = win.ordered(TRACK, *ORDER)
    rows = points(spark, sf_dir).withColumns({"vx": win.velocity(w, "x", "t"), "vy": win.velocity(w, "y", "t")})
    return rows.withColumns({"speed": F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")) * 3600.0, "heading": circular.heading(F.col("vx"), F.col("vy"))})


@catalog.add(PT + VEL + " SELECT event_id, user_id, round(speed, 6) AS speed, round(heading, 4) AS heading FROM sp")
def track_velocity(spark, sf_dir):
    """W3, G9, D11."""
    return moving(spark, sf_dir).select("event_id", "user_id", r6("speed").alias("speed"), F.round("heading", 4).alias("heading"))


@catalog.add(PT + VEL + f""", b AS (SELECT *, speed <= 2.0 AS still FROM sp), o AS (SELECT *, CASE WHEN still IS DISTINCT FROM lag(still) OVER {W} THEN 1 ELSE 0 END AS ch FROM b), r AS (SELECT *, sum(ch) OVER {W} AS run FROM o)
 SELECT user_id, min(t) AS t0, max(t) AS t1, round(median(x), 6) AS x, median(y) AS y, count(*) AS n, round(max(t) - min(t), 6) AS dur FROM r WHERE still GROUP BY user_id, run HAVING max(t) - min(t) >= 3600.0""")
def stop_runs(spark, sf_dir):
    """W4, W5, D13."""
    out = tracks.stop_runs(moving(spark, sf_dir), TRACK, "speed", 2.0, 3600.0, ORDER)
    return out.withColumns({"dur": r6("dur"), "x": r6("x")})


@catalog.add(PT + VEL + f""", r AS (SELECT *, row_number() OVER {W} AS a, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS z FROM sp)
 SELECT user_id, count(*) AS n, min(t) AS t0, max(t) AS t1, round(avg(x) FILTER (a <= 3), 6) AS x0, round(avg(y) FILTER (a <= 3), 6) AS y0, round(avg(x) FILTER (z <= 3), 6) AS x1, round(avg(y) FILTER (z <= 3), 6) AS y1,
 round(median(speed) FILTER (speed > 2.0), 6) AS med_speed_moving, round(quantile_cont(speed, 0.85), 6) AS p85_speed, round(avg(CASE WHEN speed <= 2.0 THEN 1.0 ELSE 0.0 END), 6) AS frac_stopped, round(max(t) - min(t), 6) AS dur,
 round(sqrt(pow(avg(x) FILTER (z <= 3) - avg(x) FILTER (a <= 3), 2) + pow(avg(y) FILTER (z <= 3) - avg(y) FILTER (a <= 3), 2)), 6) AS disp FROM r GROUP BY user_id""")
def track_table(spark, sf_dir):
    """A15, D12, A25."""
    out = tracks.summaries(moving(spark, sf_dir), TRACK, ORDER, 2.0)
    return out.withColumns({c: r6(c) for c in ("x0", "y0", "x1", "y1", "med_speed_moving", "p85_speed", "frac_stopped", "dur", "disp")})


@catalog.add(EV + ", c AS (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c) SELECT user_id, event_type, n AS votes FROM r WHERE rn = 1")
def majority_class(spark, sf_dir):
    """A9."""
    return tracks.majority(events(spark, sf_dir), TRACK, "event_type")


@catalog.add(EV + """, b AS (SELECT DISTINCT CAST(floor(t / 21600.0) AS INT) AS bin, event_type, user_id FROM ev)
 SELECT CAST(s.i AS INT) AS bin, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS "view" FROM range(124) s(i) LEFT JOIN b ON b.bin = s.i GROUP BY s.i""")
def counts_per_bin(spark, sf_dir):
    """Distinct tracks by bin and class with an empty-bin spine."""
    return tracks.counts_per_bin(events(spark, sf_dir), "t", 21600.0, 124, "event_type", ["click", "error", "view"], "user_id")


@catalog.add(EV + """ SELECT CAST(floor(t / 86400.0) AS INT) AS bin, count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS vehicles, count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS persons,
 round(coalesce(avg(CASE WHEN event_type = 'view' THEN value END), 0.0), 6) AS mean_value FROM ev GROUP BY 1""")
def density(spark, sf_dir):
    """A12."""
    of = lambda kind, c: F.when(F.col("event_type") == kind, F.col(c))
    return events(spark, sf_dir).groupBy(F.floor(F.col("t") / 86400.0).cast("int").alias("bin")).agg(
        F.countDistinct(of("view", "user_id")).alias("vehicles"), F.countDistinct(of("click", "user_id")).alias("persons"),
        r6(F.coalesce(F.avg(of("view", "value")), F.lit(0.0))).alias("mean_value"),
    )


@catalog.add(PT + VEL + """, p AS (SELECT CAST(floor(x / 20) AS INT) AS i, CAST(floor(y / 20) AS INT) AS j, user_id, avg(cos(radians(heading))) AS c, avg(sin(radians(heading))) AS s, count(*) AS n FROM sp GROUP BY ALL),
 a AS (SELECT i, j, avg(c) AS ux, avg(s) AS uy, sum(n) AS n, count(*) AS tracks FROM p GROUP BY ALL) SELECT i, j, n::BIGINT AS n, tracks, round(sqrt(ux * ux + uy * uy), 6) AS coherence, round(ux, 6) AS ux, round(uy, 6) AS uy FROM a WHERE n >= 8 AND tracks >= 3""")
def direction_field(spark, sf_dir):
    """Two-level mean direction by cell."""
    rows = moving(spark, sf_dir).withColumns({"i": geometry.cell(F.col("x"), 20), "j": geometry.cell(F.col("y"), 20)})
    out = tracks.direction_field(rows, TRACK, ["i", "j"])
    return out.select("i", "j", "n", "tracks", r6("coherence").alias("coherence"), r6("ux").alias("ux"), r6("uy").alias("uy"))


@catalog.add(PT + " SELECT CAST(least(floor(x / 25), 11) AS INT) AS i, CAST(least(floor(y / 25), 3) AS INT) AS j, count(*) AS n FROM pt WHERE x BETWEEN 0 AND 300 AND y BETWEEN 0 AND 100 GROUP BY 1, 2")
def histogram2d(spark, sf_dir):
    """A13, P15."""
    return tracks.histogram2d(points(spark, sf_dir), "x", "y", 25.0, 300.0, 100.0)


@catalog.add(PT + f""", m AS (SELECT *, CASE WHEN t - lag(t) OVER {W} > 0 AND t - lag(t) OVER {W} <= 7200 THEN sqrt(pow(x - lag(x) OVER {W}, 2) + pow(y - lag(y) OVER {W}, 2)) / (t - lag(t) OVER {W}) END AS s FROM pt)
 SELECT event_id, round(s * 3600.0, 6) AS per_hour FROM m""")
def step_speed(spark, sf_dir):
    """W13, G11."""
    return tracks.recent_speed(points(spark, sf_dir), TRACK, 7200.0, ORDER).select("event_id", r6(F.col("step_speed") * 3600.0).alias("per_hour"))


@catalog.add(PT + """, m AS (SELECT *, sqrt(pow(last_value(x) OVER w - first_value(x) OVER w, 2) + pow(last_value(y) OVER w - first_value(y) OVER w, 2)) AS d, last_value(t) OVER w - first_value(t) OVER w AS e FROM pt WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 7200.0 PRECEDING AND 7200.0 FOLLOWING))
 SELECT event_id, round(d, 6) AS moved, round(e, 6) AS elapsed, e > 0 AND d >= 0.001 * e AS moving FROM m""")
def motion_range(spark, sf_dir):
    """First and last sample of a range frame."""
    moved, elapsed = win.movement(TRACK, ["x", "y"], "t", 7200.0)
    rows = points(spark, sf_dir).withColumns({"d": moved, "e": elapsed})
    return rows.select("event_id", r6("d").alias("moved"), r6("e").alias("elapsed"), ((F.col("e") > 0) & (F.col("d") >= 0.001 * F.col("e"))).alias("moving"))


@catalog.add(PT + f""", l AS (SELECT a.event_id, a.t, a.x, list({{'t': b.t, 'x': b.x}} ORDER BY b.t, b.event_id) AS past FROM (SELECT *, row_number() OVER {W} AS rn FROM pt) a LEFT JOIN (SELECT *, row_number() OVER {W} AS rn FROM pt) b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - 4 AND a.rn - 1 GROUP BY ALL)
 SELECT event_id, round(x - (list_filter(past, lambda p: t - p.t > 0 AND t - p.t <= 14400.0)[1]).x, 6) AS dx FROM l""")
def recent_motion(spark, sf_dir):
    """From the oldest of the last four samples within reach."""
    dx, _ = win.recent_motion(win.ordered(TRACK, *ORDER), ["x", "y"], "t", 4, 14400.0)
    return points(spark, sf_dir).select("event_id", dx.alias("dx")).withColumn("dx", r6("dx"))


@catalog.add(PT + f""", g AS (SELECT *, x - 40.0 AS side, (y - 10.0) / 80.0 AS pl, lead(x - 40.0) OVER {W} AS nside, lead((y - 10.0) / 80.0) OVER {W} AS npl, lead(t) OVER {W} AS nt FROM pt)
 SELECT user_id, min(nt) AS t FROM g WHERE side * nside < 0 AND (pl BETWEEN 0 AND 1 OR npl BETWEEN 0 AND 1) AND nside > side GROUP BY user_id""")
def gate_crossings(spark, sf_dir):
    """First directed crossing of the gate x = 40, y from 10 to 90, to the right."""
    return tracks.gate_crossings(points(spark, sf_dir), TRACK, ((40.0, 10.0), (40.0, 90.0)), (1.0, 0.0), ORDER)


@catalog.add(PT + VEL + f""", m AS (SELECT *, row_number() OVER {W} AS a, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS z FROM sp WHERE speed > 2.0),
 h AS (SELECT user_id, count(*) AS n, avg(vx) FILTER (a <= 5) AS ax, avg(vy) FILTER (a <= 5) AS ay, avg(vx) FILTER (z <= 5) AS zx, avg(vy) FILTER (z <= 5) AS zy FROM m GROUP BY user_id HAVING count(*) >= 10),
 d AS (SELECT user_id, n, degrees(atan2(zy, zx)) - degrees(atan2(ay, ax)) AS raw FROM h), c AS (SELECT user_id, n, CASE WHEN raw > 180 THEN raw - 360 WHEN raw <= -180 THEN raw + 360 ELSE raw END AS change FROM d)
 SELECT user_id, n, round(change, 4) AS change, CASE WHEN abs(change) < 35 THEN 'straight' WHEN abs(change) > 140 THEN 'u-turn' WHEN change > 0 THEN 'right' ELSE 'left' END AS kind FROM c""")
def turn_kinds(spark, sf_dir):
    """W26, A17."""
    return tracks.turns(moving(spark, sf_dir), TRACK, ORDER, 2.0).withColumn("change", F.round("change", 4))


def _edge_sql(e):
    x, y, dx, dy = e
    u = f"greatest(0.0, least(1.0, ((x - {x}) * {dx} + (y - {y}) * {dy}) / {dx * dx + dy * dy}))"
    return f"sqrt((x - ({x} + {u} * {dx})) * (x - ({x} + {u} * {dx})) + (y - ({y} + {u} * {dy})) * (y - ({y} + {u} * {dy})))"


def _edge_rows():
    return ", ".join(f"({z}, {x}, {y}, {dx}, {dy})" for z, p in enumerate(ZONES) for x, y, dx, dy in geometry.edges(p))


@catalog.add(PT + f""", ed(z, ex, ey, dx, dy) AS (SELECT z, ex::DOUBLE, ey::DOUBLE, dx::DOUBLE, dy::DOUBLE FROM (VALUES {_edge_rows()}) v(z, ex, ey, dx, dy)),
 al AS (SELECT event_id, x, y, ed.*, greatest(0.0, least(1.0, ((x - ex) * dx + (y - ey) * dy) / (dx * dx + dy * dy))) AS u FROM pt, ed),
 zo AS (SELECT event_id, z, min(sqrt(pow(x - (ex + u * dx), 2) + pow(y - (ey + u * dy), 2))) AS d, sum(CASE WHEN dy <> 0 AND ((ey > y) <> (ey + dy > y)) AND x < dx * (y - ey) / CASE WHEN dy = 0 THEN 1 ELSE dy END + ex THEN 1 ELSE 0 END) % 2 = 1 AS o FROM al GROUP BY event_id, z),
 fi AS (SELECT event_id, z, o OR d = 0 AS i, round(CASE WHEN o THEN d ELSE 0.0 - d END, 6) + 0.0 AS s FROM zo)
 SELECT event_id, """ + ", ".join(f"bool_or(i) FILTER (z = {k}) AS in{k}, max(s) FILTER (z = {k}) AS d{k}" for k in range(3)) + " FROM fi GROUP BY event_id")
def point_in_polygon(spark, sf_dir):
    """G1, G2, J7, J8."""
    x, y = F.col("x"), F.col("y")
    cols = [c for i, p in enumerate(ZONES) for c in (geometry.inside(x, y, p).alias(f"in{i}"), (r6(geometry.signed_distance(x, y, p)) + 0.0).alias(f"d{i}"))]
    return points(spark, sf_dir).select("event_id", *cols)


@catalog.add(PT + VEL + ", f AS (SELECT *, sqrt(vx * vx + vy * vy) * 1e3 AS len FROM sp), e AS (" + " UNION ALL ".join(
    f"SELECT event_id, len, {z} AS z, {i} AS i, {_edge_sql(e)} AS d, abs(vx * 1e3 * {e[2]} + vy * 1e3 * {e[3]}) / {(e[2] ** 2 + e[3] ** 2) ** 0.5} AS a FROM f" for z, p in enumerate(ZONES) for i, e in enumerate(geometry.edges(p))
) + "), n AS (SELECT *, row_number() OVER (PARTITION BY event_id, z ORDER BY d, i) AS rn FROM e) SELECT event_id, bool_or(len >= 1e-6 AND d <= 8.0 AND a >= 0.866 * len) AS follows FROM n WHERE rn = 1 GROUP BY event_id")
def follows_edge(spark, sf_dir):
    """G3."""
    rows = moving(spark, sf_dir)
    return rows.select("event_id", geometry.follows_edge(F.col("x"), F.col("y"), F.col("vx") * 1e3, F.col("vy") * 1e3, ZONES, F.lit(8.0)).alias("follows"))


@catalog.add(PT + """, q AS (SELECT event_id, (1.1 * x + 0.05 * y + 3.0) / (0.0001 * x + 0.0002 * y + 1.0) AS u, (0.02 * x + 0.9 * y - 2.0) / (0.0001 * x + 0.0002 * y + 1.0) AS v,
 (1.1 * (x + 0.1) + 0.05 * (y + 0.2) + 3.0) / (0.0001 * (x + 0.1) + 0.0002 * (y + 0.2) + 1.0) AS u1, (0.02 * (x + 0.1) + 0.9 * (y + 0.2) - 2.0) / (0.0001 * (x + 0.1) + 0.0002 * (y + 0.2) + 1.0) AS v1 FROM pt)
 SELECT event_id, round(u, 6) AS u, round(v, 6) AS v, round((u1 - u) / 0.1, 5) AS vu, round((v1 - v) / 0.1, 5) AS vv FROM q""")
def homography(spark, sf_dir):
    """G5, G6, D16."""
    x, y = F.col("x"), F.col("y")
    u, v = geometry.homography(x, y, H)
    vu, vv = geometry.homography_velocity(x, y, F.lit(1.0), F.lit(2.0), H)
    return points(spark, sf_dir).select("event_id", r6(u).alias("u"), r6(v).alias("v"), F.round(vu, 5).alias("vu"), F.round(vv, 5).alias("vv"))


BOX = EV + """, bx AS (SELECT event_id, video, event_type, CAST(floor(t / 1800.0) AS BIGINT) AS frame, value AS x1, k::DOUBLE AS y1, value + 5.0 + k % 7 * 10.0 AS x2, k + 5.0 + event_id % 11 * 8.0 AS y2 FROM ev)"""


def boxes(spark, sf_dir):
    k = F.col("k")
    return events(spark, sf_dir).select(
        "event_id", "video", "event_type", F.floor(F.col("t") / 1800.0).alias("frame"), F.col("value").alias("x1"), k.cast("double").alias("y1"),
        (F.col("value") + 5.0 + k % 7 * 10.0).alias("x2"), (k + 5.0 + F.col("event_id") % 11 * 8.0).alias("y2"),
    )


@catalog.add(BOX + """ SELECT p.event_id FROM bx p WHERE p.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM bx v WHERE v.event_type IN ('view', 'error') AND v.video = p.video AND v.frame = p.frame
  AND (p.x1 + p.x2) / 2 BETWEEN v.x1 AND v.x2 AND (p.y1 + p.y2) / 2 BETWEEN v.y1 AND v.y2 AND v.y2 > v.y1 AND greatest(0.0, least(p.x2, v.x2) - greatest(p.x1, v.x1)) * greatest(0.0, least(p.y2, v.y2) - greatest(p.y1, v.y1)) / ((p.x2 - p.x1) * (p.y2 - p.y1)) >= 0.85
  AND (p.y2 - v.y1) / (v.y2 - v.y1) <= 0.75)""")
def occupant_antijoin(spark, sf_dir):
    """People not riding inside a vehicle of the same frame."""
    bx = boxes(spark, sf_dir)
    p, v = bx.where("event_type = 'click'").alias("p"), bx.where("event_type in ('view', 'error')").alias("v")
    cols = lambda a: [F.col(f"{a}.{c}") for c in ("x1", "y1", "x2", "y2")]
    on = (F.col("p.video") == F.col("v.video")) & (F.col("p.frame") == F.col("v.frame")) & geometry.rides_inside(cols("p"), cols("v"))
    return p.join(v, on, "left_anti").select("p.event_id")


@catalog.add(BOX + """, pr AS (SELECT a.event_id AS a_id, b.event_id AS b_id, (b.x1 + b.x2) / 2 - (a.x1 + a.x2) / 2 AS dx, b.y2 - a.y2 AS dy, greatest(2.0, (a.x2 - a.x1) * 0.45) + greatest(2.0, (b.x2 - b.x1) * 0.45) AS rx, greatest(2.0, (a.y2 - a.y1) * 0.12) + greatest(2.0, (b.y2 - b.y1) * 0.12) AS ry
   FROM bx a JOIN bx b ON a.video = b.video AND a.frame = b.frame AND a.event_id < b.event_id),
 q AS (SELECT a_id, b_id, dx / rx AS px, dy / ry AS py, -dx / 4.0 / rx AS ux, -dy / 4.0 / ry AS uy FROM pr), s AS (SELECT *, ux * ux + uy * uy AS a, 2 * (px * ux + py * uy) AS b, px * px + py * py - 1 AS c FROM q),
 e AS (SELECT a_id, b_id, CASE WHEN a >= 0.04 AND b < 0 AND c > 0 AND b * b - 4 * a * c >= 0 THEN (-b - sqrt(b * b - 4 * a * c)) / (2 * a) END AS ttc FROM s)
 SELECT a_id, b_id, round(CASE WHEN ttc > 0 AND ttc <= 5 THEN ttc END, 6) AS ttc FROM e""")
def pair_ttc(spark, sf_dir):
    """All unordered pairs of a frame."""
    bx = boxes(spark, sf_dir)
    a, b = bx.alias("a"), bx.alias("b")
    fa, fb = (geometry.footprint([F.col(f"{n}.{c}") for c in ("x1", "y1", "x2", "y2")], F.lit(False)) for n in "ab")
    pairs = a.join(b, (F.col("a.video") == F.col("b.video")) & (F.col("a.frame") == F.col("b.frame")) & (F.col("a.event_id") < F.col("b.event_id")))
    dx, dy = fb[0] - fa[0], fb[1] - fa[1]
    ttc = geometry.time_to_contact(dx, dy, -dx / 4.0, -dy / 4.0, fa[2] + fb[2], fa[3] + fb[3])
    return pairs.select(F.col("a.event_id").alias("a_id"), F.col("b.event_id").alias("b_id"), r6(ttc).alias("ttc"))


@catalog.add(BOX + """, pe AS (SELECT event_id % 50 AS person, video, frame, (x1 + x2) / 2 AS x, y2 AS y FROM bx WHERE event_type = 'click'), cy AS (SELECT * FROM bx WHERE event_type = 'view'),
 hi AS (SELECT person, count(*) AS hits FROM (SELECT DISTINCT pe.person, pe.video, pe.frame FROM pe JOIN cy ON pe.video = cy.video AND pe.frame = cy.frame AND pe.x BETWEEN cy.x1 AND cy.x2 AND pe.y >= cy.y1 AND pe.y <= cy.y2 + 0.25 * (cy.y2 - cy.y1)) GROUP BY 1)
 SELECT person, n, hits FROM (SELECT person, count(*) AS n FROM pe GROUP BY 1) JOIN hi USING (person) WHERE hits >= 0.05 * n""")
def riders(spark, sf_dir):
    """J13."""
    bx = boxes(spark, sf_dir)
    people = tracks.ground_points(bx.where("event_type = 'click'")).withColumn("person", F.col("event_id") % 50)
    return tracks.riders(people, bx.where("event_type = 'view'"), ["video", "frame"], ["person"], 0.05)


@catalog.add(PT + f""", o AS (SELECT *, t - lag(t) OVER {W} > 14400.0 OR lag(t) OVER {W} IS NULL OR x > 60.0 OR lag(x) OVER {W} > 60.0 AS br FROM pt), e AS (SELECT *, sum(CASE WHEN br THEN 1 ELSE 0 END) OVER {W} AS ep FROM o)
 SELECT user_id, min(t) AS start_s, max(t) AS last_s, count(*) AS n, round(sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)), 6) AS extent FROM e WHERE x <= 60.0 GROUP BY user_id, ep HAVING count(*) >= 2""")
def episodes(spark, sf_dir):
    """Runs broken by a gap or a sample that does not count."""
    from trackloom.operators.intervals import islands

    w = win.ordered(TRACK, *ORDER)
    br = (F.col("t") - F.lag("t").over(w) > 14400.0) | F.lag("t").over(w).isNull() | (F.col("x") > 60.0) | (F.lag("x").over(w) > 60.0)
    rows = islands(points(spark, sf_dir), TRACK, ORDER, br, "ep").where("x <= 60.0")
    out = rows.groupBy("user_id", "ep").agg(F.min("t").alias("start_s"), F.max("t").alias("last_s"), F.count("*").alias("n"), r6(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).alias("extent"))
    return out.where("n >= 2").drop("ep")


@catalog.add(PT.replace("WITH ev", "WITH RECURSIVE ev", 1) + """, s AS (SELECT user_id, t, x, y, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn FROM (SELECT DISTINCT ON (user_id, t) * FROM pt ORDER BY user_id, t, event_id)),
 st AS (SELECT a.user_id, a.t AS s, (SELECT min(b.t) FROM s b WHERE b.user_id = a.user_id AND b.t >= a.t + 16200.0) AS e FROM s a),
 ok AS (SELECT st.user_id, st.s, st.e FROM st JOIN s b ON b.user_id = st.user_id AND b.t BETWEEN st.s AND st.e WHERE st.e IS NOT NULL GROUP BY ALL HAVING max(b.x) - min(b.x) <= 45.0 AND max(b.y) - min(b.y) <= 60.0)
 SELECT DISTINCT b.user_id, b.t FROM s b JOIN ok ON ok.user_id = b.user_id AND b.t BETWEEN ok.s AND ok.e""")
def dwell(spark, sf_dir):
    """Samples of forward windows that stay within a spread."""
    rows = points(spark, sf_dir)
    first = rows.groupBy("user_id", "t").agg(F.min_by(F.struct("x", "y"), "event_id").alias("p")).select("user_id", "t", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    cols = {f"{f}{c}": win.within(f"{fn}({c})", TRACK, "t", 0, 16200.0) for c in ("x", "y") for f, fn in (("lo", "min"), ("hi", "max"))}
    win_rows = first.withColumns(cols).withColumn("e", win.within("first(t)", TRACK, "t", 16200.0, None))
    ends = first.select("user_id", F.col("t").alias("e"), F.col("x").alias("ex"), F.col("y").alias("ey"))
    ok = win_rows.join(ends, ["user_id", "e"]).where("greatest(hix, ex) - least(lox, ex) <= 45.0 and greatest(hiy, ey) - least(loy, ey) <= 60.0").select("user_id", F.col("t").alias("s"), "e")
    return first.select("user_id", "t").join(ok, "user_id").where("t between s and e").select("user_id", "t").distinct()


@catalog.add("SELECT l_orderkey % 7 AS grp, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1")
def linear_fit(spark, sf_dir):
    """A22."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 7).alias("grp")).agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"))
