"""Queries of state timelines, scene maps, statistics and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import circular, scalars
from trackloom.operators import clusters, scene, signal, stats
from trackloom.operators import windows as win
from trackloom.plans.common import EV, Catalog, events, r6, read
from trackloom.plans.track_queries import PT, VEL, moving, points

catalog = Catalog()

# samples of a timeline: a frame is a minute, a state comes from the event type, errors are unseen
SM = EV + """, sm0 AS (SELECT video, CAST(floor(t / 60.0) AS BIGINT) AS frame, max_by(event_type, event_id) AS et, max_by(value, event_id) AS value FROM ev GROUP BY ALL),
 sm AS (SELECT video, frame, value, CASE et WHEN 'view' THEN 'green' WHEN 'click' THEN 'green' WHEN 'signup' THEN 'red' WHEN 'purchase' THEN 'amber' ELSE 'unknown' END AS state, CASE WHEN et = 'error' THEN 'occluded' ELSE 'observed' END AS observation FROM sm0)"""


def samples(spark, sf_dir):
    ev = events(spark, sf_dir).groupBy("video", F.floor(F.col("t") / 60.0).alias("frame")).agg(F.max_by("event_type", "event_id").alias("et"), F.max_by("value", "event_id").alias("value"))
    state = F.when(F.col("et").isin("view", "click"), "green").when(F.col("et") == "signup", "red").when(F.col("et") == "purchase", "amber").otherwise("unknown")
    return ev.select("video", "frame", "value", state.alias("state"), F.when(F.col("et") == "error", "occluded").otherwise("observed").alias("observation"))


TL = SM + """, e AS (SELECT *, coalesce(lead(frame) OVER (PARTITION BY video ORDER BY frame), 43200) AS end_frame, observation = 'observed' AND state <> 'unknown' AS known FROM sm),
 r AS (SELECT *, sum(CASE WHEN ch THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY frame) AS run FROM (SELECT *, known IS DISTINCT FROM lag(known) OVER (PARTITION BY video ORDER BY frame) AS ch FROM e)),
 b AS (SELECT *, last_value(CASE WHEN known THEN state END IGNORE NULLS) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bf, first_value(CASE WHEN known THEN state END IGNORE NULLS) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS af,
   max(end_frame) OVER (PARTITION BY video, run) - min(frame) OVER (PARTITION BY video, run) AS len FROM r),
 l AS (SELECT *, coalesce(NOT known AND len <= 30 AND bf = af, false) AS imputed FROM b), m AS (SELECT *, CASE WHEN known THEN state WHEN imputed THEN bf ELSE 'unknown' END AS label FROM l),
 n AS (SELECT *, frame - lag(frame) OVER (PARTITION BY video ORDER BY frame) AS step, sum(CASE WHEN c2 THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY frame) AS run2 FROM (SELECT *, label IS DISTINCT FROM lag(label) OVER (PARTITION BY video ORDER BY frame) AS c2 FROM m)),
 g AS (SELECT video, run2, min(frame) AS start_frame, max(end_frame) AS end_frame, min(label) AS state, count(*) AS n_samples, count(*) FILTER (known) AS n_observed, count(*) FILTER (imputed) AS n_imputed, coalesce(first(step ORDER BY frame), 0) AS u FROM n GROUP BY video, run2),
 tl AS (SELECT video, start_frame, end_frame, state, n_samples, n_observed, n_imputed, CASE WHEN state = 'unknown' THEN n_samples - n_observed - n_imputed ELSE 0 END AS n_unobserved, n_imputed > 0 AS imputed,
   u + CASE WHEN lag(state) OVER w = 'unknown' AND state <> 'unknown' THEN lag(end_frame - start_frame) OVER w ELSE 0 END AS start_uncertainty_frames FROM g WINDOW w AS (PARTITION BY video ORDER BY start_frame))"""


def timeline(spark, sf_dir):
    return signal.state_intervals(samples(spark, sf_dir), ["video"], 43200).drop("start_t", "end_t", "duration_s")


@catalog.add(TL + " SELECT * FROM tl")
def interval_tiling(spark, sf_dir):
    """W20, D19."""
    return timeline(spark, sf_dir)


@catalog.add(TL + ", c AS (SELECT state AS \"from\", lead(state) OVER (PARTITION BY video ORDER BY start_frame) AS \"to\" FROM tl) SELECT \"from\", \"to\", count(*) AS n FROM c WHERE \"to\" IS NOT NULL GROUP BY ALL")
def transitions(spark, sf_dir):
    """A37, W23."""
    return signal.transitions(timeline(spark, sf_dir), ["video"], "start_frame", "state")


@catalog.add(TL + """, c AS (SELECT state AS "from", lead(state) OVER (PARTITION BY video ORDER BY start_frame) AS "to" FROM tl), f AS (SELECT CASE WHEN "from" = 'green' THEN 'G' ELSE "from" END AS "from", CASE WHEN "to" = 'green' THEN 'G' ELSE "to" END AS "to" FROM c WHERE "to" IS NOT NULL)
 SELECT "from", "to", count(*) AS n FROM f WHERE NOT (("from" = 'G' AND "to" = 'amber') OR ("from" = 'amber' AND "to" = 'red') OR ("from" = 'red' AND "to" = 'G')) GROUP BY ALL""")
def illegal_transitions(spark, sf_dir):
    """Changes outside the legal table."""
    rows = timeline(spark, sf_dir).withColumn("state", F.when(F.col("state") == "green", "G").otherwise(F.col("state")))
    return signal.illegal(signal.transitions(rows, ["video"], "start_frame", "state"))


@catalog.add(TL + """, c AS (SELECT *, lag(state) OVER w AS a, lead(state) OVER w AS z FROM tl WINDOW w AS (PARTITION BY video ORDER BY start_frame))
 SELECT state, count(*) AS n, round(avg(end_frame - start_frame), 6) AS mean_frames FROM c WHERE state <> 'unknown' AND a <> 'unknown' AND z <> 'unknown' GROUP BY state""")
def complete_phases(spark, sf_dir):
    """A38."""
    rows = signal.complete_phases(timeline(spark, sf_dir), ["video"], "start_frame", "state")
    return rows.groupBy("state").agg(F.count("*").alias("n"), r6(F.avg(F.col("end_frame") - F.col("start_frame"))).alias("mean_frames"))


@catalog.add(TL + """, a AS (SELECT video, sum(end_frame - start_frame) AS al, sum(CASE WHEN state <> 'unknown' THEN end_frame - start_frame ELSE 0 END) AS kn FROM tl GROUP BY video)
 SELECT tl.video, state, round(sum(end_frame - start_frame) / max(al), 6) AS share, round(max(kn) / max(al), 6) AS coverage FROM tl JOIN a USING (video) GROUP BY tl.video, state""")
def state_share(spark, sf_dir):
    """A18, A36."""
    return signal.coverage(timeline(spark, sf_dir), ["video"]).withColumns({c: r6(c) for c in ("share", "coverage")})


ON = TL + """, k AS (SELECT *, last_value(CASE WHEN state <> 'unknown' THEN state END IGNORE NULLS) OVER (PARTITION BY video ORDER BY start_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM tl),
 ons AS (SELECT video, start_frame, previous FROM k WHERE state = 'green' AND previous IN ('red', 'amber'))"""


@catalog.add(ON + " SELECT video, start_frame, previous FROM ons")
def state_onsets(spark, sf_dir):
    """Entries into green from red or amber, looking past unknown stretches."""
    return signal.onsets(timeline(spark, sf_dir), ["video"], "start_frame", "state", "green", ["red", "amber"]).select("video", "start_frame", "previous")


@catalog.add(ON + """, gp AS (SELECT video, start_frame::DOUBLE AS t, start_frame::DOUBLE - lag(start_frame::DOUBLE) OVER (PARTITION BY video ORDER BY start_frame) AS gap FROM ons), u AS (SELECT *, min(gap) OVER (PARTITION BY video) AS unit FROM gp),
 kk AS (SELECT video, t, coalesce(sum(round(gap / unit)) OVER (PARTITION BY video ORDER BY t), 0.0) AS k FROM u), f AS (SELECT video, regr_slope(t, k) AS cycle, regr_intercept(t, k) AS start, count(*) AS n FROM kk GROUP BY video)
 SELECT f.video, round(max(cycle), 5) AS cycle, round(max(start), 4) AS start, max(n) AS n, round(max(abs(t - start - cycle * k)), 4) AS residual FROM f JOIN kk USING (video) GROUP BY f.video""")
def onsets_cycle_fit(spark, sf_dir):
    """A40."""
    rows = state_onsets(spark, sf_dir).select("video", F.col("start_frame").cast("double").alias("t"))
    return signal.cycle_fit(rows, ["video"], "t").select("video", F.round("cycle", 5).alias("cycle"), F.round("start", 4).alias("start"), "n", F.round("residual", 4).alias("residual"))


@catalog.add(EV + ", p AS (SELECT t - 100.0 AS d FROM ev WHERE event_type = 'view'), q AS (SELECT d - 3600.0 * floor(d / 3600.0) AS ph FROM p) SELECT CAST(least(floor(ph / 300.0), 11) AS INT) AS bin, count(*) AS n FROM q GROUP BY 1")
def phase_hist(spark, sf_dir):
    """G19, A41."""
    return signal.phase_histogram(events(spark, sf_dir).where("event_type = 'view'"), "t", 100.0, 3600.0, 12)


@catalog.add(SM + ", o AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY video ORDER BY frame) THEN 1 ELSE 0 END AS c FROM sm), r AS (SELECT *, sum(c) OVER (PARTITION BY video ORDER BY frame) AS run FROM o) SELECT video, run::BIGINT AS run, min(frame) AS a, max(frame) AS b, count(*) AS n, min(state) AS state FROM r GROUP BY video, run")
def value_runs(spark, sf_dir):
    """W4."""
    from trackloom.operators.intervals import value_runs as runs

    return runs(samples(spark, sf_dir), ["video"], ["frame"], "state").groupBy("video", "run").agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.count("*").alias("n"), F.min("state").alias("state"))


@catalog.add(SM + ", n AS (SELECT *, CASE WHEN observation = 'observed' THEN state END AS s FROM sm) SELECT video, frame, last_value(s IGNORE NULLS) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM n")
def carry_forward(spark, sf_dir):
    """W15, W16."""
    rows = samples(spark, sf_dir).withColumn("s", F.when(F.col("observation") == "observed", F.col("state")))
    return rows.select("video", "frame", win.carried(win.ordered(["video"], "frame"), "s").alias("filled"))


@catalog.add(SM + """, w AS (SELECT a.video, a.frame, b.state, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame) AS rn FROM sm) a JOIN (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame) AS rn FROM sm) b ON a.video = b.video AND b.rn BETWEEN a.rn - 4 AND a.rn + 4 GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY n DESC, state) AS r FROM w) SELECT video, frame, state AS mode FROM k WHERE r = 1""")
def moving_mode(spark, sf_dir):
    """W19."""
    return win.moving_mode(samples(spark, sf_dir), ["video"], "frame", "state").select("video", "frame", "mode")


@catalog.add(SM + ", c AS (SELECT video, frame, 100.0 * (value - lag(value, 15) OVER (PARTITION BY video ORDER BY frame)) / nullif(lag(value, 15) OVER (PARTITION BY video ORDER BY frame), 0) AS change FROM sm), k AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY abs(change) DESC, frame) AS r FROM c WHERE change IS NOT NULL) SELECT video, frame, round(change, 6) AS change FROM k WHERE r = 1")
def pct_change_lag(spark, sf_dir):
    """Largest relative change at lag 15, the first of equals."""
    rows = samples(spark, sf_dir).withColumn("change", win.percent_change(win.ordered(["video"], "frame"), "value", 15)).where("change is not null")
    best = rows.groupBy("video").agg(F.max(F.struct(F.abs("change").alias("a"), (-F.col("frame")).alias("f"), F.col("change").alias("c"))).alias("b"))
    return best.select("video", (-F.col("b.f")).alias("frame"), r6("b.c").alias("change"))


@catalog.add(SM + " SELECT video, count(*) FILTER (c) AS n_changes, count(DISTINCT state) AS n_states FROM (SELECT *, coalesce(state <> lag(state) OVER (PARTITION BY video ORDER BY frame), true) AS c FROM sm) GROUP BY video")
def change_counts(spark, sf_dir):
    """W24, A27."""
    rows = samples(spark, sf_dir).withColumn("c", win.changed(win.ordered(["video"], "frame"), "state"))
    return rows.groupBy("video").agg(F.count_if("c").alias("n_changes"), F.countDistinct("state").alias("n_states"))


@catalog.add(PT + VEL + """ SELECT CAST(floor(x / 30) AS INT) AS i, CAST(floor(y / 30) AS INT) AS j, count(*) AS n, round(degrees(atan2(avg(sin(radians(heading))), avg(cos(radians(heading))))) + CASE WHEN degrees(atan2(avg(sin(radians(heading))), avg(cos(radians(heading))))) < 0 THEN 360 ELSE 0 END, 4) AS mean,
 round(sqrt(pow(avg(sin(radians(heading))), 2) + pow(avg(cos(radians(heading))), 2)), 6) AS coherence FROM sp GROUP BY 1, 2""")
def circular_mean(spark, sf_dir):
    """A28, G8, A29."""
    rows = moving(spark, sf_dir)
    return rows.groupBy(F.floor(F.col("x") / 30).cast("int").alias("i"), F.floor(F.col("y") / 30).cast("int").alias("j")).agg(
        F.count("*").alias("n"), F.round(circular.mean_heading(F.col("heading")), 4).alias("mean"), r6(circular.resultant(F.col("heading"))).alias("coherence"))


CELLS = PT + ", ce AS (SELECT DISTINCT CAST(floor(x / 10) AS INT) AS i, CAST(floor(y / 10) AS INT) AS j FROM pt WHERE x > 60)"


def cells(spark, sf_dir):
    rows = points(spark, sf_dir).where("x > 60")
    return rows.select(F.floor(F.col("x") / 10).cast("int").alias("i"), F.floor(F.col("y") / 10).cast("int").alias("j")).distinct()


@catalog.add(CELLS + " SELECT a.i, a.j, count(*) AS n FROM ce a JOIN ce b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND (a.i <> b.i OR a.j <> b.j) GROUP BY a.i, a.j")
def cell_neighbours(spark, sf_dir):
    """J24."""
    return scene.neighbours(cells(spark, sf_dir)).groupBy("i", "j").agg(F.count("*").alias("n"))


@catalog.add(CELLS.replace("WITH ev", "WITH RECURSIVE ev", 1) + """, re(i0, j0, i, j) AS (SELECT i, j, i, j FROM ce UNION SELECT r.i0, r.j0, c.i, c.j FROM re r JOIN ce c ON abs(r.i - c.i) <= 1 AND abs(r.j - c.j) <= 1)
 SELECT i0 AS i, j0 AS j, min((i, j))[1] AS root_i, min((i, j))[2] AS root_j FROM re GROUP BY i0, j0""")
def cell_components(spark, sf_dir):
    """F8."""
    return scene.grid_components(cells(spark, sf_dir))


@catalog.add(PT + ", d AS (SELECT DISTINCT user_id, CAST(floor(x / 10) AS INT) AS i, CAST(floor(y / 10) AS INT) AS j FROM pt) SELECT i, j, count(*) AS tracks FROM d GROUP BY ALL HAVING count(*) >= 2")
def distinct_density(spark, sf_dir):
    """A32, A23, O9."""
    rows = points(spark, sf_dir).withColumns({"i": F.floor(F.col("x") / 10).cast("int"), "j": F.floor(F.col("y") / 10).cast("int")})
    return scene.distinct_density(rows, ["user_id"], ["i", "j"])


@catalog.add(PT + ", c AS (SELECT CAST(floor(x / 10) AS INT) AS i, CAST(floor(y / 10) AS INT) AS j, count(*) AS n, count(DISTINCT user_id) AS tracks, avg(y) AS m FROM pt GROUP BY 1, 2) SELECT i, j, coalesce(nullif(concat_ws('+', CASE WHEN n < 8 THEN 'thin' END, CASE WHEN tracks < 5 THEN 'few_tracks' END, CASE WHEN i > 15 THEN 'at_edge' END), ''), 'ok') AS status, CAST(n < 8 AS INT) + CAST(tracks < 5 AS INT) + CAST(i > 15 AS INT) AS n_blockers FROM c")
def blockers(spark, sf_dir):
    """P17, P18, A31."""
    rows = points(spark, sf_dir).groupBy(F.floor(F.col("x") / 10).cast("int").alias("i"), F.floor(F.col("y") / 10).cast("int").alias("j")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("tracks"))
    flags = ((F.col("n") < 8, "thin"), (F.col("tracks") < 5, "few_tracks"), (F.col("i") > 15, "at_edge"))
    return rows.select("i", "j", scalars.reasons(*flags).alias("status"), F.size(scalars.codes(*flags)).alias("n_blockers"))


def heading_modes(spark, sf_dir):
    """Rows only; greedy modes have no SQL form."""
    rows = moving(spark, sf_dir).withColumns({"i": F.floor(F.col("x") / 30).cast("int"), "j": F.floor(F.col("y") / 30).cast("int")})
    return scene.heading_modes(rows, ["i", "j"], least=8, share=0.15)


catalog.add()(heading_modes)


@catalog.add(EV + " SELECT user_id % 10 AS grp, count(*) AS n, round(corr(value, k), 6) AS r FROM ev WHERE event_type <> 'error' GROUP BY 1")
def corr_masked(spark, sf_dir):
    """A19."""
    ev = events(spark, sf_dir).withColumn("grp", F.col("user_id") % 10)
    return stats.masked_correlation(ev, ["grp"], "value", "k", F.col("event_type") != "error").select("grp", "n", r6("r").alias("r"))


RATES = EV + ", o AS (SELECT DISTINCT video, t FROM ev WHERE event_type = 'signup'), e AS (SELECT video, t FROM ev WHERE event_type = 'click')"


@catalog.add(RATES + """, u AS (SELECT * FROM o WHERE t - 7200 >= 0 AND t + 3600 <= 2592000)
 SELECT u.video, u.t AS onset, count(e.t) FILTER (e.t < u.t) AS pre, count(e.t) FILTER (e.t >= u.t) AS post, round(count(e.t) FILTER (e.t >= u.t) / 3600.0 - count(e.t) FILTER (e.t < u.t) / 7200.0, 9) AS effect FROM u LEFT JOIN e ON e.video = u.video AND e.t >= u.t - 7200 AND e.t < u.t + 3600 GROUP BY u.video, u.t""")
def window_rates(spark, sf_dir):
    """R1."""
    ev = events(spark, sf_dir)
    onsets = ev.where("event_type = 'signup'").select("video", "t").distinct()
    return stats.window_rates(onsets, ev.where("event_type = 'click'"), ["video"], 7200.0, 3600.0, 2592000.0).withColumn("effect", F.round("effect", 9))


@catalog.add(EV + " SELECT event_type, round(sum(value * k) / sum(k), 6) AS pooled FROM ev GROUP BY 1")
def pooled_mean(spark, sf_dir):
    """R2."""
    return stats.pooled(events(spark, sf_dir), ["event_type"], "value", "k").withColumn("pooled", r6("pooled"))


@catalog.add(RATES + """, d AS (SELECT range AS draw FROM range(21)), m AS (SELECT e.video, d.draw, CASE WHEN d.draw = 0 THEN e.t ELSE (e.t + d.draw * 97003.0) - 2592000.0 * floor((e.t + d.draw * 97003.0) / 2592000.0) END AS t FROM e, d)
 SELECT CAST(d.draw AS INT) AS draw, count(o.t) AS hits FROM d LEFT JOIN (SELECT m.draw, o.t FROM m JOIN o ON o.video = m.video AND m.t >= o.t AND m.t < o.t + 1800.0) o ON o.draw = d.draw GROUP BY d.draw""")
def perm_null(spark, sf_dir):
    """Joint circular shifts by arithmetic seeds."""
    ev = events(spark, sf_dir)
    onsets = ev.where("event_type = 'signup'").select("video", "t").distinct()
    return stats.circular_shift_null(onsets, ev.where("event_type = 'click'"), ["video"], 1800.0, 2592000.0, 20, F.col("draw") * 97003.0)


@catalog.add(EV + """, w AS (SELECT CAST(k AS INT) AS win, avg(value) FILTER (user_id % 2 = 0) AS a, avg(value) FILTER (user_id % 2 = 1) AS b FROM ev GROUP BY 1) SELECT win, round(a, 6) AS train_value, round(b, 6) AS test_value FROM w WHERE a IS NOT NULL ORDER BY a DESC, win LIMIT 1""")
def held_out_window(spark, sf_dir):
    """Argmax on one group, value on the other."""
    ev = events(spark, sf_dir).withColumn("win", F.col("k"))
    half = lambda p: ev.where(F.col("user_id") % 2 == p).groupBy("win").agg(F.avg("value").alias("v"))
    return stats.best_window(half(0), half(1), "win", "v").withColumns({c: r6(c) for c in ("train_value", "test_value")})


DRAW = "('0x' || substr(md5({text}), 1, 15))::BIGINT"


@catalog.add(EV + """, b AS (SELECT CAST(floor(t / 86400.0) AS INT) AS block, sum(value) AS s, count(value) AS n FROM ev GROUP BY 1),
 d AS (SELECT r.range AS draw, """ + DRAW.format(text="'0:' || r.range || ':' || s.range") + """ % 30 AS block FROM range(1000) r, range(30) s),
 m AS (SELECT draw, sum(s) / sum(n) AS mean FROM d JOIN b USING (block) GROUP BY draw) SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""")
def bootstrap_interval(spark, sf_dir):
    """Block bootstrap with hashed draws."""
    ev = events(spark, sf_dir).withColumn("block", F.floor(F.col("t") / 86400.0).cast("int"))
    return stats.interval(stats.block_bootstrap(ev, "value", "block", 30, 1000)).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@catalog.add(EV + """, b AS (SELECT CAST(floor(t / 86400.0) AS INT) AS block, sum(cos(2 * pi() * t / 3600.0)) AS c, sum(sin(2 * pi() * t / 3600.0)) AS s FROM ev GROUP BY 1),
 d AS (SELECT r.range AS draw, """ + DRAW.format(text="'0:' || r.range || ':' || s.range") + """ % 30 AS block FROM range(400) r, range(30) s),
 e AS (SELECT atan2(sum(s), sum(c)) * 3600.0 / (2 * pi()) AS e FROM b), m AS (SELECT draw, atan2(sum(s), sum(c)) * 3600.0 / (2 * pi()) AS p FROM d JOIN b USING (block) GROUP BY draw),
 v AS (SELECT e, (p - e + 1800.0) - 3600.0 * floor((p - e + 1800.0) / 3600.0) - 1800.0 AS v FROM m, e), q AS (SELECT max(e) AS e, quantile_cont(v, 0.025) AS a, quantile_cont(v, 0.975) AS z FROM v)
 SELECT round(e - 3600.0 * floor(e / 3600.0), 4) AS phase, round(e + a - 3600.0 * floor((e + a) / 3600.0), 4) AS low, round(e + z - 3600.0 * floor((e + z) / 3600.0), 4) AS high FROM q""")
def bootstrap_phase(spark, sf_dir):
    """Circular mean phase and its circular percentile interval over resampled blocks."""
    ev = events(spark, sf_dir).withColumn("block", F.floor(F.col("t") / 86400.0).cast("int"))
    return stats.phase_interval(ev, "t", 3600.0, "block", 30, 400).select(*(F.round(c, 4).alias(c) for c in ("phase", "low", "high")))


@catalog.add(EV + ", r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY " + DRAW.format(text="'7:' || event_id") + ", event_id) AS rn FROM ev) SELECT event_type, event_id FROM r WHERE rn <= 20")
def seeded_sample(spark, sf_dir):
    """An exact number of each kind, without replacement."""
    return stats.seeded_sample(events(spark, sf_dir), ["event_type"], 20, 7, ["event_id"]).select("event_type", "event_id")


@catalog.add(RATES + """, sh AS (SELECT d.range AS draw, v.range AS video, """ + DRAW.format(text="'3:' || d.range || ':' || v.range") + """ % 2592000 AS s FROM range(1, 6) d, range(4) v),
 f AS (SELECT d.range AS draw, o.video, """ + DRAW.format(text="'4:' || d.range || ':' || o.video || ':' || o.rn") + """ % 2592000 AS t FROM (SELECT video, row_number() OVER (PARTITION BY video ORDER BY t) AS rn FROM o) o, range(1, 6) d),
 a AS (SELECT 'observed' AS kind, 0 AS draw, count(*) AS hits FROM e JOIN o ON o.video = e.video AND e.t >= o.t AND e.t < o.t + 1800.0),
 b AS (SELECT 'circular_shift' AS kind, draw, count(*) AS hits FROM (SELECT e.video, draw, e.t + s - 2592000.0 * floor((e.t + s) / 2592000.0) AS t FROM e JOIN sh USING (video)) m JOIN o ON o.video = m.video AND m.t >= o.t AND m.t < o.t + 1800.0 GROUP BY draw),
 c AS (SELECT 'random_onsets' AS kind, draw, count(*) AS hits FROM e JOIN f ON f.video = e.video AND e.t >= f.t AND e.t < f.t + 1800.0 GROUP BY draw)
 SELECT kind, draw::INT AS draw, hits FROM a UNION ALL SELECT kind, draw::INT, hits FROM b UNION ALL SELECT kind, draw::INT, hits FROM c""")
def null_draws(spark, sf_dir):
    """Independent circular shifts of each video and random onsets, by hashed draws."""
    ev = events(spark, sf_dir)
    onsets, hits = ev.where("event_type = 'signup'").select("video", "t").distinct(), ev.where("event_type = 'click'").select("video", "t")
    shifted = stats.circular_shift_null(onsets, hits, ["video"], 1800.0, 2592000.0, 5, stats.drawn(3, "draw", "video") % 2592000)
    free = stats.random_onset_null(onsets, hits, ["video"], 1800.0, 2592000, 5, 4)
    name = F.when(F.col("draw") == 0, "observed").otherwise("circular_shift")
    return shifted.select(name.alias("kind"), "draw", "hits").unionByName(free.select(F.lit("random_onsets").alias("kind"), "draw", "hits"))


@catalog.add(RATES + """, w AS (SELECT x.range AS a, x.range + y.w AS b FROM range(11) x, (VALUES (5), (10), (15)) y(w)), g AS (SELECT video, video % 2 AS grp, t FROM o),
 r AS (SELECT grp, a, b, count(e.t) / (any_value(n) * (b - a) * 60.0) AS rate FROM (SELECT g.*, w.*, count(*) OVER (PARTITION BY grp, a, b) AS n FROM g, w) q LEFT JOIN e ON e.video = q.video AND e.t >= q.t + a * 60.0 AND e.t < q.t + b * 60.0 GROUP BY grp, a, b),
 k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(rate, 12) DESC, a, b) AS rn FROM r) SELECT k.grp::INT AS trained_on, k.a::INT AS a, k.b::INT AS b, round(k.rate, 9) AS train_rate, round(r.rate, 9) AS test_rate FROM k JOIN r ON r.grp = 1 - k.grp AND r.a = k.a AND r.b = k.b WHERE rn = 1""")
def held_out_windows(spark, sf_dir):
    """33 windows after an onset, the best of one group of videos tested on the other, both ways."""
    ev = events(spark, sf_dir)
    onsets = ev.where("event_type = 'signup'").select("video", "t").distinct().withColumn("grp", (F.col("video") % 2).cast("int"))
    windows = [(x, x + w) for x in range(11) for w in (5, 10, 15)]
    rates = stats.rates_by_window(onsets, ev.where("event_type = 'click'").select("video", "t"), ["video"], "grp", windows, 60.0)
    return stats.best_by_group(rates, "grp").select("trained_on", "a", "b", *(F.round(c, 9).alias(c) for c in ("train_rate", "test_rate")))


def flow_clusters(spark, sf_dir):
    """k by silhouette, the best of several seeds, parallel flows merged by their medians. Labels are ranks of size; rows only."""
    rows = track_ends(spark, sf_dir)
    k, _ = clusters.choose_k(rows, 3, 5, seeds=2)
    named = clusters.merged_flows(clusters.best_kmeans(rows, k, 2), "cluster")
    return named.groupBy("flow").agg(F.count("*").alias("n"))


def track_ends(spark, sf_dir):
    from trackloom.operators import tracks

    ends = tracks.summaries(moving(spark, sf_dir), ["user_id"], ("t", "event_id"), 2.0).select("user_id", "x0", "y0", "x1", "y1")
    return clusters.features(ends, ["x0", "y0", "x1", "y1"])


catalog.add()(flow_clusters)


def kmeans_flows(spark, sf_dir):
    """rows only; labels are not comparable."""
    rows = clusters.array_features(read(spark, sf_dir, "embeddings"), "embedding")
    return clusters.kmeans(rows, 8).groupBy("cluster").agg(F.count("*").alias("n"))


catalog.add()(kmeans_flows)


@catalog.add(EV + ", b AS (SELECT CAST(floor((t - 86400.0 * floor(t / 86400.0)) / 3600.0) AS INT) AS bin, count(*) AS n FROM ev GROUP BY 1), w AS (SELECT bin, n FROM b UNION ALL SELECT bin + 24, n FROM b WHERE bin < 2 UNION ALL SELECT bin - 24, n FROM b WHERE bin >= 22), a AS (SELECT bin, n, avg(n) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS average FROM w) SELECT bin, n, round(average, 6) AS average FROM a WHERE bin BETWEEN 0 AND 23")
def circular_average(spark, sf_dir):
    """W31."""
    bins = events(spark, sf_dir).groupBy(F.floor(F.pmod("t", F.lit(86400.0)) / 3600.0).cast("int").alias("bin")).agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    return win.circular_average(bins, ["one"], "bin", "n", 24).select("bin", "n", r6("average").alias("average"))


@catalog.add(EV + ", b AS (SELECT video, CAST(floor((t - 86400.0 * floor(t / 86400.0)) / 3600.0) AS INT) AS bin, count(*) AS n FROM ev GROUP BY 1, 2), f AS (SELECT video, bin, n < avg(n) OVER (PARTITION BY video) AS low FROM b), w AS (SELECT * FROM f UNION ALL SELECT video, bin + 24, low FROM f), r AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY video ORDER BY bin) AS run FROM w), g AS (SELECT video, run, min(bin) AS start, least(count(*), 24) AS length FROM r WHERE low GROUP BY video, run), k AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY length DESC, start) AS rn FROM g WHERE start < 24) SELECT video, start, length FROM k WHERE rn = 1")
def longest_circular_run(spark, sf_dir):
    """W32."""
    from pyspark.sql import Window

    bins = events(spark, sf_dir).groupBy("video", F.floor(F.pmod("t", F.lit(86400.0)) / 3600.0).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    flagged = bins.select("video", "bin", (F.col("n") < F.avg("n").over(Window.partitionBy("video"))).alias("low"))
    return win.longest_circular_run(flagged, ["video"], "bin", "low", 24)
