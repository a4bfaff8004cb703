"""Interval properties, matching against brute force, timelines, sources, store, clustering, isolation."""

import hashlib
import json
import random
import subprocess
import sys
import time
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackloom import registry
from trackloom.operators import checks, clusters, intervals, metrics, scene, signal, stats
from trackloom.sources import documents, store

REPO = Path(__file__).resolve().parents[1]


def merged(rows, gap):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 15)), min_size=1, max_size=25), st.integers(0, 3))
def test_coalescing(spark, rows, gap):
    rows = [("k", float(s), float(s + n)) for s, n in rows]
    df = spark.createDataFrame(rows, "k string, start_s double, end_s double")
    got = sorted((r.start_s, r.end_s) for r in intervals.coalesce_intervals(df, ["k"], gap=float(gap)).collect())
    assert got == merged([(s, e) for _, s, e in rows], gap)


def greedy(gt, pred, thr):
    iou = lambda a, b: max(0, min(a[1], b[1]) - max(a[0], b[0])) / (max(a[1], b[1]) - min(a[0], b[0])) if min(a[1], b[1]) > max(a[0], b[0]) else 0
    pairs = sorted(((iou(g, p), i, j) for i, g in enumerate(gt) for j, p in enumerate(pred) if iou(g, p) >= thr), reverse=True)
    a, b = set(), set()
    for _, i, j in pairs:
        if i not in a and j not in b:
            a.add(i)
            b.add(j)
    return len(a)


def test_matching_as_brute_force(spark):
    rng = random.Random(3)
    make = lambda: sorted((s, s + rng.randint(1, 20)) for s in (rng.randint(0, 100) for _ in range(12)))
    data = {v: (make(), make()) for v in "abcd"}
    side = lambda k: spark.createDataFrame([(v, "x", float(s), float(e)) for v, d in data.items() for s, e in d[k]], "video string, label string, start_s double, end_s double")
    got = {(r.video, r.thr): (r.tp, r.fp, r.fn) for r in metrics.match_counts(side(0), side(1), ["video", "label"]).collect()}
    for v, (g, p) in data.items():
        for thr in metrics.THRESHOLDS:
            tp = greedy(g, p, thr)
            assert got[(v, thr)] == (tp, len(p) - tp, len(g) - tp)


def test_matching_in_narrow_bands_and_with_equal_segments(spark, monkeypatch):
    rng = random.Random(8)
    make = lambda n: [(s, s + rng.choice([0.0, -1.0, 0.25, 2.0, rng.random() * 9])) for s in (rng.choice([rng.random() * 20, float(rng.randint(0, 20))]) for _ in range(n)) for _ in range(rng.randint(1, 3))]
    data = {v: (make(25), make(20)) for v in range(8)}
    rows = lambda k: [(v, *x) for v, d in data.items() for x in d[k]]
    gt, pred = (spark.createDataFrame(rows(k) + [(None, 1.0, 2.0), (k, None, 2.0)], "video int, start_s double, end_s double") for k in (0, 1))
    got = {(r.video, r.thr): r.tp for r in intervals.greedy_matches(gt, pred, ["video"], metrics.THRESHOLDS).collect()}
    pairs = intervals.pairs_by_iou(*(metrics.ordinals(d.dropna().where("end_s >= start_s"), ["video"]) for d in (gt, pred)), ["video"], 0.3).collect()
    monkeypatch.setattr(intervals, "BLOCK", 7)
    monkeypatch.setattr(intervals, "PAIRS", 5)
    for v, sides in data.items():
        arrays = [c for d in sides for c in ([x[0] for x in d if x[1] > x[0]], [x[1] for x in d if x[1] > x[0]], [1 for x in d if x[1] > x[0]])]
        narrow = intervals._count_matches(*arrays, list(metrics.THRESHOLDS))
        for k, thr in enumerate(metrics.THRESHOLDS):
            a, b = set(), set()
            for _, i, j in sorted(((p.iou, p.i, p.j) for p in pairs if p.video == v and p.iou >= thr), reverse=True):
                if i not in a and j not in b:
                    a.add(i)
                    b.add(j)
            assert got[(v, thr)] == narrow[k] == len(a)


def test_score_of_thousands_of_segments_and_alarms_at_one_place(spark):
    """None of the parts may pair all that meet: 36 million pairs of segments, and as many of accidents and marks."""
    n = 6000
    gt = spark.range(n).select(F.lit("v").alias("video"), F.lit("accident").alias("label"), F.lit(20.0).alias("start_s"), F.lit(26.0).alias("end_s"))
    began = time.perf_counter()
    assert [(r.tp, r.fp, r.fn) for r in metrics.match_counts(gt, gt, ["video", "label"]).collect()] == [(n, 0, 0)] * 3
    starts = spark.range(n).select(F.lit("v").alias("video"), (15 + F.col("id") / n).alias("t"))
    matched = metrics.alarm_matches(gt, starts).agg(F.count("mark"), F.countDistinct("mark"), F.max("mark")).first()
    assert tuple(matched) == (n, n, 15 + (n - 1) / n)
    assert time.perf_counter() - began < 40


def test_sample_labels_as_brute_force_and_without_a_join(spark):
    rng = random.Random(5)
    spans = [(rng.choice("ab"), rng.choice(["accident", "near_miss", "red_light"]), s, s + rng.choice([-7, -2, 0, 3, 9])) for s in (float(rng.randint(0, 300)) for _ in range(40))]
    gt = spark.createDataFrame(spans + [("a", "accident", None, 9.0), ("a", "near_miss", 9.0, None), (None, "accident", 1.0, 90.0)], "video string, label string, start_s double, end_s double")
    risk = spark.createDataFrame([(v, float(t), t % 7 / 7) for v in ("a", "b", "c", None) for t in range(-5, 320)] + [("a", None, 0.5)], "video string, t double, score double")
    labelled = metrics.sample_labels(risk, gt)
    assert "Join" not in labelled._jdf.queryExecution().executedPlan().toString()
    rows = labelled.collect()
    assert len(rows) == risk.count() and labelled.columns == ["video", "t", "score", "label"]
    for r in rows:
        hit = {(k, r.t >= s) for v, k, s, e in spans if v == r.video and r.t is not None and s - metrics.HORIZON <= r.t <= e}
        want = None if ("accident", True) in hit else 1 if ("accident", False) in hit else None if hit & {("near_miss", True), ("near_miss", False)} else 0
        assert r.label == want, r


def test_model_score_of_a_perfect_and_an_empty_prediction(spark):
    gt = spark.createDataFrame([("v", "accident", 20.0, 26.0), ("v", "red_light", 5.0, 8.0)], "video string, label string, start_s double, end_s double")
    risk = spark.createDataFrame([("v", float(t), 0.9 if 15 <= t < 20 else 0.1) for t in range(60)], "video string, t double, score double")
    best = metrics.model_score(gt, gt, risk).first()
    assert best.score_a == 1.0 and best.score_b == pytest.approx(0.4 + 0.4 + 0.2 * 0.5) and best.model_score == pytest.approx(0.7 + 0.3 * 0.9)
    none = metrics.model_score(gt, gt.limit(0), risk.withColumn("score", F.lit(0.0))).first()
    assert none.score_a == 0.0 and none.score_b == 0.0


def test_asof_nearest_and_tolerance(spark):
    left = spark.createDataFrame([("k", 1.0, "a"), ("k", 5.0, "b"), ("q", 5.0, "c")], "k string, t double, name string")
    right = spark.createDataFrame([("k", 1.0, 10), ("k", 3.0, 30)], "k string, t double, v int")
    assert {r.name: r.v for r in intervals.asof(left, right, ["k"], "t", ["v"]).collect()} == {"a": 10, "b": 30, "c": None}
    assert {r.name: r.v for r in intervals.asof(left, right, ["k"], "t", ["v"], 1.0).collect()} == {"a": 10, "b": None, "c": None}
    assert {r.name: r.nearest_t for r in intervals.nearest(left, right.select("k", "t"), ["k"], "t").collect()} == {"a": 1.0, "b": 3.0, "c": None}


def test_timeline_tiles_and_bridges(spark):
    state = ["red"] * 4 + ["unknown"] * 2 + ["red"] * 3 + ["unknown"] * 8 + ["green"] * 4
    rows = [("v", i * 6, s, "observed" if s != "unknown" else "occluded") for i, s in enumerate(state)]
    df = spark.createDataFrame(rows, "video string, frame long, state string, observation string")
    got = signal.state_intervals(df, ["video"], 130).orderBy("start_frame").collect()
    assert [(r.start_frame, r.end_frame, r.state, r.n_imputed, r.start_uncertainty_frames) for r in got] == [(0, 54, "red", 2, 0), (54, 102, "unknown", 0, 6), (102, 130, "green", 0, 54)]
    assert intervals.tiling_violations(signal.state_intervals(df, ["video"], 130), ["video"], "start_frame", "end_frame").count() == 0


def test_demotion_blink_and_absorption(spark):
    fam = ["red"] * 6 + ["amber"] * 2 + ["G"] * 6 + ["red"] * 1 + ["G"] * 6
    df = spark.createDataFrame([("v", i, f, "observed") for i, f in enumerate(fam)], "video string, frame long, family string, observation string")
    got = [r.observation for r in signal.demoted(df, ["video"], "family", 5, 3).orderBy("frame").collect()]
    assert [i for i, o in enumerate(got) if o != "observed"] == [6, 7]  # a lone red before green is legal
    st_ = ["green"] * 6 + ["green_flash", "green", "green_flash", "green"] + ["red"] * 3
    df = spark.createDataFrame([("v", i, s, "observed") for i, s in enumerate(st_)], "video string, frame long, state string, observation string")
    assert [r.state for r in signal.blink_tails(df, ["video"], 5, 3).orderBy("frame").collect()] == ["green"] * 6 + ["green_blink"] * 4 + ["red"] * 3
    runs = spark.createDataFrame([("v", "red", 0.0, 5.0), ("v", "amber", 5.0, 5.2), ("v", "red", 5.2, 9.0), ("v", "green", 9.0, 12.0)], "video string, state string, start double, end double")
    assert [(r.state, r.start, r.end) for r in signal.absorb_short_runs(runs, ["video"], 1.0).orderBy("start").collect()] == [("red", 0, 9), ("green", 9, 12)]


def test_two_means_and_cycle(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 1, 2, 1] * 6 + [9, 10, 9, 10] * 6], "x double")
    low, high, apart = signal.two_means(df, "x")
    assert low == pytest.approx(1.4) and high == pytest.approx(9.5) and apart > 10
    df = spark.createDataFrame([("v", t) for t in (10.0, 40.0, 100.0, 130.0)], "video string, t double")
    r = signal.cycle_fit(df, ["video"], "t").first()
    assert (r.cycle, r.start, r.residual) == (pytest.approx(30), pytest.approx(10), pytest.approx(0))


def test_components_modes_and_flows(spark):
    cells = spark.createDataFrame([(0, 0), (1, 1), (5, 5), (5, 6), (9, 0)], "i int, j int")
    assert {(r.i, r.j): (r.root_i, r.root_j) for r in scene.grid_components(cells).collect()} == {(0, 0): (0, 0), (1, 1): (0, 0), (5, 5): (5, 5), (5, 6): (5, 5), (9, 0): (9, 0)}
    rows = [(0, 0, float(h)) for h in [358, 2, 0, 1, 359] * 4 + [180, 181, 179] * 3]
    modes = scene.heading_modes(spark.createDataFrame(rows, "i int, j int, heading double"), ["i", "j"]).orderBy("mode").collect()
    assert [round(m.heading) % 360 for m in modes] == [0, 180] and [m.n for m in modes] == [20, 9]
    assert clusters.alike((0, 0, 1000, 0), (0, 100, 900, 120)) and not clusters.alike((0, 0, 1000, 0), (0, 900, 1000, 900)) and not clusters.alike((0, 0, 1000, 0), (1000, 0, 0, 0))
    rows = [(c, *(float(x + d) for x in f)) for c, f in enumerate([(0, 0, 1000, 0), (0, 200, 1000, 200), (0, 400, 1000, 400), (0, 2000, 0, 100)]) for d in range(9 - c)]
    got = clusters.merged_flows(spark.createDataFrame(rows, "cluster int, x0 double, y0 double, x1 double, y1 double"), "cluster")
    names = {r.cluster: r.flow for r in got.collect()}
    assert names[0] == names[1] == "F1" and names[3] != "F1" and len(set(names.values())) == (2 if names[2] == "F1" else 3)


def test_sampling_and_bootstrap_repeat(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    a, b = (sorted(r.id for r in stats.seeded_sample(df.repartition(n), ["g"], 10, 1, ["id"]).collect()) for n in (1, 7))
    assert a == b and len(a) == 30
    blocks = df.select((F.col("id") % 10).alias("block"), F.col("id").cast("double").alias("v"))
    r = stats.interval(stats.block_bootstrap(blocks, "v", "block", 10, 200)).first()
    assert 480 < r.low < 500 < r.high < 520


def test_documents_round_trip(spark, tmp_path):
    doc = {"a.mp4": {"duration": 60.0, "fps": 25.0, "events": [[5.0, 8.0, "red_light"], [20.0, 26.0, "accident"]]}, "b.mp4": {"duration": 40.0, "fps": 25.0, "events": []}}
    (tmp_path / "gt.json").write_text(json.dumps(doc, indent=1))
    videos, events = documents.read_truth(spark, str(tmp_path / "gt.json"))
    assert videos.count() == 2 and sorted((r.video, r.start_s, r.end_s, r.label, r.arity) for r in events.collect()) == [("a.mp4", 5.0, 8.0, "red_light", 3), ("a.mp4", 20.0, 26.0, "accident", 3)]
    documents.write_document(documents.event_document(videos, events), str(tmp_path / "out"))
    again = documents.read_truth(spark, str(tmp_path / "out"))[1]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, events.collect()))
    pred = {"team": "t", "videos": {"a.mp4": {"events": [[1, 2, "accident"]], "risk": [[0, 0.1], [1, 0.7]]}}}
    (tmp_path / "p.json").write_text(json.dumps(pred))
    _, ev, risk = documents.read_predictions(spark, str(tmp_path / "p.json"))
    assert ev.count() == 1 and [(r.t, r.score) for r in risk.orderBy("pos").collect()] == [(0.0, 0.1), (1.0, 0.7)]


def test_entries_of_a_folder_whose_tables_are_files_or_folders(spark, tmp_path):
    root = tmp_path / "x.parquet" / "a b"
    for name, text in {"one.parquet": "1", "two.parquet/part-1": "22", "two.parquet/part-0.parquet": "2", "two.parquet/k=1/part-0.parquet": "3", "two.parquet/_SUCCESS": "", "notes.txt": "n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    lines = "\n".join(f"{k} {sha(v)}" for k, v in [("k=1/part-0.parquet", "3"), ("part-0.parquet", "2"), ("part-1", "22")])
    want = [("one.parquet", 1, sha("1")), ("two.parquet", 3, sha(lines))]
    for path in (str(root), f"file://{root}/"):
        assert [tuple(r) for r in documents.entries(spark, path, "*.parquet").collect()] == want
    assert documents.entries(spark, str(root), "*.csv").collect() == []
    assert [tuple(r) for r in registry.QUERIES["file_listing"](spark, str(root)).collect()] == [("one", 64), ("two", 64)]
    assert documents.listing(spark, str(root), "*.parquet").count() == documents.checksums(spark, str(root), "*.parquet").count() == 3


def test_checksums_of_files_that_are_no_single_value(spark, tmp_path):
    texts = {"a b.bin": b"x" * 5000, "c.bin": b"\x00\xff" * 4000, "d.bin": b"1"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in documents.checksums(spark, str(tmp_path), "*.bin").collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {name: hashlib.sha256(text).hexdigest() for name, text in texts.items()}


def test_small_sources(spark, tmp_path):
    assert sorted(r.frame for r in documents.frame_ranges(spark, "0:10:4,8,20").collect()) == [0, 4, 8, 20]
    assert sorted(r.frame for r in documents.even_frames(spark, 9, 4).collect()) == [0, 3, 6, 9]
    (tmp_path / "C1.csv").write_text("frame,t_sec,track_id,cls,conf,x1,y1,x2,y2\n0,0.0,1,car,0.9,1,2,3,4\n30,9.0,1,car,0.9,1,2,3,4\n")
    assert [(r.stem, r.frame) for r in documents.read_tracks(spark, str(tmp_path / "C1.csv"), until=5.0).collect()] == [("C1", 0)]
    assert documents.listing(spark, str(tmp_path), "*.csv").count() == 1 and documents.checksums(spark, str(tmp_path), "*.csv").count() == 1
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert documents.append_new(rows, str(tmp_path / "t"), ["k"]) == 2 and documents.append_new(rows, str(tmp_path / "t"), ["k"]) == 0
    documents.write_csv(spark.createDataFrame([('say "hi"',)], "x string"), str(tmp_path / "csv"))
    assert '"say ""hi"""' in next((tmp_path / "csv").glob("part*")).read_text()
    tags = spark.createDataFrame([({"Doc1:Iso": "100", "Doc2:Iso": "200"},)], "tags map<string, string>")
    assert sorted((r.row, r.tag, r.value) for r in documents.unpack_tags(tags).collect()) == [(0, "Iso", "100"), (1, "Iso", "200")]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.save("a", "one", 0, "x") == 1 and s.save("a", "one", 1, "y") == 1 and s.save("a", "two", 1, "y") == 2
    with pytest.raises(store.Conflict):
        s.save("a", "three", 1)
    assert s.save("a", "three", 1, force=True) == 3
    assert s.current().first().body == "three" and s.editors().first().editors == ["x", "y"]
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert [(r.key, r.version, r.body) for r in s.export(keys).orderBy("key").collect()] == [("a", 3, "three"), ("b", 0, "")]
    assert store.recent(s.history(), ["key"], 2).count() == 2 and store.snapshots(s.history(), 2).count() == 1


def test_validation(spark):
    nan = float("nan")
    ev = [("v", 0, 1.0, 2.0, "accident"), ("v", 1, 1.5, 3.0, "accident"), ("v", 2, nan, 3.0, "accident"), ("v", 3, 5.0, 99.0, "jaywalking"), ("a/b", 4, 1.0, 2.0, "nothing")]
    events = spark.createDataFrame(ev, "video string, ordinal int, start_s double, end_s double, label string")
    videos = spark.createDataFrame([("v", 60.0)], "video string, duration double")
    got = sorted((r.ordinal, r.message) for r in checks.event_findings(events, videos).collect())
    assert got == [(1, "overlaps its predecessor"), (2, "bad times"), (3, "ends after the video"), (4, "unknown label"), (4, "video is a path")]
    clean = sorted((r.start_s, r.end_s, r.label) for r in checks.clean_events(events, videos).collect())
    assert clean == [(1.0, 2.0, "accident"), (5.0, 60.0, "jaywalking")]
    zones = [("v", "z1", "bus_stop", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], {}), ("v", "z1", "live_lane", [(0.0, 0.0), (1.0, 0.0)], {"direction": "up"}), ("v", "z 2", "pond", [(9e9, 0.0)], {})]
    zdf = spark.createDataFrame(zones, "video string, id string, type string, points array<struct<x: double, y: double>>, attrs map<string, string>")
    found = sorted(r.message for r in checks.zone_findings(zdf, 3840, 2160).collect())
    assert found == ["bad attribute", "bad id", "id used twice", "id used twice", "outside the frame", "too few points", "unknown type"]


def test_the_rest_lives_without_the_corpus_operators(tmp_path):
    code = "import sys; sys.modules['trackloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    n, has, pipe = out.stdout.split()
    assert int(n) > 80 and has == pipe == "False", out.stderr
    for p in (REPO / "trackloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "trackloom.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p
