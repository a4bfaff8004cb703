"""Sources and functions that no query holds, two savers at once, and plans without frames that shrink."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom import registry
from trackloom.functions import scalars
from trackloom.operators import checks, scene
from trackloom.sources import documents, store

SF = "/root/testdata/sf0.001"


def test_npz_stacks_and_backgrounds(spark, tmp_path):
    stack = np.arange(24).reshape(2, 3, 4)
    np.savez(tmp_path / "a.npz", crops=stack, t=np.array([0.5, 1.0]))
    rows = {r.name: r for r in documents.read_npz(spark, str(tmp_path)).collect()}
    assert rows["crops"].shape == [2, 3, 4] and rows["crops"].data == stack.ravel().tolist() and rows["t"].data == [0.5, 1.0]
    pixels = spark.createDataFrame([(x, 0, float(v)) for x in range(2) for v in ([1, 2, 9], [5, 5, 5])[x]], "x int, y int, value double")
    assert sorted(map(tuple, documents.temporal_median(pixels).collect())) == [(0, 0, 2.0, 4.0), (1, 0, 5.0, 0.0)]


def test_colour_scores(spark):
    import colorsys

    rgb = [(255, 0, 0), (10, 200, 30), (128, 128, 128), (250, 180, 10), (0, 0, 0), (255, 255, 255), (200, 20, 180)]
    df = spark.createDataFrame([tuple(map(float, x)) for x in rgb], "r double, g double, b double")
    for hue in (0.0, 45.0, 120.0):
        got = [x[0] for x in df.select(scalars.colour_score(F.col("r"), F.col("g"), F.col("b"), hue)).collect()]
        for (r, g, b), score in zip(rgb, got):
            h, s, v = colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)
            near = s > 0 and abs((h * 360 - hue + 180) % 360 - 180) <= 25
            assert score == pytest.approx(s * v if near else 0.0)


def test_of_two_savers_one_succeeds(spark, tmp_path):
    path, got = str(tmp_path / "s"), []

    def save(body):
        try:
            got.append(store.Store(spark, path).save("k", body, 0))
        except store.Conflict:
            got.append("conflict")

    threads = [threading.Thread(target=save, args=(b,)) for b in ("one", "two", "three")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, got)) == ["1", "conflict", "conflict"]
    assert store.Store(spark, path).history().count() == 1


def test_rejected_bodies_say_why(spark):
    rows = [("a", 1.0, 2.0, "accident"), ("a", 3.0, 2.0, "accident"), ("b", 1.0, 9.9995, "jaywalking"), ("c", 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "key string, start_s double, end_s double, label string").withColumn("note", F.lit("x" * 3000))
    good, bad = checks.label_bodies(df, ["key"], F.lit(10.0))
    assert [(r.key, r.end_s, len(r.note)) for r in good.collect()] == [("b", 10.0, 2000)]
    assert sorted(map(tuple, bad.collect())) == [("a", "bad times"), ("c", "unknown label")]


def test_modes_end_at_the_least_share(spark):
    rows = [(0, float(h)) for h in [10] * 40 + [190] * 5 + [100] * 3]
    modes = scene.heading_modes(spark.createDataFrame(rows, "i int, heading double"), ["i"], least=3, share=0.1).orderBy("mode").collect()
    assert [(round(m.heading), m.n) for m in modes] == [(10, 40), (190, 5)]


@pytest.mark.parametrize("name", ["interval_tiling", "nearest_event", "state_onsets", "complete_phases", "onset_lags", "settling"])
def test_no_frame_runs_to_the_far_end(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "currentrow$(), unboundedfollowing$()" not in plan and "window" in plan
