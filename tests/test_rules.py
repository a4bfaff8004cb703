"""Geometry against dense sampling, episodes and rules against slow forms on generated walks, and the rules' own statements."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry as geo
from trackloom.operators import rules, tracks

STAR = [(0, 0), (40, 10), (80, 0), (60, 40), (80, 90), (40, 60), (5, 85), (20, 40)]


def turns_around(x, y, polygon):
    """Winding number: the sum of signed angles under which the edges are seen."""
    total = 0.0
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        total += math.atan2((ax - x) * (by - y) - (bx - x) * (ay - y), (ax - x) * (bx - x) + (ay - y) * (by - y))
    return abs(total) > math.pi


def test_containment_and_distance(spark):
    rng = random.Random(4)
    points = [(i, rng.uniform(-10, 95), rng.uniform(-10, 100)) for i in range(150)]
    df = spark.createDataFrame(points, "i int, x double, y double")
    got = df.select("i", geo.inside(F.col("x"), F.col("y"), STAR).alias("in"), geo.signed_distance(F.col("x"), F.col("y"), STAR).alias("d")).collect()
    border = [(a[0] + (b[0] - a[0]) * k / 2000, a[1] + (b[1] - a[1]) * k / 2000) for a, b in zip(STAR, STAR[1:] + STAR[:1]) for k in range(2000)]
    for r in got:
        _, x, y = points[r.i]
        assert r["in"] == turns_around(x, y, STAR) == (r.d > 0)
        assert abs(r.d) == pytest.approx(min(math.dist((x, y), p) for p in border), abs=0.05)
    corners = spark.createDataFrame([(float(x), float(y)) for x, y in STAR], "x double, y double")
    assert all(r[0] for r in corners.select(geo.inside(F.col("x"), F.col("y"), STAR)).collect())


def slow_episodes(samples, period, limit):
    """``samples`` of one track: (t, x, y, h, eligible)."""
    def counts(i):
        near = [s for s in samples if abs(s[0] - samples[i][0]) <= 1.01]
        a, b = near[0], near[-1]
        return samples[i][4] and b[0] > a[0] and math.dist(a[1:3], b[1:3]) >= 0.1 * samples[i][3] * (b[0] - a[0])

    good, parts = [counts(i) for i in range(len(samples))], []
    for i, s in enumerate(samples):
        if not good[i]:
            continue
        p = samples[i - 1] if i else None
        if i and good[i - 1] and s[0] - p[0] <= max(1.01, 2.01 * period) and math.dist(p[1:3], s[1:3]) <= max(p[3], s[3]) * (0.5 + 1.5 * (s[0] - p[0])):
            parts[-1].append(s)
        else:
            parts.append([s])
    out = []
    for q in parts:
        xs, ys = [s[1] for s in q], [s[2] for s in q]
        if len(q) >= 3 and q[-1][0] - q[0][0] >= 0.75 and math.hypot(max(xs) - min(xs), max(ys) - min(ys)) >= 0.3 * statistics.median(s[3] for s in q):
            out.append((round(q[0][0], 3), round(min(q[-1][0] + period, limit), 3)))
    return out


def test_episodes_as_defined(spark):
    rng, rows = random.Random(12), {}
    for k in range(25):
        t, x, y, own = 0.0, 50.0, 50.0, []
        for _ in range(rng.randint(2, 30)):
            own.append((round(t, 3), x, y, 40.0 + rng.uniform(-4, 4), rng.random() > 0.12))
            t += rng.choice([0.5, 0.5, 0.5, 1.0, 1.5])
            x, y = x + rng.choice([0, 2, 9, 14, 200 if rng.random() < 0.1 else 5]), y + rng.uniform(-2, 2)
        rows[k] = own
    df = spark.createDataFrame([("v", k, *s) for k, own in rows.items() for s in own], "video string, track_id int, t double, x double, y double, h double, eligible boolean")
    got = sorted((r.track_id, r.start_s, r.end_s) for r in tracks.road_episodes(df, ["video", "track_id"], 0.5, 14.0).collect())
    want = sorted((k, *e) for k, own in rows.items() for e in slow_episodes(own, 0.5, 14.0))
    assert got == want and len(want) > 5


COLUMNS = "video string, t double, track_id int, cls int, x1 double, y1 double, x2 double, y2 double, speed double"
# a crossing from top to bottom in the middle of a road that runs from left to right, a stop at the left
SCENE = rules.Scene(400, 300, crosswalks=[[(0.45, 0), (0.55, 0), (0.55, 1), (0.45, 1)]], roads=[[(0, 0.2), (1, 0.2), (1, 0.9), (0, 0.9)]], bus_stops=[[(0, 0.2), (0.25, 0.2), (0.25, 0.5), (0, 0.5)]])


def box(t, track, cls, x, y, w, h, speed=0.03, video="v"):
    return (video, float(t), track, cls, x - w / 2, float(y - h), x + w / 2, float(y), speed)


def found(spark, rule, rows, duration=30.0):
    df = spark.createDataFrame(rows, COLUMNS)
    return sorted((r.video, r.start_s, r.end_s, r.label) for r in rule(df, SCENE, 0.5, duration).collect())


def drive(pace, stop_at=None, n=30):
    return [box(i / 2, 1, 2, min(60 + pace * i / 2, stop_at or 1e9), 150, 40, 25) for i in range(n)]


def stand(x, y, n=30):
    return [box(i / 2, 2, 0, x, y, 8, 25) for i in range(n)]


def test_car_through_an_occupied_crossing(spark):
    # box of 40: its front touches the crossing (x = 180) at centre 160, its back leaves it (x = 220) at 240
    [(_, start, end, label)] = found(spark, rules.failure_to_yield, drive(20.0) + stand(200, 160))
    assert label == "failure_to_yield" and start == 5.0 and end == 9.5


@pytest.mark.parametrize("rows", [drive(20.0), drive(20.0) + stand(300, 160), drive(20.0, stop_at=140.0) + stand(200, 160), drive(2.0, n=20) + stand(200, 160)], ids=["nobody", "elsewhere", "waits", "never there"])
def test_no_failure_to_yield(spark, rows):
    assert found(spark, rules.failure_to_yield, rows) == []


def test_person_in_a_bus_is_not_on_the_crossing(spark):
    bus = [box(i / 2, 3, 5, 200, 200, 120, 120, 0.0) for i in range(30)]
    assert found(spark, rules.failure_to_yield, drive(20.0) + stand(200, 150) + bus) == []


def walk(x, dx, y=180.0, dy=0.0, n=12, start=0.0):
    return [box(start + i / 2, 7, 0, x + dx * i, y + dy * i, 8, 25) for i in range(n)]


def test_walking_on_the_road(spark):
    assert found(spark, rules.jaywalking, walk(40, 0.0, 90, 8.0)) == [("v", 0.0, 6.0, "jaywalking")]
    assert found(spark, rules.jaywalking_by_speed, walk(40, 0.0, 90, 8.0)) == [("v", 0.0, 6.0, "jaywalking")]


@pytest.mark.parametrize("rows", [walk(200, 0.0, 90, 8.0), walk(40, 0.0, 90, 0.0), walk(40, 4.0, 20, 0.0), walk(40, 6.0, 62, 0.0)], ids=["on the crossing", "stands", "off the road", "along the kerb"])
def test_no_jaywalking(spark, rows):
    assert found(spark, rules.jaywalking, rows) == []


def test_two_walks_close_in_time_are_one(spark):
    one = walk(40, 0.0, 90, 8.0) + [r[:2] + (8,) + r[3:] for r in walk(80, 0.0, 90, 8.0, start=7.0)]
    assert found(spark, rules.jaywalking, one) == [("v", 0.0, 13.0, "jaywalking")]
    far = walk(40, 0.0, 90, 8.0) + [r[:2] + (8,) + r[3:] for r in walk(80, 0.0, 90, 8.0, start=7.5)]
    assert len(found(spark, rules.jaywalking, far)) == 2


@pytest.mark.parametrize("stay,want", [(30, [("v", 0.0, 15.0, "stopped_vehicle")]), (15, [])])
def test_bus_at_a_stop(spark, stay, want):
    rows = [box(i / 2, 4, 5, 50 + max(0, i - stay + 1) * 20, 120, 40, 30) for i in range(40)]
    assert found(spark, rules.stopped_buses, rows) == want


def test_foot_cut_off_by_the_frame(spark):
    cases = [((50, 50, 60, 100), True), ((1, 50, 60, 100), False), ((50, 50, 399, 100), False), ((50, 50, 60, 299), False), ((50, 0, 60, 100), True)]
    df = spark.createDataFrame([tuple(map(float, b)) for b, _ in cases], "x1 double, y1 double, x2 double, y2 double")
    assert [r[0] for r in df.select(geo.reliable_foot([F.col(c) for c in df.columns], 400, 300)).collect()] == [w for _, w in cases]


@pytest.mark.parametrize("heading,margin,want", [(0, 5, True), (25, 5, True), (35, 5, False), (180, 5, True), (90, 5, False), (0, 3, False)])
def test_along_an_edge(spark, heading, margin, want):
    mx, my = math.cos(math.radians(heading)), math.sin(math.radians(heading))
    c = geo.follows_edge(F.lit(50.0), F.lit(-4.0), F.lit(mx), F.lit(my), [[(0, 0), (100, 0), (100, 60), (0, 60)]], F.lit(float(margin)))
    assert spark.range(1).select(c.alias("x")).first().x is want


@pytest.mark.parametrize("gap,closing", [(60, 10), (60, 30), (24, 2), (60, -10), (20, 10), (200, 10)])
def test_contact_time_by_steps(spark, gap, closing):
    steps = [k / 1000 for k in range(1, 5001)]
    hit = next((t for t in steps if abs(gap - closing * t) <= 22), None) if gap > 22 and closing * closing / 22**2 >= 0.04 else None
    got = spark.range(1).select(geo.time_to_contact(F.lit(float(gap)), F.lit(0.0), F.lit(-float(closing)), F.lit(0.0), F.lit(22.0), F.lit(6.0)).alias("x")).first().x
    assert (got is None) == (hit is None) and (hit is None or got == pytest.approx(hit, abs=2e-3))
