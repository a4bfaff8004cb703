"""Event rules over tracks and scene polygons.

``detections(video, t, track_id, cls, x1, y1, x2, y2)`` in pixels, with times of one sampling grid. A scene gives polygons in
shares of the frame. Each rule returns ``(video, start_s, end_s, label)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import geometry as geo
from trackloom.operators import tracks
from trackloom.operators.intervals import coalesce_intervals, sessions
from trackloom.operators.windows import ordered, recent_motion, step_speed

PERSON, BUS = 0, 5
#: Vehicles that may hold people; vehicles that must yield (fixed class numbers).
ENCLOSING, YIELDING = (2, 5, 7), (1, 2, 3, 5, 7)
BOX = ("x1", "y1", "x2", "y2")


@dataclass(frozen=True)
class Scene:
    width: float
    height: float
    crosswalks: Sequence[geo.Polygon] = ()
    roads: Sequence[geo.Polygon] = ()
    ignored: Sequence[geo.Polygon] = ()
    bus_stops: Sequence[geo.Polygon] = ()
    road_edges: Sequence[geo.Polygon] = field(default=())  # outer outline in pixels; by default each road's own border
    crossing_margin: float = 0.01
    bus_stop_margin: float = 0.005

    def pixels(self, polygons: Sequence[geo.Polygon]) -> list[geo.Polygon]:
        return [[(x * self.width, y * self.height) for x, y in p] for p in polygons]


def box(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in BOX]


def occupants(detections: DataFrame) -> DataFrame:
    """Person rows whose box lies high inside a vehicle of the same time."""
    p, v = detections.where(F.col("cls") == PERSON).alias("p"), detections.where(F.col("cls").isin(*ENCLOSING)).alias("v")
    on = (F.col("p.video") == F.col("v.video")) & (F.col("p.t") == F.col("v.t")) & geo.rides_inside(box("p."), box("v."))
    return p.join(v, on, "left_semi").select("p.*")


def _people(detections: DataFrame, scene: Scene, drop_occupants: bool = True) -> DataFrame:
    rows = detections.where(F.col("cls") == PERSON)
    rows = rows.withColumns({"x": (F.col("x1") + F.col("x2")) / 2, "y": F.col("y2"), "h": F.col("y2") - F.col("y1")})
    if drop_occupants:
        inside = occupants(detections).select("video", "t", "track_id", F.lit(True).alias("occupant")).distinct()
        rows = rows.join(inside, ["video", "t", "track_id"], "left").withColumn("occupant", F.coalesce("occupant", F.lit(False)))
    else:
        rows = rows.withColumn("occupant", F.lit(False))
    return rows.withColumns({"ax": F.col("x") / scene.width, "ay": F.col("y") / scene.height})


def _on_road(rows: DataFrame, scene: Scene, margin: float) -> Column:
    ax, ay = F.col("ax"), F.col("ay")
    near = F.lit(False)
    for p in scene.crosswalks:
        near = near | (geo.signed_distance(ax, ay, p) >= -margin)
    return geo.any_inside(ax, ay, scene.roads) & ~near & ~geo.any_inside(ax, ay, scene.ignored)


def jaywalking(detections: DataFrame, scene: Scene, period: float, duration: Column | float) -> DataFrame:
    """People on the road away from crossings, by their movement: not along a crossing's or the road's edge, feet visible, not inside a vehicle."""
    rows = _people(detections, scene)
    w = ordered(["video", "track_id"], "t")
    mx, my = recent_motion(w, ["x", "y"], "t")
    rows = rows.withColumns({"mx": mx, "my": my, "ok": _on_road(rows, scene, scene.crossing_margin)})
    motion = F.hypot("mx", "my")
    moved = motion.between(0.1 * F.col("h"), 2 * F.col("h"))
    edges = scene.road_edges or scene.pixels(scene.roads)
    beside = geo.follows_edge(F.col("x"), F.col("y"), F.col("mx"), F.col("my"), scene.pixels(scene.crosswalks), 0.15 * F.col("h"))
    kerb = geo.follows_edge(F.col("x"), F.col("y"), F.col("mx"), F.col("my"), edges, 0.3 * F.col("h"))
    along = F.coalesce(moved & (beside | kerb), F.lit(False))
    eligible = F.col("ok") & ~along & geo.reliable_foot(box(), scene.width, scene.height) & ~F.col("occupant")
    found = tracks.road_episodes(rows.withColumn("eligible", eligible), ["video", "track_id"], period, duration)
    return _labelled(coalesce_intervals(found.select("video", "start_s", "end_s"), ["video"], gap=1.1), "jaywalking")


def jaywalking_by_speed(detections: DataFrame, scene: Scene, period: float, duration: float, margin: float = 0.025) -> DataFrame:
    """The older form: eligible samples of some speed, joined by time alone. ``detections`` has ``speed``, in frames a second."""
    rows = _people(detections, scene)
    rows = rows.where(_on_road(rows, scene, margin) & (F.col("speed") >= 0.005) & ~F.col("occupant"))
    found = sessions(rows, ["video", "track_id"], "t", max(1.0, 2 * period), period, 0.6, duration)
    return _labelled(coalesce_intervals(found.select("video", "start_s", "end_s"), ["video"], gap=1.1), "jaywalking")


def failure_to_yield(detections: DataFrame, scene: Scene, period: float, duration: float) -> DataFrame:
    """Vehicles that move through a crossing while a person stands on it, on the same road section, within one and a half box sizes."""
    crossings, roads = scene.pixels(scene.crosswalks), scene.pixels(scene.roads)
    people = _people(detections, scene).where(~F.col("occupant") & (F.col("y2") < scene.height - 3))
    people = people.withColumns({"pc": geo.containing(F.col("x"), F.col("y"), crossings), "pr": geo.containing(F.col("x"), F.col("y"), roads)})
    people = people.where("size(pr) > 0").select("video", "t", F.col("x").alias("px"), F.col("y").alias("py"), "pr", F.explode("pc").alias("crossing"))
    v = detections.where(F.col("cls").isin(*YIELDING))
    v = v.withColumns({"x": (F.col("x1") + F.col("x2")) / 2, "y": F.col("y2"), "extent": F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))})
    speed = step_speed(ordered(["video", "cls", "track_id"], "t"), ["x", "y"], "t", 1.1)
    v = v.withColumns({"moving": F.coalesce(speed.between(0.15 * F.col("extent"), 4 * F.col("extent")), F.lit(False)), "vr": geo.containing(F.col("x"), F.col("y"), roads)})
    on = [F.struct(F.lit(i).alias("crossing"), _touches(box(), p).alias("on")) for i, p in enumerate(crossings)]
    v = v.withColumn("c", F.explode(F.array(*on))).select("video", "cls", "track_id", "t", "x", "y", "extent", "moving", "vr", "c.crossing", F.col("c.on").alias("on"))
    near = v.where("moving and on").join(people, ["video", "t", "crossing"]).where(F.arrays_overlap("vr", "pr") & (F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) <= 1.5 * F.col("extent")))
    hit = near.select("video", "cls", "track_id", "t", "crossing", F.lit(True).alias("conflict")).distinct()
    rows = v.join(hit, ["video", "cls", "track_id", "t", "crossing"], "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    found = tracks.flagged_episodes(rows, ["video", "cls", "track_id", "crossing"], "on", "conflict", period, duration)
    return _labelled(coalesce_intervals(found.select("video", "start_s", "end_s"), ["video"], gap=1.0), "failure_to_yield")


def failure_to_yield_by_distance(detections: DataFrame, scene: Scene, period: float, duration: float) -> DataFrame:
    """The older form: times at which a person and a fast vehicle share a crossing within 0.07 of the frame."""
    at = lambda d: d.withColumns({"ax": (F.col("x1") + F.col("x2")) / (2 * scene.width), "ay": F.col("y2") / scene.height})
    spread = lambda d: d.withColumn("crossing", F.explode(geo.containing(F.col("ax"), F.col("ay"), scene.crosswalks)))
    p = spread(at(_people(detections, scene).where(~F.col("occupant")))).where("ay < 0.95").select("video", "t", "crossing", F.col("ax").alias("px"), F.col("ay").alias("py"))
    v = spread(at(detections.where(F.col("cls").isin(2, 3, 5, 7) & (F.col("speed") >= 0.025))))
    flags = v.join(p, ["video", "t", "crossing"]).where(F.hypot(F.col("ax") - F.col("px"), F.col("ay") - F.col("py")) < 0.07).select("video", "t").distinct()
    return _labelled(sessions(flags, ["video"], "t", max(1.0, 2 * period), period, 0.3, duration), "failure_to_yield")


def stopped_buses(detections: DataFrame, scene: Scene, period: float, duration: float) -> DataFrame:
    """Buses near a stop whose ground point keeps within 1.2 % of the frame for ten seconds."""
    rows = detections.where(F.col("cls") == BUS).withColumns({"x": (F.col("x1") + F.col("x2")) / (2 * scene.width), "y": F.col("y2") / scene.height})
    near = F.lit(False)
    for p in scene.bus_stops:
        for px in (F.col("x"), F.col("x1") / scene.width, F.col("x2") / scene.width):
            near = near | (geo.signed_distance(px, F.col("y"), p) >= -scene.bus_stop_margin)
    found = tracks.dwells(rows.where(near), ["video", "track_id"], period, 0.012, 10.0, duration)
    return _labelled(coalesce_intervals(found.select("video", "start_s", "end_s"), ["video"], gap=1.0), "stopped_vehicle")


def _touches(b: Sequence[Column], polygon: geo.Polygon) -> Column:
    out = F.lit(False)
    for x, y in geo.contact_points(b):
        out = out | geo.inside(x, y, polygon)
    return out


def _labelled(df: DataFrame, label: str) -> DataFrame:
    return df.select("video", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), F.lit(label).alias("label"))


def all_events(detections: DataFrame, scene: Scene, period: float, duration: float) -> DataFrame:
    """All rules, sorted by start and label."""
    rules = (jaywalking, failure_to_yield, stopped_buses)
    first, *rest = [r(detections, scene, period, duration) for r in rules]
    for r in rest:
        first = first.unionByName(r)
    return first.orderBy("start_s", "label")


def may_judge_red(state: Column, observed_or_imputed: Column, uncertainty: Column) -> Column:
    """A frame at which the signal may be taken as red: red or red-amber, seen or bridged, its start certain."""
    return state.isin("red", "red_amber") & observed_or_imputed & (uncertainty == 0)
