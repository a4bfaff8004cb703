"""Small scalar rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label domain (fixed values).
LABELS = (
    "accident", "near_miss", "red_light", "wrong_way", "illegal_u_turn", "stopped_vehicle", "jaywalking", "failure_to_yield", "illegal_turn",
    "solid_line_crossing", "stop_line", "congestion", "road_obstacle", "fire_smoke",
)


def number(c: Column) -> Column:
    """Finite number: neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0.0 on zero denominators."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * p * r, p + r)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def stem(name: Column) -> Column:
    """Name before the last dot."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def exposure_value(f_number: Column, shutter: Column, iso: Column) -> Column:
    """EV at ISO 100."""
    return F.log2(f_number * f_number / shutter) - F.log2(iso / 100.0)


def vehicle_lamp(red: Column, amber: Column, green: Column) -> Column:
    """State of a three-lamp head from which lamps are on."""
    return (
        F.when(red & amber & ~green, "red_amber").when(red & ~amber & ~green, "red").when(~red & amber & ~green, "amber")
        .when(~red & ~amber & green, "green").when(~red & ~amber & ~green, "green_flash").otherwise("unclear")
    )


def pedestrian_lamp(red: Column, green: Column) -> Column:
    return F.when(red & ~green, "red").when(~red & green, "green").when(~red & ~green, "green_flash").otherwise("unclear")


def confidence(margins: list[Column]) -> Column:
    """min(1, margin / 2), margin the least of the lamps' distances from their thresholds."""
    least = F.least(*[F.abs(m) for m in margins]) if len(margins) > 1 else F.abs(margins[0])
    return F.least(F.lit(1.0), least / 2.0)


def frame_rate(fraction: Column) -> Column:
    """``num/den`` -> frames per second; 25 where it can't be read."""
    part = F.split(fraction, "/")
    value = F.try_divide(part[0].try_cast("double"), F.coalesce(F.get(part, F.lit(1)).try_cast("double"), F.lit(1.0)))
    return F.coalesce(F.when(value > 0, value), F.lit(25.0))


def codes(*flags: tuple[Column, str]) -> Column:
    """Names of the flags that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in flags]), lambda x: x.isNotNull())


def reasons(*flags: tuple[Column, str]) -> Column:
    """Names of the flags that hold joined by ``+``, or ``ok``."""
    return F.coalesce(F.nullif(F.concat_ws("+", codes(*flags)), F.lit("")), F.lit("ok"))


def has_prefix(c: Column, prefixes: list[str]) -> Column:
    """Whether a text starts with one of some prefixes."""
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes], F.lit(False))


def place(c: Column, order: list[str]) -> Column:
    """Rank of a value in a list; values that are not in it come last."""
    at = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(at > 0, at).otherwise(F.lit(len(order) + 1))


def padded_id(stem_: Column, head: Column, k: Column) -> Column:
    """``stem_head_07``."""
    return F.format_string("%s_%s_%02d", stem_, head, k)


def compact_stamp(at: Column) -> Column:
    """A time as ``20240131T235959Z``, in the session's zone."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def appended(items: Column, new: Column) -> Column:
    """A list with one more value unless it has it."""
    return F.array_union(items, F.array(new))


def list_mean(text: Column, sep: str = " ") -> tuple[Column, Column]:
    """(mean, mean magnitude) of a text of numbers."""
    values = F.transform(F.split(F.trim(text), sep), lambda x: x.try_cast("double"))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    return mean(values), mean(F.transform(values, F.abs))


def triples_mean(values: Column) -> Column:
    """Mean of each of three axes of a flat list x, y, z, x, y, z, ..."""
    n = F.size(values) / 3
    axis = lambda k: F.aggregate(F.filter(values, lambda v, i: i % 3 == k), F.lit(0.0), lambda a, x: a + x) / n
    return F.array(*map(axis, range(3)))


def colour_score(r: Column, g: Column, b: Column, hue: float, reach: float = 25.0) -> Column:
    """How strongly a pixel (0 to 255) shows a hue in degrees: saturation times value within ``reach`` of it, else 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    angle = F.when(top == r, F.pmod((g - b) / span, F.lit(6.0))).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4) * 60
    off = F.abs(F.pmod(angle - hue + 180, F.lit(360.0)) - 180)
    return F.when((span > 0) & (off <= reach), span / top * top / 255.0).otherwise(0.0)
