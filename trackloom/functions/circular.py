"""Angles and phases: floored remainders, differences on the circle, means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def heading(dx: Column, dy: Column) -> Column:
    """Degrees in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))


def signed_difference(a: Column, b: Column) -> Column:
    """a - b wrapped to (-180, 180]."""
    return F.lit(180.0) - F.pmod(F.lit(180.0) - (a - b), F.lit(360.0))


def difference(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def mean_heading(degrees: Column) -> Column:
    """Aggregate: circular mean in degrees."""
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees))))), F.lit(360.0))


def resultant(degrees: Column) -> Column:
    """Aggregate: length of the mean unit vector (coherence)."""
    s, c = F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))
    return F.sqrt(s * s + c * c)


def phase(t: Column, start: float | Column, cycle: float | Column) -> Column:
    return F.pmod(t - (start if isinstance(start, Column) else F.lit(float(start))), cycle if isinstance(cycle, Column) else F.lit(float(cycle)))


def compass(degrees: Column) -> Column:
    """Name of the nearest of eight directions (image axes: y grows downwards)."""
    names = F.array(*map(F.lit, ("right", "down-right", "down", "down-left", "left", "up-left", "up", "up-right")))
    return F.element_at(names, (F.floor(F.pmod(degrees + 22.5, F.lit(360.0)) / 45.0) + 1).cast("int"))


def turn(degrees: Column) -> Column:
    """Kind of a heading change in (-180, 180]."""
    size = F.abs(degrees)
    return F.when(size < 35, "straight").when(size > 140, "u-turn").when(degrees > 0, "right").otherwise("left")
