"""Window-shaped operators over one ordered sequence per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def rolling_median_padded(w: WindowSpec, keys: Sequence[str], x: str, k: int = 5) -> Column:
    """Centred median with the first and last value repeated beyond the ends; sequences shorter than k stay as they are."""
    half = k // 2
    every = Window.partitionBy(*keys)
    n, at = F.count("*").over(every).cast("int"), F.row_number().over(w).cast("int")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = F.collect_list(x).over(w.rowsBetween(-half, half))
    before = F.array_repeat(F.first(x).over(whole), F.greatest(F.lit(half + 1) - at, F.lit(0)))
    after = F.array_repeat(F.last(x).over(whole), F.greatest(at + half - n, F.lit(0)))
    return F.when(n < k, F.col(x)).otherwise(F.element_at(F.array_sort(F.concat(before, near, after)), half + 1))


def rolling_median_shrinking(w: WindowSpec, x: str, k: int = 5) -> Column:
    """Centred median of what there is at the ends."""
    return F.percentile(x, F.lit(0.5)).over(w.rowsBetween(-(k // 2), k // 2))


def velocity(w: WindowSpec, x: str, t: str, reach: int = 5) -> Column:
    """Slope between the samples ``reach`` before and after, clipped to the ends; 0 for a single sample."""
    around = w.rowsBetween(-reach, reach)
    dt = F.greatest(F.last(t).over(around) - F.first(t).over(around), F.lit(1e-6))
    return (F.last(x).over(around) - F.first(x).over(around)) / dt


def within(fn: str, keys: Sequence[str], t: str, low: float | None, high: float | None) -> Column:
    """An aggregate over a RANGE frame around a double: from ``low`` to ``high`` seconds away (None: unbounded)."""

    def edge(x: float | None, side: str) -> str:
        return f"UNBOUNDED {side}" if x is None else "CURRENT ROW" if x == 0 else f"{abs(float(x))!r}D {'PRECEDING' if x < 0 else 'FOLLOWING'}"

    return F.expr(f"{fn} OVER (PARTITION BY {', '.join(keys)} ORDER BY {t} RANGE BETWEEN {edge(low, 'PRECEDING')} AND {edge(high, 'FOLLOWING')})")


def movement(keys: Sequence[str], points: Sequence[str], t: str, reach: float = 1.01) -> tuple[Column, Column]:
    """(distance, elapsed) between the first and last sample within ``reach`` seconds."""
    end = lambda f, c: within(f"{f}({c})", keys, t, -reach, reach)
    moved = [end("last", p) - end("first", p) for p in points]
    return F.sqrt(sum((m * m for m in moved[1:]), moved[0] * moved[0])), end("last", t) - end("first", t)


def step_speed(w: WindowSpec, points: Sequence[str], t: str, most: float) -> Column:
    """Speed since the previous sample; null unless that is within (0, most] seconds."""
    dt = F.col(t) - F.lag(t).over(w)
    moved = [F.col(p) - F.lag(p).over(w) for p in points]
    return F.when((dt > 0) & (dt <= most), F.sqrt(sum((m * m for m in moved[1:]), moved[0] * moved[0])) / dt)


def carried(w: WindowSpec, x: Column | str) -> Column:
    """Last value that is not null, this row's included."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def changed(w: WindowSpec, x: str) -> Column:
    """Differs from the row before; a null always counts as a change, as does the first row."""
    return F.coalesce(F.col(x) != F.lag(x).over(w), F.lit(True))


def percent_change(w: WindowSpec, x: str, lag: int) -> Column:
    before = F.lag(x, lag).over(w)
    return F.try_divide(100.0 * (F.col(x) - before), before)


def moving_mode(df: DataFrame, keys: Sequence[str], order: str, x: str, width: int = 9, name: str = "mode") -> DataFrame:
    """Most frequent value of the centred window, the lowest of equals."""
    around = ordered(keys, order).rowsBetween(-(width // 2), width // 2)
    return df.withColumn(name, F.mode(x, True).over(around))


def recent_motion(w: WindowSpec, points: Sequence[str], t: str, rows: int = 4, most: float = 1.6) -> list[Column]:
    """Per coordinate, displacement from the oldest of the last ``rows`` samples within (0, most] seconds; null if none."""
    past = F.collect_list(F.struct(F.col(t).alias("t"), *[F.col(p).alias(p) for p in points])).over(w.rowsBetween(-rows, -1))
    oldest = F.get(F.filter(past, lambda s: (F.col(t) - s["t"] > 0) & (F.col(t) - s["t"] <= most)), F.lit(0))
    return [F.col(p) - oldest[p] for p in points]


def circular_average(df: DataFrame, keys: Sequence[str], at: str, x: str, size: int, k: int = 5) -> DataFrame:
    """Moving average around a circle of ``size`` bins: the ends are repeated on the other side."""
    half = k // 2
    low = df.where(F.col(at) < half).withColumn(at, F.col(at) + size)
    high = df.where(F.col(at) >= size - half).withColumn(at, F.col(at) - size)
    w = ordered(keys, at).rowsBetween(-half, half)
    return df.unionByName(low).unionByName(high).withColumn("average", F.avg(x).over(w)).where((F.col(at) >= 0) & (F.col(at) < size))


def longest_circular_run(df: DataFrame, keys: Sequence[str], at: str, flag: str, size: int) -> DataFrame:
    """``start, length`` of the longest run of true bins around the circle (the first of equals)."""
    twice = df.unionByName(df.withColumn(at, F.col(at) + size))
    w = ordered(keys, at)
    run = F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w)
    lengths = twice.withColumn("__run", run).where(flag).groupBy(*keys, "__run").agg(F.min(at).alias("start"), F.least(F.count("*"), F.lit(size)).alias("length"))
    best = lengths.where(F.col("start") < size).groupBy(*keys).agg(F.max(F.struct("length", (-F.col("start")).alias("s"))).alias("m"))
    return best.select(*keys, (-F.col("m.s")).alias("start"), F.col("m.length").alias("length"))


def ordered_scan(df: DataFrame, key: str, order: Sequence[str], scan: Callable, added: str) -> DataFrame:
    """Adds columns ``added`` by ``scan(state, *row) -> (state, values)`` over each key's rows in order; the state of a new key is None.

    For recursions that no window can express. Partitions are sorted and read as a stream of batches with the state carried along, so it is linear
    and no key is held in memory. Nulls arrive as None or NaN.
    """
    at, names = df.columns.index(key), [*df.columns, *(c.split()[0] for c in added.split(","))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = state = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if row[at] != held:
                    held, state = row[at], None
                state, values = scan(state, *row)
                out.append((*row, *values))
            yield pd.DataFrame(out, columns=names)

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"{kind}, {added}")
