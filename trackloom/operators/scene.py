"""Scene maps: direction by grid cell, modes, neighbours, density, components, blockers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import circular
from trackloom.functions.scalars import codes, reasons


def distinct_density(df: DataFrame, track: Sequence[str], cell: Sequence[str], least: int = 2) -> DataFrame:
    """Distinct tracks by cell; a track counts once in a cell however long it stays."""
    once = df.select(*track, *cell).distinct()
    return once.groupBy(*cell).agg(F.count("*").alias("tracks")).where(F.col("tracks") >= least)


def neighbours(cells: DataFrame, keys: tuple[str, str] = ("i", "j")) -> DataFrame:
    """Pairs of a cell and its present neighbours (3 x 3 without the centre): an offset table of eight rows exploded, then an equi-join."""
    i, j = keys
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]))
    reach = cells.select(i, j, steps.alias("s")).select(i, j, (F.col(i) + F.col("s.di")).alias("ni"), (F.col(j) + F.col("s.dj")).alias("nj"))
    return reach.join(cells.select(F.col(i).alias("ni"), F.col(j).alias("nj")), ["ni", "nj"])


def grid_components(cells: DataFrame, keys: tuple[str, str] = ("i", "j"), by: Sequence[str] = ()) -> DataFrame:
    """Connected components of cells (eight neighbours): ``root_i, root_j`` is the least cell reachable.

    A grid is fixed by its image and has some thousand cells at most, so one grid is one group; ``by`` separates grids.
    """
    i, j = keys
    fields = "".join(f"{c} {cells.schema[c].dataType.simpleString()}, " for c in by)

    def label(part: pd.DataFrame) -> pd.DataFrame:
        left, out = set(zip(part[i].tolist(), part[j].tolist())), {}
        for root in sorted(left):
            todo = [root] if root in left else []
            while todo:
                c = todo.pop()
                if c in left:
                    left.discard(c)
                    out[c] = root
                    todo += [(c[0] + a, c[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        head = {c: part[c].iloc[0] for c in by}
        return pd.DataFrame([{**head, i: c[0], j: c[1], "root_i": r[0], "root_j": r[1]} for c, r in out.items()])

    flat = cells.select(*by, F.col(i).cast("int"), F.col(j).cast("int")).distinct().withColumn("__grid", F.lit(0))
    return flat.groupBy(*(by or ["__grid"])).applyInPandas(label, f"{fields}{i} int, {j} int, root_i int, root_j int")


def direction_cells(df: DataFrame, cell: Sequence[str], track: Sequence[str], video: str = "video", agree: float = 30.0, support: int = 3) -> DataFrame:
    """Merged direction by cell: circular mean over tracks of their mean headings, coherence, and how many videos with enough tracks agree."""
    unit = df.groupBy(*cell, video, *[t for t in track if t != video]).agg(circular.mean_heading(F.col("heading")).alias("h"))
    per_video = unit.groupBy(*cell, video).agg(circular.mean_heading(F.col("h")).alias("vh"), F.count("*").alias("vn"))
    whole = unit.groupBy(*cell).agg(circular.mean_heading(F.col("h")).alias("heading"), circular.resultant(F.col("h")).alias("coherence"), F.count("*").alias("tracks"))
    both = per_video.where(F.col("vn") >= support).join(whole.select(*cell, "heading"), list(cell))
    votes = both.groupBy(*cell).agg(F.count("*").alias("videos"), F.sum(F.when(circular.difference(F.col("vh"), F.col("heading")) <= agree, 1).otherwise(0)).alias("agreeing"))
    out = whole.join(votes, list(cell), "left").na.fill(0, ["videos", "agreeing"])
    return out.withColumn("status", acceptance(F.col("coherence"), F.col("tracks"), F.col("videos"), F.col("agreeing")))


def acceptance(coherence: Column, tracks: Column, videos: Column, agreeing: Column) -> Column:
    """``ok`` or what is missing, joined by ``+``."""
    return reasons((coherence < 0.8, "incoherent"), (tracks < 5, "few_tracks"), (agreeing < videos, "videos_disagree"))


def blockers(coherence: Column, tracks: Column, modes: Column, agreeing: Column, videos: Column, edge: Column, neighbour_ok: Column) -> Column:
    """Codes that keep a cell from being safe; a safe cell has none."""
    return codes(
        (coherence < 0.8, "incoherent"), (tracks < 5, "few_tracks"), (modes > 1, "several_directions"), (agreeing < videos, "videos_disagree"),
        (videos < 2, "one_video"), (edge, "at_edge"), (~neighbour_ok, "lone_cell"),
    )


def heading_modes(df: DataFrame, cell: Sequence[str], heading: str = "heading", reach: float = 45.0, kappa: float = 12.0, least: int = 1, share: float = 0.0) -> DataFrame:
    """Directions of a cell, greedily: the peak of a von Mises density on a 1-degree grid, re-centred once on the members within ``reach``; members leave and the search repeats.

    It ends where fewer than ``least`` samples, or less than ``share`` of the cell's, are left or make the next mode.

    A cell is collected into one task as a histogram of whole degrees (at most 360 rows), whatever its number of samples.
    """
    binned = df.groupBy(*cell, F.pmod(F.round(F.col(heading)), F.lit(360.0)).cast("int").alias("degree")).agg(F.count("*").alias("n"))
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cell)
    grid = np.radians(np.arange(360))

    def modes(part: pd.DataFrame) -> pd.DataFrame:
        degree, weight = part["degree"].to_numpy(), part["n"].to_numpy().astype(float)
        total, out = weight.sum(), []
        while weight.sum() >= max(least, share * total, 1):
            density = (np.exp(kappa * (np.cos(grid[:, None] - grid[degree][None, :]) - 1)) * weight).sum(axis=1)
            peak = float(np.argmax(density))
            for _ in range(2):
                near = (np.abs((degree - peak + 180) % 360 - 180) <= reach) & (weight > 0)
                peak = float(np.degrees(np.arctan2((np.sin(grid[degree]) * weight)[near].sum(), (np.cos(grid[degree]) * weight)[near].sum())) % 360)
            near = (np.abs((degree - peak + 180) % 360 - 180) <= reach) & (weight > 0)
            if weight[near].sum() < max(least, share * total, 1):
                break
            out.append((round(peak, 3), weight[near].sum() / total, int(weight[near].sum())))
            weight = np.where(near, 0, weight)
        keys = {c: part[c].iloc[0] for c in cell}
        return pd.DataFrame([{**keys, "mode": k, "heading": h, "share": s, "n": n} for k, (h, s, n) in enumerate(out)], columns=[*cell, "mode", "heading", "share", "n"])

    return binned.groupBy(*cell).applyInPandas(modes, f"{fields}, mode int, heading double, share double, n long")


def against_flow(safe: Column, heading: Column, expected: Column, tolerance: float = 120.0) -> Column:
    """Whether a heading goes against the expected one; null outside safe cells."""
    return F.when(safe, circular.difference(heading, expected) > tolerance)
