"""Clustering of flows: k-means with k chosen by silhouette, and merging of parallel flows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def features(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def array_features(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def kmeans(df: DataFrame, k: int, seed: int = 8, rounds: int = 100) -> DataFrame:
    """Adds ``cluster``. The objective is k-means'; labels need not agree with any other implementation's."""
    model = KMeans(k=k, seed=seed, maxIter=rounds, initMode="k-means||", featuresCol="features", predictionCol="cluster").fit(df)
    return model.transform(df)


def best_kmeans(df: DataFrame, k: int, seeds: int = 8, rounds: int = 100) -> DataFrame:
    """Adds ``cluster``: of several seeds, the model of the least cost."""
    tries = [KMeans(k=k, seed=s, maxIter=rounds, initMode="k-means||", featuresCol="features", predictionCol="cluster").fit(df) for s in range(seeds)]
    return min(tries, key=lambda m: m.summary.trainingCost).transform(df)


def choose_k(df: DataFrame, low: int = 3, high: int = 10, better: float = 0.01, seeds: int = 8) -> tuple[int, dict[int, float]]:
    """A larger k must beat the best silhouette by more than ``better``; silhouettes use squared distances."""
    high = min(high, df.count() // 4)
    scores: dict[int, float] = {}
    best = None
    for k in range(low, high + 1):
        got = best_kmeans(df, k, seeds)
        if got.select("cluster").distinct().count() < 2:
            continue
        scores[k] = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(got)
        if best is None or scores[k] > scores[best] + better:
            best = k
    return best or low, scores


def alike(a: Sequence[float], b: Sequence[float], angle: float = 20.0, apart: float = 250.0) -> bool:
    """Whether flow b (x0, y0, x1, y1) has a's heading and both its ends near a's line."""
    u, v = (np.subtract(f[2:], f[:2]) for f in (np.asarray(a, float), np.asarray(b, float)))
    u, v = (w / max(float(np.hypot(*w)), 1e-6) for w in (u, v))
    off = max(abs(u[0] * (y - a[1]) - u[1] * (x - a[0])) for x, y in ((b[0], b[1]), (b[2], b[3])))
    return float(np.degrees(np.arccos(np.clip(u @ v, -1, 1)))) < angle and off < apart


def merged_flows(df: DataFrame, cluster: str, angle: float = 20.0, apart: float = 250.0) -> DataFrame:
    """``df(cluster, x0, y0, x1, y1)`` with ``flow``: clusters of the same heading and line are one, medians taken anew after each merge; F1 is the largest.

    The driver sees a row a cluster (some ten); a merge is one aggregation.
    """
    into: dict[int, int] = {r[0]: r[0] for r in df.select(cluster).distinct().collect()}
    while into:
        pairs = F.create_map(*[F.lit(x) for p in into.items() for x in p])
        own = df.withColumn("__flow", pairs[F.col(cluster)])
        rows = own.groupBy("__flow").agg(F.count("*").alias("n"), *(F.median(c).alias(c) for c in ("x0", "y0", "x1", "y1"))).orderBy(F.desc("n"), "__flow").collect()
        pair = next(((a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if alike(a[2:], b[2:], angle, apart)), None)
        if pair is None:
            rank = F.create_map(*[x for k, r in enumerate(rows, 1) for x in (F.lit(r[0]), F.lit(f"F{k}"))])
            return own.withColumn("flow", rank[F.col("__flow")]).drop("__flow")
        into = {c: pair[0] if f == pair[1] else f for c, f in into.items()}
    return df.withColumn("flow", F.lit(None).cast("string"))
