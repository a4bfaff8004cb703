"""Modified Kneser-Ney over characters, one model for each value of ``lang``, of one order and the full alphabet at every size.

Counts, discounts, back-off weights and probabilities are tables, so nothing of the model is bounded by one machine. An
n-gram of four code points is two integers of 42 bits (0 is the text's border, others are one more than the code point).
The n-grams' 64-bit hashes and costs (negative log-probabilities, in units of ``1 / UNIT`` nats) are dealt by hash
to as many sorted arrays as hold ``MOST`` each; texts are read once for each. Costs are integers, so sums do not depend
on the number of arrays. The counts cover all texts that are scored: each n-gram of a text is in the model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch, small_batches

ORDER = 4
BITS = 21
UNIT = 1 << 24
#: n-grams of one array (12 bytes each).
MOST = 6_000_000
_ONE = (1 << BITS) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.sha256(lang.encode("utf-8", "surrogatepass")).digest()[:8], "little"))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low halves of the n-grams that end at each character of all texts, and each text's length."""
    lengths = np.array([len(x) for x in texts], np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    at = np.arange(len(cp)) + (ORDER - 1) * (np.repeat(np.arange(len(texts)), lengths) + 1)
    padded = np.zeros(len(cp) + (ORDER - 1) * len(texts), np.int64)
    padded[at] = cp
    return padded[at - 3] << BITS | padded[at - 2], padded[at - 1] << BITS | cp, lengths


def hashed(hi: np.ndarray, lo: np.ndarray, salts: np.uint64 | np.ndarray) -> np.ndarray:
    return _mix(_mix(hi.astype(np.uint64) ^ salts) ^ lo.astype(np.uint64)).view(np.int64)


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Rows (hash, high, low, n) with equal n-grams added up."""
    h, hi, lo, n = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((lo, hi, h))
    h, hi, lo, n = h[order], hi[order], lo[order], n[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
    return h[first], hi[first], lo[first], np.add.reduceat(n, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, ...]]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            cols = _merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cols[0]), pa.string()), *map(pa.array, cols)], names=["lang", "h", "hi", "lo", "n"])

    waiting = 0
    for batch in small_batches(batches, "text"):
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if text:
                by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            hi, lo, _ = grams(texts)
            h, first, n = np.unique(hashed(hi, lo, salt(lang)), return_index=True, return_counts=True)
            held.setdefault(lang, []).append((h, hi[first], lo[first], n))
            waiting += len(first)
        if waiting > 1_000_000:
            held = {lang: [_merge(parts)] for lang, parts in held.items()}
            waiting = 0
            if sum(len(p[0][0]) for p in held.values()) > 2_000_000:
                yield from rows()
                held = {}
    yield from rows()


def counts(docs: DataFrame) -> DataFrame:
    """``lang, h, hi, lo, n`` of all n-grams of ``docs(lang, text)``; lang is not null."""
    rows = docs.select("lang", "text").mapInArrow(_count, "lang string, h long, hi long, lo long, n long")
    return rows.groupBy("lang", "h", "hi", "lo").agg(F.sum("n").alias("n"))


def _discounts(level: DataFrame) -> DataFrame:
    """``lang, d1, d2, d3, v``: discounts of counts of 1, 2, and 3 or more; number of n-grams."""
    times = level.groupBy("lang").agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)), F.count("*").alias("v"))
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.0)
    d = [F.when(F.col(f"n{i}") > 0, F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.0)), F.lit(float(i)))).otherwise(0.0).alias(f"d{i}") for i in (1, 2, 3)]
    return times.select("lang", *d, "v")


def costs(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """``h, cost`` of every n-gram: the interpolated probability of its last character after the others."""
    one = F.lit(_ONE)
    hi, lo = F.col("hi"), F.col("lo")
    #: the suffix that a level's n-grams have at the level below
    suffix: list[tuple[Column, Column] | None] = [None, (F.lit(0).cast("long"), lo.bitwiseAND(one)), (F.lit(0).cast("long"), lo), (hi.bitwiseAND(one), lo)]
    levels = [counted]
    for to in reversed(suffix[1:]):  # continuation counts: distinct left neighbours; texts' borders are one
        levels.insert(0, scratch.keep(levels[0].groupBy("lang", to[0].alias("hi"), to[1].alias("lo")).agg(F.count("*").alias("n")), "level"))
    below = None
    for k, level in enumerate(levels):
        d = F.broadcast(scratch.keep(_discounts(level), "discounts"))
        head = F.shiftright(lo, BITS)
        ctx = level.groupBy("lang", hi.alias("chi"), head.alias("clo")).agg(F.sum("n").alias("total"), *(F.count_if(F.col("n") == i).alias(f"m{i}") for i in (1, 2)), F.count_if(F.col("n") > 2).alias("m3"))
        rows = level.withColumns({"chi": hi, "clo": head}).join(F.broadcast(ctx) if k == 0 else ctx, ["lang", "chi", "clo"]).join(d, "lang")
        if k:
            rows = rows.withColumns({"shi": suffix[k][0], "slo": suffix[k][1]})
            rows = rows.join(below.select("lang", F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p").alias("lower")), ["lang", "shi", "slo"])
        else:
            rows = rows.withColumn("lower", 1.0 / F.col("v"))
        own = F.greatest(F.col("n") - F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")), F.lit(0.0))
        gamma = F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")
        p = own / F.col("total") + gamma / F.col("total") * F.col("lower")
        if k < len(levels) - 1:
            below = scratch.keep(rows.select("lang", "hi", "lo", p.alias("p")), "level_p")
    return scratch.keep(rows.select("h", F.round(-F.log(F.greatest(p, F.lit(1e-12))) * UNIT).cast("int").alias("cost")), "costs")


class Costs:
    """One of ``of`` sorted hash arrays: those n-grams whose hash leaves the remainder ``part``."""

    def __init__(self, h: np.ndarray, cost: np.ndarray, part: int, of: int):
        order = np.argsort(h)
        self.h, self.cost, self.part, self.of = h[order], cost[order], part, of

    def sums(self, langs: list[str], texts: list[str]) -> np.ndarray:
        """Costs of each text's n-grams that this array holds."""
        hi, lo, lengths = grams(texts)
        salts = {x: salt(x) for x in set(langs)}
        h = hashed(hi, lo, np.repeat(np.array([salts[x] for x in langs], np.uint64), lengths))
        row = np.repeat(np.arange(len(texts)), lengths)
        if self.of > 1:
            own = h % self.of == self.part
            h, row = h[own], row[own]
        if not len(self.h) or not len(h):
            return np.zeros(len(texts), np.int64)
        known, which = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.h, known), len(self.h) - 1)
        cost = np.where(self.h[at] == known, self.cost[at], 0).astype(np.int64)
        upto = np.r_[0, np.cumsum(cost[which])]
        bounds = np.searchsorted(row, np.arange(len(texts) + 1))
        return upto[bounds[1:]] - upto[bounds[:-1]]


def arrays(table: DataFrame, most: int = MOST) -> Iterator[Costs]:
    """The model's arrays, one at a time; about ``most`` n-grams each."""
    of = max(1, -(-table.count() // most))
    for part in range(of):
        rows = (table if of == 1 else table.where(F.pmod("h", F.lit(of)) == part)).select("h", "cost").toArrow()
        yield Costs(rows.column("h").to_numpy(), rows.column("cost").to_numpy(), part, of)
