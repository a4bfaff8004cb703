"""Mixing sources to target weights by systematic sampling.

Within a source every document expects ``target / source_size`` copies. Documents stand in the order
of (size class, part by hash, size), so that each size gets its share; expected copies are summed
along it, one offset u in [0, 1) is added, and a document is emitted once for each integer boundary
that its stretch crosses. So each document gets the floor or the ceiling of its expectation.

The prefix sum is distributed: rows are numbered within buckets (source, size class, hash) of bounded
expected size, and only bucket counts are summed across buckets. A source with a third of all rows is
spread over its buckets. Offsets have 20 binary digits, so sums stay exact.

Null texts have size 0. A source without words gets target 0 and no copies. A null source is a source of
its own, last in order. Repeated doc_ids are separate rows; buckets are dealt by id and text,
so that rows without an id, or of one id, do not meet in one bucket (rows equal in both do). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch, n_words

WEIGHTS = (1, 2, 3)
MOST = 3
BUCKET = 4_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes(source, source_size)`` -> with ``target``: weights in code-point order, null last, water-filled under caps.

    The level is closed-form: in the order of cap per weight, the first source that the level of those
    from it on leaves under its cap ends the capped ones. One row per source, so windows over all
    rows hold as many rows as there are sources.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level)
    rows = rows.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every).getField("level"))
    free = F.col("level") * F.col("weight")
    return rows.select("source", "source_size", F.when(free > F.col("cap"), F.col("cap").cast("double")).otherwise(F.coalesce(free, F.lit(0.0))).alias("target"))


def _hashed(seed: int, value: Column, digits: int) -> Column:
    """The first hexadecimal digits of an MD5 of seed and value, as a number: the same in any engine."""
    text = F.concat(F.lit(f"{seed}:"), value)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row."""
    scratch = Scratch(docs.sparkSession, "mixing")
    # the text counts too, so that rows without an id, or of the same id, are dealt over all buckets
    own = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    sized = docs.select("doc_id", "source", n_words("text").alias("size"), own.alias("own"))
    # the size class is the binary length of the size; a class has n / bucket + 1 hashed parts
    kind = F.length(F.bin("size"))
    sized = scratch.keep(sized.withColumn("kind", kind).withColumn("mark", _hashed(seed, F.col("own"), 15)).drop("own"), "sizes")
    classes = sized.groupBy("source", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    goal = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    parts = classes.select(F.col("source").alias("s"), F.col("kind").alias("k"), (F.col("n") / bucket).cast("int").alias("parts"))
    stretch = (F.col("mark") % (F.col("parts") + 1)).cast("int")
    rows = sized.join(parts, sized.source.eqNullSafe(parts.s) & (sized.kind == parts.k)).withColumn("part", stretch).drop("s", "k", "parts")
    counts = rows.groupBy("source", "kind", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy("kind", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("s"), F.col("kind").alias("k"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    goal = goal.select(F.col("source").alias("g"), "source_size", "target")
    counts = counts.join(goal, counts.s.eqNullSafe(goal.g)).drop("g")
    within = Window.partitionBy("source", "kind", "part").orderBy("size", "mark", F.col("doc_id").asc_nulls_last())
    rows = rows.withColumn("at", F.row_number().over(within))
    rows = rows.join(counts, rows.source.eqNullSafe(counts.s) & (rows.kind == counts.k) & (rows.part == counts.p))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hashed(seed, F.coalesce("source", F.lit("")), 5) / F.lit(float(1 << 20))
    end = F.col("ahead") + F.col("at")
    copies = F.least(F.floor(end * each + offset) - F.floor((end - 1) * each + offset), F.lit(most))
    out = rows.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    out = scratch.keep(out, "out")
    scratch.clear(out)
    return out


#: DuckDB's form of ``mix`` with default parameters over documents.
ORACLE = r"""WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS body FROM documents),
 m AS (SELECT *, length(bin(size)) AS kind, ('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || body), 1, 15))::BIGINT AS mark FROM s),
 c AS (SELECT source, kind, count(*) // 4000 AS parts FROM m GROUP BY ALL), src AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
 w AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight, 3 * source_size AS cap FROM src),
 l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
   / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv FROM w),
 v AS (SELECT arg_min(lv, (cap / weight, lv)) AS lv FROM l WHERE lv * weight <= cap),
 t AS (SELECT source, source_size, CASE WHEN v.lv * weight > cap THEN cap::DOUBLE ELSE coalesce(v.lv * weight, 0.0) END AS target,
   ('0x' || substr(md5('0:' || coalesce(source, '')), 1, 5))::BIGINT / 1048576.0 AS u FROM w LEFT JOIN v ON true),
 o AS (SELECT m.*, row_number() OVER (PARTITION BY m.source ORDER BY m.kind, m.mark % (c.parts + 1), m.size, m.mark, m.doc_id NULLS LAST) AS e FROM m JOIN c ON m.source IS NOT DISTINCT FROM c.source AND m.kind = c.kind),
 x AS (SELECT o.doc_id, o.size, t.source_size, t.target, e, u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS r FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source)
 SELECT doc_id, size, source_size, target, (least(floor(e * r + u) - floor((e - 1) * r + u), 3) * size)::BIGINT AS taken FROM x"""
