"""Quality rules: counts of words, symbols and repeats, and n-gram perplexity under a corpus-counted model.

The language model is a modified Kneser-Ney model of characters, one for each value of ``lang`` (null is a
language of its own): ``charmodel``, of order 4 over all code points at every size. Spark counts all n-grams of all texts;
tasks pre-aggregate, so what is shuffled is a row per n-gram, language and task. Where the model has more n-grams than
one array holds, texts are read once for each array and the sums added.

Each text's log-perplexity, in nats a character and in nats a word, is held against its language's band,
median -/+ ``BAND`` robust deviations over all documents that pass the base rules; documents outside either go.

Null text: no words, base_failed. Repeated rows count as often as they are listed and get the same answer.
Texts of one language only, empty tables and null languages need no special case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm import charmodel
from trackloom.llm.common import Scratch, small_batches

BAND = (6.0, 6.0)
BIN = 0.005
#: Words beyond which a text's mean is no steadier; least robust deviations (nats a character, a word).
STEADY = 1000
LEAST_SPREAD = (0.05, 0.5)
_WS = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"  # fixed values of the contract
_NONE = "\x00null"


def repeated(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more, first occurrences included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    own: dict[bytes, int] = {}
    ids = np.array([own.setdefault(w, len(own)) for w in words], np.int64)
    if len(own) == len(words):
        return 0
    bits = max(1, int(len(own) - 1).bit_length())
    key, used = ids[:n].copy(), bits
    for k in range(1, width):
        if used + bits > 62:  # ranks instead of packed words, so that windows stay exact
            key = np.unique(key, return_inverse=True)[1]
            used = int(key.max()).bit_length()
        key, used = (key << bits) | ids[k : k + n], used + bits
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    mark = np.zeros(len(words) + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + width, -1)
    return int((np.cumsum(mark) > 0).sum())


def base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text or "") - (len(raw) - len(raw.translate(None, _WS)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = repeated(words)
    return len(words), chars, symbols, len(lines) - len(set(lines)), again, len(words) < 10 or 100 * again > 20 * len(words)


SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_perplexity double, nats double"


RAW = SCORED.replace("log_perplexity double, nats double", "cost long, n_code long, mark long, twin long")


def _first_pass(shared):
    """Counts of each text, and the costs of the n-grams that the first array holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts = batch.column("text").to_pylist()
            cols = [pa.array(c, k) for c, k in zip(zip(*map(base, texts)), [pa.int64()] * 5 + [pa.bool_()])]
            size = np.array([len(x or "") for x in texts], np.int64)
            cost = pa.array(shared.value.sums(batch.column("name").to_pylist(), [x or "" for x in texts]), mask=size == 0)
            names = ["id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cost", "n_code", "mark", "twin"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), *cols, cost, pa.array(size), batch.column("mark"), batch.column("twin")], names=names)

    return run


def _later_pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            cost = shared.value.sums(batch.column("name").to_pylist(), batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("mark"), batch.column("twin"), pa.array(cost)], names=["mark", "twin", "more"])

    return run


def graded(docs: DataFrame, scratch: Scratch, most: int = charmodel.MOST) -> DataFrame:
    """``id, lang`` and the columns of ``SCORED``: a pass over the texts for each array of the model, usually one.

    Later passes are joined by two 64-bit hashes of language and text; equal texts have equal costs.
    """
    spark, kind = docs.sparkSession, docs.schema["id"].dataType.simpleString()
    rows = docs.select("id", "lang", F.coalesce("lang", F.lit(_NONE)).alias("name"), "text")
    counted = scratch.keep(charmodel.counts(rows.select(F.col("name").alias("lang"), "text")), "grams")
    table = charmodel.costs(counted, scratch)
    scored, more = None, []
    for array in charmodel.arrays(table, most):
        several = array.of > 1
        own = rows.withColumns({"mark": F.xxhash64("name", "text") if several else F.lit(0).cast("long"), "twin": F.xxhash64("text", "name", F.lit(1)) if several else F.lit(0).cast("long")})
        shared = spark.sparkContext.broadcast(array)
        if scored is None:
            scored = scratch.keep(own.mapInArrow(_first_pass(shared), f"id {kind}, lang string, {RAW}"), "scored")
        else:
            part = own.where("text <> ''").select("name", "text", "mark", "twin").mapInArrow(_later_pass(shared), "mark long, twin long, more long")
            more.append(scratch.keep(part.groupBy("mark", "twin").agg(F.max("more").alias("more")), "more"))
        shared.unpersist()
    if more:
        rest = reduce(DataFrame.unionByName, more).groupBy("mark", "twin").agg(F.sum("more").alias("more"))
        scored = scored.join(rest, ["mark", "twin"], "left").withColumn("cost", F.col("cost") + F.coalesce("more", F.lit(0)))
    nats = F.col("cost") / F.lit(float(charmodel.UNIT))
    scored = scored.select(*(c for c in scored.columns if c not in ("cost", "n_code", "mark", "twin", "more")), F.when(F.col("n_code") > 0, nats / F.col("n_code")).alias("log_perplexity"), nats.alias("nats"))
    return scratch.keep(scored, "graded") if more else scored


def _middle(rows: DataFrame, name: str) -> DataFrame:
    """Median of ``x`` by (of, measure), from a histogram with bins of ``BIN``: exact counts, so reruns agree."""
    hist = rows.groupBy("of", "measure", F.round(F.col("x") / BIN).alias("x")).agg(F.count("*").alias("n"))
    key = Window.partitionBy("of", "measure")
    hist = hist.withColumn("upto", F.sum("n").over(key.orderBy("x"))).withColumn("all", F.sum("n").over(key))
    return hist.where("2 * upto >= all").groupBy("of", "measure").agg((F.min("x") * BIN).alias(name))


def bands(scored: DataFrame, scratch: Scratch) -> DataFrame:
    """``of, measure, median, spread`` of each language: the middle and the robust deviation of both measures.

    A text's mean varies the less the more words it has, so deviations are taken in units of
    sqrt(1 / words + 1 / STEADY). The table has two rows a language.
    """
    rows = scored.where("not base_failed and nats is not null").select(F.col("lang").alias("of"), "n_words", F.explode(_measures()).alias("measure", "x"))
    median = scratch.keep(_middle(rows, "median"), "medians")
    near = median.select(F.col("of").alias("o"), F.col("measure").alias("m"), "median")
    off = rows.join(F.broadcast(near), F.col("of").eqNullSafe(F.col("o")) & (F.col("measure") == F.col("m")))
    off = off.select("of", "measure", (F.abs(F.col("x") - F.col("median")) / _unit()).alias("x"))
    spread = _middle(off, "deviation").select(F.col("of").alias("o"), F.col("measure").alias("m"), "deviation")
    both = median.join(spread, F.col("of").eqNullSafe(F.col("o")) & (F.col("measure") == F.col("m")))
    least = F.when(F.col("measure") == "char", F.lit(LEAST_SPREAD[0])).otherwise(F.lit(LEAST_SPREAD[1]))
    return both.select("of", "measure", "median", F.greatest(1.4826 * F.col("deviation"), least).alias("spread"))


def _measures() -> Column:
    return F.create_map(F.lit("char"), F.col("log_perplexity"), F.lit("word"), F.col("nats") / _words())


def _unit() -> Column:
    return F.sqrt(1.0 / _words() + 1.0 / STEADY)


def _words() -> Column:
    """Number of words, 1 for wordless texts (they fail the base rules)."""
    return F.greatest(F.col("n_words"), F.lit(1))


def assess(docs: DataFrame, width: tuple[float, float] = BAND) -> DataFrame:
    """``id, <counts>, base_failed, log_perplexity, kept`` of every row of ``docs(id, lang, text)``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    scored = graded(docs, scratch)
    limits = scratch.keep(bands(scored, scratch), "bands")
    wide = limits.groupBy(F.col("of")).agg(*(F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}") for m in ("char", "word") for c in ("median", "spread")))

    def inside(x: Column, m: str) -> Column:
        z = (x - F.col(f"{m}_median")) / _unit() / F.col(f"{m}_spread")
        return F.coalesce(z.between(-width[0], width[1]), F.lit(True))

    rows = scored.join(F.broadcast(wide), F.col("lang").eqNullSafe(F.col("of")), "left")
    out = rows.select(*scored.columns, (~F.col("base_failed") & inside(F.col("log_perplexity"), "char") & inside(F.col("nats") / _words(), "word")).alias("kept"))
    out = scratch.keep(out.drop("lang", "nats"), "out")
    scratch.clear(out)
    return out
