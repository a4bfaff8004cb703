"""Language ID by compression.

A language's model is a raw-content zstandard dictionary: text of a bounded sample of labelled rows
(``SAMPLE`` documents a language, those of the smallest hash, of each a stretch of ``PART`` letters that begins at a hashed place;
``DICT_BYTES`` bytes a language). Letters alone count, lower-cased. A whole text is
cut into stretches of ``STRETCH`` bytes, each is encoded with every dictionary, and the language with
the fewest bytes in total wins. Margins under ``NARROW`` are flagged as rejected.

Null texts and texts without a letter (marks alone are none) give ``und`` with score 0. Lang, source and doc_id are never
inputs of a prediction. With nothing to learn from, all predictions are ``und``. Repeated rows get the
same answer each. Ties (very short texts) go
to the language with the most labelled rows, then the first in code-point order. A language of one short text has that as its dictionary; one without
a letter in its sample cannot be learned. Any number of languages will do: dictionaries go to the tasks in groups of ``MODEL_BYTES``, each a
step over the texts that carries the least costs on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 400
DICT_BYTES = 60_000
STRETCH = 4096
LEVEL = 5
NARROW = 0.02
#: Letters that one sampled text gives.
PART = DICT_BYTES // 25
#: Languages whose counts are broadcast (some 50 bytes each); those of more are joined by shuffle.
FEW = 100_000
#: Dictionaries that a task holds at once.
MODEL_BYTES = 32 << 20


def letters(text: Column | str) -> Column:
    """Lower-cased letters and marks, all else one space: format habits tell nothing about a language."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M} ]+", " ")


def dictionaries(labelled: DataFrame, sample: int = SAMPLE, size: int = DICT_BYTES) -> dict[str, bytes]:
    """``labelled(doc_id, text, lang)`` -> a dictionary for each language, from a bounded sample.

    Rows are picked by the hash of (doc_id, text): a first filter at about twice the wanted share leaves
    few rows to rank, so no language, however large, is ranked in one task. What reaches the driver is ``size`` bytes a language,
    in the order of preference on ties.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text").withColumn("mark", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    counts = rows.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"))
    if counts.limit(FEW + 1).count() <= FEW:  # a row a language: texts stay where they are
        counts = F.broadcast(counts)
    rows = rows.join(counts, F.col("lang") == F.col("of")).where(F.col("mark") <= F.least(F.lit(1.0), (2.0 * sample + 100) / F.col("n")) * float(2**63))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mark", "text"))
    own, part = letters("text"), size // 25
    begin = F.pmod(F.col("mark"), F.greatest(F.length("own") - part, F.lit(0)) + 1) + 1
    picked = rows.withColumn("rank", rank).where(F.col("rank") <= sample).withColumn("own", own).select("lang", "rank", F.substring("own", begin.cast("int"), F.lit(part)).alias("own"), "n")
    texts: dict[tuple[int, str], bytearray] = {}
    for r in picked.orderBy("lang", "rank").toLocalIterator():
        held = texts.setdefault((-r.n, r.lang), bytearray())
        if len(held) < size and r.own.strip():
            held += r.own.encode("utf-8", "replace") + b"\n"
    out = {k[1]: bytes(v[:size]) for k, v in sorted(texts.items()) if v}
    return {k: v * -(-8 // len(v)) for k, v in out.items()}  # zstandard wants eight bytes


def groups(dicts: dict[str, bytes], most: int = MODEL_BYTES) -> list[dict[str, bytes]]:
    """Dictionaries in order, as many in a group as ``most`` bytes hold."""
    out: list[dict[str, bytes]] = [{}]
    room = most
    for lang, raw in dicts.items():
        if out[-1] and len(raw) > room:
            out.append({})
            room = most
        out[-1][lang] = raw
        room -= len(raw)
    return out


class Classifier:
    def __init__(self, dicts: dict[str, bytes]):
        self.langs = list(dicts)
        self.coders = []
        for raw in dicts.values():
            own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))

    def costs(self, text: str) -> np.ndarray:
        """Bytes of a text under each dictionary."""
        raw = text.encode("utf-8", "replace")
        cost = np.zeros(len(self.langs))
        for at in range(0, len(raw), STRETCH):
            part = raw[at : at + STRETCH]
            cost += [len(c.compress(part)) for c in self.coders]
        return cost

    def __call__(self, text: str | None, lang: str | None = None, least: float = np.inf, second: float = np.inf) -> tuple[str | None, float, float]:
        """The best language of ``letters(text)``, its cost and the next one's, after those of earlier groups."""
        if text is None or not self.langs:
            return lang, least, second
        for name, cost in zip(self.langs, self.costs(text)):
            if cost < least:
                lang, least, second = name, cost, least
            else:
                second = min(second, cost)
        return lang, float(least), float(second)


def predict(docs: DataFrame, dicts: dict[str, bytes], most: int = MODEL_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, lang_pred, score, rejected``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = F.when(F.col("text").rlike(r"\p{L}"), letters("text"))
    rows = docs.select("doc_id", own.alias("own"), F.lit(None).cast("string").alias("lang"), F.lit(float("inf")).alias("least"), F.lit(float("inf")).alias("second"))
    for group in groups(dicts, most):
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            classify = Classifier(shared.value)
            for batch in batches:
                held = zip(*(c.to_pylist() for c in batch.columns[1:]))
                got = list(zip(*(classify(*x) for x in held))) or [()] * 3
                cols = [pa.array(c, k) for c, k in zip(got, (pa.string(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=batch.schema.names)

        rows = rows.mapInArrow(run, f"doc_id {kind}, own string, lang string, least double, second double")
    margin = (F.col("second") - F.col("least")) / F.greatest(F.col("least"), F.lit(1.0))
    found = F.col("lang").isNotNull()
    score = F.when(~found, 0.0).when(F.col("second") == float("inf"), 1.0).otherwise(1 - F.exp(-20 * margin))
    narrow = ~found | ((F.col("second") < float("inf")) & (margin < NARROW))
    return rows.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang_pred"), score.alias("score"), narrow.alias("rejected"))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from documents whose crc32(doc_id as text) mod 3 is not 1, predict all: adds ``held_out``."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    learned = dictionaries(docs.where(~held).select("doc_id", "text", "lang"))
    return predict(docs, learned).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
