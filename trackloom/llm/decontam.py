"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND.

Every text is cut into overlapping passages: windows of twice a stride, one stride apart, the stride being the
least power of two (64 at least) that an item does not exceed, so each item lies whole in some passage, however
long or short the others are. Every passage is a query against the index of items of its stride. An item is retrieved if its BM25 score
reaches ``RECALL`` of the score that its own text gets. Impacts are stored divided by that threshold, so one bound
serves all items.

The index holds postings sorted by (term, item) and, sparsely, the largest impact of each term in each block of ``BLOCK`` items. Passages whose
summed term maxima stay under the threshold hold no item and end there. For batches of the others the block maxima are summed from the
block postings of their terms: blocks that stay under the threshold are dead to a passage. What is left is searched by block-max WAND: cursors in the
order of their items, the pivot where the term maxima first reach the threshold, a jump over dead blocks, the block maxima of the cursors at the
pivot, then a jump or the exact score. All bounds are upper bounds.

Number of items, their mean length and document frequencies are taken once over the whole benchmark. The index goes to the tasks in
shards of ``SHARD_BYTES`` of text (an item is never split), a pass over the texts for each; what is found depends neither on their number nor on their size.

Retrieved pairs are verified: of the question's and of the answer's 5-word shingles, ``OVERLAP`` each
must stand in the passage.

Words are runs of letters and digits (any non-ASCII byte counts as a letter), lower-cased. Null or
empty texts and items match nothing. Repeated rows are answered each. Repeated item_ids are separate items.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trackloom.llm.common import Scratch, small_batches

K1, B = 1.2, 0.75
RECALL = 0.6
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 8
LEAST_STRIDE = 64
#: Text of one shard's items; its index takes some ten times that.
SHARD_BYTES = 4 << 20
#: Rounding of sums of single-precision impacts: bounds are cut by this much.
SLACK = 1e-4
#: Cells and block postings that one batch of passages may take.
CELLS = 1 << 21
_SPACES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
FOUND = "score double, question_overlap double, answer_overlap double"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


def parts(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item that is one text: its last line is the answer, or its last quarter of words."""
    lines = [x for x in map(tokens, (text or "").split("\n")) if x]
    if len(lines) > 1:
        return [w for x in lines[:-1] for w in x], lines[-1]
    words = lines[0] if lines else []
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def _shingles(ids: np.ndarray, width: int = SHINGLE) -> set[bytes]:
    """All runs of ``width`` words (fewer words: the whole sequence)."""
    ids = np.ascontiguousarray(ids, np.int32)
    width = min(width, len(ids))
    if not width:
        return set()
    return set(np.lib.stride_tricks.sliding_window_view(ids, width).copy().view(f"V{4 * width}").ravel().tolist())


def overlap(side: np.ndarray, passage: np.ndarray) -> float:
    """Share of a side's shingles that stand in the passage; an empty side is wholly in."""
    own = _shingles(side)
    return len(own & _shingles(passage, min(SHINGLE, len(side)))) / len(own) if own else 1.0


class Item(NamedTuple):
    id: object
    question: list[bytes]
    answer: list[bytes]

    @property
    def words(self) -> list[bytes]:
        return self.question + self.answer


class Statistics(NamedTuple):
    """Of the whole benchmark: items with a word, their mean length, and the document frequency of a term."""

    n: int
    average: float
    df: Callable[[bytes], int]


def counted(items: list[Item]) -> Statistics:
    items = [x for x in items if x.words]
    df: dict[bytes, int] = {}
    for x in items:
        for w in set(x.words):
            df[w] = df.get(w, 0) + 1
    return Statistics(len(items), sum(len(x.words) for x in items) / max(len(items), 1), lambda w: df.get(w, 0))


def stride_of(length: int) -> int:
    return max(LEAST_STRIDE, 1 << max(length - 1, 0).bit_length())


class Postings:
    """Inverted index of the items of one stride. ``seq``: word ids of (question, answer) of each."""

    def __init__(self, seq: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, average: float, stride: int):
        self.stride, self.n = stride, len(seq)
        whole = [np.concatenate(x) for x in seq]
        item = np.repeat(np.arange(self.n), [len(x) for x in whole])
        length = np.array([len(x) for x in whole], np.float64)
        key, tf = np.unique(np.concatenate(whole).astype(np.int64) * (self.n + 1) + item, return_counts=True)
        term, doc = key // (self.n + 1), key % (self.n + 1)
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / average))
        self.least = RECALL * np.bincount(doc, impact, self.n)
        impact = impact / np.maximum(self.least[doc], 1e-9)
        self.keys, self.docs, self.impact = key, doc, impact.astype(np.float32)
        self.begin = np.searchsorted(term, np.arange(len(idf) + 1))
        self.blocks = -(-self.n // BLOCK)
        bkey, first = np.unique(term * (self.blocks + 1) + doc // BLOCK, return_index=True)
        self.bkeys, self.bmax = bkey, np.maximum.reduceat(self.impact, first)
        self.block = bkey % (self.blocks + 1)
        self.bbegin = np.searchsorted(bkey // (self.blocks + 1), np.arange(len(idf) + 1))
        self.top = np.zeros(len(idf), np.float32)
        np.maximum.at(self.top, term, self.impact)

    def seek(self, terms: np.ndarray, target: int | np.ndarray) -> np.ndarray:
        """Places of the first postings of terms at items from ``target`` on."""
        return np.searchsorted(self.keys, terms * (self.n + 1) + target)

    def at(self, terms: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Items under cursors; ``n`` for those at their list's end."""
        done = place >= self.begin[terms + 1]
        return np.where(done, self.n, self.docs[np.minimum(place, len(self.docs) - 1)])

    def wand(self, terms: np.ndarray, live: np.ndarray) -> Iterator[tuple[int, float]]:
        """(item, score over threshold) of all items of ``live`` blocks whose postings of ``terms`` (distinct) sum up to the threshold."""
        terms = terms[self.top[terms] > 0]
        place, top = self.begin[terms].copy(), self.top[terms]
        doc = self.at(terms, place)
        while True:
            order = np.argsort(doc, kind="stable")
            reach = np.cumsum(top[order])
            p = int(np.searchsorted(reach, 1 - SLACK))
            if p == len(order) or doc[order[p]] == self.n:
                return
            pivot = int(doc[order[p]])
            alive = int(np.searchsorted(live, pivot // BLOCK))
            if alive == len(live):
                return
            if live[alive] > pivot // BLOCK:
                target = int(live[alive]) * BLOCK
                within = np.flatnonzero(doc < target)
                place[within] = self.seek(terms[within], target)
                doc[within] = self.at(terms[within], place[within])
                continue
            within = np.flatnonzero(doc <= pivot)
            block = terms[within] * (self.blocks + 1) + pivot // BLOCK
            b = np.minimum(np.searchsorted(self.bkeys, block), len(self.bkeys) - 1)
            if self.bmax[b][self.bkeys[b] == block].sum() < 1 - SLACK:  # nothing before the block's end or the next cursor
                beyond = doc[doc > pivot]
                target = min((pivot // BLOCK + 1) * BLOCK, int(beyond.min()) if len(beyond) else self.n)
            elif doc[order[0]] == pivot:
                score = float(self.impact[place[within]].sum())
                if score >= 1 - SLACK:
                    yield pivot, score
                target = pivot + 1
            else:
                target, within = pivot, np.flatnonzero(doc < pivot)
            place[within] = self.seek(terms[within], target)
            doc[within] = self.at(terms[within], place[within])

    def passages(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the passages of texts that end at ``ends``."""
        starts, stops, begin = [], [], 0
        for end in ends.tolist():
            s = np.arange(begin, max(begin + 1, end - self.stride), self.stride) if end > begin else np.zeros(0, np.int64)
            starts.append(s)
            stops.append(np.minimum(s + 2 * self.stride, end))
            begin = end
        return (np.concatenate(starts), np.concatenate(stops)) if starts else (np.zeros(0, np.int64),) * 2

    def bounded(self, ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number, distinct terms, live blocks) of the passages with any; in batches of at most ``CELLS`` words, block postings and cells."""
        weight = np.r_[0, np.cumsum((self.bbegin[1:] - self.bbegin[:-1])[ids])]
        cost = np.maximum(weight[stop] - weight[start] + stop - start, self.blocks)
        turn = np.cumsum(cost) // CELLS
        for own in np.split(np.arange(len(start)), np.flatnonzero(np.diff(turn)) + 1):
            size = stop[own] - start[own]
            row = np.repeat(np.arange(len(own)), size)
            pair = np.unique(row * len(self.top) + ids[_ranges(start[own], size)])  # a query term counts once
            row, term = pair // len(self.top), pair % len(self.top)
            size = self.bbegin[term + 1] - self.bbegin[term]
            at = _ranges(self.bbegin[term], size)
            bound = np.bincount(np.repeat(row, size) * self.blocks + self.block[at], self.bmax[at], len(own) * self.blocks).reshape(len(own), self.blocks)
            first = np.searchsorted(row, np.arange(len(own) + 1))
            for k in np.flatnonzero((bound >= 1 - SLACK).any(axis=1)).tolist():
                yield int(own[k]), term[first[k] : first[k + 1]], np.flatnonzero(bound[k] >= 1 - SLACK)

    def retrieve(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(start, end, item, score) of every passage and item over the threshold."""
        start, stop = self.passages(ends)
        total = np.r_[0.0, np.cumsum(self.top[ids], dtype=np.float64)]
        kept = np.flatnonzero(total[stop] - total[start] >= 1 - SLACK)
        start, stop = start[kept], stop[kept]
        for k, terms, live in self.bounded(ids, start, stop) if len(kept) else ():
            for item, score in self.wand(terms, live):
                yield int(start[k]), int(stop[k]), item, score * float(self.least[item])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... of each size, one after another."""
    return np.arange(int(size.sum())) + np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size)


class Index:
    """One shard: words of its items, and postings by stride."""

    def __init__(self, items: list[Item], whole: Statistics):
        items = [x for x in items if x.words]
        self.terms: dict[bytes, int] = {}
        seq = [tuple(np.array([self.terms.setdefault(w, len(self.terms) + 1) for w in side], np.int32) for side in (x.question, x.answer)) for x in items]
        df = np.array([0, *map(whole.df, self.terms)], np.float64)
        idf = np.log1p((whole.n - df + 0.5) / (df + 0.5))
        idf[0] = 0  # words of no item
        strides = [stride_of(len(x.words)) for x in items]
        self.parts: list[tuple[Postings, list[object], list[tuple[np.ndarray, np.ndarray]]]] = []
        for stride in sorted(set(strides)):
            own = [k for k, s in enumerate(strides) if s == stride]
            self.parts.append((Postings([seq[k] for k in own], idf, whole.average, stride), [items[k].id for k in own], [seq[k] for k in own]))

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, object, float, float, float]]:
        """(number of the text, item_id, score, overlaps) for each verified pair, best passage first."""
        if not self.parts:
            return
        get, held, ends = self.terms.get, [np.zeros(0, np.int32)], []
        for text in texts:
            words = tokens(text)
            held.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
            ends.append(len(words) + (ends[-1] if ends else 0))
        ids, ends = np.concatenate(held), np.array(ends, np.int64)
        for postings, names, seq in self.parts:
            best: OrderedDict[tuple[int, int], tuple[float, float, float]] = OrderedDict()
            for start, stop, item, score in postings.retrieve(ids, ends):
                q, a = (overlap(side, ids[start:stop]) for side in seq[item])
                if q >= OVERLAP and a >= OVERLAP:
                    key = int(np.searchsorted(ends, start, "right")), item
                    best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, q, a))
            for (k, item), found in best.items():
                yield k, names[item], *found


def _sides(split: bool):
    return (lambda r: Item(r[0], tokens(r[1]), tokens(r[2]))) if split else (lambda r: Item(r[0], *parts(r[1])))


def _terms(split: bool):
    """``size`` of each item (number of words, on one row of it) and its distinct terms."""
    item = _sides(split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, size = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                words = item(row).words
                own = sorted(set(words))
                term += own
                size += [len(words)] + [0] * (len(own) - 1) if own else []
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.binary()), pa.array(size, pa.int64())], names=["term", "size"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of every verified pair.

    ``benchmark`` has item_id and text, or question and answer instead of text. Its terms are counted by Spark; the driver holds the items
    of one shard at a time, and of the counts those of the shard's own terms.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    kind, of_item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    named = to_arrow_type(of_item)
    split = "question" in benchmark.columns
    texts = ("question", "answer") if split else ("text",)
    rows = benchmark.select("item_id", *texts)
    terms = rows.mapInArrow(_terms(split), "term binary, size long")
    terms = scratch.keep(terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("items")), "terms")
    n, size = terms.agg(F.coalesce(F.sum("items"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    total = rows.agg(F.coalesce(F.sum(reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) for c in texts])), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // shard_bytes))
    out = None
    for k in range(shards):
        own = rows if shards == 1 else rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(shards)) == k)
        items = [_sides(split)(r) for r in own.orderBy(*rows.columns).collect()]
        counts = terms.select("term", "df")
        if shards > 1:
            counts = counts.join(own.mapInArrow(_terms(split), "term binary, size long").select("term").distinct(), "term", "left_semi")
        df = {bytes(r[0]): r[1] for r in counts.collect()}
        shared = spark.sparkContext.broadcast(Index(items, Statistics(n, size / max(n, 1), lambda w, df=df: df.get(w, 0))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, "text"):
                found = list(shared.value.search(batch.column("text").to_pylist()))
                at, *cols = zip(*found) if found else [()] * 5
                cols = [pa.array(c, t) for c, t in zip(cols, (named, pa.float64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *cols], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id {of_item.simpleString()}, {FOUND}")
        out = part if out is None else out.unionByName(part)
    scratch.clear()
    return out
