"""Suffix-array dedup of bytes: repeated 200-byte strings by column-wise construction.

The collection is built column by column, right to left, one symbol of every string a round. A round
sorts the strings by (symbol, order of the round before), which is the Burrows-Wheeler order of their
suffixes at that column, and updates beside it how far neighbours agree (common prefixes). Two neighbours
that agree over 200 bytes hold a repeated string there.

The transform is positional: only texts around *anchors* that occur at several places enter
(``anchors``: equal 200-byte strings have equal anchors at equal places), and strings of one anchor are
aligned at it. Equal strings then lie in the same column, so suffixes of different columns need no order
between them, and a symbol costs the same however large the collection is; the unaligned form re-writes the
whole transform for each column. Symbols stand in an external file, column after column, written once and
read in sequence; order and prefixes of one column are all that is held.

Before that, occurrences with the same anchor and the same context (128 bits of all bytes under the windows that the
anchor owns) are known to repeat each other and need one member in the collection. An anchor with more than
``GROUP`` different contexts is split into groups by hash; strings that no group member repeats are then compared
across groups by a 128-bit hash, pre-aggregated, so no task holds an unbounded group.

Each byte covered by a 200-byte string that also starts anywhere else goes, the same document included. Null
texts are empty. Rows equal in doc_id and text count as one document listed more than once. Texts under 200
bytes lose nothing. Removed bytes may split a code point; the kept bytes are hashed as they are.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.anchors import BYTES, cover
from trackloom.llm.common import Scratch, small_batches, with_uid
from trackloom.llm.runs import SAMPLE, Runs, contexts, fingerprint_rows, one_window, unpack

LENGTH = 200
GRAM = 48
GROUP = 20_000
#: Strings that one construction takes (about 300 bytes each).
COLLECTION = 20_000


def _units(text: bytes) -> np.ndarray:
    return BYTES[np.frombuffer(text, np.uint8)]


def repeats(groups: np.ndarray, strings: list[bytes], place: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each string the starts of its ``length``-byte strings that another string of its group has in the same column.

    ``groups``: group numbers; ``place``: offset of the anchor in each string, column 0.
    """
    m = len(strings)
    sizes = np.array([len(x) for x in strings], np.int64)
    left, right = -place, sizes - place - 1
    columns = np.arange(int(right.max()), int(left.min()) - 1, -1)
    hits: list[tuple[np.ndarray, int]] = []
    with tempfile.TemporaryFile() as file:  # one column after another, in the order of the rounds
        width, low = len(columns), int(left.min())
        step = max(1, (1 << 24) // width)
        table = np.zeros((width, min(step, m)), np.uint8)
        for at in range(0, m, step):  # by blocks of strings: a block is columns x strings
            n = min(step, m - at)
            table[:] = 0
            for k in range(n):
                own = np.frombuffer(strings[at + k], np.uint8)
                start = int(left[at + k]) - low
                table[width - start - len(own) : width - start, k] = own[::-1]
            file.seek(0, 2)
            np.ascontiguousarray(table[:, :n]).tofile(file)
        order, agree = np.zeros(0, np.int64), np.zeros(0, np.int64)
        by_end = np.argsort(-right, kind="stable")
        ends, nxt = -right[by_end], 0
        blocks = [(at, min(step, m - at)) for at in range(0, m, step)]
        for turn, c in enumerate(columns.tolist()):
            until = int(np.searchsorted(ends, -c, "right"))
            fresh = by_end[nxt:until]
            nxt = until
            live = left[order] <= c
            if not live.all():  # strings that began right of this column leave; agreement passes over them
                at = np.flatnonzero(live)
                agree = np.minimum.reduceat(agree[: at[-1] + 1], np.r_[0, at[:-1] + 1]) if len(at) else agree[:0]
                order = order[at]
            symbols = np.empty(m, np.uint8)
            base = 0
            for at, n in blocks:
                file.seek(base + turn * n)
                symbols[at : at + n] = np.frombuffer(file.read(n), np.uint8)
                base += n * width
            border = len(fresh)
            order, agree = np.r_[fresh, order], np.r_[np.full(border, c + 1), agree]
            if border < len(order):
                agree[border] = c + 1
            key = (groups[order] << 8) | symbols[order]
            sort = np.argsort(key, kind="stable")
            key = key[sort]
            same = np.r_[False, key[1:] == key[:-1]]
            got = np.full(len(order), c, np.int64)
            two = np.flatnonzero(same)
            lo, hi = sort[two - 1] + 1, sort[two] + 1  # agreement of neighbours: least over what lay between them
            mixed = (sort[two - 1] < border) != (sort[two] < border)
            got[two[mixed]] = c + 1
            lo, hi, two = lo[~mixed], hi[~mixed], two[~mixed]
            power = np.frexp(hi - lo)[1] - 1
            value, level, k = np.zeros(len(lo), np.int64), agree, 0
            while len(lo):  # level k holds the least of each 2**k in a row
                now = np.flatnonzero(power == k)
                value[now] = np.minimum(level[lo[now]], level[hi[now] - (1 << k)])
                if k == power.max():
                    break
                level, k = np.minimum(level[: -(1 << k)], level[1 << k :]), k + 1
            got[two] = value
            order, agree = order[sort], got
            long = np.flatnonzero(agree >= c + length)
            if len(long):
                hits.append((np.unique(np.r_[order[long], order[long - 1]]), c))
    out: list[list[int]] = [[] for _ in range(m)]
    for who, c in hits:
        for k in who.tolist():
            out[k].append(c + int(place[k]))
    return [np.array(x[::-1], np.int64) for x in out]


def _members(length: int):
    """Bytes under the windows of each wanted context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            cols: list[list] = [[] for _ in range(8)]
            for uid, text, rows in zip(batch.column("uid").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("wanted").to_pylist()):
                raw = text.as_py()
                for r in rows:
                    first, size, place = (int(x) for x in unpack(np.int64(r["at"])))
                    row = (r["anchor"], r["part"], r["parts"], r["single"], uid, first, place, raw[first : first + size + length - 1])
                    for c, x in zip(cols, row):
                        c.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["anchor", "part", "parts", "single", "uid", "first", "place", "raw"])

    return run


MEMBER = "anchor long, part int, parts int, single boolean, uid long, first long, place int, raw binary"
FOUND = "uid long, start long, repeats boolean, h long, k long"


def _construct(length: int):
    """Repeated strings of the sorted members of a partition, some groups at a time.

    Windows that repeat within their group are returned as such; of split groups, every other window (of a
    single context) and every window of a repeated context with its hash, for the comparison across groups.
    """

    def solve(held: list[tuple]) -> pa.RecordBatch:
        number: dict[tuple, int] = {}
        groups = np.array([number.setdefault((r[0], r[1]), len(number)) for r in held], np.int64)
        strings, place = [r[7] for r in held], np.array([r[6] for r in held], np.int64)
        out: list[tuple] = []
        for r, starts in zip(held, repeats(groups, strings, place, length)):
            if r[3]:
                out += [(r[4], r[5] + s, True, None, None) for s in starts.tolist()]
            if r[2] > 1:
                known = set(starts.tolist()) if r[3] else set()
                for s in range(len(r[7]) - length + 1):
                    h, k = np.frombuffer(xxhash.xxh3_128_digest(r[7][s : s + length]), np.int64).tolist()
                    out.append((r[4], r[5] + s, None if r[3] and s not in known else False, h, k))
        cols = list(zip(*out)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["uid", "start", "repeats", "h", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if len(held) >= COLLECTION and (row[0], row[1]) != (held[-1][0], held[-1][1]):
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


def _removed(length: int, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows = []
            for text, at in zip(batch.column("text").cast(pa.binary()), batch.column("at")):
                raw = text.as_py() or b""
                n, spans, kept = len(raw), 0, raw
                if at.is_valid:
                    first, size, _ = unpack(at.values.to_numpy())
                    gone = cover(first, size, length, n)
                    spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def repeated_strings(docs: DataFrame, occurrences: DataFrame, scratch: Scratch, length: int, group: int) -> DataFrame:
    """``uid, at`` of runs of strings that also start elsewhere."""
    by = contexts(occurrences, scratch)
    twice = by.where("not single").select("anchor", "context", "twin")
    known = scratch.keep(occurrences.join(twice, ["anchor", "context", "twin"]).select("uid", "at"), "known")
    scratch.discard(occurrences)
    scratch.free()
    wanted = by.where("n > 1 and lone > 0").withColumn("parts", F.ceil(F.col("n") / group).cast("int"))
    wanted = wanted.withColumn("part", F.pmod("context", F.col("parts")).cast("int"))
    wanted = wanted.select("first.uid", F.struct("anchor", "part", "parts", "single", "first.at").alias("wanted")).groupBy("uid").agg(F.collect_list("wanted").alias("wanted"))
    members = docs.select("uid", "text").join(wanted, "uid").mapInArrow(_members(length), MEMBER)
    n = max(1, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
    members = members.repartition(n, "anchor", "part").sortWithinPartitions("anchor", "part")
    found = scratch.keep(members.mapInArrow(_construct(length), FOUND), "found")
    scratch.discard(by)
    scratch.free()
    inside = found.where("repeats").select("uid", one_window(F.col("start")).alias("at"))
    # across the groups of a split anchor: windows not yet known to repeat, against all its windows
    split = found.where("h is not null")
    where = F.struct("uid", "start")
    several = split.groupBy("h", "k").agg(F.min(where).alias("a"), F.max(where).alias("b")).where("a <> b").select("h", "k")
    across = split.where("repeats is null").join(several, ["h", "k"], "left_semi").select("uid", one_window(F.col("start")).alias("at"))
    out = scratch.keep(known.unionByName(inside).unionByName(across), "ranges")
    scratch.discard(known, found)
    return out


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, with_bytes: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row of ``docs(doc_id, text)``; kept is null without ``with_bytes``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    docs = with_uid(docs, scratch)
    runs = Runs(spark, scratch)
    sample = docs.where(F.pmod(F.xxhash64("uid"), F.lit(SAMPLE)) == 0)
    matched = runs.append(fingerprint_rows(docs, _units, length, gram), fingerprint_rows(sample, _units, length, gram))
    occurrences = runs.occurrences(matched)
    runs.drop()
    ranges = repeated_strings(docs, occurrences, scratch, length, group)
    ranges = ranges.groupBy("uid").agg(F.collect_list("at").alias("at"))
    scratch.free()
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.join(ranges, "uid", "left").select("doc_id", "text", "at")
    out = rows.mapInArrow(_removed(length, with_bytes), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = scratch.keep(out, "out")
    runs.drop()
    scratch.free()
    scratch.clear(out)
    return out
