"""SimHash near-duplicates by a byte-position inverted index with count filtering.

1. Every whole text becomes a 64-bit fingerprint (3-word shingles, XXH64 seed 42). Equal
   fingerprints are pre-aggregated to one row with its smallest doc_id, so exact copies never meet.
2. Fingerprints at 3 or fewer differing bits differ in at most 3 of their 8 bytes: they share at
   least 5 positional bytes, and so at least 3 of the 4 in one half. The index lists every
   fingerprint under its 8 (byte positions, byte values) triples within the halves: two
   fingerprints below the guaranteed count can share no list, all others share one (the 8 triples
   are a Turan system: any 5 of 8 positions contain one).
3. Within a list, shared positional bytes are tallied for each pair, pairs under 5 are dropped, the
   rest verified by differing bits. Lists longer than ``BLOCK`` are split into blocks and each pair
   of blocks is a task of its own; a task returns a spanning forest of its links, so what leaves it
   grows with the fingerprints and never with the pairs.
4. Components by contraction (``graph.components``).

``near_groups`` links by these 64 bits. ``similar_groups`` links texts whose sets of five-word shingles have a
Jaccard similarity of about 0.8 or more, by the same steps over 1,024 bits: sets that similar have a cosine of 0.889 or more,
so that 0.152 of the bits differ, give or take 0.011. ``MOST_WIDE`` is one such deviation above. No count of
shared bytes is guaranteed at so many bits, so the least counts are statistical: a pair at the limit shares 31 of
128 positional bytes, give or take 5, ``LEAST_WIDE`` is three deviations below, and it meets in one of the 126 lists
(``WIDE``: three rounds that deal all positions into triples) with a probability of 0.86, at the similarity of 0.8 of 0.91,
at 0.85 of 0.99. A list's links are searched from a pivot outwards, among the members not yet reached, so that a
list of thousands of near copies costs about its length.

Null or wordless texts have fingerprint zero and link like any other. Rows that repeat a doc_id
keep one output row each. An empty table gives an empty result. A null doc_id is kept and counts as
larger than any other; a component of nulls alone has a null component_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch
from trackloom.llm.graph import components

BLOCK = 1024
MOST_BITS = 3
LEAST_BYTES = 8 - MOST_BITS
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]

WIDTH = 5
N_WORDS = 16
MOST_WIDE = 167
LEAST_WIDE = 16
WIDE_BLOCK = 8192
WIDE = np.concatenate([np.random.default_rng(k).permutation(8 * N_WORDS)[: 8 * N_WORDS // 3 * 3].reshape(-1, 3) for k in range(3)])
_STEPS = np.arange(1, N_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_LOW_BITS = np.uint64(0x0101010101010101)


def fingerprint(text: bytes | None) -> int:
    """Majority bits of the XXH64 (seed 42) of all 3-word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < 3:
        return int.from_bytes(digest(b" ".join(words), 42), "big")
    ones, join = np.zeros(64, np.int64), b" ".join
    for at in range(0, len(words) - 2, 1 << 16):  # bounded memory for very long texts
        part = words[at : at + (1 << 16) + 2]
        raw = b"".join([digest(s, 42) for s in map(join, zip(part, part[1:], part[2:]))])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(words) - 2).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left, out = np.ones(len(near), bool), []
    for root in np.flatnonzero(near.any(axis=1)):
        if not left[root]:
            continue
        left[root], front = False, [root]
        while front:
            v = front.pop()
            new = np.flatnonzero(near[v] & left)
            left[new] = False
            out += [(v, x) for x in new]
            front += list(new)
    return out


def links(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Boolean matrix: at least 5 shared positional bytes (tallied), then at most 3 differing bits."""
    x = a[:, None] ^ b[None, :]
    shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=2, dtype=np.uint8)
    kept = shared >= LEAST_BYTES
    out = np.zeros(x.shape, bool)
    out[kept] = np.bitwise_count(x[kept]) <= MOST_BITS
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends: list[tuple[int, int]] = []
        lists, i, j = batch.column("members"), batch.column("i").to_numpy(), batch.column("j").to_numpy()
        for k in range(batch.num_rows):
            rows = lists[k].values
            fps, block = rows.field("fp").to_numpy().view(np.uint64), rows.field("block").to_numpy()
            if i[k] == j[k]:
                near = links(fps, fps)
                np.fill_diagonal(near, False)
            else:
                first = block == i[k]
                fps, n = np.concatenate([fps[first], fps[~first]]), int(first.sum())
                near = np.zeros((len(fps), len(fps)), bool)
                near[:n, n:] = links(fps[:n], fps[n:])
                near[n:, :n] = near[:n, n:].T
            own = fps.view(np.int64)
            ends += [(own[v], own[x]) for v, x in forest(near)]
        got = np.array(ends, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])


def candidate_links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """``distinct(fp)`` -> ``(a, b)``: verified links, a spanning forest of each list's."""
    byte = [F.shiftrightunsigned("fp", 56 - 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = [F.lit(t << 24) + byte[p] * 65536 + byte[q] * 256 + byte[r] for t, (p, q, r) in enumerate(TRIPLES)]
    index = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    long = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = index.join(long, "key").withColumn("of", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("of")).cast("int"))
    dealt = dealt.select("key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.struct("fp", "block").alias("member"))
    tasks = dealt.groupBy("key", "i", "j").agg(F.collect_list("member").alias("members"))
    return tasks.select("i", "j", "members").mapInArrow(_verified, "a long, b long")


def wide_fingerprint(text: bytes | None) -> bytes:
    """Majority bits, 128 bytes of them, of 16 mixed hashes of each distinct five-word shingle."""
    words = (text or b"").lower().split()
    if not words:
        return bytes(8 * N_WORDS)
    digest, join = xxhash.xxh64_digest, b" ".join
    shingles = map(join, zip(*(words[k:] for k in range(WIDTH)))) if len(words) >= WIDTH else [join(words)]
    h = np.unique(np.frombuffer(b"".join([digest(s, 42) for s in shingles]), np.uint64))
    ones = np.zeros((8, N_WORDS, 8), np.int64)
    for at in range(0, len(h), 255 * 64):  # bounded memory; 255 rows at most share an 8-bit counter
        part = h[at : at + 255 * 64]
        x = part[:, None] + _STEPS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        starts = np.arange(0, len(x), 255)
        for bit in range(8):
            sums = np.add.reduceat((x >> np.uint64(bit)) & _LOW_BITS, starts, axis=0)
            ones[bit] += sums.view(np.uint8).reshape(-1, N_WORDS, 8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), axis=0, bitorder="little").tobytes()


def _wide_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [wide_fingerprint(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "fp"])


def _matrix(fps: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(fps.to_pylist()), np.uint64).reshape(-1, N_WORDS)


def _wide_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = np.arange(len(WIDE)) << 24
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            got = _matrix(part.column("fp")).view(np.uint8).astype(np.int32)[:, WIDE]
            key = numbers + (got[..., 0] << 16 | got[..., 1] << 8 | got[..., 2])
            ids = np.repeat(part.column("id").to_numpy(), len(WIDE))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int32)), pa.array(ids)], names=["key", "id"])


def wide_links(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which of ``many`` share enough positional bytes (tallied) with ``one``, and then differ in few enough bits."""
    x = many ^ one
    out = (x.view(np.uint8) == 0).sum(axis=1, dtype=np.int32) >= LEAST_WIDE
    out[out] = np.bitwise_count(x[out]).sum(axis=1, dtype=np.int32) <= MOST_WIDE
    return out


def wide_forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of all links; only members not yet reached are compared with a reached one."""
    left, front, out = np.arange(len(fps)), [], []
    while len(left):
        if not front:
            front, left = [left[0]], left[1:]
        v = front.pop()
        near = wide_links(fps[v], fps[left])
        new, left = left[near], left[~near]
        out += [(v, x) for x in new]
        front += list(new)
    return out


def _wide_verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for members in batch.column("members"):
            own = members.values
            for v, x in wide_forest(_matrix(own)):
                a.append(own[v].as_py())
                b.append(own[x].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def wide_candidate_links(distinct: DataFrame, block: int = WIDE_BLOCK) -> DataFrame:
    """``distinct(fp)`` -> ``(a, b)``: verified links, a spanning forest of each list's.

    Lists hold 64-bit ids; lists of equal members are verified once, and fingerprints meet them only then. Ids or
    list numbers that collide merge lists, which costs comparisons and changes no link.
    """
    own = distinct.select("fp", F.xxhash64("fp").alias("id"))
    index = own.mapInArrow(_wide_index, "key int, id long")
    long = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    of = F.ceil(F.col("n") / block).cast("int")
    dealt = index.join(long, "key").select("key", "id", of.alias("of"), F.pmod(F.shiftright("id", 20), of).cast("int").alias("block"))
    dealt = dealt.select("key", "id", "block", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other"))
    dealt = dealt.select("key", "id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    lists = dealt.groupBy("key", "i", "j").agg(F.array_sort(F.collect_set("id")).alias("ids")).where("size(ids) > 1")
    lists = lists.select("ids").distinct().select(F.xxhash64("ids").alias("list"), F.explode("ids").alias("id"))
    tasks = lists.join(own, "id").groupBy("list").agg(F.collect_set("fp").alias("members"))
    return tasks.select("members").mapInArrow(_wide_verified, "a binary, b binary")


def near_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text)``: 3-word shingles, 3 bits of 64."""
    return _grouped(docs.sparkSession, fingerprints(docs), lambda fps: candidate_links(fps, block), F.lower(F.lpad(F.hex("fp"), 16, "0")))


def similar_groups(docs: DataFrame, block: int = WIDE_BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text)``: 5-word shingles, similarity of about 0.8."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.encode("text", "UTF-8").alias("raw")).mapInArrow(_wide_fingerprints, f"doc_id {kind}, fp binary")
    return _grouped(docs.sparkSession, own, lambda fps: wide_candidate_links(fps, block), F.lower(F.hex("fp")))


def _grouped(spark: SparkSession, own: DataFrame, pairs: Callable[[DataFrame], DataFrame], digits: Column) -> DataFrame:
    scratch = Scratch(spark, "simhash")
    own = scratch.keep(own, "fingerprints")
    least = scratch.keep(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    label = components(pairs(least.select("fp")), scratch)
    member = least.join(label.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    smallest = member.groupBy("label").agg(F.min("least").alias("component_id"))
    member = member.join(smallest, "label").select("fp", "component_id")
    out = own.join(member, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")
    out = scratch.keep(out, "out")
    scratch.clear(out)
    return out
