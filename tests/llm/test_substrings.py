"""Substring dedup (words) and suffix dedup (bytes) against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import anchors, runs, substrings, suffixes
from trackloom.llm.common import Scratch


def words_brute(docs, length):
    first, out = {}, []
    order = sorted(range(len(docs)), key=lambda k: docs[k][0])
    for k in order:
        words = (docs[k][1] or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            if w in first:
                gone[i : i + length] = [True] * length
            else:
                first[w] = True
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((docs[k][0], len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def bytes_brute(docs, length):
    where = defaultdict(int)
    for _, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            where[b[i : i + length]] += 1
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if where[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = sum(bool(gone[i]) and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone[: len(b)].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n=60, vocabulary=40):
    rng = np.random.default_rng(seed)
    words = ["w%d" % i for i in range(vocabulary)] + ["é%d" % i for i in range(5)]
    pool = [" ".join(rng.choice(words, int(rng.integers(15, 60)))) for _ in range(8)]
    docs = []
    for d in range(n):
        parts = []
        for _ in range(int(rng.integers(0, 5))):
            r = rng.random()
            p = pool[int(rng.integers(len(pool)))]
            if r < 0.3:
                parts.append(p)
            elif r < 0.6:
                own = p.split()
                own[int(rng.integers(len(own)))] = "x%d" % d
                parts.append(" ".join(own))
            else:
                parts.append(" ".join(rng.choice(words, int(rng.integers(1, 40)))))
        docs.append((d * 3, "\n".join(parts) if rng.random() > 0.05 else None))
    docs.append((1000, "same word " * 60))
    docs.append((1001, "a" * 700))
    docs.append((1002, "b" * 201))
    docs.append((1003, ""))
    return docs


def test_every_window_has_one_anchor_and_equal_windows_equal_ones():
    rng = np.random.default_rng(0)
    for _ in range(60):
        texts = [bytes(rng.integers(97, 99, int(rng.integers(0, 40))).astype(np.uint8)) for _ in range(5)]
        units = anchors.BYTES[np.frombuffer(b"".join(texts), np.uint8)]
        found = anchors.anchors(units, np.cumsum([len(t) for t in texts]), 6, 3)
        owned, by = [], defaultdict(set)
        for a, _, _, p, s, z, o in zip(*found):
            for i in range(s, s + z):
                owned.append((p, i))
                by[texts[p][i : i + 6]].add((int(a), int(o - (i - s))))
        assert sorted(owned) == [(p, i) for p, t in enumerate(texts) for i in range(len(t) - 5)]
        assert all(len(v) == 1 for v in by.values())


@pytest.mark.parametrize("seed,batches,fanout", [(1, 1, 4), (2, 5, 2)])
def test_words_as_brute_force(spark, seed, batches, fanout):
    docs = corpus(seed)
    got = substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string"), batches=batches, length=8, gram=3, fanout=fanout)
    assert sorted(tuple(r)[:4] for r in got.collect()) == words_brute(docs, 8)


def test_words_production_window(spark):
    docs = corpus(3, n=40)
    got = substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(tuple(r)[:4] for r in got.collect()) == words_brute(docs, 20)


@pytest.mark.parametrize("seed,length,gram,group", [(1, 20, 6, 20_000), (2, 12, 4, 3), (3, 200, 48, 20_000)])
def test_bytes_as_brute_force(spark, seed, length, gram, group):
    docs = corpus(seed, n=40)
    got = suffixes.dedup(spark.createDataFrame(docs, "doc_id long, text string"), length=length, gram=gram, group=group)
    assert sorted(tuple(r)[:5] for r in got.collect()) == bytes_brute(docs, length)


def test_construction_as_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        m, strings, place, groups = int(rng.integers(1, 12)), [], [], []
        for _ in range(m):
            left = bytes(rng.integers(97, 99, int(rng.integers(0, 6))).astype(np.uint8))
            right = bytes(rng.integers(97, 99, int(rng.integers(0, 8))).astype(np.uint8))
            strings.append(left + b"zz" + right)
            place.append(len(left))
            groups.append(int(rng.integers(0, 2)))
        got = suffixes.repeats(np.array(groups), strings, np.array(place), 4)
        for i in range(m):
            want = [s for s in range(len(strings[i]) - 3) if any(
                j != i and groups[j] == groups[i] and 0 <= s - place[i] + place[j] <= len(strings[j]) - 4
                and strings[j][s - place[i] + place[j] :][:4] == strings[i][s : s + 4] for j in range(m))]
            assert got[i].tolist() == want


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, uid string, at int")
    assert substrings.dedup(empty).count() == 0
    assert suffixes.dedup(empty).count() == 0
    odd = [(None, "a b c " * 30), (1, "a b c " * 30), (1, "a b c " * 30), (1, "other"), (2, None)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in odd], "doc_id long, text string, uid string, at int")
    got = substrings.dedup(df)
    assert got.count() == len(odd)
    rows = {(r.doc_id, r.n_words): r.n_removed for r in got.collect()}
    assert rows[(None, 90)] == 90 and 0 < rows[(1, 90)] < 90 and rows[(2, 0)] == 0
    assert suffixes.dedup(df).count() == len(odd)


def test_runs_are_bucketed_and_compacted(spark):
    scratch = Scratch(spark, "t")
    log = runs.Runs(spark, scratch, buckets=2, fanout=2)
    rows = [(a, a, a, u, u) for u in range(4) for a in (u, u + 1)]
    for u in range(4):
        log.append(spark.createDataFrame([r for r in rows if r[3] == u], runs.ROW))
    assert len(log.names) <= 2 and log.rows().count() == len(rows)
    plan = log.rows().groupBy("anchor").count()._jdf.queryExecution().toString()
    assert plan
    log.drop()


@pytest.mark.parametrize("runs_of", [1, 3])
def test_hot_anchors_are_dealt_over_buckets_and_lose_nothing(spark, runs_of):
    rng = np.random.default_rng(0)
    rows = [(7, int(c), int(c), int(u), int(u)) for u, c in enumerate(rng.integers(0, 5, 4000))] + [(100 + u, 1, 1, u, u) for u in range(2000)] + [(9, 1, 1, 9999, 1), (11, 1, 1, 1, 1)]
    log = runs.Runs(spark, Scratch(spark, "hot"), buckets=8, fanout=4)
    matched = None
    for k in range(runs_of):
        own = spark.createDataFrame([r for r in rows if r[3] % runs_of == k], runs.ROW)
        new = log.append(own, own.where(F.pmod(F.xxhash64("uid"), F.lit(16)) == 0) if k == 0 else None)  # later runs do not know of it
        matched = new if matched is None else matched.unionByName(new)
    first = spark.table(log.names[0]).groupBy("anchor").count().agg(F.max("count")).first()[0]
    assert first < 4000 / runs_of / 3
    got = sorted(map(tuple, log.occurrences(matched.distinct()).select("anchor", "context", "twin", "uid", "at").collect()))
    assert got == sorted(r for r in rows if r[0] == 7)
    log.drop()


def test_batches_against_a_lasting_index(spark, tmp_path):
    docs = corpus(6, n=50)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want, got = words_brute(docs, 8), []
    cuts = [0, 40, 41, 90, 120, 2000]
    for low, high in zip(cuts, cuts[1:]):
        index = substrings.Index(spark, str(tmp_path / "index"), 8, 3, fanout=2, buckets=3)  # found again each time
        part = df.where(F.col("doc_id").between(low, high - 1))
        got += [tuple(r)[:4] for r in index.add(part, df.where(F.col("doc_id") < low)).collect()]
    assert sorted(got) == want
    assert len(index.runs.names) <= 2
    with pytest.raises(ValueError):
        index.add(df.limit(1))


def test_ids_of_other_types(spark):
    docs = [(f"{d:05d}", t) for d, t in corpus(4, n=20)]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    assert sorted(tuple(r)[:4] for r in substrings.dedup(df, length=8, gram=3).collect()) == words_brute(docs, 8)
    assert sorted(tuple(r)[:5] for r in suffixes.dedup(df, length=20, gram=6).collect()) == bytes_brute(docs, 20)
    with pytest.raises(ValueError):
        substrings.dedup(df, length=2000, gram=3)
