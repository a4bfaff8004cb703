"""Near copies by five-word shingles: fingerprints, links and groups against slow versions."""

import random

import numpy as np
import pytest
import xxhash

from trackloom.llm import simhash


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)}


def slow_fingerprint(text):
    words = text.lower().split()
    if not words:
        return bytes(128)
    parts = shingles(text) or {" ".join(words)}
    ones = [0] * 1024
    for s in parts:
        h = int.from_bytes(xxhash.xxh64_digest(s.encode(), 42), "little")
        for k in range(16):
            x = (h + (k + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
            x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
            x ^= x >> 31
            for b in range(64):
                ones[64 * k + b] += x >> b & 1
    return b"".join(sum((2 * ones[64 * k + b] > len(parts)) << b for b in range(64)).to_bytes(8, "little") for k in range(16))


@pytest.mark.parametrize("n", [0, 1, 4, 5, 9, 300, 1100])
def test_fingerprint_as_bit_by_bit(n):
    rng = random.Random(n)
    text = " ".join(f"W{rng.randrange(10 ** 6)}" for _ in range(n))
    assert simhash.wide_fingerprint(text.encode()) == slow_fingerprint(text)


def family(rng, n, words, edits):
    """A text and ``n`` copies with some words replaced."""
    first = [f"w{rng.randrange(10 ** 9)}" for _ in range(words)]
    out = [" ".join(first)]
    for _ in range(n):
        own = list(first)
        for at in rng.sample(range(words), edits):
            own[at] = f"w{rng.randrange(10 ** 9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [3, 8192])
def test_groups_hold_similar_texts_and_no_others(spark, block):
    rng = random.Random(7)
    near = [family(rng, 3, 400, 4) for _ in range(20)]  # five-word similarity of 0.9
    far = [family(rng, 1, 200, 24) for _ in range(20)]  # about 0.3
    rows = [(f * 10 + k, t) for f, part in enumerate(near + far) for k, t in enumerate(part)]
    rows += [(1000, near[0][0]), (1001, None), (1002, "  "), (1003, "one two"), (1003, "one two")]
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), block).collect()
    label = {r.doc_id: r.component_id for r in got}
    assert len(got) == len(rows)
    for f in range(40):
        want = [f * 10] * 4 if f < 20 else [f * 10, f * 10 + 1]
        assert [label[f * 10 + k] for k in range(len(want))] == want
    assert label[1000] == 0 and label[1001] == label[1002] == 1001 and label[1003] == 1003


def test_forest_keeps_the_components_of_all_links():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, (4, 16), dtype=np.int64).view(np.uint64)
    fps = []
    for k in range(80):
        bits = np.zeros(1024, np.uint8)
        bits[rng.choice(1024, int(rng.integers(0, 140)), replace=False)] = 1
        fps.append(centre[k % 4] ^ np.packbits(bits).view(np.uint64))
    fps = np.array(fps)
    near = np.array([simhash.wide_links(x, fps) for x in fps])
    label = np.arange(80)
    for _ in range(80):
        label = np.where(near, label[None, :], 80).min(axis=1)
    forest = np.arange(80)
    for _ in range(80):
        for a, b in simhash.wide_forest(fps):
            forest[a] = forest[b] = min(forest[a], forest[b])
    assert (forest == label).all()


def test_empty_table(spark):
    assert simhash.similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
