"""The language model of the quality rules: full alphabet, one order, whatever its size."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trackloom.llm import charmodel, quality
from trackloom.llm.common import Scratch


def slow_perplexity(texts):
    """Modified Kneser-Ney of order 4 over code points, from dictionaries; nats of each text."""
    split = lambda t: "\0\0\0" + t
    tables = {4: Counter(s[i : i + 4] for s in map(split, texts) for i in range(len(s) - 3))}
    for k in (3, 2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    cut, heads = {}, {}
    for k, c in tables.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        cut[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0), i) if n[i - 1] else 0 for i in (1, 2, 3)]
        heads[k] = defaultdict(list)
        for g, v in c.items():
            heads[k][g[:-1]].append(v)

    def p(g):
        if not g:
            return 1 / len(tables[1])
        k, less = len(g), lambda v: cut[len(g)][min(v, 3) - 1]
        own = heads[k][g[:-1]]
        return max(tables[k][g] - less(tables[k][g]), 0) / sum(own) + sum(map(less, own)) / sum(own) * p(g[1:])

    return [-sum(math.log(p(s[i : i + 4])) for i in range(len(s) - 3)) for s in map(split, texts)]


BY_LANG = {"ru": ["мама мыла раму", "рама мыла маму", "мимо мамы", "ё" * 30], "en": ["abracadabra", "a cab", "bad dab!", "ab ab ab"], None: ["中文字符", "文字中文 zz"]}


@pytest.fixture(scope="module")
def rows(spark):
    flat = [(lang, t) for lang, texts in BY_LANG.items() for t in texts] + [("ru", ""), ("ru", None), ("en", "a cab")]
    return spark.createDataFrame([(i, *x) for i, x in enumerate(flat)], "id long, lang string, text string")


@pytest.mark.parametrize("most", [charmodel.MOST, 40])
def test_full_alphabet_and_one_order_at_every_size(spark, rows, most):
    got = {r.id: r for r in quality.graded(rows, Scratch(spark, "t"), most).collect()}
    own = {**BY_LANG, "en": [*BY_LANG["en"], "a cab"]}
    want = {(lang, t): x for lang, texts in own.items() for t, x in zip(texts, slow_perplexity(texts))}
    assert len(got) == rows.count()
    for r in rows.collect():
        if r.text:
            assert got[r.id].nats == pytest.approx(want[r.lang, r.text], abs=1e-4)
            assert got[r.id].log_perplexity == pytest.approx(got[r.id].nats / len(r.text))
        else:
            assert got[r.id].nats is None and got[r.id].log_perplexity is None


def test_number_of_arrays_changes_nothing(spark, rows):
    one, many = (sorted(map(str, quality.graded(rows, Scratch(spark, "t"), m).collect())) for m in (charmodel.MOST, 7))
    assert one == many


def test_code_points_are_told_apart(spark):
    """Characters 21 code points apart were one class of the earlier model."""
    usual, odd = "абвгде ёжзи " * 40, "".join(chr(ord(c) + 21) if ord(c) > 127 else c for c in "абвгде ёжзи " * 1)
    df = spark.createDataFrame([*((i, "ru", usual) for i in range(20)), (99, "ru", odd)], "id long, lang string, text string")
    got = {r.id: r.log_perplexity for r in quality.assess(df).collect()}
    assert got[99] > 2 * got[0]
