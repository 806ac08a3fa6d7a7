"""The exact similarity join against all pairs."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lexmill.operators import joins


@pytest.mark.parametrize(("least", "band", "letters"), [(0.85, 3, "abcdeü"), (0.88, 2, "ab'c"), (0.6, 3, "aábc")])
def test_near_words_are_those_of_all_pairs(spark, monkeypatch, least, band, letters):
    rng = random.Random(int(least * 100))
    make = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12)))
    known = sorted({make() for _ in range(150)})
    words = sorted({make() for _ in range(60)} | {w[:k] + rng.choice(letters) + w[k:] for w in rng.sample(known, 60) for k in [rng.randrange(len(w) + 1)]})
    got = {(r.word, r.match): r.ratio for r in joins.near_words(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(k,) for k in known], "match string"), least, band).collect()}
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    want = {(a, b): ratio(a, b) for a in words for b in known if a[0] == b[0] and abs(len(a) - len(b)) <= band and ratio(a, b) >= least}
    assert got == want and len(got) > 20


def test_no_pair_below_the_bound_reaches_the_ratio(spark):
    """Pairs that the filters let through share enough characters for the ratio."""
    rng = random.Random(2)
    words = sorted({"a" + "".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(300)})
    df = lambda name: spark.createDataFrame([(w,) for w in words], f"{name} string")
    plan = joins.near_words(df("word"), df("match"), 0.85, 3)
    assert plan.count() >= len(words)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in text and text.index("ArrowEvalPython") < text.index("array_intersect")  # the count filter lies below the ratio
    shared = lambda a, b: sum((Counter(a) & Counter(b)).values())
    assert all(2 * shared(r.word, r.match) >= 0.85 * (len(r.word) + len(r.match)) - 1e-9 for r in plan.collect())


def test_bags(spark):
    got = {r.w: r.bag for r in joins.bags(spark.createDataFrame([("banana",), ("",), ("é'é",)], "w string"), "w", "an").collect()}
    assert got == {"banana": ["n0", "n1", "a0", "a1", "a2", "b0"], "": [], "é'é": ["'0", "é0", "é1"]} or sorted(got["banana"]) == ["a0", "a1", "a2", "b0", "n0", "n1"]


def test_words_of_two_letters_and_nulls(spark):
    words = spark.createDataFrame([("zo",), ("ab",), (None,), ("",)], "w string")
    known = spark.createDataFrame([("zo",), ("abc",), (None,), ("",)], "v string")
    got = sorted((r.word, r.match, r.step) for r in joins.fuzzy(words, "w", known, 0.8).collect())
    assert got == [("ab", "abc", "similar"), ("zo", "zo", "exact")]
    assert joins.fuzzy(words.limit(0), "w", known).count() == 0 and joins.fuzzy(words, "w", known.limit(0)).count() == 0
