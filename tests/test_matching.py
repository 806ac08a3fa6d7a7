"""Sequential matching and alignment against brute force, with long inputs and hot keys."""

import functools
import itertools
import random
import time
from math import ceil

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import matching as M


def free_points(spark, cases):
    """cases: {key: (targets, points)}"""
    t = spark.createDataFrame([(k, i, t) for k, (ts, _) in cases.items() for i, t in enumerate(ts)], "k int, i int, target long")
    p = spark.createDataFrame([(k, p) for k, (_, ps) in cases.items() for p in ps], "k int, point long")
    return {(r.k, r.i): r.point for r in M.nearest_unused(t.repartition(5), p.repartition(3), "k", "i", "target", "point").collect()}


def taken_by_hand(targets, points):
    free, out = list(points), []
    for t in targets:
        best = min(free, key=lambda p, t=t: (abs(p - t), p), default=None)
        if best is not None:
            free.remove(best)
        out.append(best)
    return out


def test_nearest_unused(spark):
    rng = random.Random(3)
    cases = {i: ([rng.randrange(50) for _ in range(rng.randrange(9))], [rng.randrange(50) for _ in range(rng.randrange(9))]) for i in range(60)}
    cases[60] = ([10, 11, 12], [11, 20])
    got = free_points(spark, cases)
    assert got == {(k, i): p for k, (ts, ps) in cases.items() for i, p in enumerate(taken_by_hand(ts, ps))}


def test_a_user_with_very_many_events(spark):
    """One key with all rows, in many batches; near-linear."""
    rng = random.Random(4)
    cases = {1: ([rng.randrange(10**9) for _ in range(20_000)], [rng.randrange(10**9) for _ in range(30_000)])}
    began = time.time()
    got = free_points(spark, cases)
    points = [got[1, i] for i in range(20_000)]
    assert len(set(points)) <= 20_000 and None not in points and time.time() - began < 60
    few = {1: (cases[1][0][:300], cases[1][1][:900])}
    got = free_points(spark, few)
    assert [got[1, i] for i in range(300)] == taken_by_hand(*few[1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=5), st.lists(st.integers(0, 1000), max_size=9, unique=True))
def test_boundaries_against_all_choices(targets, points):
    targets, points = np.array(sorted(targets), np.int64), np.array(sorted(points), np.int64)
    got = M.boundaries(targets, points).tolist()
    cost = lambda ps: sum((int(p) - int(t)) ** 2 for p, t in zip(ps, targets, strict=True))
    if len(points) >= len(targets):
        every = list(itertools.combinations(points.tolist(), len(targets)))
        assert cost(got) == min(map(cost, every)) and got == sorted(set(got))
    elif len(points):
        assert got == sorted(min(points.tolist(), key=lambda p, t=t: (abs(p - t), p)) for t in targets.tolist())
    else:
        assert got == targets.tolist()


def test_split_by_points(spark):
    sizes = spark.createDataFrame([(1, 0, 10), (1, 1, 10), (1, 2, 20), (2, 0, 5), (3, 0, 0), (3, 1, 0)], "k int, i int, n int")
    points = spark.createDataFrame([(1, p) for p in (900, 1500, 2100, 2100)] + [(2, 7)], "k int, p long")
    totals = spark.createDataFrame([(1, 4000), (2, 50), (3, 60), (4, 70)], "k int, total long")
    got = sorted(tuple(r) for r in M.split_by_points(sizes, points, totals, "k", "i", "n", "p", "total").collect())
    assert got == [(1, 0, 0, 900), (1, 1, 900, 2100), (1, 2, 2100, 4000), (2, 0, 0, 50), (3, 0, 0, 60)]
    rng = random.Random(1)
    many = M.boundaries(np.arange(1, 2001, dtype=np.int64) * 1000, np.array(sorted(rng.sample(range(2_100_000), 200_000)), np.int64))
    assert len(set(many.tolist())) == 2000 and np.abs(many - np.arange(1, 2001) * 1000).max() < 1000


def parts(spark, segments, points, most):
    s = spark.createDataFrame(segments, "k int, start_ms long, end_ms long, text string")
    p = spark.createDataFrame(points or [(-1, 0)], "k int, point long")
    out = {}
    for r in M.sub_split(s, p, "k", most).orderBy("k", "start_ms").collect():
        out.setdefault(r.k, []).append((r.start_ms, r.end_ms, r.text))
    return out


def test_sub_split(spark):
    got = parts(spark, [(1, 0, 1000, "a b"), (2, 0, 4000, "a b c d"), (3, 0, 4000, "a b c d"), (4, 500, 4500, None), (5, 0, 9000, " ")], [(3, 1000), (3, 2100)], 2.5)
    assert got[1] == [(0, 1000, "a b")] and got[2] == [(0, 2000, "a b"), (2000, 4000, "c d")]
    assert got[3] == [(0, 2100, "a b"), (2100, 4000, "c d")] and got[4] == [(500, 4500, None)] and got[5] == [(0, 9000, " ")]


def test_sub_split_keeps_words_and_time(spark):
    rng = random.Random(9)
    segments, points, want = [], [], {}
    for k in range(60):
        n_words, most, end = rng.randrange(1, 40), 20, rng.randrange(1000, 100_000)
        mine = rng.sample(range(1, end), min(rng.randrange(9), end - 1))
        segments.append((k, 0, end, " ".join(f"w{i}" for i in range(n_words))))
        points += [(k, p) for p in mine]
        n = 1 if end <= most * 1000 else max(2, ceil(end / 1000 / (most * 0.8)))
        targets = [int(i * (end / n)) for i in range(1, n)]
        want[k] = sorted(taken_by_hand(targets, mine) if len(mine) >= n - 1 else targets)
    got = parts(spark, segments, points, 20)
    for k, _, end, text in segments:
        assert " ".join(p[2] for p in got[k]).split() == text.split() and got[k][-1][1] == end
        assert {p[0] for p in got[k][1:]} <= {0, *want[k]} and all(a[1] <= b[0] for a, b in zip(got[k], got[k][1:], strict=False))


def cells(heard, target):
    """The alignment cell by cell, with its tie order."""
    n, m = len(heard), len(target)
    cost = [[j * M.SKIP_TARGET if not i else i * M.SKIP_HEARD for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + M.sound_cost(heard[i - 1], target[j - 1]), cost[i - 1][j] + M.SKIP_HEARD, cost[i][j - 1] + M.SKIP_TARGET)
    out, i, j = [], n, m
    while i and j:
        if cost[i][j] == cost[i - 1][j - 1] + M.sound_cost(heard[i - 1], target[j - 1]):
            i, j = i - 1, j - 1
            out.append((j, i))
        elif cost[i][j] == cost[i - 1][j] + M.SKIP_HEARD:
            i -= 1
        else:
            j -= 1
    return out[::-1]


@settings(max_examples=80, deadline=None)
@given(st.text("aszplnmk", max_size=40), st.text("aeszpktlr", max_size=40))
def test_warp_equals_cell_by_cell(heard, target):
    assert M.warp(heard, target) == cells(heard, target)


def test_warp_of_strings_longer_than_the_first_band():
    rng = random.Random(7)
    for _ in range(6):
        target = "".join(rng.choice("aeioszplnmrtk") for _ in range(rng.randrange(150, 400)))
        heard = "".join(c for c in target if rng.random() > 0.2)[: rng.randrange(100, 400)] + "z" * rng.randrange(200)
        assert M.warp(heard, target) == cells(heard, target)


def test_warp_of_very_long_strings():
    rng, began = random.Random(2), time.process_time()
    target = "".join(rng.choice("aeioszplnmrtk") for _ in range(20_000))
    heard = "".join(c if rng.random() > 0.1 else rng.choice("aez") for c in target if rng.random() > 0.05)
    pairs = M.warp(heard, target)
    assert len(pairs) > 18_000 and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:], strict=False)) and time.process_time() - began < 60
    assert sum(target[t] == heard[s] for t, s in pairs) > 0.85 * len(pairs)


def test_word_bounds(spark):
    df = spark.createDataFrame([(1, ["ab", "", "c"], [(0, 3), (1, 5)]), (2, ["x"], [])], "k int, words array<string>, pairs array<struct<t:int,s:int>>")
    got = sorted((r.k, r.word_no, r.word, r.first_char, r.last_char) for r in M.word_bounds(df, "k", "words", "pairs").collect())
    assert got == [(1, 0, "ab", 3, 5), (1, 1, "", None, None), (1, 2, "c", None, None), (2, 0, "x", None, None)]


def lcs_by_hand(a, b):
    @functools.cache
    def at(i, j):
        return 0 if not i or not j else max(at(i - 1, j), at(i, j - 1), at(i - 1, j - 1) + 1 if a[i - 1] == b[j - 1] else 0)

    return at(len(a), len(b))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), max_size=70), st.lists(st.sampled_from("abcdefgh"), max_size=70))
def test_common_subsequence_by_bits(a, b):
    assert X.lcs_length(a, b) == lcs_by_hand(tuple(a), tuple(b))


def test_common_subsequence_of_whole_texts(spark):
    rng, began = random.Random(5), time.process_time()
    a = rng.choices([f"w{i}" for i in range(3000)], k=20_000)
    b = [w for w in a if rng.random() > 0.3]
    assert X.lcs_length(a, b) == len(b) and X.lcs_length(["x"] * 9000, ["x"] * 20_000) == 9000 and time.process_time() - began < 40
    row = [0] * 901
    for w in a[:800]:  # plain rows
        new = [0]
        for j, v in enumerate(b[300:1200], 1):
            new.append(row[j - 1] + 1 if v == w else max(row[j], new[-1]))
        row = new
    assert X.lcs_length(a[:800], b[300:1200]) == row[-1]
    df = spark.createDataFrame([(["a", "b"], ["b"]), (None, ["a"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r.n for r in df.select(X.common_subsequence(F.col("a"), F.col("b")).alias("n")).collect()] == [1, None, 0]
