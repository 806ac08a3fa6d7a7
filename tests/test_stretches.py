"""Scans by stretches give what windows over whole keys give, with one key that holds nearly all rows."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lexmill.operators import sequences as S, stats
from lexmill.operators.stretches import Ordered


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(11)
    rows = [(rng.choice([1, 1, 1, 1, 1, 2, None]), i, rng.choice([None, rng.randrange(20)]), rng.choice("abbb"), rng.random() < 0.5) for i in range(900)]
    rows += [(3, 5000, None, "a", None), (4, 5001, 3, "b", True)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k int, t int, v int, s string, f boolean").repartition(6)


def same(make, frame, spark):
    """Few rows a stretch, many partitions; and the hot key is dealt to several of them."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, want = (sorted(map(str, make(frame, most).collect())) for most in (0, 10**9))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want and got
    return got


def test_the_hot_key_lies_in_many_stretches(spark, frame):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = Ordered(frame, ["k"], ["t"], 0).rows
        assert rows.where("k = 1").select("_s").distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_every_kind_of_scan(spark, frame):
    v = F.col("v")
    make = lambda df, most: Ordered(df, ["k"], ["t"], most).scan(a=("sum", v), b=("total", v), c=("last", v), d=("next", v), e=("lag", v), f1=("lead", v), g=("first_row", v), h=("sum", F.lit(1))).done("k", "t", "v", "a", "b", "c", "d", "e", "f1", "g", "h")
    same(make, frame, spark)


@pytest.mark.parametrize("make", [
    lambda df, most: S.fill_gaps(df, ["k"], ["t"], "v", most),
    lambda df, most: S.islands(df, ["k"], ["t"], F.col("f"), 2, most=most),
    lambda df, most: S.islands(df, ["k"], ["t"], F.col("f"), 1, keep_open=False, most=most),
    lambda df, most: S.islands(df, ["k"], ["t"], F.col("t") < 4000, 1, most=most),  # one run through all stretches
    lambda df, most: S.collapse_repeats(df, ["k"], ["t"], "s", "a", most),
    lambda df, most: S.adjacent(df, ["k"], ["t"], "s", most),
    lambda df, most: S.consumed_pairs(df, ["k"], ["t"], "t", F.col("s") == "b", F.col("s") == "b", most),
    lambda df, most: S.carry_forward(df, ["k"], ["t"], F.when(F.col("s") == "a", F.col("t")), "h", most),
    lambda df, most: S.proportional_targets(df.where("v is not null"), ["k"], ["t"], "v", F.lit(1000.0), most),
    lambda df, most: stats.upper_median(df, ["k"], "v", most),
    lambda df, most: S.fill_spans(df.withColumn("z", F.col("v") + 1), ["k"], ["t"], "v", "z", most).selectExpr("k", "t", "round(filled_start, 6) as a", "round(filled_end, 6) as z"),
])
def test_operators(spark, frame, make):
    same(make, frame, spark)


def test_fill_spans_step_by_step(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, None, 10 * i + 1]), rng.choice([None, 10 * i + 5])) for k in range(12) for i in range(1, 15)]
    got = {(r.k, r.i): (r.filled_start, r.filled_end) for r in S.fill_spans(spark.createDataFrame(rows, "k int, i int, a int, z int"), ["k"], ["i"], "a", "z").collect()}
    for k in range(12):
        mine, last = [r for r in rows if r[0] == k], Fraction(0)
        for n, (_, i, a, z) in enumerate(mine):
            later = next((x[2] for x in mine[n + 1 :] if x[2] is not None), None)
            start = Fraction(a) if a is not None else last
            last = Fraction(z) if z is not None else start + (later - start) / 2 if later is not None else start
            assert got[k, i] == pytest.approx((float(start), float(last)))
    named = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, None, None), (1, 3, 3.0, 4.0)], "k int, i int, a double, z double")
    assert [(r.filled_start, r.filled_end) for r in S.fill_spans(named, ["k"], ["i"], "a", "z").orderBy("i").collect()] == [(0.0, 1.0), (1.0, 2.0), (3.0, 4.0)]


def test_upper_median_by_sorting(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(30)) for k in range(9) for _ in range(rng.randrange(1, 40))] + [(1, None)]
    got = {r.k: r.upper_median for r in stats.upper_median(spark.createDataFrame(rows, "k int, v int"), ["k"], "v").collect()}
    for k in range(9):
        of = sorted(v for x, v in rows if x == k and v is not None)
        assert got[k] == of[len(of) // 2]
